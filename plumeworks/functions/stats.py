"""Deltas, rates and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_delta(current: Column, previous: Column) -> Column:
    """Change in percent, one place; from nothing it is 0 or 100."""
    change = F.round((current - previous) * 100.0 / F.when(previous != 0, previous), 1)
    return F.when(previous == 0, F.when(current == 0, 0.0).otherwise(100.0)).otherwise(change)


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 over nothing."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def rank_of(n: Column, percent: float) -> Column:
    """The rounded rank of a percentile among n values (halves to even), from 1 to n."""
    return F.least(n, F.greatest(F.lit(1), F.bround(percent / 100 * n).cast("int")))


def nearest_rank(ascending: Column, percent: float) -> Column:
    """The element of an ascending array at the rounded rank (halves to even), 0 for an empty one."""
    n = F.size(ascending)
    rank = rank_of(n, percent)
    return F.when(n > 0, F.element_at(ascending, F.greatest(rank, F.lit(1)))).otherwise(F.lit(0.0))


def confusion_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall and their kin, each 0 on an empty denominator and at 6 places."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    total = tp + fp + fn + tn
    found = {
        "precision_": p,
        "recall_": r,
        "f1": ratio(2 * p * r, p + r),
        "iou": ratio(tp, tp + fp + fn),
        "dice": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": (tp + tn).cast("double") / F.greatest(total, F.lit(1)),
        "positive_rate": (tp + fn).cast("double") / F.greatest(total, F.lit(1)),
    }
    return {k: F.round(v, 6) for k, v in found.items()}
