"""Evaluation of scores against truth, and audits of datasets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..functions.stats import confusion_rates, rank_of, ratio
from .masks import labelled

# Fixed values of the sweep.
THRESHOLDS = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)


def _cells(threshold: Column) -> list[Column]:
    hit, truth = F.col("p") >= threshold, F.col("y") >= 0.5
    return [F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"), F.count_if(~hit & ~truth).alias("tn")]


def _rates() -> dict[str, Column]:
    return confusion_rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))


def confusion(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    got = pairs.agg(*_cells(F.lit(threshold)))
    return got.select("*", *(v.alias(k) for k, v in _rates().items()))


def macro_dice(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The mean over items of their dice, which is 1 for an item with nothing to find and nothing found."""
    each = pairs.groupBy("item").agg(*_cells(F.lit(threshold)))
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    dice = F.when(bottom == 0, 1.0).otherwise(2.0 * F.col("tp") / F.when(bottom > 0, bottom))
    return each.agg(F.count("*").alias("items"), F.round(F.avg(dice), 6).alias("macro_dice"))


def threshold_sweep(pairs: DataFrame) -> DataFrame:
    """Rates at all thresholds from one scan, each row counted for every threshold within one pass."""
    got = pairs.agg(*(c.alias(f"{n}_{i}") for i, t in enumerate(THRESHOLDS) for n, c in zip(("tp", "fp", "fn", "tn"), _cells(F.lit(t)), strict=True)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(THRESHOLDS)))
    got = got.select(F.explode(rows).alias("r")).select("r.*")
    return got.select("*", *(v.alias(k) for k, v in _rates().items()))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest f1, then iou; the first wins ties."""
    return sweep.orderBy(F.desc("f1"), F.desc("iou"), "threshold").limit(1)


def group_report(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rates by label, negatives by kind; overlap rates only where there is something to overlap."""
    group = F.when(F.col("label") == "negative", F.concat(F.lit("negative:"), F.coalesce("negative_kind", F.lit("unknown")))).otherwise(F.col("label"))
    got = pairs.groupBy(group.alias("group_name")).agg(*_cells(F.lit(threshold)))
    some = F.col("tp") + F.col("fn") > 0
    r = _rates()
    fpr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return got.select("*", F.when(some, r["dice"]).alias("dice"), F.when(some, r["iou"]).alias("iou"), F.round(fpr, 6).alias("false_positive_rate"))


def dataset_audit(docs: DataFrame) -> DataFrame:
    """Counts and mean sizes by label, by kind and over all, from one scan by grouping sets."""
    return docs.groupingSets([["label"], ["negative_kind"], []], "label", "negative_kind").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p")
    )


def latency_report(samples: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of measured samples and errors of all, by endpoint.

    Equal samples are counted, and counts are summed over buckets of nearly equal samples first. Only the
    buckets that hold a wanted rank are put in order, so that no endpoint's samples meet in one place.
    """
    totals = samples.groupBy("endpoint").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(F.col("measured") & F.col("elapsed").isNotNull()).alias("m"))
    bucket = F.when(F.col("elapsed") > 0, F.floor(F.log2("elapsed") * 256)).otherwise(F.lit(-(1 << 40)))
    values = samples.where("measured and elapsed is not null").groupBy("endpoint", "elapsed").agg(F.count("*").alias("c")).withColumn("bucket", bucket)
    buckets = values.groupBy("endpoint", "bucket").agg(F.sum("c").alias("b"))
    buckets = buckets.withColumn("before", F.sum("b").over(Window.partitionBy("endpoint").orderBy("bucket")) - F.col("b"))
    ranks = F.array(*(F.struct(F.lit(q).alias("q"), rank_of(F.col("m"), q).cast("bigint").alias("rank")) for q in (50, 95, 100)))
    wanted = totals.select("endpoint", F.explode(ranks).alias("r")).select("endpoint", "r.*")
    hits = buckets.join(wanted, "endpoint").where("before < rank and rank <= before + b").select("endpoint", "bucket", "q", (F.col("rank") - F.col("before")).alias("rest"))
    inside = values.join(hits.select("endpoint", "bucket").distinct(), ["endpoint", "bucket"], "left_semi")
    inside = inside.withColumn("up_to", F.sum("c").over(Window.partitionBy("endpoint", "bucket").orderBy("elapsed")))
    found = hits.join(inside, ["endpoint", "bucket"]).where("up_to >= rest").groupBy("endpoint").agg(*(F.min(F.when(F.col("q") == q, F.col("elapsed"))).alias(f"e{q}") for q in (50, 95, 100)))
    at = {q: F.round(F.coalesce(f"e{q}", F.lit(0.0)), 6) for q in (50, 95, 100)}
    got = totals.join(found, "endpoint", "left").select("endpoint", "n", "errors", at[50].alias("p50"), at[95].alias("p95"), at[100].alias("max_elapsed"))
    return got.withColumn("passed", (F.col("errors") == 0) & (F.col("p95") <= 2.0))


def expected_smoke(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("smoking") | low.contains("smoke"), True).when(low.contains("clean"), False)


def selftest(results: DataFrame, max_false_alarms: float = 0.10, max_image_s: float = 10.0, min_fps: float = 5.0) -> DataFrame:
    """Verdicts by media kind: false alarms on clean clips, image seconds and video rates."""
    expect = expected_smoke(F.col("filename"))
    got = results.groupBy("media_type").agg(
        F.count_if(expect == F.lit(False)).alias("clean"), F.count_if((expect == F.lit(False)) & F.col("found")).alias("false_alarms"), F.count_if((expect == F.lit(True)) & F.col("found")).alias("caught"), F.round(F.max("elapsed"), 6).alias("slowest"), F.round(F.sum("frames") / F.sum("elapsed"), 6).alias("fps")
    )
    rate = ratio(F.col("false_alarms"), F.col("clean"))
    fast = F.when(F.col("media_type") == "image", F.col("slowest") < max_image_s).otherwise(F.col("fps") >= min_fps)
    return got.select("*", F.round(rate, 6).alias("false_alarm_rate"), ((rate <= max_false_alarms) & fast).alias("passed"))


def mask_confidence(mask: Column, threshold: float) -> Column:
    """The mean of a mask's values that reach the threshold, 0 for none."""
    above = F.filter(mask, lambda v: v >= threshold)
    return F.when(F.size(above) > 0, F.aggregate(above, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.when(F.size(above) > 0, F.size(above))).otherwise(0.0)


def dominant_severity(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by("severity", F.struct(severity_rank(F.col("severity")), "severity")).alias("dominant"))


def component_features(masks: DataFrame, key: str, column: str, side: int, threshold: float) -> DataFrame:
    """Pixels of the largest 8-connected component of square masks, and the compactness of the largest contour."""

    def fold(batches):
        for part in batches:
            rows = []
            for k, m in zip(part[key], part[column], strict=True):
                on = np.asarray(m, float).reshape(side, side) >= threshold
                rows.append((k, *largest_component(on)))
            yield pd.DataFrame(rows, columns=[key, "pixels", "compactness"])

    kind = masks.schema[key].dataType.simpleString()
    return masks.select(key, column).mapInPandas(fold, f"{key} {kind}, pixels int, compactness double")


_AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # clockwise from the left


def components_of(on: np.ndarray) -> list[set[tuple[int, int]]]:
    """The 8-connected components of a mask, in the order of their first pixels."""
    label = labelled(on)
    row, column = np.nonzero(label)
    order = np.argsort(label[row, column], kind="stable")
    cells = list(zip(row[order].tolist(), column[order].tolist(), strict=True))
    ends = np.bincount(label[row, column], minlength=1)[1:].cumsum().tolist()
    return [set(cells[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def outer_border(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pixels met on a walk around a component, counter-clockwise from its first pixel; thin parts are met twice."""
    first = min(cells)
    ring = lambda p, k: (p[0] + _AROUND[k % 8][0], p[1] + _AROUND[k % 8][1])
    last = next((q for k in range(8) if (q := ring(first, k)) in cells), None)
    if last is None:
        return [first]
    walk, at, back = [first], first, last
    while True:
        from_ = next(k for k in range(8) if ring(at, k) == back)
        ahead = next(q for k in range(from_ - 1, from_ - 9, -1) if (q := ring(at, k)) in cells)
        if ahead == first and at == last:
            return walk
        walk.append(ahead)
        at, back = ahead, at


def contour(cells: set[tuple[int, int]]) -> tuple[float, float]:
    """Area and length of the polygon through the centres of a component's border pixels."""
    walk = outer_border(cells)
    steps = list(zip(walk, [*walk[1:], walk[0]], strict=True))
    area = abs(sum(b * c - a * d for (a, b), (c, d) in steps)) / 2
    return area, sum(math.hypot(a - c, b - d) for (a, b), (c, d) in steps)


def largest_component(on: np.ndarray) -> tuple[int, float]:
    """Pixels of the largest component, and 4 pi A / P^2 of the contour that encloses most, in [0, 1].

    A contour without area, of a single pixel or a line, has 0. Of equal contours the last one counts.
    """
    found = components_of(on)
    if not found:
        return 0, 0.0
    area, length = max(map(contour, reversed(found)), key=lambda x: x[0])
    return max(map(len, found)), round(min(1.0, 4 * math.pi * area / length**2), 6) if area > 0 else 0.0


def early_stop(history: DataFrame, patience: int, margin: float = 1e-4) -> DataFrame:
    """The epoch at which training stops and its best one, by folding each run's scores in order."""
    scores = F.array_sort(F.collect_list(F.struct("epoch", "dice")))
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(0).alias("waited"), F.lit(-1).alias("stopped"))

    def step(a: Column, x: Column) -> Column:
        on, better = a["stopped"] < 0, x["dice"] > a["best"] + margin
        waited = F.when(better, F.lit(0)).otherwise(a["waited"] + 1)
        new = F.struct(F.when(better, x["dice"]).otherwise(a["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(a["best_epoch"]).alias("best_epoch"), waited.alias("waited"), F.when(waited >= patience, x["epoch"]).otherwise(F.lit(-1)).alias("stopped"))
        return F.when(on, new).otherwise(a)

    got = history.groupBy("run_id").agg(F.aggregate(scores, start, step).alias("r"))
    return got.select("run_id", F.col("r.best").alias("best"), F.col("r.best_epoch").alias("best_epoch"), F.when(F.col("r.stopped") >= 0, F.col("r.stopped")).alias("stopped"))


def best_candidate(candidates: DataFrame, by: str, rank: Column | None = None) -> DataFrame:
    """The candidate with the highest rank of each group, of several the first, and the group's highest score; the rank is the score if none is given."""
    order = F.struct((F.col("score") if rank is None else rank).alias("rank"), -F.col("candidate"))
    return candidates.groupBy(by).agg(F.max_by("candidate", order).alias("candidate"), F.max("score").alias("score"))


def otsu(values: np.ndarray) -> int:
    """The grey level that best parts a histogram in two, the first of equals."""
    hist = np.bincount(values, minlength=256).astype(float)
    n, mass = hist.cumsum(), (hist * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (mass[-1] * n / n[-1] - mass) ** 2 / (n * (n[-1] - n))
    return int(np.nan_to_num(spread, nan=-1.0, posinf=-1.0).argmax())


def shadow_score(values: np.ndarray) -> float:
    """How much a crop looks like a shadow on a bright ground: the parts' separation, less for small dark parts.

    What lies strictly below the level is dark, so a crop of two levels has no dark part.
    """
    dark = values < otsu(values)
    share = float(dark.mean())
    if not 0.08 <= share <= 0.75:
        return 0.0
    return (float(values[~dark].mean()) - float(values[dark].mean())) * min(share / 0.35, 1.0)


def shadow_scores(crops: DataFrame, key: str, column: str) -> DataFrame:
    """Scores of crops given as arrays of grey levels from 0 to 255."""

    def fold(batches):
        for part in batches:
            yield pd.DataFrame({key: part[key], "score": [round(shadow_score(np.asarray(v, np.int64)), 6) for v in part[column]]})

    return crops.select(key, column).mapInPandas(fold, f"{key} {crops.schema[key].dataType.simpleString()}, score double")
