"""Windows, series, deltas and shares of the dashboard."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES
from ..functions.stats import pct_delta

# Windows in days, and the levels' colours.
DEFAULT_DAYS, MAX_DAYS, SPARK_DAYS, RECENT = 30, 365, 14, 5
COLOURS = {"low": "#4ade80", "moderate": "#fbbf24", "high": "#f87171"}


def clamp_days(days) -> int:
    """Whole days from 1 to 365; junk and infinities give the default."""
    try:
        return max(1, min(MAX_DAYS, int(float(days))))
    except (TypeError, ValueError, OverflowError):
        return DEFAULT_DAYS


def between(df: DataFrame, start: date, end: date, column: str = "created_at") -> DataFrame:
    """The half-open range from start to before end."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def measures() -> list:
    """Counts and the mean confidence over rows that have one; 0 where there is none."""
    return [
        F.count("*").alias("analyses"),
        F.count_if(F.col("overall_severity") == "high").alias("high_severity"),
        F.round(F.coalesce(F.avg(F.when(F.col("avg_confidence") > 0, F.col("avg_confidence"))), F.lit(0.0)), 4).alias("avg_confidence"),
    ]


def window_totals(runs: DataFrame, today: date, days: int) -> DataFrame:
    return between(runs, today - timedelta(days - 1), today + timedelta(1)).agg(*measures())


def calendar(df: DataFrame, start: date, end: date) -> DataFrame:
    return df.sparkSession.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day")


def daily_series(runs: DataFrame, today: date, days: int) -> DataFrame:
    """One row a day, empty days included."""
    start = today - timedelta(days - 1)
    found = between(runs, start, today + timedelta(1)).groupBy(F.to_date("created_at").alias("day")).agg(*measures())
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return calendar(runs, start, today).join(found, "day", "left").select("day", zero("analyses", 0), zero("high_severity", 0), zero("avg_confidence", 0.0))


def daily_by_user(runs: DataFrame, today: date, days: int) -> DataFrame:
    """The series of all accounts at once, days without runs left out."""
    return between(runs, today - timedelta(days - 1), today + timedelta(1)).groupBy("user_id", F.to_date("created_at").alias("day")).agg(*measures())


def daily_reports(runs: DataFrame, reports: DataFrame, today: date, days: int) -> DataFrame:
    """Reports by the day on which they were made."""
    start = today - timedelta(days - 1)
    made = between(reports, start, today + timedelta(1), "generated_at").join(runs.select("analysis_id"), "analysis_id", "left_semi")
    found = made.groupBy(F.to_date("generated_at").alias("day")).agg(F.count("*").alias("reports"))
    return calendar(runs, start, today).join(found, "day", "left").select("day", F.coalesce("reports", F.lit(0)).alias("reports"))


def period_delta(runs: DataFrame, today: date, days: int) -> DataFrame:
    """The window, the equal window before it, and the change; confidence is compared as rounded."""
    start = today - timedelta(days - 1)
    both = between(runs, start - timedelta(days), today + timedelta(1))
    now = F.col("created_at") >= F.lit(start)
    conf = lambda p: F.round(F.coalesce(F.avg(F.when(p & (F.col("avg_confidence") > 0), F.col("avg_confidence"))), F.lit(0.0)), 4)
    got = both.agg(*(x for name, p in (("current", now), ("previous", ~now)) for x in (F.count_if(p).alias(f"{name}_analyses"), F.count_if(p & (F.col("overall_severity") == "high")).alias(f"{name}_high"), conf(p).alias(f"{name}_confidence"))))
    return got.select("*", *(pct_delta(F.col(f"current_{m}"), F.col(f"previous_{m}")).alias(f"{m}_delta") for m in ("analyses", "high", "confidence")))


def severity_donut(runs: DataFrame) -> DataFrame:
    """Counts of the three levels and whole percentages that sum to 100, by largest remainder."""
    levels = runs.sparkSession.createDataFrame([(i, s, COLOURS[s]) for i, s in enumerate(SEVERITIES)], "place int, severity string, colour string")
    counts = runs.groupBy(F.col("overall_severity").alias("severity")).agg(F.count("*").alias("n"))
    rows = levels.join(counts, "severity", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # three rows
    whole = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("n").over(whole)).withColumn("exact", F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0))
    rows = rows.withColumn("base", F.floor("exact").cast("int"))
    order = Window.orderBy((F.col("exact") - F.col("base")).desc(), F.col("n").desc(), "place")
    rest = F.when(F.col("total") > 0, 100 - F.sum("base").over(whole)).otherwise(0)
    rows = rows.withColumn("rest", rest).withColumn("rank", F.row_number().over(order))
    return rows.select("severity", "colour", F.col("n").alias("count"), (F.col("base") + (F.col("rank") <= F.col("rest")).cast("int")).alias("percentage"))


def recent(runs: DataFrame, media: DataFrame, k: int = RECENT) -> DataFrame:
    """The newest runs, whenever they were."""
    return runs.join(media.select("media_id", "filename"), "media_id").orderBy(F.desc("created_at"), "analysis_id").limit(k)
