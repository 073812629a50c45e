"""Dashboard queries of one account, at a fixed day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.text import day_label
from ..operators import dashboard as D
from ..operators.history import owned
from ..sources import adapters as A
from .base import query
from .views import sql

TODAY, DAYS, USER = date(2001, 8, 1), 365, 605
_IN = "created_at >= DATE '2000-08-02' AND created_at < DATE '2001-08-02'"
_MEASURES = "count(*) AS analyses, count(*) FILTER (overall_severity = 'high') AS high_severity, round(coalesce(avg(avg_confidence) FILTER (avg_confidence > 0), 0), 4) AS avg_confidence"


def _mine(spark, sf_dir):
    return owned(A.runs(spark, sf_dir), USER)


@query(sql(f"SELECT {_MEASURES} FROM runs WHERE user_id = {USER} AND {_IN}", "runs"))
def window_totals(spark, sf_dir):
    return D.window_totals(_mine(spark, sf_dir), TODAY, DAYS)


@query(sql("SELECT d AS day, coalesce(analyses, 0) AS analyses, coalesce(high_severity, 0) AS high_severity, coalesce(avg_confidence, 0) AS avg_confidence FROM days LEFT JOIN found ON d = day", "runs", days="SELECT CAST(unnest(generate_series(DATE '2000-08-02', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS d", found=f"SELECT CAST(created_at AS DATE) AS day, {_MEASURES} FROM runs WHERE user_id = {USER} AND {_IN} GROUP BY 1"))
def daily_series(spark, sf_dir):
    return D.daily_series(_mine(spark, sf_dir), TODAY, DAYS)


@query(sql(f"SELECT user_id, CAST(created_at AS DATE) AS day, {_MEASURES} FROM runs WHERE {_IN} GROUP BY 1, 2", "runs"))
def daily_by_user(spark, sf_dir):
    return D.daily_by_user(A.runs(spark, sf_dir), TODAY, DAYS)


@query(sql("SELECT d AS day, coalesce(n, 0) AS reports FROM days LEFT JOIN found ON d = day", "runs", "reports", days="SELECT CAST(unnest(generate_series(DATE '2000-08-02', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS d", found=f"SELECT CAST(generated_at AS DATE) AS day, count(*) AS n FROM reports WHERE generated_at >= DATE '2000-08-02' AND generated_at < DATE '2001-08-02' AND analysis_id IN (SELECT analysis_id FROM runs WHERE user_id%5 = 0) GROUP BY 1"))
def daily_reports(spark, sf_dir):
    return D.daily_reports(A.runs(spark, sf_dir).where("user_id % 5 = 0"), A.reports(spark, sf_dir), TODAY, DAYS)


@query(sql("SELECT strftime(d, '%b ') || day(d) AS label, d AS day, coalesce(analyses, 0) AS analyses, coalesce(avg_confidence, 0) AS avg_confidence FROM days LEFT JOIN found ON d = found.day", "runs", days="SELECT CAST(unnest(generate_series(DATE '2001-07-19', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS d", found=f"SELECT CAST(created_at AS DATE) AS day, {_MEASURES} FROM runs WHERE created_at >= DATE '2001-07-19' AND created_at < DATE '2001-08-02' GROUP BY 1"))
def sparkline14(spark, sf_dir):
    return D.daily_series(A.runs(spark, sf_dir), TODAY, D.SPARK_DAYS).select(day_label(F.col("day")).alias("label"), "day", "analyses", "avg_confidence")


def _delta(m):
    return f"CASE WHEN previous_{m} = 0 THEN CASE WHEN current_{m} = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE round((current_{m} - previous_{m}) * 100.0::DOUBLE / previous_{m}, 1) END AS {m}_delta"


def _sums(name, condition):
    return f"count(*) FILTER ({condition}) AS {name}_analyses, count(*) FILTER ({condition} AND overall_severity = 'high') AS {name}_high, round(coalesce(avg(avg_confidence) FILTER ({condition} AND avg_confidence > 0), 0), 4) AS {name}_confidence"


@query(sql(f"SELECT *, {_delta('analyses')}, {_delta('high')}, {_delta('confidence')} FROM sums", "runs", sums=f"SELECT {_sums('current', chr(99) + 'reated_at >= DATE ' + repr('2000-08-02'))}, {_sums('previous', 'created_at < DATE ' + repr('2000-08-02'))} FROM runs WHERE created_at >= DATE '1999-08-03' AND created_at < DATE '2001-08-02'"))
def period_delta(spark, sf_dir):
    return D.period_delta(A.runs(spark, sf_dir), TODAY, DAYS)


@query(
    sql(
        "SELECT severity, colour, n AS count, CAST(base + CASE WHEN rank <= rest THEN 1 ELSE 0 END AS INTEGER) AS percentage FROM ranked",
        "runs",
        counts=f"SELECT place, severity, colour, (SELECT count(*) FROM runs WHERE overall_severity = severity AND {_IN}) AS n FROM (VALUES (0,'low','#4ade80'),(1,'moderate','#fbbf24'),(2,'high','#f87171')) AS l(place, severity, colour)",
        exact="SELECT *, n*100.0::DOUBLE/sum(n) OVER () AS e, floor(n*100.0::DOUBLE/sum(n) OVER ()) AS base FROM counts",
        ranked="SELECT *, 100 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY e - base DESC, n DESC, place) AS rank FROM exact",
    )
)
def severity_donut(spark, sf_dir):
    return D.severity_donut(D.between(A.runs(spark, sf_dir), date(2000, 8, 2), date(2001, 8, 2)))


@query(sql(f"SELECT analysis_id, filename, status, created_at FROM runs JOIN media USING (media_id) WHERE runs.user_id = {USER} ORDER BY created_at DESC, analysis_id LIMIT 5", "runs", "media"))
def recent_runs(spark, sf_dir):
    return D.recent(_mine(spark, sf_dir), A.media(spark, sf_dir)).select("analysis_id", "filename", "status", "created_at")
