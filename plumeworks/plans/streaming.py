"""Streaming queries, run to the end of their input; the oracle is the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tracking import step_index
from ..sources import adapters as A
from ..sources.files import seed_runs
from ..streaming import operators as S
from ..streaming.jobs import admission_stream, progress_stream
from ..streaming.runner import drain, scratch
from ..streaming.tracks import track_stream
from .base import query


def _events(spark, sf_dir):
    # a pattern, as a stream takes a single file by no other name
    return S.read_events(spark, f"{sf_dir}/event[s].parquet", A.table(spark, sf_dir, "events").schema)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_daily_series(spark, sf_dir):
    return drain(S.daily_buckets(_events(spark, sf_dir)), "complete", "daily")


@query("SELECT d AS start_day, count(*) AS n FROM events, (SELECT CAST(unnest(generate_series(DATE '2023-12-01', DATE '2024-03-01', INTERVAL 1 DAY)) AS DATE) AS d) WHERE ts >= d AND ts < d + INTERVAL 14 DAY GROUP BY 1")
def stream_sliding_counts(spark, sf_dir):
    return drain(S.sliding_counts(_events(spark, sf_dir)), "complete", "sliding")


@query("SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 2 HOUR AS ends, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 7200000000 THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, s")
def stream_gap_sessions(spark, sf_dir):
    got = drain(S.sessions(_events(spark, sf_dir), "user_id", "2 hours"), "complete", "sessions")
    return got.select("user_id", F.col("begins").cast("timestamp_ntz").alias("begins"), F.col("ends").cast("timestamp_ntz").alias("ends"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return drain(S.dedup(_events(spark, sf_dir), ["user_id", "event_type"], late="365 days"), "append", "dedup").select("user_id", "event_type")


_LATE_MS = 3_600_000
_LANES = "view click purchase signup error".split()


_IDLE_MS = 86_400_000


def _stream_of_detections(spark, sf_dir):
    """Events as frames of their user's clip: each type of event keeps its place; rows arrive in several files and out of order."""
    e = A.table(spark, sf_dir, "events")
    lane = F.element_at(F.create_map(*(F.lit(v) for i, t in enumerate(_LANES) for v in (t, 1000.0 * i))), F.col("event_type"))
    rows = e.select(F.col("user_id").cast("string").alias("clip_id"), "ts", F.col("event_id").alias("frame_index"), F.lit(0).alias("det_idx"), lane.alias("x"), F.lit(100.0).alias("y"), F.lit(120.0).alias("w"), F.lit(90.0).alias("h"))
    path = scratch(spark, "detections")
    rows.repartition(4, F.col("frame_index")).write.parquet(path)
    return S.read_events(spark, path, rows.schema)


_VISITS = (
    f"WITH m AS (SELECT epoch_us(max(ts))//1000 - {_LATE_MS} AS mark FROM events), f AS (SELECT user_id, event_type, event_id, epoch_us(ts)//1000 AS ms, epoch_us(ts)//1000 - lag(epoch_us(ts)//1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id) > {_IDLE_MS} AS brk FROM events, m WHERE epoch_us(ts)//1000 < mark), "
    "v AS (SELECT *, count(*) FILTER (brk) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM f), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY user_id, visit ORDER BY ms, event_id) AS step FROM v), "
    "g AS (SELECT *, step - lag(step) OVER (PARTITION BY user_id, visit, event_type ORDER BY step) AS gap FROM s) "
)


@query(
    _VISITS + "SELECT CAST(user_id AS VARCHAR) AS clip_id, min(ms) AS began_ms, CAST(count(*) FILTER (gap IS NULL OR gap > 2) AS INTEGER) AS tracks, CAST(max(step) AS INTEGER) AS steps, max(ms) < any_value(mark) - "
    f"{_IDLE_MS} OR visit < max(visit) OVER (PARTITION BY user_id) AS ended FROM g, m GROUP BY user_id, visit"
)
def stream_tracks(spark, sf_dir):
    """Tracks and steps of each visit of a clip: a track ends where its type is away for over two steps, a visit after a day without events.

    What is newer than the watermark still waits; a visit that has ended has left no state.
    """
    found = drain(track_stream(_stream_of_detections(spark, sf_dir), late=f"{_LATE_MS} milliseconds", idle=f"{_IDLE_MS} milliseconds"), "update", "tracks")
    latest = found.groupBy("clip_id", "began").agg(F.max("tracks").alias("tracks"), F.max("steps").alias("steps"), F.max("ended").alias("ended"))
    return latest.select("clip_id", F.unix_millis("began").alias("began_ms"), "tracks", "steps", "ended")


def _shuffled(spark, rows, name):
    """Rows as a stream of several files, out of order."""
    path = scratch(spark, name)
    rows.repartition(4, F.xxhash64("event_id")).write.parquet(path)
    return S.read_events(spark, path, rows.schema)


@query(
    f"WITH e AS (SELECT user_id*4 + event_id%4 AS media_id, event_id, event_type IN ('purchase', 'error') AS finishes, epoch_us(ts)//1000 AS ms FROM events WHERE epoch_us(ts)//1000 < (SELECT epoch_us(max(ts))//1000 - {_LATE_MS} FROM events)), "
    "g AS (SELECT *, sum(finishes::INTEGER) OVER (PARTITION BY media_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS part FROM e) "
    "SELECT media_id, event_id AS request_id, row_number() OVER w = 1 AS admitted, first_value(event_id) OVER w AS run_id FROM g WHERE NOT finishes WINDOW w AS (PARTITION BY media_id, part ORDER BY ms, event_id)"
)
def stream_admissions(spark, sf_dir):
    """Requests and ends of runs as they come: who is admitted, and the run that is in flight."""
    e = A.table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("media_id"), "event_id", F.col("event_type").isin("purchase", "error").alias("finishes"), F.lit(None).cast("bigint").alias("run_id"), "ts")
    return drain(admission_stream(_shuffled(spark, rows, "requests"), late=f"{_LATE_MS} milliseconds"), "append", "admissions")


_GAP_MS = 21_600_000


@query(
    f"WITH RECURSIVE w AS (SELECT user_id AS analysis_id, event_id, epoch_us(ts)//1000 AS at_ms, CAST(event_id%101 AS INTEGER) AS percent, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id%101, event_type) AS n FROM events WHERE epoch_us(ts)//1000 < (SELECT epoch_us(max(ts))//1000 - {_LATE_MS} FROM events)), "
    "f AS (SELECT analysis_id, n, at_ms AS last_at, percent AS last_percent, stage AS last_stage, true AS kept FROM w WHERE n = 1 UNION ALL "
    "SELECT analysis_id, n2, CASE WHEN skip THEN last_at ELSE a2 END, CASE WHEN skip THEN last_percent ELSE p2 END, CASE WHEN skip THEN last_stage ELSE s2 END, NOT skip "
    f"FROM (SELECT f.*, w.at_ms AS a2, w.percent AS p2, w.stage AS s2, w.n AS n2, (w.percent = last_percent AND w.stage = last_stage) OR (w.percent < 100 AND w.at_ms - last_at < {_GAP_MS}) AS skip FROM f JOIN w ON w.analysis_id = f.analysis_id AND w.n = f.n + 1)) "
    "SELECT analysis_id, event_id, at_ms, percent, stage FROM f JOIN w USING (analysis_id, n) WHERE kept"
)
def stream_progress(spark, sf_dir):
    """Progress writes that survive a throttle of six hours, from reports out of order."""
    e = A.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("analysis_id"), "event_id", (F.col("event_id") % 101).cast("int").alias("percent"), F.col("event_type").alias("stage"), "ts")
    return drain(progress_stream(_shuffled(spark, rows, "reports"), late=f"{_LATE_MS} milliseconds", gap=_GAP_MS / 1000, idle="365 days"), "append", "progress")


_PICK = "('0x' || substr(md5(o_orderkey || ':11:{s}'), 1, 8))::BIGINT%{m}".format


@query(f"SELECT o_orderkey AS analysis_id, {_PICK(s=2, m=25)} AS media_id, (['', 'low', 'moderate', 'high'])[{_PICK(s=1, m=4)} + 1] AS overall_severity, CAST(1 + {_PICK(s=3, m=3)} AS INTEGER) AS vehicles, DATE '2001-08-01' - CAST({_PICK(s=4, m=400)} AS INTEGER) AS created_on FROM orders")
def seeded_runs(spark, sf_dir):
    """A synthetic run for each order."""
    return seed_runs(A.table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT user_id AS clip_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events WHERE event_type <> 'view'")
def steps_skip_empty_frames(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("clip_id"), "event_id")
    return step_index(e, "clip_id", "event_id")
