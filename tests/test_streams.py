"""Streams in order of event time: late rows, visits, admissions, progress, and state that ends."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumeworks.operators import tracking as T
from plumeworks.streaming import operators as S
from plumeworks.streaming.jobs import admission_stream, progress_stream
from plumeworks.streaming.runner import drain
from plumeworks.streaming.tracks import track_stream

FRAMES = "clip_id string, ts timestamp, frame_index long, det_idx int, x double, y double, w double, h double"
REQUESTS = "media_id long, ts timestamp, event_id long, finishes boolean, run_id long"
REPORTS = "analysis_id string, ts timestamp, event_id long, percent int, stage string, status string"


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def files(spark, path, parts, schema):
    """A stream that gets one part a trigger."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return S.read_events(spark, path, spark.createDataFrame([], schema).schema, per_trigger=1)


def frame(s, x, clip="c", index=None):
    return clip, at(s), s if index is None else index, 0, float(x), 0.0, 100.0, 100.0


def test_tracks_wait_for_late_frames(spark, tmp_path):
    # frames of one moving vehicle in wrong order: in the order of arrival they would be several tracks
    parts = [[frame(3, 120), frame(1, 40)], [frame(2, 80), frame(4, 160), frame(0, 0)], [frame(100, 900)]]
    got = drain(track_stream(files(spark, str(tmp_path / "in"), parts, FRAMES), late="30 seconds"), "update", "late").collect()
    assert max((r.steps, r.tracks) for r in got) == (5, 1) and not any(r.ended for r in got)  # the frame at 100 s waits


def test_visits_end_and_leave_no_state(spark, tmp_path):
    parts = [
        [frame(0, 0), frame(1, 40), frame(0, 0, "d"), frame(2, 0, "n", None)],
        [frame(500, 0), frame(501, 500)],  # after a silence
        [("x", at(2000), None, None, None, None, None, None), ("x", None, 1, 0, 1.0, 1.0, 1.0, 1.0)],
        [frame(4000, 0, "last")], [frame(4001, 0, "last")],
    ]
    stream = track_stream(files(spark, str(tmp_path / "in"), parts, FRAMES), late="10 seconds", idle="60 seconds")
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out).collect()
    ended = {(r.clip_id, r.began): (r.tracks, r.steps) for r in rows if r.ended}
    assert ended == {("c", at(0)): (1, 2), ("c", at(500)): (2, 2), ("d", at(0)): (1, 1), ("n", at(2)): (1, 1), ("x", at(2000)): (1, 1)}
    held = spark.read.format("statestore").option("stateVarName", "kept").load(state)
    assert {r.key.clip_id for r in held.collect()} == {"last"}


def test_a_bucket_of_waiting_frames_that_the_watermark_splits(spark, tmp_path):
    parts = [[frame(s, 0, index=s) for s in (1, 3, 5, 7, 9)], [frame(14, 0, "w")], [frame(100, 0, "w")]]
    got = drain(track_stream(files(spark, str(tmp_path / "in"), parts, FRAMES), late="10 seconds"), "update", "split").where("clip_id = 'c'").collect()
    assert sorted(r.steps for r in got) == [2, 5]


def admitted(spark, tmp_path, parts):
    got = drain(admission_stream(files(spark, str(tmp_path / "in"), parts, REQUESTS), late="20 seconds"), "append", "admit")
    return {r.request_id: (r.admitted, r.run_id) for r in got.collect()}


def test_admission_out_of_order_and_repeated(spark, tmp_path):
    ask = lambda s, i, media=1: (media, at(s), i, False, None)
    end = lambda s, i, run=None, media=1: (media, at(s), i, True, run)
    parts = [
        [ask(5, 2), ask(1, 1), ask(1, 1)],  # the earlier request comes second, and twice
        [end(8, 3, run=1), ask(9, 4), end(10, 5, run=1), ask(11, 6), ask(2, 20, media=2)],  # run 1 ends once; its second end frees nothing
        [end(12, 7), ask(13, 8), (1, at(14), 9, None, None), (1, at(14), None, False, None), (None, at(3), 30, False, None), (None, at(4), 31, False, None)],
        [ask(500, 99, media=3)], [ask(501, 100, media=3)],
    ]
    got = admitted(spark, tmp_path, parts)
    assert got == {1: (False, 1), 2: (False, 1), 4: (True, 4), 6: (False, 4), 8: (True, 8), 9: (False, 8), 20: (True, 20), 30: (True, 30), 31: (False, 30)} | {1: got[1]}
    assert got[1][1] == 1


def test_a_medium_without_a_run_has_no_state(spark, tmp_path):
    parts = [[(1, at(1), 1, False, None), (1, at(2), 2, True, 1), (2, at(1), 3, False, None), (4, at(1), 4, True, None)], [(3, at(200), 5, False, None)], [(3, at(201), 6, False, None)]]
    stream = admission_stream(files(spark, str(tmp_path / "in"), parts, REQUESTS))
    state = str(tmp_path / "state")
    stream.writeStream.outputMode("append").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "kept").load(state)
    assert {r.key.media_id for r in held.collect()} == {2, 3}


def test_progress_stream_equals_the_batch(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(f"r{i % 3}", at(1000 + rng.randrange(4000) / 10), i, rng.choice([None, -5, 10, 10, 50, 100, 400]), rng.choice(["a", "b", None, "s" * 60]), rng.choice(["running", "running", "running", "failed"])) for i in range(300)]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # equal times leave the order to the columns
    rng.shuffle(rows)
    end = ("z", at(100_000), 1, 1, "z", "running")
    parts = [rows[:100], rows[100:200], [*rows[200:], end]]
    stream = progress_stream(files(spark, str(tmp_path / "in"), parts, REPORTS), late="3600 seconds", gap=2.0)
    got = {(r.analysis_id, r.event_id, r.percent, r.stage) for r in drain(stream, "append", "progress").collect()}
    batch = spark.createDataFrame(rows, REPORTS).withColumn("at", F.unix_millis("ts") / 1000)
    want = {(r.analysis_id, r.event_id, r.percent, r.stage) for r in T.throttle_progress(batch, 2.0).collect()}
    assert got == want and 20 < len(want) < len(rows)


def test_progress_of_a_silent_run_begins_again(spark, tmp_path):
    parts = [[("r", at(0), 1, 10, "a", "running"), ("r", at(1), 2, 10, "a", "running")], [("q", at(900), 3, 1, "a", "running")], [("q", at(901), 4, 2, "b", "running")], [("r", at(1000), 5, 10, "a", "running")], [("q", at(5000), 6, 3, "c", "running")]]
    got = drain(progress_stream(files(spark, str(tmp_path / "in"), parts, REPORTS), gap=0.4, idle="60 seconds"), "append", "silent").collect()
    assert sorted(r.event_id for r in got) == [1, 3, 4, 5]


@pytest.mark.parametrize("make, schema", [(track_stream, FRAMES), (admission_stream, REQUESTS), (progress_stream, REPORTS)])
def test_streams_without_rows(spark, tmp_path, make, schema):
    assert drain(make(files(spark, str(tmp_path / "in"), [[]], schema)), "update" if make is track_stream else "append", "none").count() == 0
