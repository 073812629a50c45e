"""Hand-written cases: boundaries, tracks, verdicts, rules."""

from __future__ import annotations

from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeworks.functions import settings as S
from plumeworks.functions import severity as V
from plumeworks.functions import stats, text
from plumeworks.functions.geometry import clamp_crop, exhaust_roi, iou, map_box
from plumeworks.operators import dashboard as D
from plumeworks.operators import evaluation as E
from plumeworks.operators import history as H
from plumeworks.operators import ingest as I
from plumeworks.operators import tracking as T
from plumeworks.sources import files

BOX = "struct<x:double,y:double,w:double,h:double>"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_bands_differ_on_their_edges(spark):
    rows = spark.createDataFrame([(v,) for v in (0.10, 0.33, 0.50, 0.66, 0.90)], "v double").select(V.classify(F.col("v")).alias("a"), V.severity_for(F.col("v")).alias("b")).collect()
    assert [r.a for r in rows] == ["low", "moderate", "moderate", "high", "high"]
    assert [r.b for r in rows] == ["low", "low", "moderate", "moderate", "high"]
    got = one(spark, null=V.severity_for(F.lit(None).cast("double")), rank=V.severity_rank(F.lit("?")), none=V.worst_of_counts(F.lit(0), F.lit(0), F.lit(0)))
    assert (got.null, got.rank, got.none) == ("low", -1, "")


def test_density_and_gate(spark):
    full = [F.lit(float(x)) for x in (1, 1, 1, 1, 1)]
    got = one(spark, most=V.smoke_density(F.lit(10), *full), none=V.smoke_density(F.lit(0), *full), small=V.gate_reason(*map(F.lit, (11, 50, 0.5, 0.5, 100, 0.9))), smoke=V.gate_reason(*map(F.lit, (12, 12, 0.02, 0.018, 64, 0.15))), thin=V.gate_reason(*map(F.lit, (12, 12, 0.02, 0.018, 63, 0.15))))
    assert (got.most, got.none, got.small, got.smoke, got.thin) == (1.0, 0.0, "roi_below_minimum_size", "smoke", "no_smoke")


@pytest.mark.parametrize("a, b, want", [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 5, 5), 0.0), ((0, 0, None, 10), (0, 0, 10, 10), 0.0), ((0, 0, 0, 10), (0, 0, 10, 10), 0.0), ((0, 0, 10, 10), (5, 0, 10, 10), 1 / 3)])
def test_iou(spark, a, b, want):
    row = spark.createDataFrame([(tuple(None if v is None else float(v) for v in a), tuple(map(float, b)))], f"a {BOX}, b {BOX}").select(iou(F.col("a"), F.col("b")).alias("v")).first()
    assert row.v == pytest.approx(want)
    assert T.overlap(a, b) == pytest.approx(want)


def test_roi_and_crop(spark):
    lits = lambda *v: [F.lit(x) for x in v]
    got = one(spark, roi=exhaust_roi(*lits(100, 100, 120, 90, 640, 480)), edge=exhaust_roi(*lits(-50, -50, 5, 5, 640, 480)), crop=clamp_crop(F.struct(F.lit(630).alias("x"), F.lit(-5).alias("y"), F.lit(50).alias("w"), F.lit(3).alias("h")), F.lit(640), F.lit(480)), moved=map_box(F.struct(F.lit(10).alias("x"), F.lit(10).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h")), F.lit(2), F.lit(2), F.lit(0.5)))
    assert tuple(got.roi) == (64, 150, 192, 52)
    assert got.edge.w >= 1 and got.edge.h >= 1
    assert tuple(got.crop) == (630, 0, 10, 1)
    assert tuple(got.moved) == (4.0, 4.0, 2.0, 2.0)


def frames(fires, n=12, vehicles=1, x=lambda v, i: 50 + 4 * i + 400 * v):
    return [(f"c{0}", i, v, float(x(v, i)), 100.0, 120.0, 90.0, (v, i) in fires, "car") for i in range(n) for v in range(vehicles)]


def verdict(spark, rows, n=12):
    d = spark.createDataFrame(rows, "clip_id string, frame_index long, det_idx int, x double, y double, w double, h double, fired boolean, vehicle_type string")
    d = d.withColumn("intensity", F.when(F.col("fired"), 0.42)).withColumn("severity", F.when(F.col("fired"), "moderate")).withColumn("confidence", F.lit(0.9))
    tracked = T.associate(d)
    tracks = T.tracked_counters(tracked)
    return T.clip_verdict(d, tracks, spark.createDataFrame([("c0", n)], "clip_id string, frames_processed int")).first(), tracks.collect()


CASES = {
    "isolated": ({0}, (0, 1, "none", 0)),
    "two apart": ({0, 7}, (0, 2, "none", 0)),
    "alternate": ({0, 2, 4, 6, 8, 10}, (0, 6, "none", 0)),
    "sustained": (set(range(8)), (8, 0, "moderate", 1)),
    "three": ({0, 1, 2}, (0, 3, "none", 0)),
    "four": ({0, 1, 2, 3}, (4, 0, "moderate", 1)),
    "clean": (set(), (0, 0, "none", 0)),
}


@pytest.mark.parametrize("case", CASES)
def test_persistence(spark, case):
    fires, want = CASES[case]
    got, _ = verdict(spark, frames({(0, i) for i in fires}))
    assert (got.total_smoke, got.discarded_regions, got.overall_severity, got.confirmed_tracks) == want
    assert got.total_vehicles == 12


def test_crowd_and_single_frame(spark):
    got, _ = verdict(spark, frames({(3, 0)}, vehicles=8))
    assert (got.total_vehicles, got.total_smoke) == (96, 0)
    still, _ = verdict(spark, frames({(0, 0)}, n=1), n=1)
    assert (still.total_smoke, still.overall_severity, still.applied) == (1, "moderate", False)


def test_fraction_and_no_pooling(spark):
    got, _ = verdict(spark, frames({(0, i) for i in range(5)}, n=21), n=21)
    assert got.total_smoke == 0
    fixed = frames({(i % 2, i) for i in range(12)}, vehicles=2, x=lambda v, i: 400 * v)
    got, tracks = verdict(spark, fixed)
    assert got.total_smoke == 0 and len(tracks) == 2


def test_tracker_gaps_and_unreadable_boxes():
    seen, other = (0, 0, 10, 10), (500, 0, 10, 10)
    t = T.Tracker()
    assert [t.update([b]) for b in (seen, other, seen)] == [[1], [2], [1]]
    t = T.Tracker()
    assert [t.update([b]) for b in (seen, other, other, seen)] == [[1], [2], [2], [3]]
    t = T.Tracker()
    assert t.update([None]) == [1] and t.tracks[0]["box"] is None


def test_runs_break_at_missed_steps(spark):
    rows = [("c", 1, 1, 1, True, 0.5, "car"), ("c", 1, 3, 3, True, 0.6, "bus")]
    got = T.tracked_counters(spark.createDataFrame(rows, "clip_id string, track_id int, step int, frame_index long, fired boolean, intensity double, vehicle_type string")).first()
    assert (got.observations, got.hits, got.longest_run, got.vehicle_type) == (2, 2, 1, "bus")


def test_throttle(spark):
    rows = [("a", i * 0.01, i, "s") for i in range(1, 80)] + [("a", 0.9, 100, "s"), ("a", 0.95, 100, "s")]
    got = T.throttle_progress(spark.createDataFrame(rows, "analysis_id string, at double, percent int, stage string"), 60.0)
    assert [r.percent for r in got.orderBy("at").collect()] == [1, 100]


@pytest.mark.parametrize("days, want", [("abc", 30), (100000, 365), (-5, 1), (float("inf"), 30), (None, 30), ("7", 7)])
def test_days(days, want):
    assert D.clamp_days(days) == want


def test_delta_and_donut(spark):
    got = one(spark, a=stats.pct_delta(F.lit(4), F.lit(2)), b=stats.pct_delta(F.lit(0), F.lit(0)), c=stats.pct_delta(F.lit(3), F.lit(0)))
    assert (got.a, got.b, got.c) == (100.0, 0.0, 100.0)
    df = spark.createDataFrame([("low",), ("moderate",), ("high",), ("",)], "overall_severity string")
    assert {r.severity: r.percentage for r in D.severity_donut(df).collect()} == {"low": 34, "moderate": 33, "high": 33}
    assert [r.percentage for r in D.severity_donut(df.where("false")).collect()] == [0, 0, 0]


def test_empty_account_has_all_days(spark):
    df = spark.createDataFrame([], "created_at timestamp_ntz, overall_severity string, avg_confidence double")
    assert D.daily_series(df, date(2001, 8, 1), 30).count() == 30


def test_unknown_choices_are_errors():
    for bad in ({"status": "x"}, {"severity": "x"}, {"vehicle_type": "boat"}, {"ordering": "error_message"}):
        with pytest.raises(ValueError):
            H.HistoryFilter(**bad)


@pytest.mark.parametrize("percent, n, want", [(50, 5, 2), (50, 4, 2), (95, 20, 19), (100, 3, 3), (1, 3, 1)])
def test_nearest_rank(spark, percent, n, want):
    assert one(spark, v=stats.nearest_rank(F.array(*(F.lit(float(i + 1)) for i in range(n))), percent)).v == want


@given(st.lists(st.lists(st.booleans(), min_size=5, max_size=5), min_size=5, max_size=5))
def test_component_is_within_its_mask(cells):
    import numpy as np

    on = np.array(cells)
    size, compact = E.largest_component(on)
    assert 0 <= size <= on.sum() and 0 <= compact <= 1 and (size > 0) == bool(on.any())


def test_text_functions(spark):
    names = ["a.JPG", "b", "x.tar.gz", ".hidden", None, "dir.v1/file", "c."]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.file_extension(F.col("n")).alias("e")).collect()
    assert [r.e for r in got] == ["jpg", "", "gz", "", "", "", ""]
    sizes = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 5 * 1024**2, 3 * 1024**4)], "n long").select(text.human_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == ["0 B", "1023 B", "1.0 KB", "5.0 MB", "3072.0 GB"]
    assert one(spark, v=text.contains_literal(F.lit("100%_done"), "%_D")).v


def test_clamps(spark):
    s = lambda v: F.lit(v).cast("string")
    got = one(spark, a=S.clamp_float(s("nan"), 0, 1, 0.5), b=S.clamp_float(s("7"), 0.0, 1.0, 0.5), c=S.clamp_int(s("3.9"), 1, 60, 5), d=S.clamp_int(s("inf"), 1, 60, 5), e=S.clamp_int(s("x"), 1, 60, 5), f=S.coerce_bool(s(" ON ")), g=S.sensitivity_threshold(s("50")))
    assert (got.a, got.b, got.c, got.d, got.e, got.f, got.g) == (0.5, 1.0, 3, 5, 5, True, 0.5)


def test_final_state_never_resurrects(spark):
    rows = [("j", 1, 1, "running"), ("j", 2, 2, "failed"), ("j", 3, 3, "done"), ("k", 1, 1, "queued"), ("k", 2, 2, "running")]
    got = I.final_states(spark.createDataFrame(rows, "job_id string, ts int, event_id int, state string"))
    assert {r.job_id: r.state for r in got.collect()} == {"j": "failed", "k": "running"}


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 0.5 0.5 0.2 0.2\n0 0.5 0.5 0.2 0.2\n7 0.1 0.1 0.01 0.01\n")
    (tmp_path / "b.txt").write_text("2 0.5 0.5 0.2 0.2\n2 oops 0.5 0.2 0.2\n")
    got = files.label_boxes(spark, str(tmp_path), 640, 480).collect()
    assert [(r.vehicle_type, r.x, r.y, r.w, r.h) for r in got] == [("car", 256, 192, 128, 96)]
    (tmp_path / "a.txt").write_text("2 0.5\n0 oops x x x\n2.9\t0.5  0.5 0.2 0.2\n5 0.5 0.5 0.9 0.001\n3 0.25 0.25 0.2515625 0.2 0.9\n")
    got = files.label_boxes(spark, str(tmp_path), 640, 480).collect()
    # the width of the last is 161: its left edge comes from the rounded width, 160 - 80.5
    assert sorted((r.vehicle_type, r.x, r.y, r.w, r.h) for r in got) == [("bus", 32, 236, 576, 8), ("car", 256, 192, 128, 96), ("motorcycle", 80, 72, 161, 96)]


def test_files_metrics_and_partitions(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"metrics": {"dice": 0.78}, "threshold": 0.65}')
    assert files.metrics(spark, str(tmp_path / "m.json")).first().threshold == 0.65
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(20))
    (tmp_path / "y.jpg").write_bytes(b"\xff\xd8\xff" + bytes(20))
    got = files.media_files(spark, str(tmp_path), "*.png").first()
    assert (got.format, got.length) == ("png", 28)
    images, masks = files.listing(spark, str(tmp_path), "*.jpg"), files.listing(spark, str(tmp_path), "*.png")
    assert files.pairs(images, masks).count() == 0
    out = str(tmp_path / "out")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), out, ["k"])
    files.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), out, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c")]
    assert files.seed_runs(spark.range(100)).exceptAll(files.seed_runs(spark.range(100).repartition(7))).count() == 0


def test_early_stop(spark):
    scores = [0.1, 0.5, 0.50005, 0.4, 0.3, 0.9]
    got = E.early_stop(spark.createDataFrame([("r", i, v) for i, v in enumerate(scores)], "run_id string, epoch int, dice double"), 3).first()
    assert (got.best, got.best_epoch, got.stopped) == (0.5, 1, 4)


def test_shadow_score():
    import numpy as np

    assert E.shadow_score(np.full(64, 100)) == 0.0
    half = np.r_[np.full(32, 20), np.full(32, 220)]
    # the level is the lower one itself, and nothing lies strictly below it
    assert E.shadow_score(half) == 0.0
    three = np.r_[np.full(24, 10), np.full(12, 20), np.full(64, 220)]
    assert E.otsu(three) == 20
    bright = (12 * 20 + 64 * 220) / 76
    assert E.shadow_score(three) == pytest.approx((bright - 10) * 0.24 / 0.35)


def test_paths_and_failures(spark):
    rows = spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("a\\..\\b",), ("C:\\x",), ("a..b/c",)], "p string").select(text.confined(F.col("p")).alias("ok"), text.base_name(F.col("p")).alias("n")).collect()
    assert [r.ok for r in rows] == [True, False, False, False, False, True]
    assert [r.n for r in rows] == ["b", "a", "a", "b", "x", "c"]
    own = lambda *v: F.array(*map(F.lit, v))
    got = one(spark, a=I.failure_topic(own("Odd", "OSError")), b=I.failure_topic(own("Odd")))
    assert (got.a, got.b) == ("files", "unexpected")


def sampled(spark, n, failures, **options):
    rows = [("c", i, i / 10, i not in failures) for i in range(n)]
    got = I.sample_frames(spark.createDataFrame(rows, "clip_id string, frame_index long, seconds double, decoded boolean"), **options)
    return [r.frame_index for r in got.orderBy("frame_index").collect()]


def test_frames_until_the_third_failure_in_a_row(spark):
    assert sampled(spark, 12, {2, 4, 6}, rate=2) == [0, 8, 10]
    assert sampled(spark, 12, {5, 6, 7}, rate=4) == [0, 4]
    assert sampled(spark, 12, {0, 1, 2}, rate=1) == []
    assert sampled(spark, 12, {3, 4, 6, 7}, rate=1, max_frames=5) == [0, 1, 2, 5, 8]
    assert sampled(spark, 12, set(), rate=3, max_seconds=0.6) == [0, 3, 6]


def test_contours():
    import numpy as np

    mask = lambda *rows: np.array([[c == "#" for c in r] for r in rows])
    assert E.largest_component(mask("...", ".#.", "...")) == (1, 0.0)
    assert E.largest_component(mask("....", "###.", "....")) == (3, 0.0)  # a line encloses nothing
    square = mask(".....", ".###.", ".###.", ".###.", ".....")
    assert E.contour(E.components_of(square)[0]) == (4.0, 8.0)
    assert E.largest_component(square) == (9, round(4 * np.pi * 4 / 64, 6))
    ring = mask("####", "#..#", "#..#", "####")
    assert E.contour(E.components_of(ring)[0]) == (9.0, 12.0)
    diamond = mask(".#.", "###", ".#.")
    assert E.contour(E.components_of(diamond)[0]) == (2.0, pytest.approx(4 * 2**0.5))
    tail = mask("##...", "##...", "..##.")  # a diagonal tail is walked there and back
    assert E.contour(E.components_of(tail)[0]) == (1.0, pytest.approx(4 + 2 * (2**0.5 + 1)))
    # the larger component is a line; the contour with most area is the other one's
    assert E.largest_component(mask("######", "......", "##....", "##....")) == (6, round(4 * np.pi / 16, 6))


def test_progress_is_clamped_and_ends(spark):
    rows = [("a", 0.0, -5, "s" * 60, "running"), ("a", 10.0, 400, "s", "running"), ("a", 20.0, 100, "t", "failed"), ("a", 30.0, 50, "u", "running")]
    got = T.throttle_progress(spark.createDataFrame(rows, "analysis_id string, at double, percent int, stage string, status string")).orderBy("at").collect()
    assert [(r.percent, len(r.stage)) for r in got] == [(0, 50), (100, 1), (50, 1)]


def test_streams_without_rows(spark, tmp_path):
    from plumeworks.streaming import operators as R
    from plumeworks.streaming.runner import drain
    from plumeworks.streaming.tracks import track_stream

    schema = "clip_id string, ts timestamp, frame_index long, det_idx int, x double, y double, w double, h double, value double"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    stream = lambda: R.read_events(spark, str(tmp_path / "none"), spark.createDataFrame([], schema).schema)
    assert drain(R.daily_buckets(stream()), "complete", "none").count() == 0
    assert drain(track_stream(stream()), "update", "none").count() == 0


def test_pages_by_key_with_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 4)) for i in range(23)], "analysis_id long, avg_confidence double")
    for ordering in ("avg_confidence", "-avg_confidence"):
        whole = [tuple(r) for r in df.orderBy(*H.HistoryFilter(ordering=ordering).order()).collect()]
        got, last = [], None
        while rows := H.page_after(df, ordering, last, 5).collect():
            got += [tuple(r) for r in rows]
            last = (rows[-1].avg_confidence, rows[-1].analysis_id)
        assert got == whole


def test_overlapping_pairs_over_cells_of_any_size(spark):
    rows = [(1 + i % 2, i // 12, i, float((i * 37) % 90 - 20), float((i * 53) % 70 - 10), float(10 + (i * 7) % 60), float(8 + (i * 11) % 50)) for i in range(120)]
    rows += [(1, 3, 200, None, 0.0, 10.0, 10.0), (1, 3, 201, 0.0, 0.0, 0.0, 10.0), (1, 3, 202, 0.0, 0.0, 10.0, None)]
    df = spark.createDataFrame(rows, "clip_id long, frame long, vehicle_id long, x double, y double, w double, h double")
    steps = {c: {f: k for k, f in enumerate(sorted({r[1] for r in rows if r[0] == c}))} for c in (1, 2)}
    want = set()
    for a in rows[:120]:
        for b in rows[:120]:
            w, h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])
            if a[0] == b[0] and 0 < steps[a[0]][b[1]] - steps[a[0]][a[1]] <= 2 and w > 0 and h > 0 and w * h / (a[5] * a[6] + b[5] * b[6] - w * h) >= 0.3:
                want.add((a[0], a[2], b[2]))
    assert len(want) > 20
    for cell in (16, 50, 256):
        got = [(r.clip_id, r.v1, r.v2) for r in T.iou_pairs(df, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
