"""Detections, tracks and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import exhaust_roi
from ..functions.severity import classify, gate_reason, severity_for, severity_of_rank, severity_rank, smoke_density
from ..operators import history as H
from ..operators import tracking as T
from ..sources import adapters as A
from .base import query
from .views import VEHICLE_ID, sql

_BAND = "CASE WHEN intensity < 0.33 THEN 'low' WHEN intensity < 0.66 THEN 'moderate' ELSE 'high' END"
_STORED = "CASE WHEN intensity <= 0.33 THEN 'low' WHEN intensity <= 0.66 THEN 'moderate' ELSE 'high' END"
_RANK = "CASE severity WHEN 'low' THEN 0 WHEN 'moderate' THEN 1 WHEN 'high' THEN 2 ELSE -1 END"
_PAIR = "SELECT v.analysis_id AS clip_id, frame_number AS frame, v.vehicle_id, v.confidence, intensity, CASE WHEN intensity IS NOT NULL THEN " + _BAND + " END AS severity FROM one_v v LEFT JOIN one_r USING (vehicle_id)"
_ONE = {
    "one_v": "SELECT vehicle_id, any_value(analysis_id) AS analysis_id, any_value(vehicle_type) AS vehicle_type, any_value(frame_number) AS frame_number, any_value(x) AS x, any_value(y) AS y, any_value(w) AS w, any_value(h) AS h, max(confidence) AS confidence FROM vehicles GROUP BY vehicle_id",
    "one_r": "SELECT vehicle_id, max(intensity) AS intensity FROM regions GROUP BY vehicle_id",
}


#: Rows of a task by clip; beyond this many for each of Spark's partitions there are more partitions.
PER_TASK = 250_000
_CAR = ("vehicle_type", "frame_number", "x", "y", "w", "h")


def _by_clip(rows, count, *more):
    """One row per vehicle, of several the least of each column; rows, `count` at most, are dealt by clip, as the steps after this need them."""
    n = -(-count // PER_TASK)
    few = n <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = (rows.repartition("analysis_id") if few else rows.repartition(n, "analysis_id")).groupBy("analysis_id", "vehicle_id").agg(*(F.min(c).alias(c) for c in _CAR), F.max("confidence").alias("confidence"), *more)
    return each.withColumnsRenamed({"analysis_id": "clip_id", "frame_number": "frame"})


def _vehicles(spark, sf_dir):
    cars = A.vehicles(spark, sf_dir)
    return _by_clip(cars, cars.count())  # from the footers of the files


def _detections(spark, sf_dir):
    """Vehicles with the intensity and the band of their worst region. Regions name their clip too, so they go with the vehicles."""
    cars, regions = A.vehicles(spark, sf_dir).withColumn("car", F.lit(True)), A.regions(spark, sf_dir).select("analysis_id", "vehicle_id", "intensity")
    both = cars.unionByName(regions, allowMissingColumns=True)
    rows = _by_clip(both, 2 * cars.count(), F.max("intensity").alias("intensity"), F.count("car").alias("cars")).where("cars > 0").drop("cars")
    return rows.withColumn("severity", F.when(F.col("intensity").isNotNull(), classify(F.col("intensity"))))


_FEATURES = f"SELECT {VEHICLE_ID} AS vehicle_id, CAST(l_quantity*8 AS INTEGER) AS mask_pixels, round(l_quantity/100, 6) AS area, round(0.3 + abs(l_discount)*7, 6) AS opacity, round(abs(l_tax)*9, 6) AS darkness, round(abs(l_discount)*2, 6) AS edge, round(l_linenumber/8.0::DOUBLE, 6) AS compact, CAST(4 + l_partkey%90 AS INTEGER) AS roi_w, CAST(4 + l_suppkey%60 AS INTEGER) AS roi_h, round(l_quantity/500, 6) AS blob_ratio, CAST(l_quantity*6 AS INTEGER) AS blob_pixels FROM lineitem"
_CLIP = "greatest(0.0, least(1.0, {}))".format
_DENSITY = "CASE WHEN mask_pixels < 1 THEN 0.0::DOUBLE ELSE round(" + _CLIP("0.34::DOUBLE*least(area/0.35::DOUBLE, 1.0::DOUBLE) + 0.28::DOUBLE*" + _CLIP("(opacity-0.30::DOUBLE)/(1-0.30::DOUBLE)") + " + 0.18::DOUBLE*darkness + 0.12::DOUBLE*least(edge/0.18::DOUBLE, 1.0::DOUBLE) + 0.08::DOUBLE*compact") + ", 6) END"


def _features(spark, sf_dir):
    c = F.col
    key = c("l_orderkey") * 1000000000 + c("l_partkey") * 10000 + c("l_suppkey") * 10 + c("l_linenumber")
    return A.table(spark, sf_dir, "lineitem").select(
        key.alias("vehicle_id"), (c("l_quantity") * 8).cast("int").alias("mask_pixels"), F.round(c("l_quantity") / 100, 6).alias("area"), F.round(0.3 + F.abs("l_discount") * 7, 6).alias("opacity"), F.round(F.abs("l_tax") * 9, 6).alias("darkness"), F.round(F.abs("l_discount") * 2, 6).alias("edge"), F.round(c("l_linenumber") / 8, 6).alias("compact"),
        (4 + c("l_partkey") % 90).cast("int").alias("roi_w"), (4 + c("l_suppkey") % 60).cast("int").alias("roi_h"), F.round(c("l_quantity") / 500, 6).alias("blob_ratio"), (c("l_quantity") * 6).cast("int").alias("blob_pixels"),
    )


def _density():
    return smoke_density(*(F.col(c) for c in ("mask_pixels", "area", "opacity", "darkness", "edge", "compact")))


@query(sql(f"SELECT vehicle_id, {_DENSITY} AS density FROM f", f=_FEATURES))
def smoke_density_scores(spark, sf_dir):
    return _features(spark, sf_dir).select("vehicle_id", _density().alias("density"))


@query(sql("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN least(roi_w, roi_h) < 12 THEN 'roi_below_minimum_size' WHEN area >= 0.02 AND blob_ratio >= 0.018 AND blob_pixels >= 64 AND density >= 0.15 THEN 'smoke' ELSE 'no_smoke' END AS reason FROM d) GROUP BY reason", f=_FEATURES, d=f"SELECT *, {_DENSITY} AS density FROM f"))
def smoke_gate(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumn("density", _density())
    reason = gate_reason(*(F.col(c) for c in ("roi_w", "roi_h", "area", "blob_ratio", "blob_pixels", "density")))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    sql(
        "SELECT vehicle_id, least(greatest(0, x - px), 639) AS rx, least(greatest(0, y + h - band), 479) AS ry, greatest(least(640, x + w + px), least(greatest(0, x - px), 639) + 1) - least(greatest(0, x - px), 639) AS rw, greatest(least(480, y + h + pd), least(greatest(0, y + h - band), 479) + 1) - least(greatest(0, y + h - band), 479) AS rh FROM b",
        "vehicles",
        a="SELECT DISTINCT vehicle_id, x, y, w, h, greatest(1, CAST(round_even(h*0.45::DOUBLE, 0) AS INTEGER)) AS band, CAST(round_even(w*0.3::DOUBLE, 0) AS INTEGER) AS px FROM vehicles",
        b="SELECT *, CAST(round_even(band*0.3::DOUBLE, 0) AS INTEGER) AS pd FROM a",
    )
)
def exhaust_roi_boxes(spark, sf_dir):
    rows = A.vehicles(spark, sf_dir).select("vehicle_id", "x", "y", "w", "h").distinct()
    roi = exhaust_roi(*(F.col(c) for c in "xywh"), F.lit(640), F.lit(480))
    return rows.select("vehicle_id", roi.alias("r")).select("vehicle_id", *(F.col(f"r.{c}").alias(f"r{c}") for c in "xywh"))


@query(
    sql(
        "SELECT clip_id, f1, v1, f2, v2, round(o, 6) AS overlap FROM p WHERE o >= 0.3",
        "vehicles",
        **{"one_v": _ONE["one_v"]},
        st="SELECT *, dense_rank() OVER (PARTITION BY analysis_id ORDER BY frame_number) AS step FROM one_v",
        i="SELECT a.analysis_id AS clip_id, a.frame_number AS f1, a.vehicle_id AS v1, b.frame_number AS f2, b.vehicle_id AS v2, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x) AS iw, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y) AS ih, a.w*a.h + b.w*b.h AS areas FROM st a JOIN st b ON a.analysis_id = b.analysis_id AND b.step > a.step AND b.step <= a.step + 2",
        p="SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN CAST(iw*ih AS DOUBLE)/(areas - iw*ih) ELSE 0 END AS o FROM i",
    )
)
def iou_pairs(spark, sf_dir):
    return T.iou_pairs(_vehicles(spark, sf_dir))


@query(sql("SELECT clip_id, frame, vehicle_id, dense_rank() OVER (PARTITION BY clip_id ORDER BY frame) AS step FROM d", "vehicles", "regions", **_ONE, d=_PAIR))
def step_index(spark, sf_dir):
    return T.step_index(_vehicles(spark, sf_dir), "clip_id", "frame").select("clip_id", "frame", "vehicle_id", "step")


@query(sql("SELECT track_id, count(DISTINCT session) AS sessions, max(n) AS longest FROM (SELECT track_id, session, count(*) OVER (PARTITION BY track_id, session) AS n FROM s) GROUP BY track_id", "observations", g="SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY track_id ORDER BY ts, event_id) > 7200000000 THEN 1 ELSE 0 END AS brk FROM observations", s="SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g"))
def gap_sessions(spark, sf_dir):
    rows = A.observations(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    s = T.gap_sessions(rows, "track_id", F.col("us"), F.lit(2 * 3600 * 1000000), [F.col("ts"), F.col("event_id")])
    return s.groupBy("track_id", "session").agg(F.count("*").alias("n")).groupBy("track_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


_ISLANDS = "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY track_id, fired ORDER BY ts, event_id) AS island FROM observations"
_RUNS = "SELECT track_id, max(n) AS longest_run FROM (SELECT track_id, island, count(*) AS n FROM i WHERE fired GROUP BY 1, 2) GROUP BY 1"
_COUNTED = "SELECT i.track_id, count(*) AS observations, count(*) FILTER (fired) AS hits, coalesce(any_value(longest_run), 0) AS longest_run, coalesce(max(intensity) FILTER (fired), 0) AS peak_intensity, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(vehicle_type, epoch_us(ts)::HUGEINT*1000000 + event_id) AS vehicle_type, round(count(*) FILTER (fired)::DOUBLE / count(*), 6) AS hit_fraction FROM i LEFT JOIN r ON r.track_id = i.track_id GROUP BY i.track_id"


@query(sql("SELECT track_id, longest_run FROM c", "observations", i=_ISLANDS, r=_RUNS, c=_COUNTED))
def longest_run(spark, sf_dir):
    return T.track_counters(A.observations(spark, sf_dir), "track_id", ["ts", "event_id"]).select("track_id", "longest_run")


@query(sql("SELECT * FROM c", "observations", i=_ISLANDS, r=_RUNS, c=_COUNTED))
def track_counters(spark, sf_dir):
    return T.track_counters(A.observations(spark, sf_dir), "track_id", ["ts", "event_id"])


@query(sql("SELECT track_id, observations, hits, longest_run, hit_fraction FROM c WHERE hits >= 4 AND longest_run >= 3 AND hit_fraction >= 0.3", "observations", i=_ISLANDS, r=_RUNS, c=_COUNTED))
def persistent_tracks(spark, sf_dir):
    rows = T.track_counters(A.observations(spark, sf_dir), "track_id", ["ts", "event_id"])
    return rows.where(T.persistent()).select("track_id", "observations", "hits", "longest_run", "hit_fraction")


_STRICT = "SELECT user_id AS track_id, ts, event_id, event_type = 'error' AS fired, round(least(value/50, 1), 6) AS intensity, event_type AS vehicle_type FROM events"


@query(sql("SELECT track_id, hits, longest_run FROM c WHERE hits >= 4 AND longest_run >= 3 AND hit_fraction >= 0.3", i=_ISLANDS.replace("FROM observations", f"FROM ({_STRICT})"), r=_RUNS, c=_COUNTED))
def persistent_tracks_strict(spark, sf_dir):
    rows = T.track_counters(A.observations(spark, sf_dir, ("error",)), "track_id", ["ts", "event_id"])
    return rows.where(T.persistent()).select("track_id", "hits", "longest_run")


# verdicts: a clip's vehicles of one kind stand for its tracks
_KINDS = "SELECT clip_id, vehicle_type, frame, vehicle_id, intensity IS NOT NULL AS fired, row_number() OVER (PARTITION BY clip_id, vehicle_type ORDER BY frame, vehicle_id) AS step FROM (SELECT d.*, vehicle_type FROM d JOIN one_v USING (vehicle_id))"
_VERDICT = dict(
    k=_KINDS,
    il="SELECT *, step - row_number() OVER (PARTITION BY clip_id, vehicle_type, fired ORDER BY step) AS island FROM k",
    rl="SELECT clip_id, vehicle_type, max(n) AS longest_run FROM (SELECT clip_id, vehicle_type, island, count(*) AS n FROM il WHERE fired GROUP BY ALL) GROUP BY ALL",
    tl="SELECT k.clip_id, k.vehicle_type, count(*) AS observations, count(*) FILTER (fired) AS hits, coalesce(any_value(longest_run), 0) AS longest_run, round(count(*) FILTER (fired)::DOUBLE/count(*), 6) AS hit_fraction FROM k LEFT JOIN rl USING (clip_id, vehicle_type) GROUP BY k.clip_id, k.vehicle_type",
    cf="SELECT clip_id, count(*) AS confirmed_tracks FROM tl WHERE hits >= 4 AND longest_run >= 3 AND hit_fraction >= 0.3 GROUP BY clip_id",
    ag=f"SELECT clip_id, count(*) AS tv, count(intensity) AS rg, max(CASE WHEN intensity IS NOT NULL THEN {_RANK} END) AS worst, avg(intensity) AS mi, avg(confidence) AS ac FROM d GROUP BY clip_id",
    al="SELECT r.analysis_id AS clip_id, frames_processed > 1 AS applied, coalesce(tv, 0) AS tv, coalesce(rg, 0) AS rg, worst, mi, ac, coalesce(confirmed_tracks, 0) AS ct FROM runs r LEFT JOIN ag ON ag.clip_id = r.analysis_id LEFT JOIN cf ON cf.clip_id = r.analysis_id",
    dr="SELECT *, applied AND rg > 0 AND ct = 0 AS dropped FROM al",
)


@query(sql("SELECT clip_id, tv AS total_vehicles, CASE WHEN dropped THEN 0 ELSE rg END AS total_smoke, ct AS confirmed_tracks, CASE WHEN dropped THEN rg ELSE 0 END AS discarded_regions, CASE WHEN dropped OR rg = 0 THEN 'none' ELSE (['low','moderate','high'])[worst+1] END AS overall_severity, CASE WHEN dropped OR rg = 0 THEN 0 ELSE round(mi, 6) END AS mean_intensity, round(coalesce(ac, 0), 6) AS avg_confidence, applied FROM dr", "runs", "vehicles", "regions", **_ONE, d=_PAIR, **_VERDICT))
def clip_verdict(spark, sf_dir):
    d = _detections(spark, sf_dir)
    rows = d.withColumns({"lane": F.col("vehicle_type"), "fired": F.col("intensity").isNotNull()})
    tracks = T.track_counters(rows, ["clip_id", "lane"], ["frame", "vehicle_id"])
    return T.clip_verdict(d, tracks, A.runs(spark, sf_dir).select(F.col("analysis_id").alias("clip_id"), "frames_processed"))


# greedy association as a recursion over the steps of all clips: pairs of a detection and a live track are
# taken from the best on, each that meets neither a taken detection nor a taken track
_IW, _IH = (f"(least(d.{a}+d.{s}, live[k].{a}+live[k].{s}) - greatest(d.{a}, live[k].{a}))" for a, s in ("xw", "yh"))
_IOU = f"CASE WHEN {_IW} > 0 AND {_IH} > 0 THEN ({_IW}*{_IH})::DOUBLE / (d.w*d.h + live[k].w*live[k].h - {_IW}*{_IH}) ELSE 0 END"
_GREEDY = {
    "det": "SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY confidence DESC, vehicle_id, x, y, w, h, intensity) - 1 AS d, dense_rank() OVER (PARTITION BY clip_id ORDER BY frame) AS step FROM cameras",
    "st": "SELECT clip_id, step, list({'d': d, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY d) AS dets FROM det GROUP BY 1, 2",
    "tr": "SELECT DISTINCT clip_id, 0::BIGINT AS step, []::STRUCT(id BIGINT, seen BIGINT, x INTEGER, y INTEGER, w INTEGER, h INTEGER)[] AS tracks, 0::BIGINT AS n, []::STRUCT(d BIGINT, id BIGINT)[] AS given FROM cameras UNION ALL "
    "SELECT clip_id, step, list_concat(list_transform(live, lambda t, i: CASE WHEN list_contains(list_transform(taken, lambda c: c.k), i) THEN list_transform(list_filter(dets, lambda d: d.d = list_filter(taken, lambda c: c.k = i)[1].d), lambda d: {'id': t.id, 'seen': step, 'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h})[1] ELSE t END), list_transform(fresh, lambda d, i: {'id': n + i, 'seen': step, 'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h})), "
    "n + len(fresh), list_concat(list_transform(taken, lambda c: {'d': c.d, 'id': live[c.k].id}), list_transform(fresh, lambda d, i: {'d': d.d, 'id': n + i})) "
    "FROM (SELECT *, list_filter(dets, lambda d: NOT list_contains(list_transform(taken, lambda c: c.d), d.d)) AS fresh FROM "
    "(SELECT *, list_reduce(list_transform(cands, lambda c: [c]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda a: a.d = c[1].d OR a.k = c[1].k)) > 0 THEN acc ELSE list_concat(acc, c) END, []::STRUCT(o DOUBLE, d BIGINT, k BIGINT)[]) AS taken FROM "
    f"(SELECT *, list_sort(list_filter(flatten(list_transform(dets, lambda d: list_transform(range(1, len(live) + 1), lambda k: {{'o': -({_IOU}), 'd': d.d, 'k': k}}))), lambda c: c.o <= -0.3)) AS cands FROM "
    "(SELECT tr.clip_id, st.step, st.dets, tr.n, list_filter(tr.tracks, lambda t: st.step - t.seen <= 2) AS live FROM tr JOIN st ON st.clip_id = tr.clip_id AND st.step = tr.step + 1))))",
}
_GREEDY["gv"] = "SELECT clip_id, step, g.d AS d, g.id AS track_id FROM (SELECT clip_id, step, unnest(given) AS g FROM tr)"
_GREEDY["ob"] = "SELECT clip_id, frame, vehicle_type, intensity, intensity IS NOT NULL AS fired, step, track_id FROM det JOIN gv USING (clip_id, step, d)"
_GREEDY["br"] = "SELECT *, CASE WHEN fired AND coalesce(step - lag(step) OVER w = 1, false) THEN 0 ELSE 1 END AS brk FROM ob WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY step)"
_GREEDY["rn"] = "SELECT *, sum(brk) OVER (PARTITION BY clip_id, track_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM br"
_GREEDY["rs"] = "SELECT clip_id, track_id, run, count(*) FILTER (fired) AS hits FROM rn GROUP BY ALL"
_TRACKED = sql(
    "SELECT CAST(o.clip_id AS VARCHAR) AS clip_id, CAST(o.track_id AS INTEGER) AS track_id, count(*) AS observations, count(*) FILTER (fired) AS hits, max(longest) AS longest_run, coalesce(max(intensity) FILTER (fired), 0) AS peak_intensity, min(frame) AS first_frame, max(frame) AS last_frame, arg_max(vehicle_type, step) AS vehicle_type, round(count(*) FILTER (fired)::DOUBLE/count(*), 6) AS hit_fraction "
    "FROM ob o JOIN (SELECT clip_id, track_id, max(hits) AS longest FROM rs GROUP BY ALL) l ON l.clip_id = o.clip_id AND l.track_id = o.track_id GROUP BY o.clip_id, o.track_id",
    "cameras", **{k: _GREEDY[k] for k in ("det", "st", "tr", "gv", "ob", "br", "rn", "rs")},
).replace("WITH ", "WITH RECURSIVE ", 1)


def _associated(spark, sf_dir):
    from pyspark.sql import Window

    first = Window.partitionBy("clip_id", "frame").orderBy(F.desc("confidence"), "vehicle_id", "x", "y", "w", "h", "intensity")
    # dealt by clip once, for the order within frames too
    d = A.cameras(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string")).repartition("clip_id").withColumn("det_idx", F.row_number().over(first) - 1)
    return T.associate(d.select("clip_id", F.col("frame").alias("frame_index"), "det_idx", "x", "y", "w", "h", "vehicle_type", "intensity", F.col("intensity").isNotNull().alias("fired")), dealt=True)


@query(_TRACKED)
def greedy_tracks(spark, sf_dir):
    """Tracks of clips of hundreds of frames by greedy association, with their counters."""
    return T.tracked_counters(_associated(spark, sf_dir))


@query(sql("SELECT CAST(clip_id AS VARCHAR) AS clip_id, frame AS frame_index, CAST(d AS INTEGER) AS det_idx, CAST(track_id AS INTEGER) AS track_id, CAST(step AS INTEGER) AS step FROM det JOIN gv USING (clip_id, step, d)", "cameras", **{k: _GREEDY[k] for k in ("det", "st", "tr", "gv")}).replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_assignments(spark, sf_dir):
    """The track and step of each detection."""
    return _associated(spark, sf_dir).select("clip_id", "frame_index", "det_idx", "track_id", "step")


@query(sql(f"SELECT analysis_id, count(*) FILTER (b = 'low') AS low, count(*) FILTER (b = 'moderate') AS moderate, count(*) FILTER (b = 'high') AS high, (['low','moderate','high'])[max(CASE b WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END)] AS worst, round(avg(intensity), 6) AS mean_intensity, round(avg(confidence), 6) AS mean_confidence, count(*) AS regions FROM (SELECT *, {_BAND} AS b FROM regions) GROUP BY analysis_id", "regions"))
def severity_rollup(spark, sf_dir):
    rows = A.regions(spark, sf_dir).withColumn("b", classify(F.col("intensity")))
    return rows.groupBy("analysis_id").agg(*(F.count_if(F.col("b") == s).alias(s) for s in ("low", "moderate", "high")), severity_of_rank(F.max(severity_rank(F.col("b")))).alias("worst"), F.round(F.avg("intensity"), 6).alias("mean_intensity"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("*").alias("regions"))


@query(sql(f"SELECT {_BAND} AS pipeline_band, {_STORED} AS stored_band, count(*) AS n FROM (SELECT intensity FROM regions UNION ALL SELECT unnest([0.10, 0.33, 0.50, 0.66, 0.90])) GROUP BY 1, 2", "regions"))
def band_edges(spark, sf_dir):
    """Both spellings of the bands, over regions and the edges themselves."""
    edges = spark.createDataFrame([(v,) for v in (0.10, 0.33, 0.50, 0.66, 0.90)], "intensity double")
    rows = A.regions(spark, sf_dir).select("intensity").unionByName(edges)
    v = F.col("intensity")
    return rows.groupBy(classify(v).alias("pipeline_band"), severity_for(v).alias("stored_band")).agg(F.count("*").alias("n"))


# clips of hundreds of frames, so that the limits cut
_CAMERA = f"SELECT clip_id, frame, vehicle_id, confidence, intensity, CASE WHEN intensity IS NOT NULL THEN {_BAND} END AS severity FROM cameras"


def _camera(spark, sf_dir):
    return A.cameras(spark, sf_dir).withColumn("severity", F.when(F.col("intensity").isNotNull(), classify(F.col("intensity"))))


@query(sql("SELECT clip_id, frame, worst, smoking, vehicles, confidence_sum, place FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY worst DESC, smoking DESC, vehicles DESC, confidence_sum DESC, frame) AS place FROM fr) WHERE place <= 12", "cameras", d=_CAMERA, fr=f"SELECT clip_id, frame, max(CASE WHEN intensity IS NULL THEN -1 ELSE {_RANK} END) AS worst, count(intensity) AS smoking, count(*) AS vehicles, round(sum(confidence), 4) AS confidence_sum FROM d GROUP BY 1, 2"))
def frame_interest_top(spark, sf_dir):
    return T.interesting_frames(_camera(spark, sf_dir))


@query(sql("SELECT clip_id, frame, vehicle_id, smoking, crop, mask FROM (SELECT *, cw AND count(*) FILTER (cw) OVER w <= CASE WHEN smoking THEN 150 ELSE 80 END AS crop, mw AND smoking AND count(*) FILTER (mw) OVER w <= 150 AS mask FROM (SELECT *, intensity IS NOT NULL AS smoking, vehicle_id%9 <> 0 AS cw, vehicle_id%5 <> 0 AND intensity IS NOT NULL AS mw FROM d) WINDOW w AS (PARTITION BY clip_id, smoking ORDER BY frame, vehicle_id ROWS UNBOUNDED PRECEDING)) WHERE crop OR mask", "cameras", d=_CAMERA))
def artifact_budget(spark, sf_dir):
    """Crops and masks within their budgets; every ninth crop and every fifth mask can't be written."""
    key, smoking = F.col("vehicle_id"), F.col("intensity").isNotNull()
    rows = _camera(spark, sf_dir).withColumns({"crop_written": key % 9 != 0, "mask_written": (key % 5 != 0) & smoking})
    return T.artifact_budget(rows, 150, 80, 150).select("clip_id", "frame", "vehicle_id", "smoking", "crop", "mask")


@query(sql("SELECT clip_id, frame, vehicle_id, confidence, total - least(total, 200) AS more FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame NULLS FIRST, confidence DESC, vehicle_id) AS place, count(*) OVER (PARTITION BY clip_id) AS total FROM d) WHERE place <= 200", "cameras", d=_CAMERA))
def detection_table_top(spark, sf_dir):
    """The first detections of each clip and how many more there are."""
    d = _camera(spark, sf_dir)
    totals = d.groupBy("clip_id").agg(F.count("*").alias("total"))
    top = H.top_per_group(d, ["clip_id"], [F.col("frame").asc_nulls_first(), F.desc("confidence"), F.col("vehicle_id")], 200)
    return top.join(totals, "clip_id").select("clip_id", "frame", "vehicle_id", "confidence", (F.col("total") - F.least(F.col("total"), F.lit(200))).alias("more"))


@query(sql(f"SELECT f.name, vehicles, smoking, CASE WHEN worst >= 0 THEN (['low','moderate','high'])[worst+1] ELSE '' END AS dominant FROM fs f LEFT JOIN (SELECT clip_id, frame, count(*) AS vehicles, count(intensity) AS smoking, max(CASE WHEN intensity IS NULL THEN -1 ELSE {_RANK} END) AS worst FROM d GROUP BY 1, 2) g ON g.clip_id = f.clip_id AND g.frame = CAST(regexp_extract(f.name, '_(\\d+)\\.jpg', 1) AS INTEGER)", "vehicles", "regions", **_ONE, d=_PAIR, fs="SELECT analysis_id AS clip_id, 'run' || analysis_id || '_' || (analysis_id%8) || '.jpg' AS name FROM (SELECT DISTINCT analysis_id FROM vehicles)"))
def frame_evidence(spark, sf_dir):
    """Frame files joined with their detections by the number in their name."""
    d = _detections(spark, sf_dir)
    files = d.select("clip_id").distinct().select("clip_id", F.concat(F.lit("run"), "clip_id", F.lit("_"), F.col("clip_id") % 8, F.lit(".jpg")).alias("name"))
    files = files.withColumn("frame", F.regexp_extract("name", r"_(\d+)\.jpg", 1).cast("int"))
    found = d.groupBy("clip_id", "frame").agg(F.count("*").alias("vehicles"), F.count("intensity").alias("smoking"), F.max(severity_rank(F.coalesce("severity", F.lit("")))).alias("worst"))
    got = files.join(found, ["clip_id", "frame"], "left")
    return got.select("name", "vehicles", "smoking", severity_of_rank(F.coalesce("worst", F.lit(-1))).alias("dominant"))


@query(sql("SELECT clip_id, frame, vehicle_id, 40 + CAST(floor(32*least(1.0, place::DOUBLE/total)) AS INTEGER) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame, vehicle_id) AS place, count(*) OVER (PARTITION BY clip_id) AS total FROM d)", "vehicles", "regions", **_ONE, d=_PAIR))
def running_progress(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("clip_id")
    place = F.row_number().over(w.orderBy("frame", "vehicle_id"))
    share = F.least(F.lit(1.0), place / F.count("*").over(w))
    return _detections(spark, sf_dir).select("clip_id", "frame", "vehicle_id", (40 + F.floor(32 * share)).cast("int").alias("progress"))


_WRITES = "SELECT user_id AS analysis_id, epoch_us(ts)/3.6e9::DOUBLE AS at_, CAST(event_id%101 AS INTEGER) AS percent, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id%101, event_type) AS n FROM events"


@query(
    "WITH RECURSIVE w AS (" + _WRITES + "), f AS (SELECT analysis_id, n, at_ AS last_at, percent AS last_percent, stage AS last_stage, true AS kept FROM w WHERE n = 1 UNION ALL "
    "SELECT analysis_id, n2, CASE WHEN skip THEN last_at ELSE a2 END, CASE WHEN skip THEN last_percent ELSE p2 END, CASE WHEN skip THEN last_stage ELSE s2 END, NOT skip "
    "FROM (SELECT f.*, w.at_ AS a2, w.percent AS p2, w.stage AS s2, w.n AS n2, (w.percent = last_percent AND w.stage = last_stage) OR (w.percent < 100 AND w.at_ - last_at < 0.4) AS skip FROM f JOIN w ON w.analysis_id = f.analysis_id AND w.n = f.n + 1)) "
    'SELECT analysis_id, at_ AS "at", percent, stage FROM f JOIN w USING (analysis_id, n) WHERE kept'
)
def progress_throttle(spark, sf_dir):
    """Progress writes that survive the throttle, from events as reports."""
    e = A.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("analysis_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("at"), (F.col("event_id") % 101).cast("int").alias("percent"), F.col("event_type").alias("stage"))
    return T.throttle_progress(rows)
