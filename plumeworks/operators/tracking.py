"""Steps, tracks, persistence and verdicts of clips."""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..functions.severity import severity_of_rank, severity_rank

# Fixed values of association and persistence.
MIN_IOU, GAP = 0.3, 2
MIN_HITS, MIN_RUN, MIN_FRACTION = 4, 3, 0.30
# Fixed values of progress writes: the longest stage, states in which a run has ended, and seconds between writes.
STAGE_LENGTH, ENDED, GAP_SECONDS = 50, ("done", "failed"), 0.4


def step_index(detections: DataFrame, clip: str = "clip_id", frame: str = "frame_index") -> DataFrame:
    """Number a clip's frames that have detections, from 1; empty frames have no step."""
    return detections.withColumn("step", F.dense_rank().over(Window.partitionBy(clip).orderBy(frame)).cast("bigint"))


def islands(rows: DataFrame, by: list[str], order: list[Column], flag: Column) -> DataFrame:
    """Number the runs of rows with an equal flag, by gaps and islands."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    within = F.row_number().over(Window.partitionBy(*by, flag).orderBy(*order))
    return rows.withColumn("island", place - within)


def track_counters(observations: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Observations, hits, longest run, peak, span and latest type of tracks whose rows are all consecutive steps."""
    keys = [key] if isinstance(key, str) else key
    rows = islands(observations, keys, [F.col(c) for c in order], F.col("fired"))
    runs = rows.groupBy(*keys, "fired", "island").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("fired"), F.col("intensity"))).alias("peak"),
        F.min(F.struct(*order)).alias("first_"),
        F.max(F.struct(*order)).alias("last_"),
        F.max_by("vehicle_type", F.struct(*order)).alias("type_"),
    )
    got = runs.groupBy(*keys).agg(
        F.sum("n").alias("observations"),
        F.coalesce(F.sum(F.when(F.col("fired"), F.col("n"))), F.lit(0)).alias("hits"),
        F.coalesce(F.max(F.when(F.col("fired"), F.col("n"))), F.lit(0)).alias("longest_run"),
        F.coalesce(F.max("peak"), F.lit(0.0)).alias("peak_intensity"),
        F.min("first_")[order[0]].alias("first_seen"),
        F.max("last_")[order[0]].alias("last_seen"),
        F.max_by("type_", "last_").alias("vehicle_type"),
    )
    return got.withColumn("hit_fraction", F.round(F.when(F.col("observations") > 0, F.col("hits") / F.col("observations")).otherwise(0.0), 6))


def persistent() -> Column:
    return (F.col("hits") >= MIN_HITS) & (F.col("longest_run") >= MIN_RUN) & (F.col("hit_fraction") >= MIN_FRACTION)


def gap_sessions(rows: DataFrame, key: str, at: Column, gap: Column, order: list[Column]) -> DataFrame:
    """Number sessions: a new one begins where the step from the row before exceeds the gap."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("new_", new).withColumn("session", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def overlap(a, b) -> float:
    """Intersection over union of two (x, y, w, h), 0 for unreadable boxes."""
    if a is None or b is None or any(v is None or not math.isfinite(v) for v in (*a, *b)) or min(a[2], a[3], b[2], b[3]) <= 0:
        return 0.0
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def readable(b) -> bool:
    if b is None or None in b:
        return False
    x, y, w, h = b
    return math.isfinite(x) and math.isfinite(y) and math.isfinite(w) and math.isfinite(h) and w > 0 and h > 0


class Tracker:
    """Greedy association of one clip's detections with live tracks; tracks beyond the gap are counted and dropped."""

    def __init__(self, tracks: list[dict] | None = None, step: int = 0, count: int = 0):
        self.tracks, self.step, self.count = tracks or [], step, count

    def update(self, boxes: list) -> list[int]:
        """The track of each detection of a frame that has some, in detection order."""
        self.step += 1
        live = self.tracks = [t for t in self.tracks if self.step - t["last"] <= GAP]
        seen = [tuple(b) if readable(b) else None for b in boxes]
        pairs = []
        if live:
            # what overlap() gives, with each box checked once; a track's box is readable or None
            held = [(k, x, y, x + w, y + h, w * h) for k, t in enumerate(live) if t["box"] is not None for x, y, w, h in (t["box"],)]
            for d, b in enumerate(seen):
                if b is None:
                    continue
                x, y, w, h = b
                right, low, area = x + w, y + h, w * h
                for k, tx, ty, tright, tlow, tarea in held:
                    across = (right if right < tright else tright) - (x if x > tx else tx)
                    if across > 0:
                        down = (low if low < tlow else tlow) - (y if y > ty else ty)
                        if down > 0 and (v := across * down / (area + tarea - across * down)) >= MIN_IOU:
                            pairs.append((-v, d, k))
            pairs.sort()
        taken, given = {}, set()
        for _, d, k in pairs:
            if d not in taken and k not in given:
                taken[d] = live[k]
                given.add(k)
        out = []
        for d, b in enumerate(seen):
            t = taken.get(d)
            if t is None:
                self.count += 1
                t = {"id": self.count, "box": None, "last": 0}
                self.tracks.append(t)
            t["last"] = self.step
            if b is not None:
                t["box"] = b
            out.append(t["id"])
        return out


def _fold_clips(batches):
    """Association over rows sorted by clip, frame and detection; a clip and a frame may span batches."""
    tracker, clip, open_ = Tracker(), object(), None

    def tracked(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal tracker, clip
        ids, steps = [], []
        columns = [batch.column(c).to_pylist() for c in ("clip_id", "frame_index", *"xywh")]
        for (c, _), rows in groupby(zip(*columns, strict=True), key=itemgetter(0, 1)):
            if c != clip:
                tracker, clip = Tracker(), c
            got = tracker.update([None if r[2] is None else r[2:] for r in rows])
            ids += got
            steps += [tracker.step] * len(got)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32()), pa.array(steps, pa.int32())], [*batch.schema.names, "track_id", "step"])

    for batch in batches:
        if open_ is not None:
            batch = pa.concat_batches([open_, batch])
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        clips, frames = batch.column("clip_id"), batch.column("frame_index")
        whole = next((i + 1 for i in range(last - 1, -1, -1) if frames[i].as_py() != frames[last].as_py() or clips[i].as_py() != clips[last].as_py()), 0)
        open_ = batch.slice(whole)
        if whole:
            yield tracked(batch.slice(0, whole))
    if open_ is not None and open_.num_rows:
        yield tracked(open_)


def associate(detections: DataFrame, dealt: bool = False) -> DataFrame:
    """Each detection, all its columns with it, with its track and step; clips are folded in frame order, one state a clip in memory.

    detections: clip_id, frame_index, det_idx (rank by confidence), x, y, w, h, and others.
    dealt: a clip's rows are in one partition already.
    """
    rows = detections.withColumns({"frame_index": F.col("frame_index").cast("bigint"), "det_idx": F.col("det_idx").cast("int"), **{c: F.col(c).cast("double") for c in "xywh"}})
    schema = rows.withColumns({"track_id": F.lit(0), "step": F.lit(0)}).schema
    return (rows if dealt else rows.repartition("clip_id")).sortWithinPartitions("clip_id", "frame_index", "det_idx").mapInArrow(_fold_clips, schema)


def tracked_counters(tracked: DataFrame) -> DataFrame:
    """Counters of associated tracks; a run is broken by a missed step too.

    tracked: clip_id, track_id, step, frame_index, fired, intensity, vehicle_type.
    """
    w = Window.partitionBy("clip_id", "track_id").orderBy("step")
    breaks = (~F.col("fired")) | (F.col("step") - F.lag("step").over(w) != 1)
    rows = tracked.withColumn("brk", F.coalesce(breaks, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("clip_id", "track_id", "run").agg(
        F.count("*").alias("n"), F.count_if("fired").alias("hits"), F.max(F.when(F.col("fired"), F.coalesce("intensity", F.lit(0.0)))).alias("peak"), F.min("frame_index").alias("first_"), F.max("frame_index").alias("last_"), F.max_by("vehicle_type", "step").alias("type_")
    )
    got = runs.groupBy("clip_id", "track_id").agg(
        F.sum("n").alias("observations"), F.sum("hits").alias("hits"), F.max("hits").alias("longest_run"), F.coalesce(F.max("peak"), F.lit(0.0)).alias("peak_intensity"), F.min("first_").alias("first_frame"), F.max("last_").alias("last_frame"), F.max_by("type_", "last_").alias("vehicle_type")
    )
    return got.withColumn("hit_fraction", F.round(F.when(F.col("observations") > 0, F.col("hits") / F.col("observations")).otherwise(0.0), 6))


def clip_verdict(detections: DataFrame, tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a clip: smoke, confirmed tracks, discarded regions, severity or 'none'.

    detections: clip_id, confidence, intensity (null: no region), severity; tracks: clip_id and the counters;
    frames: clip_id, frames_processed. One persistent track keeps every region of its clip, none discards
    all; the rule is off for clips of one frame.
    """
    confirmed = tracks.where(persistent()).groupBy("clip_id").agg(F.count("*").alias("confirmed_tracks"))
    region = F.col("intensity").isNotNull()
    got = detections.groupBy("clip_id").agg(
        F.count("*").alias("total_vehicles"), F.count_if(region).alias("regions"), F.max(F.when(region, severity_rank(F.col("severity")))).alias("worst"), F.avg(F.when(region, F.col("intensity"))).alias("mean_"), F.avg("confidence").alias("confidence_")
    )
    rows = frames.join(got, "clip_id", "left").join(confirmed, "clip_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumn("applied", F.col("frames_processed") > 1)
    dropped = F.col("applied") & (zero("regions") > 0) & (zero("confirmed_tracks") == 0)
    rows = rows.withColumn("dropped", dropped)
    kept = F.when(F.col("dropped"), F.lit(0)).otherwise(zero("regions"))
    return rows.select(
        "clip_id",
        zero("total_vehicles").alias("total_vehicles"),
        kept.alias("total_smoke"),
        zero("confirmed_tracks").alias("confirmed_tracks"),
        F.when(F.col("dropped"), zero("regions")).otherwise(F.lit(0)).alias("discarded_regions"),
        F.when(kept > 0, severity_of_rank(F.col("worst"), "low")).otherwise("none").alias("overall_severity"),
        F.round(F.when(kept > 0, F.col("mean_")).otherwise(0.0), 6).alias("mean_intensity"),
        F.round(F.coalesce("confidence_", F.lit(0.0)), 6).alias("avg_confidence"),
        "applied",
    )


def iou_pairs(detections: DataFrame, cell: int = 256) -> DataFrame:
    """Candidate pairs of a clip's detections that overlap enough and are no more than GAP steps apart.

    A detection goes to each cell of a grid that its box touches, so that a crowded frame is dealt by cells
    and boxes far apart never meet; a pair counts in the cell of its intersection's upper left corner alone.
    Boxes with missing fields or empty sides overlap nothing. cell: side of a cell in pixels.
    """
    rows = step_index(detections, "clip_id", "frame").where("x + y is not null and w > 0 and h > 0")
    touched = lambda at, side: F.explode(F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(side)) / cell)))
    rows = rows.withColumn("cx", touched("x", "w")).withColumn("cy", touched("y", "h"))
    rows = rows.select("clip_id", "step", "cx", "cy", "frame", "vehicle_id", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    left = rows.select("clip_id", "step", "cx", "cy", F.col("frame").alias("f1"), F.col("vehicle_id").alias("v1"), F.col("box").alias("a"))
    # each later detection waits at the steps before it
    right = rows.select("clip_id", F.explode(F.sequence(F.col("step") - GAP, F.col("step") - 1)).alias("step"), "cx", "cy", F.col("frame").alias("f2"), F.col("vehicle_id").alias("v2"), F.col("box").alias("b"))
    corner = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell)
    met = left.join(right, ["clip_id", "step", "cx", "cy"]).where((corner("x") == F.col("cx")) & (corner("y") == F.col("cy"))).withColumn("overlap", iou(F.col("a"), F.col("b")))
    return met.where(F.col("overlap") >= MIN_IOU).select("clip_id", "f1", "v1", "f2", "v2", F.round("overlap", 6).alias("overlap"))


def interesting_frames(detections: DataFrame, k: int = 12) -> DataFrame:
    """A clip's k frames that rank first by worst severity, smoking, vehicles and confidence."""
    region = F.col("intensity").isNotNull()
    frames = detections.groupBy("clip_id", "frame").agg(F.max(F.coalesce(F.when(region, severity_rank(F.col("severity"))), F.lit(-1))).alias("worst"), F.count_if(region).alias("smoking"), F.count("*").alias("vehicles"), F.round(F.sum("confidence"), 4).alias("confidence_sum"))
    order = Window.partitionBy("clip_id").orderBy(F.desc("worst"), F.desc("smoking"), F.desc("vehicles"), F.desc("confidence_sum"), "frame")
    return frames.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)


def artifact_budget(detections: DataFrame, smoking_cap: int, clean_cap: int, mask_cap: int) -> DataFrame:
    """Detections whose crop or mask is kept: the first of each class in scan order that can be written.

    detections: clip_id, frame, vehicle_id, intensity (null: clean), crop_written and mask_written (false: there
    is none, or writing fails, which uses nothing of the budget).
    """
    smoking = F.col("intensity").isNotNull()
    upto = Window.partitionBy("clip_id", "smoking").orderBy("frame", "vehicle_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = detections.withColumn("smoking", smoking).withColumns({"crops": F.count_if("crop_written").over(upto), "masks": F.count_if("mask_written").over(upto)})
    crop = F.coalesce("crop_written", F.lit(False)) & (F.col("crops") <= F.when(F.col("smoking"), smoking_cap).otherwise(clean_cap))
    mask = F.coalesce("mask_written", F.lit(False)) & F.col("smoking") & (F.col("masks") <= mask_cap)
    return rows.withColumns({"crop": crop, "mask": mask}).where("crop or mask").drop("crops", "masks")


def throttle_progress(events: DataFrame, gap: float = GAP_SECONDS) -> DataFrame:
    """Progress writes of each run: repeats are dropped, and writes within the gap unless they complete it.

    Percents are held within 0 and 100 and stages cut before they are compared. With a column
    `status`, what comes when the run has ended changes nothing, though it counts as written. Whether a
    write is within the gap depends on the last one that was made, so a run's writes are folded in order,
    of time, percent and then the other columns.
    """
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("percent", F.lit(0)))).cast(events.schema["percent"].dataType)
    rows = events.withColumns({"percent": percent, "stage": F.substring(F.coalesce("stage", F.lit("")), 1, STAGE_LENGTH)})
    others = [c for c in rows.columns if c not in ("analysis_id", "at", "percent")]
    writes = rows.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("at", "percent", *others))).alias("writes"))
    ended = lambda w: F.coalesce(w["status"].isin(*ENDED), F.lit(False)) if "status" in others else F.lit(False)
    kind = writes.schema["writes"].dataType.elementType
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(writes.schema["writes"].dataType).alias("kept"))

    def step(a: Column, w: Column) -> Column:
        last = a["last"]
        repeat = (w["percent"] == last["percent"]) & (w["stage"] == last["stage"])
        soon = (w["percent"] < 100) & (w["at"] - last["at"] < gap)
        skip = F.coalesce(repeat, F.lit(False)) | F.coalesce(soon, F.lit(False))
        return F.struct(F.when(skip, last).otherwise(w).alias("last"), F.when(skip | ended(w), a["kept"]).otherwise(F.concat(a["kept"], F.array(w))).alias("kept"))

    kept = writes.select("analysis_id", F.explode(F.aggregate("writes", start, step, lambda a: a["kept"])).alias("w"))
    return kept.select(*(F.col(c) if c == "analysis_id" else F.col(f"w.{c}") for c in rows.columns))


# The detector's classes.
CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}


def detector_output(raw: DataFrame, frame_w: int, frame_h: int, threshold: float) -> DataFrame:
    """Raw corner boxes as detections: known classes over a score, clamped to the frame, ranked by confidence."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair)), F.col("class_id"))
    edge = lambda c, most: F.greatest(F.lit(0), F.least(F.bround(F.col(c)).cast("int"), F.lit(most - 1)))
    rows = raw.where(F.col("class_id").isin(*CLASSES) & (F.col("score") >= threshold))
    rows = rows.select("clip_id", "frame_index", "raw_id", kind.alias("vehicle_type"), F.round("score", 4).alias("confidence"), edge("x1", frame_w).alias("x"), edge("y1", frame_h).alias("y"), "x2", "y2")
    side = lambda c, at, most: F.greatest(F.lit(1), F.least(F.bround(F.col(c)).cast("int") - F.col(at), F.lit(most) - F.col(at)))
    rows = rows.withColumn("w", side("x2", "x", frame_w)).withColumn("h", side("y2", "y", frame_h)).drop("x2", "y2")
    place = F.row_number().over(Window.partitionBy("clip_id", "frame_index").orderBy(F.desc("confidence"), "raw_id"))
    return rows.withColumn("det_idx", (place - 1).cast("bigint"))


def preview_frames(detections: DataFrame, verdicts: DataFrame, k: int = 12) -> DataFrame:
    """The interesting frames after clips lost their discarded regions; the first is the preview."""
    lost = verdicts.where("discarded_regions > 0").select("clip_id", F.lit(True).alias("lost"))
    rows = detections.join(lost, "clip_id", "left")
    gone = F.coalesce("lost", F.lit(False))
    rows = rows.withColumn("intensity", F.when(~gone, F.col("intensity"))).withColumn("severity", F.when(~gone, F.col("severity")))
    return interesting_frames(rows.drop("lost"), k)
