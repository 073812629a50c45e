"""Upload rules, deduplication, admission and the life of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import severity_for, worst_of_counts
from ..functions.settings import clamp_float, clamp_int, coerce_bool, sensitivity_threshold
from ..functions.text import FORMATS, MIN_HEADER, file_extension, sniff_format

# Public codes of failures, rates and limits.
CODES = {"no_file": "no_file", "invalid_extension": "invalid_format", "empty_file": "empty_file", "file_too_large": "file_too_large", "corrupt_file": "corrupt_file", "format_mismatch": "corrupt_file"}
FALLBACK_FPS, FRAME_FPS = 30, 25
STALE_SECONDS, MIN_STALE_SECONDS = 6 * 3600, 60
MAX_SIDE, MAX_PIXELS = 20_000, 50_000_000
TERMINAL = ("done", "failed")
ACTIVE = ("pending", "queued", "running")


def format_policy(spark) -> DataFrame:
    """The rule table of extensions: ten rows."""
    return spark.createDataFrame([(e, k, c, list(h)) for e, k, c, h in FORMATS], "extension string, kind string, canonical string, headers array<string>")


def upload_verdict(filename: Column, size: Column, header: Column, allowed: Column, max_bytes: Column) -> Column:
    """The first rule that an upload breaks, null for none; `allowed` is an array of extensions."""
    ext, sniffed = file_extension(filename), sniff_format(header)
    known = ext.isin(*(f[0] for f in FORMATS))
    fits = F.lit(False)
    for e, _, _, headers in FORMATS:
        fits = fits | ((ext == e) & sniffed.isin(*headers))
    return (
        F.when(filename.isNull(), "no_file")
        .when(ext == "", "invalid_extension")
        .when(~F.array_contains(allowed, ext) | ~known, "invalid_extension")
        .when(size.isNull(), "corrupt_file")
        .when(size <= 0, "empty_file")
        .when(size > max_bytes, "file_too_large")
        .when(F.length(header) < MIN_HEADER, "corrupt_file")
        .when(sniffed.isNull(), "corrupt_file")
        .when(~fits, "format_mismatch")
    )


def public_code(verdict: Column) -> Column:
    out = F.lit("invalid_format")
    for k, v in CODES.items():
        out = F.when(verdict == k, v).otherwise(out)
    return F.when(verdict.isNull(), None).otherwise(out)


def finite_or_zero(v: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def duration_verdict(frames: Column, fps: Column, max_seconds: Column) -> Column:
    """Whether a video is readable and short enough; without a usable rate its frames are counted."""
    n, rate = finite_or_zero(frames), finite_or_zero(fps)
    return F.when(n <= 0, "corrupt_file").when(rate > 0, F.when(n / F.when(rate > 0, rate) > max_seconds, "video_too_long")).when(n > max_seconds * FALLBACK_FPS, "video_too_long")


def sane_fps(fps: Column) -> Column:
    """The frame iterator's rate: implausible ones become 25."""
    v = finite_or_zero(fps)
    return F.when((v <= 0.1) | (v > 1000), F.lit(float(FRAME_FPS))).otherwise(v)


def image_policy(w: Column, h: Column) -> Column:
    return F.when((w > MAX_SIDE) | (h > MAX_SIDE), "side_too_long").when(w.cast("bigint") * h > MAX_PIXELS, "too_many_pixels")


def sample_frames(frames: DataFrame, rate: int = 5, max_frames: int = 300, max_seconds: float | None = None) -> DataFrame:
    """Every rate-th decoded frame of a clip up to a number and a time, ending at the third decode failure in a row.

    Failures are counted over all frames of the clip, sampled or not.
    """
    rows = frames if max_seconds is None else frames.where(F.col("seconds") <= max_seconds)
    w = Window.partitionBy("clip_id").orderBy("frame_index")
    failed = [~F.col("decoded"), *(~F.lag("decoded", k, True).over(w) for k in (1, 2))]
    rows = rows.withColumn("third_", (failed[0] & failed[1] & failed[2]).cast("int"))
    rows = rows.withColumn("ended_", F.max("third_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where((F.col("ended_") == 0) & F.col("decoded") & (F.col("frame_index") % max(1, rate) == 0))
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= max(1, max_frames)).drop("third_", "ended_")


def dedup_newest(uploads: DataFrame, present: str | None = None) -> DataFrame:
    """One row per account and checksum: the newest, which an equal upload would be given.

    present: a column that tells if the row's file still exists; a newest row without its file is no duplicate of anything.
    """
    w = Window.partitionBy("user_id", "checksum").orderBy(F.desc("uploaded_at"), F.desc("upload_id"))
    newest = uploads.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
    return newest.where(F.col(present)) if present else newest


def admit(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """At most one run in flight for each medium: the first request of a medium that has none."""
    idle = requests.join(runs.where(F.col("status").isin(*ACTIVE)).select("media_id"), "media_id", "left_anti")
    w = Window.partitionBy("media_id").orderBy("requested_at", "request_id")
    return idle.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def final_states(events: DataFrame) -> DataFrame:
    """Each job's state after its events: the earliest terminal one stands, otherwise the latest."""
    order = F.struct("ts", "event_id")
    end = F.col("state").isin(*TERMINAL)
    got = events.groupBy("job_id").agg(F.min_by(F.when(end, F.col("state")), F.when(end, order)).alias("end_"), F.max_by("state", order).alias("last_"), F.count("*").alias("events"))
    return got.select("job_id", F.coalesce("end_", "last_").alias("state"), "events")


def recovery_verdict(owner_host: Column, owner_boot: Column, alive: Column, age_seconds: Column, host: str, boot: str, stale: int = STALE_SECONDS) -> Column:
    """Whether a job in flight may be failed after a restart, and why."""
    stale = max(MIN_STALE_SECONDS, stale)
    return (
        F.when(owner_host.isNull() & owner_boot.isNull(), "fail:unclaimed")
        .when(owner_boot == boot, "keep:own")
        .when(owner_host != host, F.when(age_seconds > stale, "fail:stale").otherwise("keep:other_host"))
        .when(alive.isNull(), "fail:unknown")
        .when(alive, "keep:alive")
        .otherwise("fail:gone")
    )


def survivors(users: DataFrame, media: DataFrame, runs: DataFrame, vehicles: DataFrame, regions: DataFrame, reports: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after accounts are deleted with everything that hangs on them. gone: user_id."""
    media = media.join(gone, "user_id", "left_anti")
    dead = runs.join(gone, "user_id", "left_semi").select("analysis_id")
    runs = runs.join(gone, "user_id", "left_anti")
    lost = vehicles.join(dead, "analysis_id", "left_semi").select("vehicle_id")
    return {"users": users.join(gone, "user_id", "left_anti"), "media": media, "runs": runs, "vehicles": vehicles.join(dead, "analysis_id", "left_anti"), "regions": regions.join(lost, "vehicle_id", "left_anti"), "reports": reports.join(dead, "analysis_id", "left_anti")}


def reband(runs: DataFrame, regions: DataFrame, settings: DataFrame) -> DataFrame:
    """Counts under the live bands beside the frozen verdict, and whether they differ. settings is one row."""
    bands = settings.select("severity_low_max", "severity_moderate_max")
    rows = regions.join(F.broadcast(bands)).withColumn("band", severity_for(F.col("intensity"), F.col("severity_low_max"), F.col("severity_moderate_max")))
    counts = rows.groupBy("analysis_id").agg(*(F.count_if(F.col("band") == b).alias(b) for b in ("low", "moderate", "high")))
    out = runs.join(counts, "analysis_id", "left").fillna(0, ["low", "moderate", "high"])
    live = worst_of_counts(F.col("low"), F.col("moderate"), F.col("high"))
    return out.withColumn("live_severity", live).withColumn("drift", live != F.col("overall_severity"))


def overlay(overrides: DataFrame, settings: DataFrame) -> DataFrame:
    """Run settings: overrides of strings over the live row, junk ignored, then clamped."""
    rows = overrides.join(F.broadcast(settings))
    mask = F.coalesce(sensitivity_threshold(F.col("sensitivity")), F.col("smoke_mask_threshold"))
    return rows.select(
        "run_id",
        clamp_float(F.coalesce(F.col("confidence").try_cast("double"), F.col("confidence_threshold")), 0.05, 0.95, 0.35).alias("confidence_threshold"),
        clamp_int(F.coalesce(F.col("rate").try_cast("double"), F.col("frame_sample_rate").cast("double")), 1, 60, 5).alias("frame_sample_rate"),
        F.round(clamp_float(mask, 0.05, 0.95, 0.5), 6).alias("smoke_mask_threshold"),
        F.coalesce(coerce_bool(F.col("pdf")), F.col("auto_generate_pdf")).alias("auto_generate_pdf"),
    )


def settings_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Fields whose values differ, one row each."""
    fields = [c for c in old.columns if c != key]
    wide = lambda df, name: df.select(key, *(F.col(c).cast("string").alias(c) for c in fields)).unpivot([key], fields, "field", name)
    both = wide(old, "before").join(wide(new, "after"), [key, "field"])
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def throttled(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Requests beyond a limit in the sliding window before them, by client and scope."""
    w = Window.partitionBy("client", "scope").orderBy(F.col("at")).rangeBetween(-seconds, 0)
    return requests.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= limit)


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Reset tokens with their state: only an account's newest may be valid, once and before it expires."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("token_id"))
    rows = tokens.withColumn("newest", F.row_number().over(w) == 1)
    state = F.when(F.col("used"), "used").when(~F.col("newest"), "superseded").when(F.col("expires_at") <= now, "expired").otherwise("valid")
    return rows.withColumn("state", state)


# Failures that have a public text of their own, by class, and its topic.
FAILURES = {"MLPipelineError": "media", "MediaError": "media", "FileNotFoundError": "missing", "PermissionError": "permission", "MemoryError": "memory", "ModuleNotFoundError": "engine", "ImportError": "engine", "OperationalError": "busy", "DatabaseError": "storage", "OSError": "files"}


def failure_topic(classes: Column) -> Column:
    """The topic of the first class, from the raised one up its bases, that has one."""
    topics = F.create_map(*(F.lit(x) for pair in FAILURES.items() for x in pair))
    found = F.filter(F.transform(classes, lambda c: F.try_element_at(topics, c)), lambda t: t.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit("unexpected"))


def claims(attempts: DataFrame) -> DataFrame:
    """Attempts to claim jobs: the first of each queued job wins and changes one row, others change none.

    attempts has job_id, ts, attempt_id and status, the job's state before all attempts.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "attempt_id")
    return attempts.withColumn("rows_affected", ((F.row_number().over(w) == 1) & (F.col("status") == "queued")).cast("int"))


def settings_update(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial updates of the bands checked against the live row: ranges, then low below moderate."""
    rows = patches.join(F.broadcast(current.select("severity_low_max", "severity_moderate_max")))
    low, moderate = F.coalesce("low", "severity_low_max"), F.coalesce("moderate", "severity_moderate_max")
    range_ok = lambda v: v.isNull() | v.between(0.0, 1.0)
    error = F.when(~range_ok(F.col("low")), "low_out_of_range").when(~range_ok(F.col("moderate")), "moderate_out_of_range").when(low >= moderate, "low_not_below_moderate")
    return rows.select("patch_id", error.alias("error"), low.alias("low_max"), moderate.alias("moderate_max"))


# The fields of the settings form with their bounds, and the formats that can be decoded.
WHOLE_FIELDS = {"max_upload_mb": (1, 4096), "max_video_seconds": (1, 3600), "frame_sample_rate": (1, 60)}
SHARE_FIELDS = ("confidence_threshold", "smoke_mask_threshold", "severity_low_max", "severity_moderate_max")
FORMAT_FIELDS = {"allowed_image_formats": ("jpg", "jpeg", "png", "bmp", "webp"), "allowed_video_formats": ("mp4", "mov", "avi", "mkv", "webm")}
FORM = ("allowed_image_formats", "allowed_video_formats", "max_upload_mb", "confidence_threshold", "smoke_mask_threshold", "severity_low_max", "severity_moderate_max", "frame_sample_rate", "auto_generate_pdf", "max_video_seconds")


def _checked(field: str, raw: Column) -> tuple[Column, Column]:
    """What is wrong with a field's value, null for nothing, and the value as it is stored."""
    if field in FORMAT_FIELDS:
        tokens = F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.regexp_replace(F.trim(x), r"^\.+", ""))), lambda x: x != ""))
        known = F.array(*map(F.lit, FORMAT_FIELDS[field]))
        bad = F.exists(tokens, lambda x: ~x.rlike("^[a-z0-9]{2,5}$"))
        error = F.when(F.size(tokens) == 0, "empty").when(bad, "bad_token").when(F.size(F.array_except(tokens, known)) > 0, "unsupported")
        return error, F.array_join(tokens, ",")
    if field == "auto_generate_pdf":
        flag = coerce_bool(raw)
        return F.when(flag.isNull(), "not_a_boolean"), flag.cast("string")
    if field in WHOLE_FIELDS:
        low, high = WHOLE_FIELDS[field]
        value = F.when(F.trim(raw).rlike(r"^[+-]?[0-9]{1,15}(\.0*)?$"), F.regexp_replace(F.trim(raw), r"\..*", "").cast("bigint"))
    else:
        low, high = 0.0, 1.0
        value = F.trim(raw).try_cast("double")
        value = F.when(~F.isnan(value), value)
    return F.when(value.isNull(), "not_a_number").when(~value.between(low, high), "out_of_range"), value.cast("string")


def settings_patch(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial updates of all fields of the form, checked against the live row: errors by field, or what changes.

    patches: patch_id, patch (a map of strings; a null value is an error, unknown keys are passed over).
    Fields that aren't sent keep their values. The bands are compared when every field is right, with the
    live value for the one that isn't sent. With an error nothing changes.
    """
    fields = [c for c in FORM if c in current.columns]
    rows = patches.join(F.broadcast(current.select(*(F.col(c).cast("string").alias(f"old_{c}") for c in fields))))  # one row
    sent = {c: F.map_contains_key("patch", F.lit(c)) for c in fields}
    checks = {c: _checked(c, F.element_at("patch", F.lit(c))) for c in fields}
    error = {c: F.when(sent[c], F.when(F.element_at("patch", F.lit(c)).isNull(), "null").otherwise(checks[c][0])) for c in fields}
    rows = rows.select("patch_id", *(error[c].alias(f"error_{c}") for c in fields), *(F.when(sent[c], checks[c][1]).alias(f"new_{c}") for c in fields), *(f"old_{c}" for c in fields))
    wrong = F.array_compact(F.array(*(F.when(F.col(f"error_{c}").isNotNull(), F.struct(F.lit(c).alias("field"), F.col(f"error_{c}").alias("code"))) for c in fields)))
    low, moderate = (F.coalesce(f"new_severity_{b}_max", f"old_severity_{b}_max").try_cast("double") for b in ("low", "moderate"))
    crossed = F.array(F.struct(F.lit("severity_low_max").alias("field"), F.lit("not_below_moderate").alias("code")))
    errors = F.when(F.size(wrong) > 0, wrong).when(low >= moderate, crossed).otherwise(wrong)
    kept = F.array_compact(F.array(*(F.when(F.col(f"new_{c}") != F.col(f"old_{c}"), F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("before"), F.col(f"new_{c}").alias("after"))) for c in fields)))
    rows = rows.select("patch_id", errors.alias("errors"), kept.alias("changes"))
    return rows.withColumn("changes", F.when(F.size("errors") == 0, F.col("changes")).otherwise(F.slice("changes", 1, 0)))


def live_sessions(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Tokens with whether they are refused: issued before the account's password changed, or without a time of issue then."""
    rows = tokens.join(users.select("user_id", "password_changed_at"), "user_id", "left")
    refused = F.col("password_changed_at").isNotNull() & (F.col("issued_at").isNull() | (F.col("issued_at") < F.col("password_changed_at")))
    return rows.withColumn("refused", refused)


def artifact_paths(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """All paths that hang on runs: their folders and their reports' files."""
    folders = runs.select("analysis_id", F.concat(F.lit("artifacts/"), "analysis_id").alias("path"))
    files = reports.join(runs.select("analysis_id"), "analysis_id", "left_semi").select("analysis_id", F.concat(F.lit("reports/"), "report_id", F.lit(".pdf")).alias("path"))
    return folders.unionByName(files)
