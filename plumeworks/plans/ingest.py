"""Upload policy, deduplication, admission, job life and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import letterbox, smoothstep, unletterbox
from ..functions.settings import clamp_float, clamp_int, coerce_bool, normalise_formats, sensitivity_threshold
from ..functions.text import moment, percent, seconds, sniff_format, truncate
from ..operators import ingest as I
from ..sources import adapters as A
from .base import query
from .views import sql

# headers by document: a signature of each kind, some of them short or strange
_HEADERS = ("FFD8FFE000104A46494600010100000100010000", "89504E470D0A1A0A0000000D4948445200000010", "524946462400000041564920000000004C495354", "52494646240000005745425056503820FFFFFFFF", "1A45DFA3010000000000001F4286810142F78101", "424D3600000000000000360000002800000001000000", "0000001866747970697361360000000069736F36", "000000086D6F6F76000000000000000000000000", "00112233445566778899AABBCCDDEEFF00112233", "FFD8FFE0", "424D36000000000000003600000099000000", "524946462400000058585858000000004C495354")
_NAMES = ("clip.jpg", "Clip.PNG", "clip.avi", "clip.webp", "clip.mkv", "clip.bmp", "clip.mp4", "clip.mov", "clip.txt", "clip", "archive.tar.jpg", "clip.webm")
_LIST = "[" + ",".join(f"'{h}'" for h in _HEADERS) + "]"
_NLIST = "[" + ",".join(f"'{n}'" for n in _NAMES) + "]"
_UPLOADS = f"SELECT doc_id AS upload_id, CASE WHEN doc_id%29 = 0 THEN NULL ELSE ({_NLIST})[doc_id*7%12 + 1] END AS filename, CASE WHEN doc_id%31 = 0 THEN NULL WHEN doc_id%23 = 0 THEN 0 ELSE n_chars*400 END AS size_bytes, ({_LIST})[(doc_id*7 + CASE WHEN doc_id%5 = 0 THEN doc_id ELSE 0 END)%12 + 1] AS hex FROM documents"


def _uploads(spark, sf_dir):
    k = F.col("doc_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % 12 + 1).cast("int"))
    return A.table(spark, sf_dir, "documents").select(
        k.alias("upload_id"),
        F.when(k % 29 == 0, None).otherwise(pick(_NAMES, k * 7)).alias("filename"),
        F.when(k % 31 == 0, None).when(k % 23 == 0, 0).otherwise(F.col("n_chars") * 400).alias("size_bytes"),
        F.unhex(pick(_HEADERS, k * 7 + F.when(k % 5 == 0, k).otherwise(0))).alias("header"),
    )


_AT = "substring(hex, {} , {})".format
_SNIFF = f"CASE WHEN length(hex) < 24 THEN NULL WHEN {_AT(1, 6)} = 'FFD8FF' THEN 'jpeg' WHEN {_AT(1, 16)} = '89504E470D0A1A0A' THEN 'png' WHEN {_AT(1, 8)} = '52494646' THEN CASE WHEN {_AT(17, 8)} = '41564920' THEN 'avi' WHEN {_AT(17, 8)} = '57454250' THEN 'webp' END WHEN {_AT(1, 8)} = '1A45DFA3' THEN 'matroska' WHEN {_AT(1, 4)} = '424D' AND length(hex) >= 36 THEN CASE WHEN {_AT(29, 8)} IN ('0C000000','10000000','28000000','34000000','38000000','40000000','6C000000','7C000000') THEN 'bmp' END WHEN {_AT(9, 8)} = '66747970' THEN 'isobmff' WHEN {_AT(9, 8)} IN ('6D6F6F76','6D646174','66726565','736B6970','77696465','706E6F74') THEN 'quicktime' END"
_EXT = "CASE WHEN contains(filename, '.') THEN lower(list_last(string_split(filename, '.'))) ELSE '' END"
_FITS = "(ext IN ('jpg','jpeg') AND sniffed = 'jpeg') OR (ext = 'png' AND sniffed = 'png') OR (ext = 'bmp' AND sniffed = 'bmp') OR (ext = 'webp' AND sniffed = 'webp') OR (ext = 'mp4' AND sniffed = 'isobmff') OR (ext = 'mov' AND sniffed IN ('isobmff','quicktime')) OR (ext = 'avi' AND sniffed = 'avi') OR (ext IN ('mkv','webm') AND sniffed = 'matroska')"
_VERDICT = f"CASE WHEN filename IS NULL THEN 'no_file' WHEN ext = '' THEN 'invalid_extension' WHEN ext NOT IN ('jpg','jpeg','png','mp4','mov','avi','webp','bmp') THEN 'invalid_extension' WHEN size_bytes IS NULL THEN 'corrupt_file' WHEN size_bytes <= 0 THEN 'empty_file' WHEN size_bytes > 2000000 THEN 'file_too_large' WHEN length(hex) < 24 THEN 'corrupt_file' WHEN sniffed IS NULL THEN 'corrupt_file' WHEN NOT coalesce({_FITS}, false) THEN 'format_mismatch' END"


@query(sql("SELECT upload_id, verdict, CASE verdict WHEN 'no_file' THEN 'no_file' WHEN 'invalid_extension' THEN 'invalid_format' WHEN 'format_mismatch' THEN 'corrupt_file' ELSE verdict END AS code FROM v", u=_UPLOADS, s=f"SELECT *, {_EXT} AS ext, {_SNIFF} AS sniffed FROM u", v=f"SELECT upload_id, {_VERDICT} AS verdict FROM s"))
def upload_validation(spark, sf_dir):
    allowed = F.array(*map(F.lit, ("jpg", "jpeg", "png", "mp4", "mov", "avi", "webp", "bmp")))
    v = I.upload_verdict(F.col("filename"), F.col("size_bytes"), F.col("header"), allowed, F.lit(2_000_000))
    return _uploads(spark, sf_dir).withColumn("verdict", v).select("upload_id", "verdict", I.public_code(F.col("verdict")).alias("code"))


@query(sql(f"SELECT upload_id, {_SNIFF} AS sniffed FROM u", u=_UPLOADS))
def sniffed_formats(spark, sf_dir):
    return _uploads(spark, sf_dir).select("upload_id", sniff_format(F.col("header")).alias("sniffed"))


@query(sql("SELECT d.upload_id, k.kind, k.canonical FROM (SELECT upload_id, " + _EXT + " AS ext FROM u) d JOIN (VALUES ('jpg','image','jpg'),('jpeg','image','jpg'),('png','image','png'),('bmp','image','bmp'),('webp','image','webp'),('mp4','video','mp4'),('mov','video','mov'),('avi','video','avi'),('mkv','video','mkv'),('webm','video','webm')) AS k(extension, kind, canonical) ON ext = extension", u=_UPLOADS))
def format_policies(spark, sf_dir):
    from ..functions.text import file_extension

    rows = _uploads(spark, sf_dir).select("upload_id", file_extension(F.col("filename")).alias("extension"))
    return rows.join(F.broadcast(I.format_policy(spark)), "extension").select("upload_id", "kind", "canonical")  # ten rules


_VIDEO = "SELECT event_id, CASE WHEN event_id%19 = 0 THEN 0 ELSE event_id%12000 END AS frames, CASE WHEN event_id%3 = 0 THEN NULL WHEN event_id%7 = 0 THEN 'nan'::DOUBLE WHEN event_id%11 = 0 THEN 'inf'::DOUBLE WHEN event_id%13 = 0 THEN -5 ELSE 1.0::DOUBLE + event_id%60 END AS fps FROM events"


@query(sql("SELECT event_id, CASE WHEN frames <= 0 THEN 'corrupt_file' WHEN r > 0 THEN CASE WHEN frames/r > 300 THEN 'video_too_long' END WHEN frames > 9000 THEN 'video_too_long' END AS verdict, CASE WHEN r <= 0.1 OR r > 1000 THEN 25.0::DOUBLE ELSE r END AS fps FROM w", v=_VIDEO, w="SELECT event_id, frames, CASE WHEN fps IS NULL OR isnan(fps) OR isinf(fps) THEN 0.0::DOUBLE ELSE fps END AS r FROM v"))
def duration_policy(spark, sf_dir):
    k = F.col("event_id")
    fps = F.when(k % 3 == 0, None).when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).when(k % 13 == 0, -5.0).otherwise(1.0 + k % 60)
    rows = A.table(spark, sf_dir, "events").select(k, F.when(k % 19 == 0, 0).otherwise(k % 12000).alias("frames"), fps.alias("fps"))
    return rows.select("event_id", I.duration_verdict(F.col("frames"), F.col("fps"), F.lit(300)).alias("verdict"), I.sane_fps(F.col("fps")).alias("fps"))


_FRAMES = "SELECT user_id AS clip_id, frame_index, frame_index/8.0::DOUBLE AS seconds, NOT (event_type = 'error') AS decoded FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index FROM events)"


@query(
    sql(
        "SELECT clip_id, frame_index, place FROM (SELECT clip_id, frame_index, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS place FROM e WHERE ended = 0 AND decoded AND frame_index%2 = 0) WHERE place <= 20",
        f=_FRAMES,
        s="SELECT *, CASE WHEN NOT decoded AND NOT lag(decoded, 1, TRUE) OVER (PARTITION BY clip_id ORDER BY frame_index) AND NOT lag(decoded, 2, TRUE) OVER (PARTITION BY clip_id ORDER BY frame_index) THEN 1 ELSE 0 END AS third FROM f WHERE seconds <= 8",
        e="SELECT *, max(third) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS ended FROM s",
    )
)
def frame_sampler(spark, sf_dir):
    from pyspark.sql import Window

    e = A.table(spark, sf_dir, "events").withColumn("frame_index", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint"))
    frames = e.select(F.col("user_id").alias("clip_id"), "frame_index", (F.col("frame_index") / 8).alias("seconds"), (F.col("event_type") != "error").alias("decoded"))
    return I.sample_frames(frames, 2, 20, 8).select("clip_id", "frame_index", "place")


_COPIES = "SELECT doc_id AS upload_id, doc_id%40 AS user_id, sha256(text) AS checksum, doc_id*13%1009 AS uploaded_at, doc_id%7 <> 0 AS present FROM documents"


@query(sql("SELECT upload_id, user_id, checksum FROM (SELECT *, row_number() OVER (PARTITION BY user_id, checksum ORDER BY uploaded_at DESC, upload_id DESC) AS rn FROM c) WHERE rn = 1 AND present", c=_COPIES))
def dedup_newest(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("upload_id"), (F.col("doc_id") % 40).alias("user_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"), (F.col("doc_id") * 13 % 1009).alias("uploaded_at"), (F.col("doc_id") % 7 != 0).alias("present"))
    return I.dedup_newest(rows, "present").select("upload_id", "user_id", "checksum")


@query(sql("SELECT request_id, media_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY requested_at, request_id) AS rn FROM (SELECT event_id AS request_id, user_id*4 + event_id%4 AS media_id, ts AS requested_at FROM events) WHERE media_id NOT IN (SELECT media_id FROM runs WHERE status IN ('pending','queued','running'))) WHERE rn = 1", "runs"))
def admission_one_in_flight(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") * 4 + F.col("event_id") % 4).alias("media_id"), F.col("ts").alias("requested_at"))
    return I.admit(e, A.runs(spark, sf_dir)).select("request_id", "media_id")


_STATE = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


@query(sql("SELECT job_id, coalesce(e, l) AS state, n AS events FROM (SELECT job_id, arg_min(state, k) FILTER (state IN ('done','failed')) AS e, arg_max(state, k) AS l, count(*) AS n FROM j GROUP BY job_id)", j=f"SELECT user_id*100 + event_id%50 AS job_id, epoch_us(ts)::HUGEINT*1000000 + event_id AS k, {_STATE} AS state FROM events"))
def job_final_state(spark, sf_dir):
    t = F.col("event_type")
    state = F.when(t == "signup", "pending").when(t == "view", "queued").when(t == "click", "running").when(t == "purchase", "done").otherwise("failed")
    rows = A.table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 50).alias("job_id"), "ts", "event_id", state.alias("state"))
    return I.final_states(rows)


@query(
    sql(
        "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN host IS NULL AND boot IS NULL THEN 'fail:unclaimed' WHEN boot = 'b1' THEN 'keep:own' WHEN host <> 'h1' THEN CASE WHEN age > 21600 THEN 'fail:stale' ELSE 'keep:other_host' END WHEN alive IS NULL THEN 'fail:unknown' WHEN alive THEN 'keep:alive' ELSE 'fail:gone' END AS verdict FROM o) GROUP BY verdict",
        "runs",
        o="SELECT CASE WHEN analysis_id%6 = 0 THEN NULL WHEN analysis_id%2 = 0 THEN 'h1' ELSE 'h2' END AS host, CASE WHEN analysis_id%6 = 0 THEN NULL WHEN analysis_id%10 = 4 THEN 'b1' ELSE 'b0' END AS boot, CASE WHEN analysis_id%8 = 2 THEN NULL ELSE analysis_id%8 = 4 END AS alive, analysis_id*37%50000 AS age FROM runs WHERE status IN ('queued','running')",
    )
)
def recovery_verdicts(spark, sf_dir):
    k = F.col("analysis_id")
    none = F.lit(None)
    rows = A.runs(spark, sf_dir).where(F.col("status").isin("queued", "running"))
    rows = rows.select(F.when(k % 6 == 0, none).when(k % 2 == 0, "h1").otherwise("h2").alias("host"), F.when(k % 6 == 0, none).when(k % 10 == 4, "b1").otherwise("b0").alias("boot"), F.when(k % 8 == 2, none).otherwise(k % 8 == 4).alias("alive"), (k * 37 % 50000).alias("age"))
    v = I.recovery_verdict(*(F.col(c) for c in ("host", "boot", "alive", "age")), "h1", "b1")
    return rows.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query(sql("SELECT 'users' AS table_name, count(*) AS n FROM users WHERE user_id%10 <> 3 UNION ALL SELECT 'media', count(*) FROM media WHERE user_id%10 <> 3 UNION ALL SELECT 'runs', count(*) FROM runs WHERE user_id%10 <> 3 UNION ALL SELECT 'vehicles', count(*) FROM vehicles WHERE analysis_id NOT IN (SELECT analysis_id FROM gone) UNION ALL SELECT 'regions', count(*) FROM regions WHERE vehicle_id NOT IN (SELECT vehicle_id FROM vehicles WHERE analysis_id IN (SELECT analysis_id FROM gone)) UNION ALL SELECT 'reports', count(*) FROM reports WHERE analysis_id NOT IN (SELECT analysis_id FROM gone)", "users", "media", "runs", "vehicles", "regions", "reports", gone="SELECT analysis_id FROM runs WHERE user_id%10 = 3"))
def cascade_survivors(spark, sf_dir):
    get = lambda f: f(spark, sf_dir)
    gone = get(A.users).where("user_id % 10 = 3").select("user_id")
    left = I.survivors(get(A.users), get(A.media), get(A.runs), get(A.vehicles), get(A.regions), get(A.reports), gone)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_LIVE = "SELECT analysis_id, count(*) FILTER (intensity <= 0.33) AS low, count(*) FILTER (intensity > 0.33 AND intensity <= 0.66) AS moderate, count(*) FILTER (intensity > 0.66) AS high FROM regions GROUP BY analysis_id"
_BANDED = "SELECT r.analysis_id, overall_severity, coalesce(low, 0) AS low, coalesce(moderate, 0) AS moderate, coalesce(high, 0) AS high FROM runs r LEFT JOIN l USING (analysis_id)"
_WORST = "CASE WHEN high > 0 THEN 'high' WHEN moderate > 0 THEN 'moderate' WHEN low > 0 THEN 'low' ELSE '' END"


@query(sql(f"SELECT *, {_WORST} AS live_severity, {_WORST} <> overall_severity AS drift FROM b", "runs", "regions", l=_LIVE, b=_BANDED))
def reband_live_vs_frozen(spark, sf_dir):
    rows = I.reband(A.runs(spark, sf_dir), A.regions(spark, sf_dir), A.settings(spark))
    return rows.select("analysis_id", "overall_severity", "low", "moderate", "high", "live_severity", "drift")


@query(sql(f"SELECT overall_severity, {_WORST} AS live_severity, count(*) AS n FROM b WHERE {_WORST} <> overall_severity GROUP BY 1, 2", "runs", "regions", l=_LIVE, b=_BANDED))
def drift_report(spark, sf_dir):
    rows = I.reband(A.runs(spark, sf_dir), A.regions(spark, sf_dir), A.settings(spark)).where("drift")
    return rows.groupBy("overall_severity", "live_severity").agg(F.count("*").alias("n"))


_JUNK = "CASE WHEN event_id%9 = 0 THEN 'junk' WHEN event_id%9 = 1 THEN NULL WHEN event_id%9 = 2 THEN 'nan' ELSE CAST({} AS VARCHAR) END".format
_OVER = f"SELECT event_id AS run_id, {_JUNK('(event_id%130)/100.0::DOUBLE')} AS confidence, {_JUNK('event_id%90 - 5')} AS rate, {_JUNK('event_id%120 - 10')} AS sensitivity, CASE event_id%4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'maybe' END AS pdf FROM events"
_NUM = "try_cast({} AS DOUBLE)".format


def _clamped(v, low, high, default):
    return f"CASE WHEN {v} IS NULL OR isnan({v}) THEN {default} ELSE greatest({low}, least({high}, {v})) END"


@query(
    sql(
        f"SELECT run_id, {_clamped('c', '0.05::DOUBLE', '0.95::DOUBLE', '0.35::DOUBLE')} AS confidence_threshold, CASE WHEN isnan(r) THEN 5 ELSE greatest(1, least(60, CAST(trunc(r) AS BIGINT))) END AS frame_sample_rate, round({_clamped('m', '0.05::DOUBLE', '0.95::DOUBLE', '0.5::DOUBLE')}, 6) AS smoke_mask_threshold, coalesce(p, true) AS auto_generate_pdf FROM n",
        o=_OVER,
        n=f"SELECT run_id, coalesce({_NUM('confidence')}, 0.35::DOUBLE) AS c, coalesce({_NUM('rate')}, 5) AS r, coalesce(CASE WHEN NOT isnan({_NUM('sensitivity')}) THEN 0.25::DOUBLE + greatest(0.0, least(100.0, {_NUM('sensitivity')}))/100*0.5::DOUBLE END, 0.5::DOUBLE) AS m, CASE WHEN lower(trim(pdf)) IN ('1','true','yes','on','t','y') THEN true WHEN lower(trim(pdf)) IN ('0','false','no','off','f','n') THEN false END AS p FROM o",
    )
)
def settings_overlay(spark, sf_dir):
    k = F.col("event_id")
    junk = lambda v: F.when(k % 9 == 0, "junk").when(k % 9 == 1, None).when(k % 9 == 2, "nan").otherwise(v.cast("string"))
    pdf = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "off").when(k % 4 == 2, "maybe")
    rows = A.table(spark, sf_dir, "events").select(k.alias("run_id"), junk((k % 130) / 100.0).alias("confidence"), junk(k % 90 - 5).alias("rate"), junk(k % 120 - 10).alias("sensitivity"), pdf.alias("pdf"))
    return I.overlay(rows, A.settings(spark))


_OLD = "SELECT c_custkey AS id, 5 + c_custkey%3 AS frame_sample_rate, CASE WHEN c_custkey%4 = 0 THEN 'mp4,avi' ELSE 'mp4,mkv' END AS allowed_video_formats, c_custkey%2 = 0 AS auto_generate_pdf, CASE WHEN c_custkey%6 <> 0 THEN 'kept' END AS note FROM customer"


@query(
    sql(
        "SELECT id, field, before, after FROM ("
        + " UNION ALL ".join(f"SELECT id, '{c}' AS field, CAST(o.{c} AS VARCHAR) AS before, CAST(n.{c} AS VARCHAR) AS after FROM o JOIN n USING (id)" for c in ("frame_sample_rate", "allowed_video_formats", "auto_generate_pdf", "note"))
        + ") WHERE before IS DISTINCT FROM after",
        o=_OLD,
        n="SELECT id, CASE WHEN id%7 = 0 THEN frame_sample_rate + 1 ELSE frame_sample_rate END AS frame_sample_rate, CASE WHEN id%9 = 0 THEN 'mp4,mkv' ELSE allowed_video_formats END AS allowed_video_formats, auto_generate_pdf AND id%10 <> 0 AS auto_generate_pdf, CASE WHEN id%12 <> 0 THEN 'kept' END AS note FROM o",
    )
)
def settings_diff(spark, sf_dir):
    """Fields that differ between two states of each account's settings."""
    k = F.col("id")
    old = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", (5 + k % 3).alias("frame_sample_rate"), F.when(k % 4 == 0, "mp4,avi").otherwise("mp4,mkv").alias("allowed_video_formats"), (k % 2 == 0).alias("auto_generate_pdf"), F.when(k % 6 != 0, "kept").alias("note"))
    new = old.withColumns({"frame_sample_rate": F.when(k % 7 == 0, F.col("frame_sample_rate") + 1).otherwise(F.col("frame_sample_rate")), "allowed_video_formats": F.when(k % 9 == 0, "mp4,mkv").otherwise(F.col("allowed_video_formats")), "auto_generate_pdf": F.col("auto_generate_pdf") & (k % 10 != 0), "note": F.when(k % 12 != 0, "kept")})
    return I.settings_diff(old, new)


_FIT = "SELECT *, greatest(1, CAST(round_even(fw*s, 0) AS INTEGER)) AS nw, greatest(1, CAST(round_even(fh*s, 0) AS INTEGER)) AS nh FROM (SELECT vehicle_id, 640 + x AS fw, 480 + y AS fh, x, y, least(256.0::DOUBLE/(640 + x), 256.0::DOUBLE/(480 + y)) AS s FROM (SELECT DISTINCT vehicle_id, x, y FROM vehicles))"


@query(sql("SELECT vehicle_id, round(((x*s + (256-nw)//2) - (256-nw)//2)/s, 6) AS back_x, round((128 - (256-nw)//2)/s, 6) AS middle_x, round((128 - (256-nh)//2)/s, 6) AS middle_y FROM f", "vehicles", f=_FIT))
def letterbox_inverse(spark, sf_dir):
    """Points of the square back in the frame: a vehicle's corner, there and back, and the square's middle."""
    rows = A.vehicles(spark, sf_dir).select("vehicle_id", "x", "y").distinct()
    rows = rows.withColumn("fit", letterbox(640 + F.col("x"), 480 + F.col("y")))
    back = unletterbox(F.col("x") * F.col("fit.scale") + F.col("fit.pad_x"), F.lit(0.0), F.col("fit"))
    middle = unletterbox(F.lit(128.0), F.lit(128.0), F.col("fit"))
    return rows.select("vehicle_id", F.round(back["x"], 6).alias("back_x"), F.round(middle["x"], 6).alias("middle_x"), F.round(middle["y"], 6).alias("middle_y"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_id%2 = 0 THEN 'jpg' ELSE 'png' END, CASE WHEN event_id%3 = 0 THEN 'jpg' ELSE 'mp4' END, CASE WHEN event_id%5 = 0 THEN 'x' ELSE 'avi' END], lambda x, i: len(x) >= 2 AND NOT (i = 2 AND event_id%2 = 0 AND event_id%3 = 0)), ',') AS formats FROM events")
def format_list_normalise(spark, sf_dir):
    k = F.col("event_id")
    raw = F.concat(F.when(k % 2 == 0, " .JPG").otherwise("Png "), F.lit(","), F.when(k % 3 == 0, "jpg").otherwise("mp4"), F.lit(", "), F.when(k % 5 == 0, "x").otherwise("AVI"), F.lit(",,"))
    return A.table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", normalise_formats(raw)).alias("formats"))


@query("SELECT event_id, array_to_string(list_sort(list_intersect(['jpg','png','bmp'], CASE WHEN event_id%2 = 0 THEN ['png','mp4'] ELSE ['bmp','jpg','x'] END)), ',') AS usable, CASE WHEN event_id%2 = 0 THEN 'jpg,png,mp4' ELSE 'jpg,png,bmp,x' END AS everything FROM events")
def format_set_operations(spark, sf_dir):
    """Intersection with a whitelist, and the ordered union of two lists."""
    even = F.col("event_id") % 2 == 0
    own = lambda *v: F.array(*map(F.lit, v))
    other = F.when(even, own("png", "mp4")).otherwise(own("bmp", "jpg", "x"))
    usable = F.array_sort(F.array_intersect(own("jpg", "png", "bmp"), other))
    return A.table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", usable).alias("usable"), F.concat_ws(",", F.array_distinct(F.concat(own("jpg", "png"), other))).alias("everything"))


@query(sql("SELECT client, scope, count(*) FILTER (recent > 3) AS refused FROM (SELECT user_id%50 AS client, event_type AS scope, count(*) OVER (PARTITION BY user_id%50, event_type ORDER BY secs RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT *, epoch_us(ts)//1000000 AS secs FROM events)) GROUP BY 1, 2"))
def throttle_windows(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("client"), F.col("event_type").alias("scope"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return I.throttled(rows, 3, 86400).groupBy("client", "scope").agg(F.count_if(~F.col("allowed")).alias("refused"))


_NOW = "TIMESTAMP '2024-01-25 00:00:00'"


@query(sql(f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_id%6 = 0 THEN 'used' WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 1 THEN 'superseded' WHEN ts + INTERVAL 3 DAY <= {_NOW} THEN 'expired' ELSE 'valid' END AS state FROM events WHERE event_type = 'signup') GROUP BY state"))
def reset_tokens(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").where("event_type = 'signup'")
    rows = rows.select(F.col("event_id").alias("token_id"), "user_id", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"), (F.col("event_id") % 6 == 0).alias("used"))
    return I.valid_tokens(rows, F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(round_even(avgv*100, 0) AS BIGINT) || '%' AS share, printf('%.1f', round(value, 1)) || 's' AS took, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, CASE WHEN length(name) <= 20 THEN name ELSE substring(name, 1, 19) || '…' END AS name FROM (SELECT *, (event_id%128)/128.0::DOUBLE AS avgv, 'report_' || event_type || '_' || event_id || '.pdf' AS name FROM events)")
def display_strings(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    name = F.concat(F.lit("report_"), "event_type", F.lit("_"), "event_id", F.lit(".pdf"))
    return e.select("event_id", percent((F.col("event_id") % 128) / 128).alias("share"), seconds(F.col("value")).alias("took"), moment(F.col("ts")).alias("moment"), truncate(name, 20).alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.mode'), 'default') AS mode FROM events")
def json_runtime(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.mode"), F.lit("default")).alias("mode"))


_BOX = "SELECT DISTINCT x, y, w, h, 32 + x AS fw, 32 + y AS fh FROM vehicles"


@query(sql("SELECT fw, fh, round(s, 6) AS scale, CAST(floor((256 - greatest(1, round_even(fw*s, 0)))/2) AS INTEGER) AS pad_x, CAST(floor((256 - greatest(1, round_even(fh*s, 0)))/2) AS INTEGER) AS pad_y, round(t*t*(3-2*t), 6) AS smooth FROM (SELECT DISTINCT fw, fh, least(256.0::DOUBLE/fw, 256.0::DOUBLE/fh) AS s, least(1.0::DOUBLE, fw/400.0::DOUBLE) AS t FROM b)", "vehicles", b=_BOX))
def letterbox_geometry(spark, sf_dir):
    rows = A.vehicles(spark, sf_dir).select((32 + F.col("x")).alias("fw"), (32 + F.col("y")).alias("fh")).distinct()
    rows = rows.withColumn("l", letterbox(F.col("fw"), F.col("fh")))
    return rows.select("fw", "fh", F.round("l.scale", 6).alias("scale"), "l.pad_x", "l.pad_y", F.round(smoothstep(F.col("fw") / 400), 6).alias("smooth"))


@query("SELECT slider, round(0.25 + slider/100.0*0.5, 4)::DOUBLE AS threshold, round(greatest(0.05, least(0.95, slider/50.0)), 4)::DOUBLE AS clamped, CAST(greatest(1, least(60, slider - 20)) AS BIGINT) AS rate, (slider%20 = 0) AS flag, count(*) AS n FROM (SELECT event_id%101 AS slider FROM events) GROUP BY slider")
def slider_mapping(spark, sf_dir):
    """Slider positions, as strings, under every mapping, with how often each was sent."""
    rows = A.table(spark, sf_dir, "events").groupBy((F.col("event_id") % 101).alias("slider")).agg(F.count("*").alias("n"))
    s = F.col("slider").cast("string")
    flag = coerce_bool(F.when(F.col("slider") % 20 == 0, "YES").otherwise("no"))
    return rows.select("slider", F.round(sensitivity_threshold(s), 4).alias("threshold"), F.round(clamp_float((F.col("slider") / 50).cast("string"), 0.05, 0.95, 0.5), 4).alias("clamped"), clamp_int((F.col("slider") - 20).cast("string"), 1, 60, 5).alias("rate"), flag.alias("flag"), "n")


@query(sql("SELECT w, h, CASE WHEN w > 20000 OR h > 20000 THEN 'side_too_long' WHEN CAST(w AS BIGINT)*h > 50000000 THEN 'too_many_pixels' END AS verdict FROM (SELECT DISTINCT x*40 AS w, y*40 AS h FROM vehicles)", "vehicles"))
def image_dimensions(spark, sf_dir):
    rows = A.vehicles(spark, sf_dir).select((F.col("x") * 40).alias("w"), (F.col("y") * 40).alias("h")).distinct()
    return rows.select("w", "h", I.image_policy(F.col("w"), F.col("h")).alias("verdict"))
