"""History, detail, media, report and queue queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.text import file_extension, human_bytes, media_kind, normalise_email
from ..operators import history as H
from ..sources import adapters as A
from .base import query
from .views import sql

USER = 605
_ROW = "analysis_id, created_at, status, overall_severity, avg_confidence, total_vehicles, total_smoke, filename"
_COLUMNS = _ROW.split(", ")


def _filtered(spark, sf_dir, user=USER, **options):
    f = H.HistoryFilter(**options)
    runs = A.runs(spark, sf_dir)
    return f, f.apply(runs if user is None else H.owned(runs, user), A.media(spark, sf_dir), A.vehicles(spark, sf_dir))


@query(sql(f"SELECT {_ROW} FROM runs JOIN media USING (media_id) WHERE runs.user_id = {USER} ORDER BY created_at DESC, analysis_id LIMIT 10 OFFSET 10", "runs", "media"))
def history_page(spark, sf_dir):
    f, rows = _filtered(spark, sf_dir)
    return H.page(rows, f.order(), 2).select(*_COLUMNS)


@query(sql("SELECT analysis_id, overall_severity, status FROM runs ORDER BY overall_severity DESC, analysis_id LIMIT 10 OFFSET 30", "runs"))
def history_page_after(spark, sf_dir):
    """The fourth page, reached by keys."""
    runs, last = A.runs(spark, sf_dir), None
    for _ in range(3):
        row = H.page_after(runs, "-overall_severity", last).collect()[-1]
        last = (row.overall_severity, row.analysis_id)
    return H.page_after(runs, "-overall_severity", last).select("analysis_id", "overall_severity", "status")


@query(sql(f"SELECT count(*) AS count, 2 AS page, greatest(1, CAST(ceil(count(*)/10.0) AS BIGINT)) AS pages, 10 AS page_size, CASE WHEN 2 < ceil(count(*)/10.0) THEN 3 END AS next_page, 1 AS previous_page FROM runs WHERE user_id = {USER}", "runs"))
def history_envelope(spark, sf_dir):
    return H.page_envelope(H.owned(A.runs(spark, sf_dir), USER), 2)


@query(sql(f"SELECT {_ROW} FROM runs JOIN media USING (media_id) WHERE analysis_id IN (SELECT analysis_id FROM vehicles WHERE vehicle_type = 'bus')", "runs", "media", "vehicles"))
def history_semi_vehicle_type(spark, sf_dir):
    return _filtered(spark, sf_dir, None, vehicle_type="bus")[1].select(*_COLUMNS)


@query(sql(f"SELECT {_ROW} FROM runs JOIN media USING (media_id) WHERE contains(lower(filename), 'auto') AND status = 'done'", "runs", "media"))
def history_search(spark, sf_dir):
    return _filtered(spark, sf_dir, None, search="AUTO", status="done")[1].select(*_COLUMNS)


@query(sql(f"SELECT {_ROW} FROM runs JOIN media USING (media_id) WHERE contains(lower(filename), '%a_')", "runs", "media"))
def history_search_literal(spark, sf_dir):
    return _filtered(spark, sf_dir, None, search="%a_")[1].select(*_COLUMNS)


@query(sql(f"SELECT {_ROW} FROM runs JOIN media USING (media_id) WHERE CAST(created_at AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-04-15'", "runs", "media"))
def history_date_range(spark, sf_dir):
    return _filtered(spark, sf_dir, None, date_from=date(1998, 3, 1), date_to=date(1998, 4, 15))[1].select(*_COLUMNS)


@query(sql(f"SELECT {_ROW} FROM runs JOIN media USING (media_id) WHERE status = 'done' AND overall_severity = 'high' AND analysis_id IN (SELECT analysis_id FROM vehicles WHERE vehicle_type = 'truck') ORDER BY avg_confidence, analysis_id LIMIT 50", "runs", "media", "vehicles"))
def history_combined(spark, sf_dir):
    f, rows = _filtered(spark, sf_dir, None, status="done", severity="high", vehicle_type="truck", ordering="avg_confidence")
    return H.page(rows, f.order(), 1, 50).select(*_COLUMNS)


@query(sql("SELECT status, count(*) AS n FROM runs WHERE status NOT IN ('done','failed') GROUP BY status", "runs"))
def nonterminal_counts(spark, sf_dir):
    return A.runs(spark, sf_dir).where(~F.col("status").isin("done", "failed")).groupBy("status").agg(F.count("*").alias("n"))


@query(sql("SELECT r.analysis_id, status, progress, report_status, report_id, CASE WHEN report_status = 'pending' AND report_id IS NOT NULL THEN 'ready' ELSE report_status END AS report_state, page_count FROM runs r LEFT JOIN reports p USING (analysis_id)", "runs", "reports"))
def status_row(spark, sf_dir):
    return H.with_report(A.runs(spark, sf_dir), A.reports(spark, sf_dir)).select("analysis_id", "status", "progress", "report_status", "report_id", "report_state", "page_count")


@query(sql(f"SELECT analysis_id, status FROM runs WHERE analysis_id = 1 AND user_id = {USER}", "runs"))
def point_lookup_not_owned(spark, sf_dir):
    return H.one(A.runs(spark, sf_dir), "analysis_id", 1, USER).select("analysis_id", "status")


@query(sql("SELECT analysis_id, status, nullif(overall_severity, '') AS overall_severity, '/media/previews/' || analysis_id || '.jpg' AS preview_url FROM runs", "runs"))
def public_projection(spark, sf_dir):
    return H.public(A.runs(spark, sf_dir))


@query(
    sql(
        "SELECT r.analysis_id, status, string_agg(vehicle_type || ':' || frame_number || ':' || coalesce(regions, '-'), ',' ORDER BY frame_number, confidence DESC, vehicle_id) AS vehicles FROM runs r LEFT JOIN cars v USING (analysis_id) LEFT JOIN nested w USING (vehicle_id) GROUP BY r.analysis_id, status",
        "runs", "vehicles", "regions",
        nested="SELECT vehicle_id, string_agg(CAST(CAST(round(intensity*1000000) AS BIGINT) AS VARCHAR), '+' ORDER BY intensity DESC) AS regions FROM regions GROUP BY vehicle_id",
        cars="SELECT vehicle_id, analysis_id, c.t AS vehicle_type, c.f AS frame_number, c.c AS confidence FROM (SELECT vehicle_id, analysis_id, min({'t': vehicle_type, 'f': frame_number, 'c': confidence}) AS c FROM vehicles GROUP BY 1, 2)",
    )
)
def detail_tree(spark, sf_dir):
    tree = H.detail_tree(A.runs(spark, sf_dir), A.vehicles(spark, sf_dir), A.regions(spark, sf_dir))
    text = F.transform("vehicles", lambda v: F.concat_ws(":", v.vehicle_type, v.frame.cast("string"), F.coalesce(F.nullif(F.concat_ws("+", F.transform(v.regions, lambda r: F.round(r.intensity * 1000000).cast("bigint").cast("string"))), F.lit("")), F.lit("-"))))
    return tree.select("analysis_id", "status", F.nullif(F.concat_ws(",", text), F.lit("")).alias("vehicles"))


@query(sql("SELECT m.media_id, filename, analysis_id, status FROM media m LEFT JOIN (SELECT media_id, analysis_id, status FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY created_at DESC, analysis_id DESC) AS rn FROM runs) WHERE rn = 1) USING (media_id)", "runs", "media"))
def media_latest_run(spark, sf_dir):
    rows = H.latest_child(A.media(spark, sf_dir), A.runs(spark, sf_dir), "media_id", "created_at", ["analysis_id", "status"], "analysis_id")
    return rows.select("media_id", "filename", "analysis_id", "status")


@query(sql("SELECT report_id, p.analysis_id, r.user_id, m.filename, lower(trim(u.email)) AS email, page_count FROM reports p JOIN runs r USING (analysis_id) JOIN media m USING (media_id) JOIN users u ON u.user_id = r.user_id", "runs", "reports", "media", "users"))
def report_list(spark, sf_dir):
    runs = A.runs(spark, sf_dir).select("analysis_id", "media_id", "user_id")
    users = A.users(spark, sf_dir).select("user_id", normalise_email(F.col("email")).alias("email"))
    rows = A.reports(spark, sf_dir).join(runs, "analysis_id").join(A.media(spark, sf_dir).select("media_id", "filename"), "media_id").join(users, "user_id")
    return rows.select("report_id", "analysis_id", "user_id", "filename", "email", "page_count")


@query(sql("SELECT analysis_id, status, created_at FROM runs WHERE status IN ('pending','queued','running') ORDER BY created_at, analysis_id LIMIT 20", "runs"))
def active_queue(spark, sf_dir):
    return A.runs(spark, sf_dir).where(F.col("status").isin(*H.ACTIVE)).orderBy("created_at", "analysis_id").limit(20).select("analysis_id", "status", "created_at")


@query(sql("SELECT p.report_id, file_size_bytes FROM reports p WHERE analysis_id IN (SELECT analysis_id FROM runs WHERE user_id%7 = 0)", "runs", "reports"))
def reports_by_key_set(spark, sf_dir):
    return H.exists(A.reports(spark, sf_dir), A.runs(spark, sf_dir).where("user_id % 7 = 0"), "analysis_id").select("report_id", "file_size_bytes")


@query(sql("SELECT vehicle_type, count(*) AS n FROM vehicles WHERE analysis_id NOT IN (SELECT analysis_id FROM runs WHERE status = 'failed') GROUP BY vehicle_type", "runs", "vehicles"))
def orphan_check(spark, sf_dir):
    return H.orphans(A.vehicles(spark, sf_dir), A.runs(spark, sf_dir).where("status = 'failed'"), "analysis_id").groupBy("vehicle_type").agg(F.count("*").alias("n"))


@query(sql("SELECT media_id, filename, split_part(filename, '.', 2) AS extension, CASE WHEN split_part(filename, '.', 2) IN ('jpg','png') THEN 'image' ELSE 'video' END AS kind, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes/1024.0::DOUBLE) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes/1048576.0::DOUBLE) ELSE printf('%.1f GB', size_bytes/1073741824.0::DOUBLE) END AS size_text, round(size_bytes/1048576.0::DOUBLE, 2) AS size_mb FROM media", "media"))
def media_properties(spark, sf_dir):
    name = F.col("filename")
    return A.media(spark, sf_dir).select("media_id", "filename", file_extension(name).alias("extension"), media_kind(name).alias("kind"), human_bytes(F.col("size_bytes")).alias("size_text"), F.round(F.col("size_bytes") / 1048576, 2).alias("size_mb"))


@query(sql("SELECT analysis_id, generated_at, CAST(date_diff('second', created_at, generated_at) AS DOUBLE) AS duration_seconds, status IN ('done','failed') AS is_terminal, status IN ('pending','queued','running') AS is_active, round(file_size_bytes/1024.0::DOUBLE, 1) AS size_kb FROM runs JOIN reports USING (analysis_id)", "runs", "reports"))
def derived_columns(spark, sf_dir):
    rows = A.runs(spark, sf_dir).join(A.reports(spark, sf_dir), "analysis_id")
    took = F.timestamp_diff("SECOND", F.col("created_at").cast("timestamp"), F.col("generated_at").cast("timestamp")).cast("double")
    return rows.select("analysis_id", "generated_at", took.alias("duration_seconds"), F.col("status").isin("done", "failed").alias("is_terminal"), F.col("status").isin(*H.ACTIVE).alias("is_active"), F.round(F.col("file_size_bytes") / 1024, 1).alias("size_kb"))


@query(sql("SELECT wanted, media_id, filename, media_type FROM media, (VALUES ('hologram'), ('video'), ('')) AS w(wanted) WHERE user_id = 605 AND (wanted <> 'video' OR media_type = 'video')", "media"))
def media_list_ignores_invalid(spark, sf_dir):
    """Media of an account by type; a type that there isn't is ignored, not an error."""
    made = [H.media_list(A.media(spark, sf_dir), USER, w).select(F.lit(w).alias("wanted"), "media_id", "filename", "media_type") for w in ("hologram", "video", "")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(sql("SELECT analysis_id, status, progress, CASE status WHEN 'done' THEN 'done' WHEN 'running' THEN 'scanning' ELSE 'waiting for a worker' END AS stage, created_at + INTERVAL 1 MINUTE AS start_time, CASE WHEN status IN ('done', 'failed') THEN created_at + INTERVAL 5 MINUTE END AS end_time, CASE WHEN status = 'failed' THEN 'The media could not be read.' ELSE '' END AS error_message, total_vehicles, total_smoke, overall_severity, report_id FROM runs LEFT JOIN reports USING (analysis_id)", "runs", "reports"))
def status_poll(spark, sf_dir):
    s, at = F.col("status"), F.col("created_at")
    runs = A.runs(spark, sf_dir).withColumns({
        "stage": F.when(s == "done", "done").when(s == "running", "scanning").otherwise("waiting for a worker"), "start_time": at + F.expr("INTERVAL 1 MINUTE"),
        "end_time": F.when(s.isin("done", "failed"), at + F.expr("INTERVAL 5 MINUTES")), "error_message": F.when(s == "failed", "The media could not be read.").otherwise(""),
    })
    return H.status_poll(runs, A.reports(spark, sf_dir))


_SNAPSHOT = """CASE WHEN o_orderkey%13 = 0 THEN NULL WHEN o_orderkey%11 = 0 THEN '{"cut' ELSE '{"rate": ' || o_orderkey%60 || ', "formats": "jpg,png"' || CASE WHEN o_orderkey%3 <> 0 THEN ', "_runtime": {"device": "cpu' || o_orderkey%2 || '", "annotated_frames": ["", "/a/' || o_orderkey || '.jpg", "b.jpg"]}' ELSE '' END || '}' END"""


@query(
    sql(
        "SELECT analysis_id, CASE WHEN good THEN 'formats=jpg,png;rate=' || analysis_id%60 ELSE '' END AS settings, CASE WHEN ran THEN '/media/a/' || analysis_id || '.jpg,/media/b.jpg' ELSE '' END AS annotated_frames, '' AS segmenter_mode, CASE WHEN ran THEN 'cpu' || analysis_id%2 ELSE '' END AS device, CASE WHEN good THEN '0,' || analysis_id%7 || ',0,5' ELSE '0,0,0,0' END AS box FROM g",
        g="SELECT o_orderkey AS analysis_id, o_orderkey%13 <> 0 AND o_orderkey%11 <> 0 AS good, o_orderkey%13 <> 0 AND o_orderkey%11 <> 0 AND o_orderkey%3 <> 0 AS ran FROM orders",
    )
)
def public_detail(spark, sf_dir):
    """Snapshots without their runtime, what they say of it, and boxes with defaults; some snapshots are missing or broken."""
    runs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.expr(_SNAPSHOT).alias("settings_snapshot"))
    box = F.when(F.col("settings_snapshot").endswith("}"), F.concat(F.lit('{"x": null, "y": '), F.col("analysis_id") % 7, F.lit(', "w": "wide", "h": 5}'))).otherwise(F.lit("{"))
    boxes = runs.select("analysis_id", H.public_box(box).alias("b")).select("analysis_id", F.concat_ws(",", *(F.col(f"b.{c}") for c in "xywh")).alias("box"))
    pairs = F.array_sort(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    rows = H.public_detail(runs).select("analysis_id", F.array_join(pairs, ";").alias("settings"), F.array_join("annotated_frames", ",").alias("annotated_frames"), "segmenter_mode", "device")
    return rows.join(boxes, "analysis_id")
