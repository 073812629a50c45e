"""SQL of the domain's views over the star schema, for the oracles."""

from __future__ import annotations

VEHICLE_ID = "l_orderkey*1000000000 + l_partkey*10000 + l_suppkey*10 + l_linenumber"
VIEWS = {
    "runs": """SELECT o_orderkey AS analysis_id, o_custkey*4 + o_orderkey%4 AS media_id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE CASE o_orderkey%3 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' ELSE 'running' END END AS status,
  CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'moderate' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE '' END AS overall_severity,
  CASE WHEN o_orderstatus = 'P' THEN CAST(0 AS DOUBLE) ELSE round(least(o_totalprice/600000, 1), 4) END AS avg_confidence,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey%9 END AS INTEGER) AS total_vehicles,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey%9//3 END AS INTEGER) AS total_smoke,
  CAST(1 + o_orderkey%40 AS INTEGER) AS frames_processed, CAST(o_orderkey%101 AS INTEGER) AS progress,
  CASE WHEN o_orderkey%2 = 0 THEN 'pending' WHEN o_orderkey%7 = 0 THEN 'failed' ELSE 'skipped' END AS report_status, o_orderdate AS created_at FROM orders""",
    "media": """SELECT c_custkey*4 + k AS media_id, c_custkey AS user_id, 'Cam_' || c_mktsegment || '_' || c_custkey || '_' || k || '.' || (['jpg','png','mp4','mov'])[k+1] AS filename,
  (['jpg','png','mp4','mov'])[k+1] AS format, CASE WHEN k < 2 THEN 'image' ELSE 'video' END AS media_type, (c_custkey*7919 + k*104729) % 600000000 AS size_bytes
  FROM customer, (VALUES (0),(1),(2),(3)) AS ks(k)""",
    "vehicles": f"""SELECT {VEHICLE_ID} AS vehicle_id, l_orderkey AS analysis_id,
  CASE WHEN l_returnflag = 'A' THEN 'car' WHEN l_returnflag = 'R' THEN 'truck' WHEN l_linestatus = 'F' THEN 'bus' ELSE 'motorcycle' END AS vehicle_type, l_linenumber AS frame_number,
  CAST(l_partkey%600 AS INTEGER) AS x, CAST(l_suppkey%400 AS INTEGER) AS y, CAST(l_quantity+20 AS INTEGER) AS w, CAST(l_quantity+10 AS INTEGER) AS h, round(0.35 + l_tax*5, 4) AS confidence FROM lineitem""",
    "cameras": f"""SELECT l_suppkey AS clip_id, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)//10 AS frame, {VEHICLE_ID} AS vehicle_id,
  CASE WHEN l_returnflag = 'A' THEN 'car' WHEN l_returnflag = 'R' THEN 'truck' WHEN l_linestatus = 'F' THEN 'bus' ELSE 'motorcycle' END AS vehicle_type,
  CAST(l_partkey*37%240 AS INTEGER) AS x, CAST(l_orderkey*53%160 AS INTEGER) AS y, CAST(l_quantity+90 AS INTEGER) AS w, CAST(l_quantity+70 AS INTEGER) AS h,
  round(0.35 + l_tax*5, 4) AS confidence, CASE WHEN l_linestatus = 'F' THEN round(abs(l_discount)*10, 6) END AS intensity FROM lineitem""",
    "regions": f"""SELECT {VEHICLE_ID} AS vehicle_id, l_orderkey AS analysis_id, round(abs(l_discount)*10, 6) AS intensity, round(0.5 + abs(l_tax)*4, 6) AS confidence,
  round(l_quantity/100, 6) AS area_ratio, round(0.3 + abs(l_discount)*7, 6) AS opacity FROM lineitem WHERE l_linestatus = 'F'""",
    "reports": "SELECT analysis_id AS report_id, analysis_id, created_at + INTERVAL 90 MINUTE AS generated_at, CAST(1 + analysis_id%12 AS INTEGER) AS page_count, analysis_id*37%5000000 AS file_size_bytes FROM runs WHERE status = 'done' AND analysis_id%2 = 0",
    "users": "SELECT c_custkey AS user_id, '  User' || c_custkey || '@Example.COM ' AS email, CASE WHEN c_custkey%50 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer",
    "observations": "SELECT user_id AS track_id, ts, event_id, event_type IN ('error','purchase') AS fired, round(least(value/50, 1), 6) AS intensity, event_type AS vehicle_type FROM events",
    "scored": """SELECT doc_id, doc_id%97 AS item, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label,
  CASE WHEN quality = 1 THEN NULL WHEN doc_id%3 = 0 THEN 'shadow' WHEN doc_id%3 = 1 THEN 'fog' END AS negative_kind, round((doc_id*37%101)/100.0::DOUBLE*0.4 + quality*0.45, 4) AS p, CAST(quality AS DOUBLE) AS y FROM labels""",
}
NEEDS = {"reports": ("runs",)}


def sql(body: str, *views: str, **more: str) -> str:
    """A query over domain views; `more` adds common table expressions after them."""
    names: list[str] = []
    for v in views:
        names += [n for n in (*NEEDS.get(v, ()), v) if n not in names]
    ctes = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({text})" for n, text in more.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
