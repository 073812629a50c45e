"""The domain's tables, derived from the star schema that tests and benchmarks provide.

Every adapter is a projection of one table, so that filters and column choices
reach the scan. The SQL of the same views stands in plans/views.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of an account's four media.
EXTENSIONS = ("jpg", "png", "mp4", "mov")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis runs, from orders."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    failed = status == "P"
    waiting = F.when(key % 3 == 0, "pending").when(key % 3 == 1, "queued").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        key.alias("analysis_id"),
        (F.col("o_custkey") * 4 + key % 4).alias("media_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(status == "F", "done").when(failed, "failed").otherwise(waiting).alias("status"),
        F.when(failed, "").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "moderate").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("").alias("overall_severity"),
        F.when(failed, 0.0).otherwise(F.round(F.least(F.col("o_totalprice") / 600000, F.lit(1.0)), 4)).alias("avg_confidence"),
        F.when(failed, F.lit(0)).otherwise((key % 9).cast("int")).alias("total_vehicles"),
        F.when(failed, F.lit(0)).otherwise((key % 9 / 3).cast("int")).alias("total_smoke"),
        (1 + key % 40).cast("int").alias("frames_processed"),
        (key % 101).cast("int").alias("progress"),
        F.when(key % 2 == 0, "pending").when(key % 7 == 0, "failed").otherwise("skipped").alias("report_status"),
        F.col("o_orderdate").alias("created_at"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four media of each account, from customer."""
    k = F.col("k")
    name = F.concat(F.lit("Cam_"), F.col("c_mktsegment"), F.lit("_"), F.col("c_custkey"), F.lit("_"), k, F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), k + 1))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return rows.select(
        (F.col("c_custkey") * 4 + k).alias("media_id"),
        F.col("c_custkey").alias("user_id"),
        name.alias("filename"),
        F.element_at(F.array(*map(F.lit, EXTENSIONS)), k + 1).alias("format"),
        F.when(k < 2, "image").otherwise("video").alias("media_type"),
        ((F.col("c_custkey") * 7919 + k * 104729) % 600000000).alias("size_bytes"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected vehicles, from lineitem."""
    kind = F.when(F.col("l_returnflag") == "A", "car").when(F.col("l_returnflag") == "R", "truck").when(F.col("l_linestatus") == "F", "bus").otherwise("motorcycle")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("vehicle_id"),
        F.col("l_orderkey").alias("analysis_id"),
        kind.alias("vehicle_type"),
        F.col("l_linenumber").alias("frame_number"),
        (F.col("l_partkey") % 600).cast("int").alias("x"),
        (F.col("l_suppkey") % 400).cast("int").alias("y"),
        (F.col("l_quantity") + 20).cast("int").alias("w"),
        (F.col("l_quantity") + 10).cast("int").alias("h"),
        F.round(0.35 + F.col("l_tax") * 5, 4).alias("confidence"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of long clips, one for each supplier: hundreds of frames of ten days, with boxes that cross."""
    kind = F.when(F.col("l_returnflag") == "A", "car").when(F.col("l_returnflag") == "R", "truck").when(F.col("l_linestatus") == "F", "bus").otherwise("motorcycle")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("clip_id"),
        F.floor(F.datediff("l_shipdate", F.lit("1995-01-01")) / 10).alias("frame"),
        (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("vehicle_id"),
        kind.alias("vehicle_type"),
        (F.col("l_partkey") * 37 % 240).cast("int").alias("x"),
        (F.col("l_orderkey") * 53 % 160).cast("int").alias("y"),
        (F.col("l_quantity") + 90).cast("int").alias("w"),
        (F.col("l_quantity") + 70).cast("int").alias("h"),
        F.round(0.35 + F.col("l_tax") * 5, 4).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", F.round(F.abs("l_discount") * 10, 6)).alias("intensity"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoke regions, from lineitem rows of status F."""
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return rows.select(
        (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("vehicle_id"),
        F.col("l_orderkey").alias("analysis_id"),
        F.round(F.abs(F.col("l_discount")) * 10, 6).alias("intensity"),
        F.round(0.5 + F.abs(F.col("l_tax")) * 4, 6).alias("confidence"),
        F.round(F.col("l_quantity") / 100, 6).alias("area_ratio"),
        F.round(0.3 + F.abs(F.col("l_discount")) * 7, 6).alias("opacity"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of every second finished run."""
    rows = runs(spark, sf_dir).where("status = 'done' and analysis_id % 2 = 0")
    return rows.select(
        F.col("analysis_id").alias("report_id"),
        "analysis_id",
        (F.col("created_at") + F.expr("INTERVAL 90 MINUTES")).alias("generated_at"),
        (1 + F.col("analysis_id") % 12).cast("int").alias("page_count"),
        (F.col("analysis_id") * 37 % 5000000).alias("file_size_bytes"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, from customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("  User"), F.col("c_custkey"), F.lit("@Example.COM ")).alias("email"),
        F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("user").alias("role"),
    )


def settings(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The one row of live settings."""
    return spark.sql("SELECT 1 AS id, 0.35D AS confidence_threshold, 0.5D AS smoke_mask_threshold, 0.33D AS severity_low_max, 0.66D AS severity_moderate_max, 5 AS frame_sample_rate, 300 AS max_video_seconds, 512 AS max_upload_mb, 'jpg,jpeg,png' AS allowed_image_formats, 'mp4,avi,mov' AS allowed_video_formats, true AS auto_generate_pdf")


def observations(spark: SparkSession, sf_dir: str, fired: tuple[str, ...] = ("error", "purchase")) -> DataFrame:
    """Steps of tracks that are already associated, from events; a step fires on the given event types."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), "ts", "event_id", F.col("event_type").isin(*fired).alias("fired"), F.round(F.least(F.col("value") / 50, F.lit(1.0)), 6).alias("intensity"), F.col("event_type").alias("vehicle_type")
    )


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation pairs: a pseudo-score and a truth for each labelled document."""
    score = F.round((F.col("doc_id") * 37 % 101) / 100.0 * 0.4 + F.col("quality") * 0.45, 4)
    kind = F.when(F.col("quality") == 1, None).when(F.col("doc_id") % 3 == 0, "shadow").when(F.col("doc_id") % 3 == 1, "fog")
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 97).alias("item"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"), kind.alias("negative_kind"), score.alias("p"), F.col("quality").cast("double").alias("y"))
