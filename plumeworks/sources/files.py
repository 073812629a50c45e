"""Files as tables: media bytes, label text, JSON documents, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sniff_format

# Vehicle classes of label files, the least box in pixels and its least side.
CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
MIN_BOX_PIXELS, MIN_SIDE = 64 * 48, 8
METRICS = "metrics struct<precision: double, recall: double, dice: double, iou: double>, threshold double, samples int"


def media_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file with its size, header, format and checksum."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", sniff_format(F.substring("content", 1, 32)).alias("format"), F.sha2("content", 256).alias("checksum"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names in order, contents unread."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name")


def pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images that have a mask of the same stem."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    return images.join(masks.select(stem(F.col("name")).alias("stem")), stem(F.col("name")) == F.col("stem"), "left_semi")


def label_boxes(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Vehicle boxes of label files, one line an object: class and centre, width and height as shares.

    Lines of fewer than five parts are passed over; other classes and small boxes are left out. A file
    with a class, or a vehicle's number, that can't be read gives no box at all.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t")).where(F.size("t") >= 5)
    number = lambda i: F.when(F.col("t")[i].rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.col("t")[i].try_cast("double"))
    rows = lines.select("file", number(0).cast("int").alias("class_id"), *(number(i + 1).alias(n) for i, n in enumerate(("cx", "cy", "bw", "bh"))))
    vehicle = F.col("class_id").isin(*CLASSES)
    bad = rows.where(F.col("class_id").isNull() | (vehicle & F.expr("cx is null or cy is null or bw is null or bh is null"))).select("file").distinct()
    kind = F.element_at(F.create_map(*(x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v)))), F.col("class_id"))
    px = lambda v: F.bround(v).cast("int")
    side = lambda c, n: F.greatest(F.lit(MIN_SIDE), px(F.col(c) * n))
    boxes = rows.where(vehicle).join(bad, "file", "left_anti").select("file", kind.alias("vehicle_type"), "cx", "cy", side("bw", width).alias("w"), side("bh", height).alias("h"))
    boxes = boxes.select("file", "vehicle_type", px(F.col("cx") * width - F.col("w") / 2).alias("x"), px(F.col("cy") * height - F.col("h") / 2).alias("y"), "w", "h")
    return boxes.where(F.col("w") * F.col("h") >= MIN_BOX_PIXELS)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics document; what cannot be parsed is null."""
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").schema(METRICS).json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# The entries of an index of samples, and of a dataset's manifest.
ENTRY = "file string, label string, negative_kind string, smoke_colour string, source string, mask_coverage double, on_cast_shadow boolean"
MANIFEST = "name string, generator_version string, seed long, tile_size int, totals struct<samples: long, positive: long, negative: long>, splits map<string, struct<count: long, positive: long, negative: long>>"


def _documents(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    rows = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema(f"{schema}, corrupt string").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))


def index_entries(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Entries of index documents, arrays of objects, with their path and time; a repeated file counts once, as its last entry.

    A document that can't be parsed, or with an entry that names no file, gives none.
    """
    rows = _documents(spark, path, ENTRY, pattern).withColumn("place", F.monotonically_increasing_id())
    # in one pass: a document is read and parsed once
    bad = F.max(F.expr("corrupt is not null or file is null")).over(Window.partitionBy("path"))
    good = rows.withColumn("bad", bad).where("not bad")
    columns = [c for c in good.columns if c not in ("corrupt", "place", "bad")]
    newest = good.groupBy("path", "file").agg(F.max_by(F.struct(*columns), "place").alias("e"))
    return newest.select("e.*")


def manifests(spark: SparkSession, path: str, pattern: str = "manifest.json") -> DataFrame:
    """A row for each manifest; what can't be parsed has nulls and readable = false."""
    rows = _documents(spark, path, MANIFEST, pattern)
    return rows.withColumn("readable", F.col("corrupt").isNull() & F.col("generator_version").isNotNull()).drop("corrupt")


def reusable(manifests: DataFrame, version: str, seed: int) -> DataFrame:
    """Manifests whose dataset may be used as it is: of the same generator and seed."""
    return manifests.where(F.col("readable") & (F.col("generator_version") == version) & (F.col("seed") == seed))


def to_read_again(found: DataFrame, known: DataFrame) -> DataFrame:
    """Documents (path, modified) that `known` doesn't hold in the same state: the key of a cache is both."""
    return found.select("path", "modified").distinct().join(known.select("path", "modified"), ["path", "modified"], "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write children so that each key's rows replace what stood under that key, and others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def seed_runs(ids: DataFrame, key: str = "id", media: int = 25, days: int = 400, seed: int = 11) -> DataFrame:
    """Synthetic runs for load tests, one for each id: the same rows for the same seed, wherever they are made."""
    pick = lambda salt, m: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key), F.lit(seed), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("bigint") % m
    severity: Column = F.element_at(F.array(*map(F.lit, ("", "low", "moderate", "high"))), (pick(1, 4) + 1).cast("int"))
    return ids.select(F.col(key).alias("analysis_id"), pick(2, media).alias("media_id"), severity.alias("overall_severity"), (1 + pick(3, 3)).cast("int").alias("vehicles"), F.date_sub(F.lit("2001-08-01").cast("date"), pick(4, days).cast("int")).alias("created_on"))
