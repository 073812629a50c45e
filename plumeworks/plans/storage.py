"""Files and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources import files, images
from ..sources.commits import CommittedTables
from ..streaming.runner import scratch
from .base import query
from .views import sql

_CARS, _REGIONS = ("SELECT {t} AS table_name, count(*) AS n, coalesce(CAST(sum({v}) AS BIGINT), 0) AS total FROM ".format(t=t, v=v) for t, v in (("'vehicles'", "frame_number"), ("'regions'", "CAST(round(intensity*1000000) AS BIGINT)")))


@query(
    sql(
        "SELECT 'first' AS moment, * FROM c1 UNION ALL SELECT 'first', * FROM r1 UNION ALL SELECT 'failed', * FROM c1 UNION ALL SELECT 'failed', * FROM r1 UNION ALL SELECT 'second', * FROM c2 UNION ALL SELECT 'second', * FROM r2 UNION ALL SELECT 'lost', * FROM c2 UNION ALL SELECT 'lost', * FROM r2",
        "vehicles", "regions",
        c1=f"{_CARS} vehicles", r1=f"{_REGIONS} regions",
        c2=f"{_CARS} (SELECT CASE WHEN analysis_id%10 = 3 THEN frame_number + 100 ELSE frame_number END AS frame_number FROM vehicles WHERE analysis_id%10 <> 3 OR frame_number < 3)",
        r2=f"{_REGIONS} (SELECT intensity FROM regions WHERE analysis_id%10 <> 3)",
    )
)
def atomic_replacement(spark, sf_dir):
    """Children of every tenth run replaced in two tables: once in vain, as the second table fails, once whole, once by a writer that has lost the run."""
    cars, regions = A.vehicles(spark, sf_dir).select("analysis_id", "vehicle_id", "frame_number"), A.regions(spark, sf_dir).select("analysis_id", "vehicle_id", "intensity")
    store = CommittedTables(spark, scratch(spark, "children"), "analysis_id")
    store.replace({"vehicles": cars, "regions": regions}, cars.select("analysis_id"))

    def totals(moment: str):
        each = (("vehicles", F.col("frame_number")), ("regions", F.round(F.col("intensity") * 1000000)))
        made = [store.read(t).agg(F.lit(moment).alias("moment"), F.lit(t).alias("table_name"), F.count("*").alias("n"), F.coalesce(F.sum(v.cast("bigint")), F.lit(0)).alias("total")) for t, v in each]
        return made[0].unionByName(made[1])

    first = totals("first")
    some = cars.where("analysis_id % 10 = 3")
    changed = some.where("frame_number < 3").withColumn("frame_number", F.col("frame_number") + 100)
    broken = regions.withColumn("intensity", F.raise_error(F.lit("the disk is full")).cast("double"))
    try:
        store.replace({"vehicles": changed, "regions": broken}, some.select("analysis_id"))
        raise AssertionError("a failing write must not commit")
    except Exception as e:
        if "the disk is full" not in str(e):
            raise
    failed = totals("failed")
    store.replace({"vehicles": changed, "regions": regions.where("false")}, some.select("analysis_id"))
    second = totals("second")
    store.replace({"vehicles": cars.where("false"), "regions": regions.where("false")}, some.select("analysis_id"), still=lambda: False)
    return first.unionByName(failed).unionByName(second).unionByName(totals("lost"))


_ENTRIES = "SELECT doc_id, doc_id//100 AS part, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, CASE WHEN quality = 0 THEN CASE doc_id%3 WHEN 0 THEN 'shadow' WHEN 1 THEN 'fog' END END AS negative_kind, round((doc_id%50)/100.0::DOUBLE, 6) AS coverage FROM labels"


@query(
    sql(
        "SELECT label, coalesce(negative_kind, '?') AS negative_kind, count(*) AS n, round(avg(coverage), 6) AS mean_coverage FROM e WHERE part%3 <> 1 GROUP BY 1, 2 UNION ALL SELECT 'manifest', 'readable', count(DISTINCT part), CAST(sum(1) AS DOUBLE) FROM e WHERE part%3 <> 1 UNION ALL SELECT 'manifest', 'unreadable', count(DISTINCT part), NULL FROM e WHERE part%3 = 1 HAVING count(*) > 0",
        e=_ENTRIES,
    )
)
def index_documents(spark, sf_dir):
    """Index and manifest documents, written in parts and read back; every third part has been cut off."""
    k, q = F.col("doc_id"), F.col("quality")
    kind = F.when(q == 0, F.when(k % 3 == 0, "shadow").when(k % 3 == 1, "fog"))
    entries = A.table(spark, sf_dir, "labels").select(F.floor(k / 100).alias("part"), F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".png")).alias("file"), F.when(q == 1, "positive").otherwise("negative").alias("label"), kind.alias("negative_kind"), F.round(k % 50 / 100.0, 6).alias("mask_coverage"))
    cut = lambda c: F.when(F.col("part") % 3 == 1, F.substring(c, 1, 20)).otherwise(c)
    parts = entries.groupBy("part").agg(F.to_json(F.collect_list(F.struct("file", "label", "negative_kind", "mask_coverage"))).alias("value"), F.count("*").alias("n"))  # 100 entries at most
    totals = F.to_json(F.struct(F.lit("smoke").alias("name"), F.lit("2.0.0").alias("generator_version"), F.col("part").alias("seed"), F.struct(F.col("n").alias("samples")).alias("totals")))
    index, manifest = scratch(spark, "index"), scratch(spark, "manifest")
    parts.select("part", cut(F.col("value")).alias("value")).repartition("part").write.partitionBy("part").text(index)
    parts.select("part", cut(totals).alias("value")).repartition("part").write.partitionBy("part").text(manifest)
    found = files.index_entries(spark, index, "*.txt").groupBy("label", F.coalesce("negative_kind", F.lit("?")).alias("negative_kind")).agg(F.count("*").alias("n"), F.round(F.avg("mask_coverage"), 6).alias("mean_coverage"))
    state = files.manifests(spark, manifest, "*.txt").groupBy(F.lit("manifest").alias("label"), F.when(F.col("readable"), "readable").otherwise("unreadable").alias("negative_kind")).agg(F.count("*").alias("n"), F.sum("totals.samples").cast("double").alias("mean_coverage"))
    return found.unionByName(state)


def _hex(number, size: int):
    """A column of whole numbers as little-endian bytes in hex."""
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)))


@query(
    "SELECT vec_id, CASE WHEN vec_id%11 <> 0 THEN 8 END AS height, CASE WHEN vec_id%11 <> 0 THEN 8 END AS width, CASE WHEN vec_id%11 <> 0 THEN CASE vec_id%3 WHEN 0 THEN total WHEN 1 THEN total*2 ELSE total*3 END END AS blue, CASE WHEN vec_id%11 <> 0 THEN CASE vec_id%3 WHEN 0 THEN total ELSE total*2 END END AS green, CASE WHEN vec_id%11 <> 0 THEN total END AS red "
    "FROM (SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda v: floor(least(80, greatest(0, 40 + 100*v::DOUBLE))))) AS BIGINT) AS total FROM embeddings)"
)
def decoded_images(spark, sf_dir):
    """Grey maps, colour maps and bitmaps, decoded to the sums of their channels; every eleventh has lost its end."""
    k = F.col("vec_id")
    levels = F.transform("embedding", lambda v: F.floor(F.least(F.lit(80.0), F.greatest(F.lit(0.0), 40 + 100 * v.cast("double")))))
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    pixels = lambda f: F.array_join(F.transform("levels", f), "")
    text = lambda s: F.hex(F.lit(s).cast("binary"))
    rows = A.table(spark, sf_dir, "embeddings").select("vec_id", levels.alias("levels"))
    grey = F.concat(text("P5\n# grey\n8 8\n255\n"), pixels(byte))
    colour = F.concat(text("P6 8 8 255\n"), pixels(lambda v: F.concat(byte(v), byte(v * 2), byte(v * 2))))
    head = F.concat(text("BM"), *(_hex(F.lit(n), s) for n, s in ((310, 4), (0, 4), (54, 4), (40, 4), (8, 4), (8, 4), (1, 2), (32, 2), (0, 4), (256, 4), (0, 4), (0, 4), (0, 4), (0, 4))))
    bitmap = F.concat(head, pixels(lambda v: F.concat(byte(v * 3), byte(v * 2), byte(v), F.lit("FF"))))
    whole = F.when(k % 3 == 0, grey).when(k % 3 == 1, colour).otherwise(bitmap)
    content = F.unhex(F.when(k % 11 == 0, F.substring(whole, 1, 60)).otherwise(whole))
    got = images.decoded(rows.select("vec_id", content.alias("content")))
    # the bytes of each channel, summed where they are
    channel = lambda at: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, i: a + F.conv(F.substring(F.col("hexed"), i * 6 + 1 + 2 * at, 2), 16, 10).cast("bigint"))
    return got.withColumn("hexed", F.hex("bgr")).select("vec_id", "height", "width", channel(0).alias("blue"), channel(1).alias("green"), channel(2).alias("red"))
