"""Running a bounded stream to its end and reading what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a local one where that is unset and all tasks run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumeworks-")
    return f"{base.rstrip('/')}/plumeworks-{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Process all that is there; in complete mode the last trigger's rows, otherwise all triggers' rows.

    A trigger that runs again replaces what it wrote before. A stream without a trigger gives no row.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    written: list[str] = []

    def write(df: DataFrame, batch: int) -> None:
        written.append(f"{out}/batch={batch}")
        df.write.mode("overwrite").parquet(written[-1])

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(written[-1:] if mode == "complete" else dict.fromkeys(written)))
