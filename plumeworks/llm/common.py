"""What the corpus operators share: tables, scratch space, batches, word patterns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that part words, and Unicode's white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, removed when the driver ends.

    A local temporary folder is used only where spark.checkpoint.dir is unset and all
    tasks run on this machine; elsewhere the setting is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumeworks-")
    path = f"{base.rstrip('/')}/plumeworks-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; nothing is left to ask
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to scratch space and read it again: computed once, its lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and an executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library of Linux
        pass


def slices(batches, column: str = "text", most: int = 4 << 20):
    """Parts of record batches with about `most` bytes of `column` each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < n:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(sizes.searchsorted(before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, sizes
        trim()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, the empty one for null."""
    return [x or "" for x in batch.column(column).to_pylist()]


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def crc_text(column) -> F.Column:
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))
