"""Children of several tables replaced all at once or not at all.

Overwriting partitions is atomic for none of several tables. Here the new rows of all
tables are written beside the old ones first; then one small file, moved into place
under a name that must not exist, says which folders count from now on. A reader takes
the newest such file, so it sees all of a replacement or nothing, and keeps what it
has seen; what a failed attempt wrote is named by no commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed since this one began."""


#: Keys, and bytes of files to be written anew, of a partition at most; beyond Spark's number of partitions there are more.
KEYS, BYTES = 60_000, 32 << 20


class CommittedTables:
    """Tables under one folder whose rows belong to parents by `key`; rows lie in buckets by the hash of the key.

    The hash is the one by which Spark deals rows, and the number of partitions is a multiple of the number of buckets: so
    rows dealt by key once, for the joins with the replaced keys, are written as they lie, each partition to one bucket.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def version(self) -> int:
        """The newest commit, 0 for none."""
        fs, folder = self._fs(f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _commit(self, version: int) -> dict:
        if not version:
            return {}
        fs, path = self._fs(f"{self.root}/commits/{version:012}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows as of a commit, the newest if none is named."""
        held = self._commit(self.version() if version is None else version)[table]
        schema = StructType.fromJson(held["schema"])
        if not held["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in held["folders"].values()))

    def _bucket(self):
        return F.pmod(F.hash(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _partitions(self, keys: int, folders: list[str]) -> int:
        """In how many partitions rows are dealt: a multiple of the buckets."""
        size = 0
        for folder in folders:
            fs, path = self._fs(f"{self.root}/{folder}")
            size += fs.getContentSummary(path).getLength()
        least = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // KEYS), -(-size // BYTES))
        return self.buckets * -(-least // self.buckets)

    def replace(self, rows: dict[str, DataFrame], keys: DataFrame, still: Callable[[], bool] = lambda: True) -> int:
        """Make `rows` all that the tables hold of `keys`, and return the commit's number.

        Rows of other keys stay as they are; rows given for other keys are left out. Only buckets that hold
        one of the keys are written anew. still: asked just before the commit; if it says no, as when the run
        belongs to another by now, nothing changes and the result is 0. Raises Conflict if another commit
        came first.
        """
        before = self.version()
        held = self._commit(before)
        keys = keys.select(self.key).distinct()
        counted = {r.b: r["count"] for r in keys.groupBy(self._bucket().alias("b")).count().collect()}
        touched = counted.keys()
        made = dict(held)
        for name, new in rows.items():
            old = held.get(name, {"schema": new.schema.jsonValue(), "folders": {}})
            folders = {b: f for b, f in old["folders"].items() if int(b) not in touched}
            stale = [f for b, f in old["folders"].items() if int(b) in touched]
            dealt = lambda rows, n=self._partitions(sum(counted.values()), stale): rows.repartition(n, self.key)
            # neither side is sent to all tasks: where one lies the other is dealt to
            gone = dealt(keys).hint("shuffle_hash")
            new = dealt(new).join(gone, self.key, "left_semi").select(new.columns)
            folder = f"data/{name}/{before + 1:012}-{uuid.uuid4().hex}"
            target = f"{self.root}/{folder}"
            if stale:
                kept = self.spark.read.schema(StructType.fromJson(old["schema"])).parquet(*(f"{self.root}/{f}" for f in stale))
                new = dealt(kept).join(gone, self.key, "left_anti").select(kept.columns).unionByName(new)
            new.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(target)
            fs, path = self._fs(f"{self.root}/{folder}")
            parts = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
            folders |= {p.removeprefix("_bucket="): f"{folder}/{p}" for p in parts if p.startswith("_bucket=")}
            made[name] = {"schema": old["schema"], "folders": folders}
        if not still():
            return 0
        self._publish(before + 1, made)
        return before + 1

    def _publish(self, version: int, made: dict) -> None:
        jvm = self.spark._jvm
        fs, draft = self._fs(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(made).encode())
        stream.close()
        _, final = self._fs(f"{self.root}/commits/{version:012}")
        fs.mkdirs(final.getParent())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), never)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"commit {version} exists") from None
            raise
