"""Binary shards of token ids with a minimal perfect hash index (operator 8).

A shard file holds the ids of documents in key order. A minimal perfect hash
maps each distinct key to a slot in constant time; the slot keeps a fingerprint
of its key, so that foreign keys are refused, and the row where the key's ids
begin. Layout, all little-endian: the header below, then keys (i64 a row), row
ends in ids (u64 a row), level sizes in 64-bit words (u32 a level), level words
(u64), fingerprints (u32 a slot), rows (u32 a slot), ids (u16 or u32).

A table of the shards with their first and last keys lies beside them in key order.
`lookup` deals the wanted keys by range, so that a task reads those entries of the
table that its keys fall into, opens these shards alone, and of them reads the index
and the spans of the ids: what it costs follows the keys, not the shards there are.

Cases: null and empty texts hold the end id alone. Rows without a key come first,
counted in the header, and are in no index. Keys are whole numbers, else TypeError.
Repeated keys are kept in the order of the hash of their texts; the index gives the
first row and the rest follow it, in later shards too. Rows of one key, or without
one, are dealt out by that hash and their place in the input, not to one task. Empty tables write no file and read back as no row. Texts of
any length are encoded whole; a shard holds one text at least. Other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_type, partitions, scratch_path, slices, stored, texts
from .pretokens import encode_texts

MAGIC = b"PWT2"
#: magic, bytes of an id, levels, rows, rows without key, slots, ids.
HEADER = struct.Struct("<4sHHQQQQ")
#: Types of keys, the name of the table of shards, and its entries in a row group, which is what a reader may pass over.
WHOLE = ("tinyint", "smallint", "int", "bigint")
TABLE, ENTRIES = "shards.parquet", 10_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mix of 64-bit keys for each seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bits: a key sits at the first level where no other key of that level shares its bit."""

    FINGERPRINT_SEED = 1 << 20

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.before = np.r_[0, np.bitwise_count(self.words).cumsum(dtype=np.int64)]

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.6) -> PerfectHash:
        levels = []
        while len(keys):
            n = max(1, int(np.ceil(len(keys) * room / 64)))
            bit = mix(keys, len(levels)) % np.uint64(64 * n)
            _, at, count = np.unique(bit, return_inverse=True, return_counts=True)
            alone = count[at] == 1
            words = np.zeros(n, np.uint64)
            np.bitwise_or.at(words, (bit[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit[alone] & np.uint64(63)))
            levels.append(words)
            keys = keys[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for a key that no level holds; a foreign key may get a slot."""
        found, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for seed, words in enumerate(self.levels):
            bit = mix(keys[open_], seed) % np.uint64(64 * len(words))
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            value = words[word]
            hit = (value >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << shift) - np.uint64(1)))
            found[open_[hit]] = (self.before[base + word] + below)[hit]
            open_, base = open_[~hit], base + len(words)
        return found

    @classmethod
    def fingerprints(cls, keys: np.ndarray) -> np.ndarray:
        return mix(keys, cls.FINGERPRINT_SEED).astype(np.uint32)


def shard_bytes(keys: np.ndarray, lens: np.ndarray, ids: np.ndarray, bare: int = 0) -> bytes:
    """The file of one shard; keys ascend, behind `bare` rows without one."""
    first = first_rows(keys, bare)
    index = PerfectHash.build(keys[first])
    slot = index.slots(keys[first])
    prints, rows = np.zeros(len(first), "<u4"), np.zeros(len(first), "<u4")
    prints[slot], rows[slot] = PerfectHash.fingerprints(keys[first]), first
    head = HEADER.pack(MAGIC, ids.itemsize, len(index.levels), len(keys), bare, len(first), len(ids))
    return b"".join([head, keys.astype("<i8").tobytes(), lens.cumsum().astype("<u8").tobytes(), np.array([len(x) for x in index.levels], "<u4").tobytes(), index.words.astype("<u8").tobytes(), prints.tobytes(), rows.tobytes(), ids.tobytes()])


def first_rows(keys: np.ndarray, bare: int) -> np.ndarray:
    """The first row of each key."""
    rest = keys[bare:]
    return np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]][: len(rest)]) + bare


class Shard:
    """A shard file's bytes, with keyed access."""

    def __init__(self, raw: bytes):
        magic, width, levels, n, self.bare, slots, total = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, kind, count, at)
            at += part.nbytes
            return part

        self.keys, self.ends = take("<i8", n), take("<u8", n).astype(np.int64)
        sizes = take("<u4", levels)
        self.index = PerfectHash([take("<u8", int(x)) for x in sizes])
        self.prints, self.rows = take("<u4", slots), take("<u4", slots)
        self.ids = take(f"<u{width}", total)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 for keys that the shard doesn't hold."""
        slot = self.index.slots(keys)
        slot = np.where(slot < len(self.rows), slot, -1)
        if not len(self.rows):
            return slot
        known = (slot >= 0) & (self.prints[slot] == PerfectHash.fingerprints(keys))
        return np.where(known, self.rows[slot].astype(np.int64), -1)

    def span(self, row: int) -> tuple[int, int]:
        """Where a row's ids begin and end."""
        return (int(self.ends[row - 1]) if row else 0), int(self.ends[row])


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(batches, folder: str, tokenizer: str, end_id: int, width: int, most: int):
    """Write a partition's rows, which ascend by key, as shards of about `most` ids."""
    task = TaskContext.get()
    system, base = _file_system(folder)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    part, seq = task.partitionId(), 0

    def flush():
        nonlocal seq
        keys, bare, lens, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        name = f"{part:08d}-{seq:06d}.ids"
        draft = f"{base}/.{name}.{task.taskAttemptId()}"
        with system.open_output_stream(draft) as out:
            out.write(shard_bytes(keys, lens, ids, int(bare.sum())))
        system.move(draft, f"{base}/{name}")  # a repeated task replaces the file by an equal one
        seq += 1
        ends = (keys[bare.sum()], keys[-1]) if not bare.all() else (None, None)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((name, len(keys), len(ids), *ends), (pa.string(), *[pa.int64()] * 4), strict=True)], ["shard", "n_rows", "n_ids", "first_key", "last_key"])

    waiting = 0
    for batch in slices(batches):
        ids, lens = encode_texts(texts(batch), tokenizer)
        lens = lens + 1
        full = np.full(int(lens.sum()), end_id, f"<u{width}")
        inner = np.ones(len(full), bool)
        inner[lens.cumsum() - 1] = False
        full[inner] = ids
        keys = batch.column("key")
        held.append((keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), lens, full))
        waiting += len(full)
        if waiting >= most:
            yield flush()
            waiting = 0
    if held:
        yield flush()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", column: str = "text", most: int = 16 << 20) -> DataFrame:
    """Write all documents in ascending key order under `folder`, a path that all executors share.

    Returns one row a shard: file name, rows, ids, first and last key, and the ids of all shards before it.
    """
    from tokenizers import Tokenizer

    if id_type(docs, key) not in WHOLE:
        raise TypeError(f"{key} is {id_type(docs, key)}; shards are in the order of whole numbers")
    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    system, base = _file_system(folder)
    system.create_dir(base)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text")).withColumns({"hash": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = [F.col("key").asc_nulls_first(), F.col("hash"), F.col("nth")]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("key", "text")
    made = rows.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, width=width, most=most), "shard string, n_rows long, n_ids long, first_key long, last_key long")
    made = stored(made, "shards")
    placed = made.withColumn("start", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])
    placed.repartitionByRange(partitions(spark), "shard").sortWithinPartitions("shard").write.option("parquet.block.row.count.limit", ENTRIES).parquet(f"{folder}/{TABLE}")
    return spark.read.parquet(f"{folder}/{TABLE}")


def _read(batches, folder: str):
    system, base = _file_system(folder)
    for batch in batches:
        for name, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with system.open_input_stream(f"{base}/{name}") as file:
                shard = Shard(file.read())
            rows, begin = np.arange(len(shard.keys)), first_rows(shard.keys, shard.bare)
            found = shard.find(shard.keys[begin])
            if (found != begin).any():
                raise ValueError(f"{name}: the index does not find its keys")
            # rows without a key, then the rows of each key from the one that the index gives
            each = np.diff(np.r_[begin, len(rows)])
            rows[shard.bare :] = np.repeat(found, each) + rows[shard.bare :] - np.repeat(begin, each)
            spans = [shard.span(int(r)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.keys, pa.int64(), mask=rows < shard.bare),
                    pa.array([start + a for a, _ in spans], pa.int64()),
                    pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in spans], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """Every document's place and checksum, each got from its shard through the index."""
    spread = shards.select("shard", "start").repartition(partitions(shards.sparkSession), "shard")
    return spread.mapInArrow(partial(_read, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


class ShardFile:
    """A shard in a file that is read where it is needed: the index once, then keys, ends and ids by row."""

    def __init__(self, file):
        self.file = file
        magic, self.width, levels, self.n, self.bare, self.slots, self.total = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.keys_at = HEADER.size
        self.ends_at = self.keys_at + 8 * self.n
        at = self.ends_at + 8 * self.n
        sizes = np.frombuffer(self._at(at, 4 * levels), "<u4").astype(np.int64)
        at += 4 * levels
        words = np.frombuffer(self._at(at, int(8 * sizes.sum())), "<u8")
        self.index = PerfectHash(np.split(words, sizes.cumsum()[:-1]) if levels else [])
        at += 8 * int(sizes.sum())
        # fingerprints and rows, eight bytes a key together
        self.prints = np.frombuffer(self._at(at, 4 * self.slots), "<u4")
        self.rows = np.frombuffer(self._at(at + 4 * self.slots, 4 * self.slots), "<u4")
        self.ids_at = at + 8 * self.slots

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    find = Shard.find

    def found(self, key: int, row: int):
        """The ids of each row of a key, from its first row on."""
        while row < self.n and struct.unpack("<q", self._at(self.keys_at + 8 * row, 8))[0] == key:
            begin, end = struct.unpack("<QQ", self._at(self.ends_at + 8 * (row - 1), 16)) if row else (0, *struct.unpack("<Q", self._at(self.ends_at, 8)))
            yield np.frombuffer(self._at(self.ids_at + self.width * begin, self.width * (end - begin)), f"<u{self.width}").astype(np.int32)
            row += 1


def _entries(system, path: str, low: int, high: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Shards that may hold keys from low to high, in order, with their first and last keys."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["shard", "first_key", "last_key"], filter=(pc.field("first_key") <= high) & (pc.field("last_key") >= low)).sort_by("shard")
    return table.column("shard").to_pylist(), table.column("first_key").to_numpy(), table.column("last_key").to_numpy()


def _lookup(batches, folder: str):
    """Rows of sorted keys; a shard stays open for the keys that follow each other."""
    system, base = _file_system(folder)
    name, shard = None, None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        names, first, last = _entries(system, f"{base}/{TABLE}", int(keys[0]), int(keys[-1]))
        begin, end = np.searchsorted(last, keys, "left"), np.searchsorted(first, keys, "right")
        out: list[list] = [[], [], []]
        for key, a, b in zip(keys.tolist(), begin.tolist(), end.tolist(), strict=True):
            for i in range(a, b):  # several only where a key goes on in the next shard
                if names[i] != name:
                    name, shard = names[i], ShardFile(system.open_input_file(f"{base}/{names[i]}"))
                row = int(shard.find(np.array([key]))[0])
                for ids in shard.found(key, row) if row >= 0 else ():
                    out[0].append(key)
                    out[1].append(name)
                    out[2].append(ids)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32()))], ["key", "shard", "ids"])


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """The ids of each distinct key of `keys` that the shards under `folder` hold: key, shard, ids, a row for each row of the key.

    Foreign keys and nulls give no row.
    """
    if id_type(keys, key) not in WHOLE:
        raise TypeError(f"{key} is {id_type(keys, key)}; shards are in the order of whole numbers")
    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    dealt = wanted.repartitionByRange(partitions(keys.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(partial(_lookup, folder=folder), "key long, shard string, ids array<int>")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id), folder)
