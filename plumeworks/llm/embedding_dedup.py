"""Embedding near-dedup by signs of random hyperplanes (operator 11).

A vector falls on one side of each of many random hyperplanes; the signs for a
few of them are its key in one table. Vectors of one label and length whose keys
agree in any table meet and are compared exactly, by cosine in double precision.
Planes a key follow the size of the largest label, so that a cell holds some
CELL vectors, and tables follow the planes, so that a pair at the threshold
meets in none with a chance of MISS at most: that is the share of links to be
expected missing just there, and less of closer ones.

Equal vectors are made one first. A cell is dealt in blocks of some BLOCK
vectors, and each pair of blocks is compared by one matrix product in a task of
bounded size. A pair counts in the first table that it meets in, so that its
link counts once; a pair of blocks returns numbers of links and a star for each
of its groups, never its pairs. Groups are joined by components.py.

Cases: vectors that are null, without components, zero, or with null or
non-finite components, and rows without a label, link with nothing: n_links is
0 and they are their own component. Vectors of unlike length don't link. Equal
vectors link, repeated rows too, and n_links counts rows. Rows without vec_id
are linked like others; a component has the least vec_id in it, none if it has
none, and then all its rows are kept. A vec_id that stands in several rows is
kept in all that name it as their component. Empty tables give no row. Other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, stored
from .components import components, with_least

THRESHOLD = 0.93
#: Chance at most that a pair at the threshold meets in no table.
MISS = 0.001
#: Expected vectors of a cell, where vectors lie evenly, and vectors of a block.
CELL, BLOCK = 128, 512
#: Bits of a key in one table, as keys are 32-bit integers.
MOST_PLANES = 31
#: Lists of up to so many crowded cells are sent to every task.
FEW = 20_000
SEED = 11

_VALID = "{v} is not null and not exists({v}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({v}, x -> x <> 0) and {l} is not null"


def shape(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Planes of a key, and tables, for `largest` vectors to compare with each other."""
    planes = min(MOST_PLANES, max(4, math.ceil(math.log2(max(1, largest) / CELL))))
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log(1 - agree))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their scale."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.ListArray, rows: np.ndarray | None = None) -> np.ndarray:
    """Vectors of one length as rows."""
    if rows is not None:
        column = column.take(pa.array(rows))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def keys_of(vectors: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """A row of keys for each vector, one key a table."""
    normals = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * planes))
    above = (unit(vectors) @ normals > 0).reshape(len(vectors), tables, planes)
    return (above * (1 << np.arange(planes, dtype=np.int64))).sum(2).astype(np.int32)


def _keyed(batches, planes: int, tables: int):
    for batch in batches:
        lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
        keys = np.zeros((batch.num_rows, tables), np.int32)
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            keys[rows] = keys_of(matrix(batch.column("embedding"), rows), planes, tables)
        made = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows + 1) * tables, pa.int32()), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "keys"])


def _least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's group, where a and b list links between 0 and n - 1."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (again := least[least]).tolist() != least.tolist():
            least = again
    return least


def compare(left: np.ndarray, right: np.ndarray | None, keys: np.ndarray, table: int, threshold: float, rows: int = 1024):
    """Pairs of places (right ones count on from the left ones), within left where right is None: near, and met here first."""
    for at in range(0, len(left), rows):
        near = left[at : at + rows] @ (left if right is None else right).T >= threshold
        a, b = np.nonzero(near)
        a += at
        if right is None:
            a, b = a[a < b], b[a < b]
        else:
            b = b + len(left)
        first = ~(keys[a, :table] == keys[b, :table]).any(1) if table else slice(None)
        yield a[first], b[first]


def _links(group: pa.Table, threshold: float) -> pa.Table:
    """Of a pair of blocks: each linked vector, its links here, and the least member of its group."""
    group = group.combine_chunks()
    table, low, high = (group.column(c)[0].as_py() for c in ("table", "low", "high"))
    block = group.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    group = group.take(pa.array(order))
    n = len(order)
    links, least = np.zeros(n, np.int64), np.arange(n)
    if n > 1:
        x = unit(matrix(group.column("embedding").combine_chunks()))
        keys, copies = matrix(group.column("keys").combine_chunks()), group.column("copies").to_numpy()
        cut = int((block == low).sum())
        pairs = list(compare(x, None, keys, table, threshold) if low == high else compare(x[:cut], x[cut:], keys, table, threshold))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        links += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
        least = _least_joined(n, a, b)
    held = np.flatnonzero(links)
    nodes = group.column("node").combine_chunks()
    return pa.table({"node": nodes.take(pa.array(held)), "links": pa.array(links[held]), "other": nodes.take(pa.array(least[held]))})


def _cells(vectors: DataFrame, planes: int, tables: int) -> DataFrame:
    """Vectors by (label, size, table, key, low, high): one row for each pair of blocks that they belong to."""
    keyed = vectors.mapInArrow(partial(_keyed, planes=planes, tables=tables), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in vectors.schema)}, keys array<int>")
    keyed = stored(keyed, "keyed")
    cell = ["label", "size", "table", "key"]
    crowded = stored(keyed.select("label", "size", F.posexplode("keys").alias("table", "key")).groupBy(cell).agg(F.count("*").alias("n")).where(f"n > {BLOCK}"), "crowded")
    # crowded cells hold BLOCK rows at least; whether their list is short is counted, not taken for granted
    rows = keyed.select("*", F.posexplode("keys").alias("table", "key"))
    rows = rows.join(F.broadcast(crowded) if crowded.count() <= FEW else crowded, cell, "left")
    rows = rows.withColumn("blocks", F.expr(f"cast(ceil(coalesce(n, 1) / {BLOCK}) as int)")).withColumn("block", F.expr("pmod(xxhash64(node, table), blocks)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.select(*cell, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "embedding", "keys")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per row: vec_id, n_links (other rows within the threshold), component_id (the least vec_id that links reach), kept (it is that one)."""
    kind = id_type(rows, key)
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    named = F.concat(F.hex(F.xxhash64("label", "embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(SEED), "embedding", "label")))
    rows = rows.withColumn("node", F.when(F.expr(_VALID.format(v="embedding", l="label")), named))
    vectors = rows.where("node is not null").groupBy("node").agg(F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    vectors = stored(vectors.withColumn("size", F.size("embedding")), "vectors")
    sizes = vectors.groupBy("label", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    largest, total = sizes.agg(F.max("n"), F.sum("rows")).first()
    planes, tables = shape(largest or 0, threshold, miss)
    cells = _cells(vectors.drop("first_id"), planes, tables)
    met = cells.groupBy("label", "size", "table", "key", "low", "high").applyInArrow(lambda group: _links(group, threshold), "node string, links long, other string")
    found = stored(met, "found")
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    light = vectors.select("node", "first_id", "copies").join(counts.hint("merge"), "node", "left").join(joined.hint("merge"), "node", "left")
    light = stored(light.select("node", "first_id", "copies", F.expr("coalesce(links, 0) + copies - 1").alias("n_links"), F.coalesce("component", "node").alias("component")), "labelled")
    least = light.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("degree"))
    owned = with_least(light, least, "component", total or 0).select("node", "n_links", "component_id", F.col("copies").alias("degree"))
    linked = with_least(rows.where("node is not null").select("vec_id", "node"), owned, "node", total or 0).select("vec_id", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("vec_id").cast(kind), "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
