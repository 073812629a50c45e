"""Hard-negative mining by Fagin's threshold algorithm (operator 12).

Candidates are dealt into shards. A shard sorts its rows once by each dimension.
An anchor reads these lists from the end where its sign makes products large,
looks up every row that it meets and scores it whole, in integers. What no list
has shown yet scores no more than the threshold, the anchor's product with the
components just read; reading stops once that is strictly below the score of the
k-th row found in each of the anchor's windows, or below the window itself. Ties
go to the smaller vec_id, so an equal threshold reads on.

The search runs twice: for positives, among shards of the anchor's own label
with one window over all scores; then for negatives, among shards of all rows,
with one window for each positive. Shards hold SHARD rows at most on average, so
a task's memory does not grow; anchors stream through each shard, and each
returns k rows a window, of which the best k are the result.

Cases: rows without vec_id or label, without a vector, or with null or
non-finite components take no part. Vectors of another length than the anchor's
are not compared with it; two vectors without components score 0. Repeated rows
are rows like others: each of them is an anchor, a positive of the other, a
negative. Anchors without positives or without negatives in a window give no
row for it. Scores that 64 bits can't hold raise OverflowError. Empty tables
give no row. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, partitions, stored

#: Scale of the integer components.
SCALE = 256
#: Expected rows of a shard at most, and rows that a shard has at least before there are several.
SHARD, LEAST = 1 << 16, 256
#: Depth of the first step down the lists; each step doubles it.
STEP = 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_PART = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def whole_product(x: list[float], y: list[float]) -> int:
    return sum(int(a) * int(b) for a, b in zip(x, y, strict=True))


class Shard:
    """Candidates with their integer components and, by dimension, their order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # places ascend with ids
        self.ids, self.rows, self.labels, self.x = ids[order], rows[order], labels[order], x[order]
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)
        self.most = float(np.abs(self.x).max(initial=0))

    def product(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where they hold all sums, else in Python's integers."""
        if self.most * float(np.abs(q).sum()) < 2**53:
            return (x @ q).astype(np.int64)
        exact = [whole_product(row, q.tolist()) for row in x.tolist()]
        if any(not LOWEST <= s <= HIGHEST for s in exact):
            raise OverflowError("an inner product does not fit into 64 bits")
        return np.array(exact, np.int64)

    def search(self, q: np.ndarray, windows: list[tuple[int, int]], k: int, label=None, row: int | None = None) -> list[np.ndarray]:
        """Places of the first k rows of each window (low, high) by (score down, vec_id up), with their scores.

        label: rows of it are left out; row: this one is left out.
        """
        n = len(self.ids)
        up = np.flatnonzero(q > 0)
        down = np.flatnonzero(q < 0)
        scores = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        allowed = np.ones(n, bool) if label is None else self.labels != label
        if row is not None:
            allowed &= self.rows != row
        found, k_th = [np.zeros(0, np.int64)] * len(windows), [None] * len(windows)
        depth, step = 0, STEP
        while depth < n:
            top = np.zeros(len(q))  # the largest products that are left, by dimension
            top[up], top[down] = self.sorted[n - 1 - depth, up], self.sorted[depth, down]
            bound = whole_product(top.tolist(), q.tolist())
            if all(bound < low or (least is not None and bound < least) for (low, _), least in zip(windows, k_th, strict=True)):
                break
            to = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.order[n - to : n - depth, up]] = True
            new[self.order[depth:to, down]] = True
            if not len(up) and not len(down):
                new[:] = True
                to = n
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new & allowed)
            scores[at] = self.product(self.x[at], q)
            for i, (low, high) in enumerate(windows):
                more = at[(scores[at] >= low) & (scores[at] <= high)]
                best = np.sort(np.concatenate([found[i], more]))
                found[i] = best[np.argsort(-scores[best], kind="stable")[:k]]
                k_th[i] = int(scores[found[i][-1]]) if len(found[i]) == k else None
            depth, step = to, step * 2
        return [(best, scores[best]) for best in found]


def components_of(column: pa.ListArray) -> np.ndarray:
    """Integer components as doubles, a row for each vector."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * x.reshape(len(column), len(x) // max(1, len(column))))
    if np.isinf(x).any():
        raise OverflowError("a component does not fit into a double")
    return x


def _runs(batches):
    """Parts of the rows that are sorted by `shard`, each of one shard."""
    for batch in batches:
        ids = batch.column("run").to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(ids[a]), batch.slice(a, b - a)


def _codes(labels: list, known: dict) -> np.ndarray:
    return np.array([known.setdefault(x, len(known)) for x in labels], np.int64)


def _searched(batches, k: int, positives: bool):
    """Of each shard, for each of its anchors and windows, the first k rows: candidates come before anchors."""
    current, held, shard, known = None, [], None, {}
    names = ["anchor_row", "nth", "found_row", "found_id", "score"]
    for run, part in _runs(batches):
        if run != current:
            current, held, shard, known = run, [], None, {}
        kind = part.column("is_anchor").to_numpy(zero_copy_only=False)
        cut = int((~kind).sum())
        if cut:
            held.append(part.slice(0, cut))
        part = part.slice(cut)
        if not part.num_rows or not held:
            continue
        if shard is None:
            rows = pa.Table.from_batches(held).combine_chunks()
            id_kind = rows.column("vec_id").type
            shard = Shard(rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), _codes(rows.column("label").to_pylist(), known), components_of(rows.column("embedding").combine_chunks()))
            held = [None]
        out: list[list] = [[], [], [], []]
        codes = _codes(part.column("label").to_pylist(), known)
        windows = part.column("windows").to_pylist()
        for i, (q, row) in enumerate(zip(components_of(part.column("embedding")), part.column("row").to_pylist(), strict=True)):
            spans = [(LOWEST, HIGHEST)] if positives else [(-((-4 * w) // 5), w) for w in windows[i]]
            # 80 p <= 100 s <= 100 p: s from 4/5 of p, rounded up
            results = shard.search(q, spans, k, None if positives else codes[i], row if positives else None)
            for nth, (at, scores) in enumerate(results):
                out[0].extend([row] * len(at))
                out[1].extend([nth] * len(at))
                out[2].append(at)
                out[3].append(scores)
        at = np.concatenate(out[2]) if out[2] else np.zeros(0, np.int64)
        scores = np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(shard.rows[at], pa.int64()), pa.array(shard.ids[at], id_kind), pa.array(scores, pa.int64())], names)


def _search(rows: DataFrame, anchors: DataFrame, by: list[str], k: int, positives: bool) -> DataFrame:
    """The first k rows of each anchor and window (anchor_row, nth, found_row, found_id, score, place) among rows of the same `by`."""
    most = partitions(rows.sparkSession)
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    sizes = sizes.select(*by, F.expr(f"cast(greatest(ceil(n / {SHARD}), least({most}, ceil(n / {LEAST}))) as int)").alias("shards"))
    # one key may hold most rows: it gets as many shards more; the list of keys is sent to tasks only if Spark finds it small
    dealt = rows.join(sizes, by).select("size", "label", F.expr("pmod(xxhash64(row), shards)").cast("int").alias("shard"), F.lit(False).alias("is_anchor"), "row", "vec_id", "embedding", F.lit(None).cast("array<bigint>").alias("windows"))
    asked = anchors.join(sizes, by).select("size", "label", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.lit(True).alias("is_anchor"), "row", "vec_id", "embedding", "windows")
    both = dealt.unionByName(asked).withColumn("run", F.xxhash64(*by, "shard"))
    both = both.repartition(*by, "shard").sortWithinPartitions(*by, "shard", "is_anchor").drop("shard", "size")
    found = both.mapInArrow(partial(_searched, k=k, positives=positives), f"anchor_row long, nth int, found_row long, found_id {id_type(rows, 'vec_id')}, score long")
    first = Window.partitionBy("anchor_row", "nth").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("place", F.row_number().over(first)).where(f"place <= {k}")


def hard_negatives(rows: DataFrame, is_anchor, label=None, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """For each anchor and each of its first k positives the first k rows of another label that score 0.8 to 1 of the positive.

    is_anchor: a condition on rows; label: a column expression, `label` if none.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    source = rows.select(F.col(key).alias("vec_id"), (F.col("label") if label is None else label).alias("label"), F.col(vector).alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    source = source.where(_PART).select("*", F.size("embedding").alias("size"), F.monotonically_increasing_id().alias("row"))
    source = stored(source, "candidates")  # a row keeps its number from here on
    anchors = source.where("asks").withColumn("windows", F.lit(None).cast("array<bigint>")).drop("asks")
    source = source.drop("asks")
    positives = _search(source, anchors, ["size", "label"], k, positives=True)
    positives = stored(positives.select("anchor_row", F.col("place").alias("nth_positive"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = positives.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("nth_positive", "positive_score"))).alias("all"))  # k at most
    windows = windows.select(F.col("anchor_row").alias("row"), F.col("all.positive_score").alias("windows"))
    asking = stored(anchors.drop("windows").join(windows, "row").select("size", "row", "vec_id", "label", "embedding", "windows"), "asking")
    negatives = _search(source, asking, ["size"], k, positives=False)
    negatives = negatives.select("anchor_row", (F.col("nth") + 1).alias("nth_positive"), F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asking.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    found = negatives.join(positives, ["anchor_row", "nth_positive"]).join(named, "anchor_row")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
