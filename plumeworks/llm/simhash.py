"""SimHash near-duplicates through segment popcounts (operator 9).

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit
segments. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so it bounds it from below. At a distance of 3 or
less, one half of the vector differs by 1 at most: the grid's cells are the
halves of vectors, and a cell is joined with itself and with the cells that are
one step up in one segment. What meets there passes the bound over both halves
and is then verified bit by bit.

Fingerprints are made distinct first, so copies cost nothing. A cell's
fingerprints travel in blocks dealt by hash, and a pair of blocks returns a
spanning forest of its links, never all pairs of a dense group.

Cases: texts without words (null, empty, blank) have fingerprint zero and are
linked like others. Texts of one or two words have one shingle; of long texts all
shingles count. A bit that half of the hashes set is 0. Repeated rows share a
component. Rows without doc_id are linked too; a component of such rows
only has no id. Empty tables give no row. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, slices, stored, texts
from .components import components, with_least

SEED = 42
#: Blocks that a cell's fingerprints are dealt to; a cell of one fingerprint fills one of them.
BLOCKS = 32
PAIRS = 0x5555555555555555
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str, width: int = 3) -> int:
    """The 64-bit SimHash over word shingles, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(_hash, shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches, key: str, column: str, width: int):
    for batch in slices(batches, column):
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([fingerprint(x, width) for x in texts(batch, column)], pa.int64())], ["doc_id", "fp"])


def popcounts(x: np.ndarray) -> np.ndarray:
    """The bit counts of all two-bit segments, each in its segment."""
    return x - ((x >> np.uint64(1)) & np.uint64(PAIRS))


def manhattan(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of two vectors of two-bit counts 0, 1 and 2."""
    low, low2 = np.uint64(PAIRS), np.uint64(PAIRS << 1)
    two_p, two_q, one_p, one_q = (p & low2) >> np.uint64(1), (q & low2) >> np.uint64(1), p & low, q & low
    zero_p, zero_q = ~(two_p | one_p) & low, ~(two_q | one_q) & low
    far = (two_p & zero_q) | (zero_p & two_q)
    near = (one_p ^ one_q) & low
    return 2 * np.bitwise_count(far) + np.bitwise_count(near)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what all links connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (r := root(x)) != (s := root(y)):
            parent[s] = r
            out[0].append(x)
            out[1].append(y)
    return out


def _links(batches, most: int, chunk: int = 1 << 20):
    """Verified links of pairs of blocks."""
    for batch in batches:
        left, right = batch.column("left_fps"), batch.column("right_fps")
        a, b = left.flatten().to_numpy().view(np.uint64), right.flatten().to_numpy().view(np.uint64)
        na, nb = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right))
        at_a, at_b = na.cumsum() - na, nb.cumsum() - nb
        pairs = na * nb
        ends = pairs.cumsum()
        row = 0
        while row < len(pairs):
            before = ends[row - 1] if row else 0
            to = max(row + 1, int(ends.searchsorted(before + chunk, "right")))
            part = slice(row, to)
            which = np.repeat(np.arange(row, to), pairs[part])
            k = np.arange(len(which)) - np.repeat(pairs[part].cumsum() - pairs[part], pairs[part])
            x, y = a[at_a[which] + k // nb[which]], b[at_b[which] + k % nb[which]]
            near = manhattan(popcounts(x), popcounts(y)) <= most
            x, y = x[near], y[near]
            same = (np.bitwise_count(x ^ y) <= most) & (x != y)
            u, v = _forest(x[same].view(np.int64), y[same].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])
            row = to


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` within `most` differing bits; most is 3 at most."""
    if most > 3:
        raise ValueError("two halves and one step reach a distance of 3")
    halves = fps.select("fp", F.posexplode(F.expr("array(fp & 4294967295L, shiftrightunsigned(fp, 32))")).alias("half", "bits"))
    halves = halves.select("fp", F.expr("bits - (shiftrightunsigned(bits, 1) & 1431655765L) + half * 8589934592L").alias("cell"))
    blocks = halves.groupBy("cell", F.expr(f"pmod(xxhash64(fp), {BLOCKS})").alias("block")).agg(F.collect_list("fp").alias("fps"))
    steps = F.expr("transform(filter(sequence(0, 15), i -> (shiftrightunsigned(cell, 2 * i) & 2L) = 0L), i -> cell + shiftleft(1L, 2 * i))")
    left = blocks.select(F.col("cell").alias("own"), F.col("block").alias("left_block"), F.col("fps").alias("left_fps"), F.explode(F.concat(F.array("cell"), steps)).alias("cell"))
    met = left.join(blocks.select("cell", F.col("block").alias("right_block"), F.col("fps").alias("right_fps")).hint("merge"), "cell")
    met = met.where("own <> cell or left_block < right_block or (left_block = right_block and size(left_fps) > 1)")
    return met.select("left_fps", "right_fps").mapInArrow(partial(_links, most=most), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (the fingerprint as a signed integer), component_id (its least doc_id)."""
    kind = id_type(docs, key)
    prints = stored(docs.select(key, column).mapInArrow(partial(_fingerprints, key=key, column=column, width=width), f"doc_id {kind}, fp long"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    labels = components(links(distinct.select("fp"), most))
    named = distinct.join(labels.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first_id", "rows", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("degree"))
    # a component of many fingerprints, and a fingerprint of many rows, are not dealt to one task
    total = prints.count()
    owned = with_least(named, least, "component", total).select("fp", "component_id", F.col("rows").alias("degree"))
    return with_least(prints, owned, "fp", total).select("doc_id", "fp", "component_id")
