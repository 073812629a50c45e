"""Substring deduplication through FM-indexes of shards (operator 6).

A window is 13 consecutive words. Of its 5-word grams the one of least hash is
its minimizer, and consecutive windows with one minimizer form a segment. Equal
windows have equal minimizers, so dealing segments to shards by minimizer
brings all copies of a window to one shard, at a cost in proportion to the text.

1. Each text's minimizers are counted by shard. Those of two or more texts set
   bits in a filter; a false hit costs time, never a result. Those of very many
   texts are hot: in step 2 grams that are hot come last when a window chooses its
   minimizer, so that windows which share a frequent phrase, but little else, are
   dealt by their other words. Windows of hot grams alone stay together.
2. Segments with a set minimizer, or with a window whose choice step 1 changed,
   are kept: each distinct segment with its least document, and each occurrence
   with its document and place.
3. Each shard builds an FM-index over its distinct segments and streams them
   through it. Backward search gives matching statistics; an interval that
   reaches 13 words is a window's places, whose least document is its first.
4. Occurrences are joined with the answers of their segments. A hot passage is
   one segment in its shard, and its occurrences are rows that Spark can split.

Words are compared by 64-bit hashes for segments and 32 bits a word inside the
index, where 13 words must agree.

The bytes of all texts set the number of shards (one for SHARD_BYTES of text, two
for a partition at least), so that a shard's index has a size that does
not grow with the input, and the size of the filter between the bounds of
FILTER_BYTES. Beyond the upper bound more segments travel. Filter and hot
minimizers (some HOT) are all that goes through the driver.

Cases: null and empty texts have no words; texts of fewer than 13 words keep
them all. Rows without doc_id neither give nor lose words. Rows of equal doc_id
do not remove each other's words; each is judged by its own text. Empty tables
give no row. Long texts and long repetitive runs are segments like others.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, trim
from .fm_index import FMIndex

WINDOW = 13
GRAM = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes of text for one shard, and for one partition of shards.
SHARD_BYTES, PARTITION_BYTES = 16 << 20, 512 << 20
#: The filter's least and largest size.
FILTER_BYTES = 16 << 20, 64 << 20
#: A minimizer is hot beyond this count. A slice counts it twice at most.
HOT_COUNT = 512
#: Where texts have a minimizer for 16 bytes or more, no more than this many are hot: larger inputs raise the count.
HOT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: So many powers of a base are kept; others are made of these, block by block, as a worker keeps what it holds between tasks.
_STEP = 1 << 12
_powers: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """base^0 ... base^(_STEP-1) modulo 2^64."""
    if base not in _powers:
        low = np.full(_STEP, base, np.uint64)
        low[0] = 1
        _powers[base] = np.multiply.accumulate(low)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[start:end] for each range."""
    sums = np.zeros(len(values) + 1, np.uint64)
    part = sums[1:]  # in place: the values may be all bytes of a slice
    np.add(values, np.uint64(1), out=part)
    low, leap = powers(_BASE), pow(_BASE, _STEP, 1 << 64)
    for block, a in enumerate(range(0, len(part), _STEP)):
        part[a : a + _STEP] *= low[: len(part) - a] * np.uint64(pow(leap, block, 1 << 64))
    np.cumsum(part, out=part)
    # shifted to the start of the range by the base's inverse
    inverse = pow(_BASE, -1, 1 << 64)
    leap = pow(inverse, _STEP, 1 << 64)
    high = np.array([pow(leap, block, 1 << 64) for block in range(int(starts.max()) // _STEP + 1 if len(starts) else 1)], np.uint64)
    return mix((sums[ends] - sums[starts]) * (high[starts // _STEP] * powers(inverse)[starts % _STEP]) + (ends - starts).astype(np.uint64))


class Words:
    """The words of a batch of texts: where they lie in its bytes, their hashes and their texts."""

    def __init__(self, column: pa.Array, lower: bool = False):
        """lower: take A-Z for a-z."""
        column = column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8) if lower else raw
        offsets = offsets - offsets[0]
        seen = ~_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        before = np.r_[False, seen[:-1]]
        after = np.r_[seen[1:], False]
        self.starts = np.flatnonzero(seen & (~before | cut[:-1]))
        self.ends = np.flatnonzero(seen & (~after | cut[1:])) + 1
        del seen, cut, before, after
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.raw = raw
        self.hashes = range_hashes(raw, self.starts, self.ends)
        self.counts = np.bincount(self.doc, minlength=len(column))
        self.first = np.r_[0, self.counts.cumsum()]

    def runs(self, hot=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments: first window's word, number of windows, minimizer, and whether a window has another one without hot.

        hot: tells of an array of grams which are hot; these are chosen last.
        """
        h, n = self.hashes, len(self.hashes) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        gram = np.zeros(len(h) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(_BASE) + h[k : k + len(gram)]
        gram = mix(gram)
        least = _least(gram, n)
        changed = np.zeros(n, bool)
        if hot is not None:
            last = hot(gram)
            cool = _least(np.where(last, np.uint64(_MASK), gram), n)
            cool = np.where(cool == np.uint64(_MASK), least, cool)
            least, changed = cool, cool != least
        inside = self.doc[:n] == self.doc[WINDOW - 1 :]
        begins = inside & np.r_[True, ~inside[:-1] | (least[1:] != least[:-1]) | (self.doc[1:n] != self.doc[: n - 1])]
        start = np.flatnonzero(begins)
        stop = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True])
        upto = np.r_[0, changed.cumsum()]
        return start, stop - start + 1, least[start], upto[stop + 1] > upto[start]


def _least(gram: np.ndarray, n: int) -> np.ndarray:
    """The least gram of each of n windows."""
    least, width = gram, 1
    while 2 * width <= WINDOW - GRAM + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = WINDOW - GRAM + 1 - width
    return np.minimum(least[:n], least[rest : rest + n])


def _place(minimizers: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each minimizer, and its bit in the shard's part of the filter."""
    return (minimizers % np.uint64(shards)).astype(np.int64), ((minimizers >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def _split(shard: np.ndarray, *arrays: np.ndarray):
    """The arrays' parts by shard; shard is sorted."""
    if not len(shard):
        return
    edges = np.flatnonzero(np.r_[True, np.diff(shard) != 0])
    for a, b in zip(edges, np.r_[edges[1:], len(shard)], strict=True):
        yield int(shard[a]), [x[a:b] for x in arrays]


def _minimizers(batches, shards: int):
    """Each text's minimizers by shard, 32 bits each, twice a slice at most."""
    for batch in slices(batches, most=2 << 20):
        words = Words(batch.column("text"))
        start, _, least, _ = words.runs()
        order = np.lexsort((words.doc[start], least))
        least, doc = least[order], words.doc[start][order]
        new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])] if len(least) else np.zeros(0, bool)
        least = least[new]
        third = np.zeros(len(least), bool)
        third[2:] = least[2:] == least[:-2]
        least = least[~third]
        shard, marks = _place(least, shards, 1 << 32)
        order = np.argsort(shard, kind="stable")
        rows = list(_split(shard[order], marks[order].astype("<u4")))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x.tobytes() for _, (x,) in rows], pa.binary())], ["shard", "marks"])


def _repeated(group: pa.Table, bits: int, hot_count: int) -> pa.Table:
    """The part of the filter of one shard, and its hot minimizers."""
    marks, counts = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in group.column("marks").to_pylist()]), return_counts=True)
    twice = marks[counts > 1].astype(np.uint64)
    part = np.zeros(bits, bool)
    part[((twice * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)] = True
    shard = group.column("shard")[0].as_py()
    hot = (np.uint64(shard) << np.uint64(32)) | marks[counts > hot_count].astype(np.uint64)
    return pa.table({"shard": pa.array([shard], pa.int32()), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary()), "hot": pa.array([hot.tobytes()], pa.binary())})


def _names(minimizers: np.ndarray, shards: int) -> np.ndarray:
    """Shard and mark as one number."""
    shard, mark = _place(minimizers, shards, 1 << 32)
    return (shard.astype(np.uint64) << np.uint64(32)) | mark


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array of one element or more."""
    return among[np.minimum(among.searchsorted(values), len(among) - 1)] == values


_SEGMENTS = "shard int, seg array<long>, seg_min array<long>, seg_max array<long>, seg_len array<int>, words binary"
_PLACES = "seg long, doc_id long, text_hash long, pos int"


class Segments:
    """A slice's segments with a repeated minimizer, in order of shard, name and document."""

    def __init__(self, batch: pa.RecordBatch, table: np.ndarray, hot: np.ndarray, bits: int):
        self.words = words = Words(batch.column("text"))
        start, windows, least, changed = words.runs((lambda gram: _found(_names(gram, len(table)), hot)) if len(hot) else None)
        shard, bit = _place(least, len(table), bits)
        bit = bit.astype(np.int64)
        # a window that left a hot minimizer is in no count of its new one, so the filter can't tell of it
        hit = ((table[shard, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1) | changed
        hit &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[words.doc[start]]
        start, shard = start[hit], shard[hit]
        stop = start + windows[hit] + WINDOW - 1
        name = range_hashes(words.hashes, start, stop).view(np.int64)
        row = words.doc[start]
        doc = batch.column("doc_id").fill_null(0).to_numpy()[row]
        order = np.lexsort((doc, name, shard))
        self.name, self.doc, self.row, self.start, self.stop, self.shard = (x[order] for x in (name, doc, row, start, stop, shard))


def _segments(batches, bits: int, parts):
    """The slices' distinct segments, by shard, with their first and last documents."""
    lists = pa.list_(pa.int64()), pa.list_(pa.int32())
    for batch in slices(batches, most=3 << 20):
        found = Segments(batch, *parts.value, bits)
        short = found.words.hashes.astype(np.uint32)
        rows = []
        for s, (n, d, a, b) in _split(found.shard, found.name, found.doc, found.start, found.stop):
            first = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            last = np.r_[first[1:], len(n)] - 1
            lens = b[first] - a[first]
            ends = lens.cumsum()
            at = np.repeat(a[first] - (ends - lens), lens) + np.arange(ends[-1])
            rows.append((s, n[first], d[first], d[last], lens.astype(np.int32), short[at].astype("<u4").tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32(), lists[0], lists[0], lists[0], lists[1], pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SEGMENTS.split(", ")])


def _places(batches, bits: int, parts):
    """All occurrences of these segments: name, document and first word."""
    for batch in slices(batches, most=3 << 20):
        found = Segments(batch, *parts.value, bits)
        text = batch.column("text_hash").to_numpy()[found.row]
        yield pa.RecordBatch.from_arrays([pa.array(found.name), pa.array(found.doc), pa.array(text), pa.array((found.start - found.words.first[found.row]).astype(np.int32))], [x.split()[0] for x in _PLACES.split(", ")])


def first_documents(seg_len: np.ndarray, words: np.ndarray, seg_min: np.ndarray) -> np.ndarray:
    """For each window of distinct segments in turn, the least document of all segments that hold it."""
    names, text = np.unique(words, return_inverse=True)
    n, m = len(seg_len), len(words)
    starts = seg_len.cumsum() - seg_len
    # the segments behind each other, each closed by symbol 0
    at = np.arange(m) + np.repeat(np.arange(n), seg_len)
    full = np.zeros(m + n, np.int64)
    full[at] = text.reshape(-1) + 1
    index = FMIndex(full, len(names) + 1, WINDOW)
    windows = seg_len - WINDOW + 1
    begin = np.repeat(starts + np.arange(n), windows) + np.arange(windows.sum()) - np.repeat(windows.cumsum() - windows, windows)
    lo, hi, _ = index.intervals(full, begin + WINDOW - 1, WINDOW)
    owner = np.repeat(seg_min, windows)
    many = np.flatnonzero(hi - lo > 1)  # at full length: more places than its own
    if len(many):
        doc = np.repeat(seg_min, seg_len + 1)[index.order]
        edges, which = np.unique(np.stack([lo[many], hi[many]], 1), axis=0, return_inverse=True)
        least = np.minimum.reduceat(np.r_[doc, doc[-1:]], edges.reshape(-1))[::2]
        owner[many] = least[which.reshape(-1)]
    return owner


def _shard_answers(group: pa.Table) -> pa.Table:
    """The least document of each window of the shard's segments that are found in more than one document."""
    flat = {c: np.concatenate([x.values.to_numpy() if hasattr(x, "values") else x for x in group.column(c)]) for c in ("seg", "seg_min", "seg_max", "seg_len")}
    words = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group.column("words")])
    starts = flat["seg_len"].astype(np.int64).cumsum() - flat["seg_len"]
    names, first, which = np.unique(flat["seg"], return_index=True, return_inverse=True)
    low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(low, which, flat["seg_min"])
    np.maximum.at(high, which, flat["seg_max"])
    lens = flat["seg_len"][first].astype(np.int64)
    ends = lens.cumsum()
    words = words[np.repeat(starts[first] - (ends - lens), lens) + np.arange(ends[-1])]
    firsts = first_documents(lens, words, low)
    windows = lens - WINDOW + 1
    offsets = np.r_[0, windows.cumsum()]
    del words
    trim()
    useful = np.minimum.reduceat(firsts, offsets[:-1]) < high
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, windows[useful].cumsum()], pa.int32()), pa.array(firsts[np.repeat(useful, windows)], pa.int64()))
    return pa.table({"seg": pa.array(names[useful], pa.int64()), "firsts": lists})


def _cut(batches):
    """Count and hash what stays of each text."""
    for batch in slices(batches, most=2 << 20):
        words = Words(batch.column("text"))
        n, removed, digests = words.counts, [], []
        raw, a, b = words.raw.tobytes(), words.starts.tolist(), words.ends.tolist()
        for i, cuts in enumerate(batch.column("starts__").to_pylist()):
            x, y = int(words.first[i]), int(words.first[i + 1])
            gone = covered(cuts, y - x)
            kept = range(x, y) if gone is None else (np.flatnonzero(~gone) + x).tolist()
            removed.append(y - x - len(kept))
            digests.append(hashlib.sha256(b" ".join([raw[a[k] : b[k]] for k in kept])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches):
    """All columns with the text less its repeated words; texts that lose their last word go."""
    for batch in slices(batches, most=2 << 20):
        words = Words(batch.column("text"))
        texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
        for i, cuts in enumerate(batch.column("starts__").to_pylist()):
            x, y = int(words.first[i]), int(words.first[i + 1])
            gone = covered(cuts, y - x)
            if gone is None:
                continue
            edge = np.r_[words.starts[x:y], words.ends[y - 1]]  # a word goes with the space behind it
            raw = words.raw
            parts = [raw[edge[a] : edge[b]].tobytes() for a, b in _spans(~gone)]
            texts[i] = b"".join(parts).decode("utf-8", "surrogatepass").rstrip()
            keep[i] = bool(parts)
        out = {c: batch.column(c) for c in batch.schema.names if c != "starts__"}
        out["text"] = pa.array(texts, pa.string())
        if "n_chars" in out:
            out["n_chars"] = pa.array([a if u is v or u == v else len(v) for a, u, v in zip(out["n_chars"].to_pylist(), batch.column("text").to_pylist(), texts, strict=True)], out["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out)).filter(pa.array(keep))


def _spans(kept: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, kept, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def covered(cuts: list[int] | None, n: int) -> np.ndarray | None:
    """Which of n words lie in windows that begin at the cuts; None for no cut."""
    if not cuts:
        return None
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(np.array(cuts))
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return edge.cumsum()[:-1] > 0


def _dealt(rows: DataFrame, count: int):
    """The rows grouped by shard, in partitions of equally many shards: hashes of few numbers would deal them unevenly."""
    return rows.withColumn("bin", F.col("shard") % count).repartitionById(count, "bin").groupBy("bin", "shard")


def repeated_windows(docs: DataFrame, filter_bytes: tuple[int, int] = FILTER_BYTES, shard_bytes: int = SHARD_BYTES, hot_count: int = HOT_COUNT) -> DataFrame:
    """Rows (doc_id, text_hash, starts): the windows of a text that start in an earlier document too.

    filter_bytes: least and largest size of the filter; a byte for 512 of text between them.
    shard_bytes: bytes of text for one shard. hot_count: the least count beyond which a minimizer is hot.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    count = max(partitions(spark), -(-total // PARTITION_BYTES))
    shards = count * max(2, -(-total // (shard_bytes * count)))
    bits = 8 * max(1, min(max(filter_bytes[0], total // 512), filter_bytes[1]) // shards)
    hot_count = max(hot_count, total // (16 * HOT))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    marks = source.select("text").mapInArrow(partial(_minimizers, shards=shards), "shard int, marks binary")
    # one step in Python for each task: further ones need workers of their own, which stay and hold memory
    parts = _dealt(marks, count).applyInArrow(lambda group: _repeated(group, bits, hot_count), "shard int, part binary, hot binary")
    table, hot = np.zeros((shards, bits // 8), np.uint8), [np.zeros(0, np.uint64)]
    for shard, part, frequent in zip(*parts.toArrow().columns, strict=True):
        table[shard.as_py()] = np.frombuffer(part.as_py(), np.uint8)
        hot.append(np.frombuffer(frequent.as_py(), np.uint64))
    shared = spark.sparkContext.broadcast((table, np.sort(np.concatenate(hot))))
    # computed twice rather than kept: the second pass costs less than a copy of the segments
    segments = source.select("doc_id", "text").mapInArrow(partial(_segments, bits=bits, parts=shared), _SEGMENTS)
    answers = _dealt(segments, count).applyInArrow(lambda group: _shard_answers(group), "seg long, firsts array<long>")
    places = source.mapInArrow(partial(_places, bits=bits, parts=shared), _PLACES)
    found = places.join(answers, "seg").select("doc_id", "text_hash", F.expr("filter(transform(firsts, (f, i) -> IF(f < doc_id, pos + i, NULL)), x -> x IS NOT NULL)").alias("starts"))
    return found.where("size(starts) > 0").groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _with_starts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    found = repeated_windows(docs).select(F.col("doc_id").alias("doc_id__"), F.col("text_hash").alias("text_hash__"), F.col("starts").alias("starts__"))
    match = (F.col("doc_id").cast("long") == F.col("doc_id__")) & (F.xxhash64("text") == F.col("text_hash__"))
    return rows.join(found.hint("shuffle_hash"), match, "left").drop("doc_id__", "text_hash__")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: words, removed words, and the SHA-256 of the kept words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_starts(docs.select("doc_id", "text"), docs).mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def drop_repeated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, their texts less the words that earlier documents hold.

    Unchanged texts stay as they are; a text that loses all its words goes. n_chars follows its text.
    """
    return _with_starts(docs, docs).mapInArrow(_rewrite, docs.schema)
