"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling (operator 3).

The next token is drawn in the restaurant of its context. New tables of contexts
whose words end alike are customers of one parent restaurant that they share, its
new tables those of the root restaurant, and the root's draw uniformly from the
vocabulary and one unknown word. The context is that of the token before: the
start of a text, each of the most frequent words for itself, or one of the buckets
into which the other words of an ending are hashed. Words and buckets with a
context of their own grow with the fourth root of the training tokens (Contexts).

Every training token of the corpus is seated. Counts of frequent words, whose
number is bounded, are kept in arrays by word and context; all other words'
tokens are shuffled by word. Each sweep of the sampler runs in parallel over
words: given the restaurants' totals from the sweep before, the tables of a
word in a restaurant are drawn from their conditional P(t | c) ~ a^t S(c, t), with
generalised Stirling numbers up to EXACT customers, and by the saddle point of
their generating function beyond (the mean of t is off by 3 % at most at 300
customers, and less with more). Totals of all contexts are summed between
sweeps. A text's score averages the predictive probabilities of kept sweeps, and
its perplexity is that of a token.

Cases: null and empty texts are one end token. Rows without doc_id are training
rows. Unknown words draw the parent's unknown. Repeated rows count and score
each for itself. Without training rows every probability is 1. Empty tables give no row. Texts of
any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_text, id_type, partitions, slices, stored, trim

ENDINGS = 64  # classes of a word's last three bytes, one parent restaurant each; the start of a text has another
OWN = 63  # frequent words with a context of their own for each bucket of an ending
UNIT = 1 << 16  # training tokens for one bucket an ending; 16 times as many for twice the contexts
SHARD = 1 << 20  # tokens of rare words in a shard, about; a shard is one row
CELLS = 1 << 22  # frequent words times contexts, whose counts and probabilities are arrays; it bounds those words, not the contexts
EXACT = 256
END = b""
ALL = b" "  # stands for all training tokens among counts of words, and is none


def held_out() -> F.Column:
    return F.coalesce(F.pmod(crc_text(F.col("doc_id")), F.lit(7)) == 2, F.lit(False))


class Contexts:
    """The frequent words and the context that each word is for the next: the start 0, own words, then buckets by ending."""

    def __init__(self, ranked: list[bytes], buckets: int, frequent: int | None = None, rare: int = 0):
        """ranked: words from the most frequent on; the first `frequent` (all, if None) are kept in arrays. rare: training tokens of other words."""
        self.words = {w: i for i, w in enumerate(ranked[:frequent])}
        self.buckets, self.rare = buckets, rare
        own = ranked[: OWN * buckets]
        self.own = {w: 1 + i for i, w in enumerate(own)}  # whether or not a word is kept in arrays
        self.size = 1 + OWN * buckets + ENDINGS * buckets
        above = np.zeros(OWN * buckets, np.int64)
        above[: len(own)] = [1 + ending(w) for w in own]
        self.group = np.r_[0, above, np.repeat(np.arange(1, ENDINGS + 1), buckets)]  # the parent of each context
        self.of_frequent = np.array([*map(self.of, self.words), 0])
        # a context and the held-out mark share a number
        self.mark = np.dtype(np.uint8 if self.size <= 1 << 7 else "<u2" if self.size <= 1 << 15 else "<u4")
        self.held = self.mark.type(1 << 8 * self.mark.itemsize - 1)

    def of(self, word: bytes) -> int:
        return self.own.get(word) or 1 + OWN * self.buckets + ending(word) * self.buckets + zlib.crc32(word) % self.buckets


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def buckets(tokens: int, unit: int) -> int:
    return max(1, round((tokens / unit) ** 0.25))


class Tokens:
    """Tokens of a slice: index among the frequent words (-1: none), context, row, and the rare words."""

    def __init__(self, values: list[str | None], contexts: Contexts):
        words: list[bytes] = []
        lens = []
        for x in values:
            w = (x or "").encode("utf-8", "surrogatepass").lower().split()
            words += w
            words.append(END)
            lens.append(len(w) + 1)
        self.lens = np.array(lens, np.int64)
        self.row = np.repeat(np.arange(len(lens)), self.lens)
        self.index = np.fromiter(map(contexts.words.get, words, repeat(-1)), np.int64, len(words))
        self.rare = np.flatnonzero(self.index < 0)
        self.rare_words = [words[i] for i in self.rare.tolist()]
        own = contexts.of_frequent[self.index]
        own[self.rare] = np.fromiter(map(contexts.of, self.rare_words), np.int64, len(self.rare))
        self.context = np.r_[0, own[:-1]]
        self.context[self.lens.cumsum() - self.lens] = 0


def tables(counts: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish with its customers, where a new table weighs a and a taken one its customers less d."""
    t = np.minimum(counts, 1)
    log_s = stirling(d)
    log_a = np.log(np.maximum(a, 1e-300))
    order = np.argsort(np.minimum(counts, EXACT), kind="stable")
    size = np.minimum(counts, EXACT)[order]
    edges = np.searchsorted(size, np.arange(2, EXACT + 2))
    for c, begin, end in zip(range(2, EXACT + 1), edges, edges[1:], strict=False):
        for at in range(begin, end, 1 << 12):
            part = order[at : min(end, at + (1 << 12))]
            k = np.arange(1, c + 1)
            t[part] = 1 + (log_s[c, 1 : c + 1] + np.outer(log_a[part], k) + rng.gumbel(size=(len(part), c))).argmax(1)
    many = np.flatnonzero(counts > EXACT)
    if len(many):
        t[many] = np.minimum(1 + large_room(counts[many], a[many], d, rng), counts[many])
    return t


def large_room(counts: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables but the first customer's of dishes with many customers.

    a^t S(c, t) is the weight of t - 1 tables, a Poisson number, and the first customer's table that
    hold c customers in all. The saddle point x of their generating function exp(a/d (1 - (1 - x)^d)) (1 - x)^(d - 1)
    at c - 1 customers gives the mean and variance of t - 1, which is drawn from the binomial distribution that has them.
    """
    c, a = counts.astype(float), np.maximum(a, 1e-300)
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # of log(1 - x)
    for _ in range(60):
        mid = (low + high) / 2
        y, x = np.exp(mid), -np.expm1(mid)
        over = a * x * np.exp((d - 1) * mid) + (1 - d) * x / y > c - 1
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    mean, others = a / d * -np.expm1(d * mid), a * x * np.exp((d - 1) * mid)
    spread = others * (1 + x * (1 - d) / y) + (1 - d) * x / y**2
    less = np.minimum(others**2 / spread, mean * (1 - 1e-9))  # how much the variance is below the mean
    few = less <= 1e-3 * mean
    n = np.where(few, 1, np.maximum(1, np.rint(mean**2 / np.where(few, 1, less))))
    return np.where(few, rng.poisson(np.where(few, mean, 0)), rng.binomial(n.astype(np.int64), np.clip(mean / n, 0, 1)))


_stirling_memory: dict[float, np.ndarray] = {}


def stirling(d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: seatings of c customers at t tables, up to EXACT."""
    if d not in _stirling_memory:
        s = np.full((EXACT + 1, EXACT + 2), -np.inf)
        s[0, 0] = 0
        for c in range(EXACT):
            t = np.arange(1, c + 2)
            stay = np.full(c + 1, -np.inf)
            inner = np.maximum(c - t * d, 1e-300)
            ok = np.isfinite(s[c, 1 : c + 2]) & (c - t * d > 0)
            stay[ok] = s[c, 1 : c + 2][ok] + np.log(inner[ok])
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, 0 : c + 1], stay)
        _stirling_memory[d] = s
    return _stirling_memory[d]


class Restaurants:
    """Types (word, context) with their customers in one shard, and the sampler's steps over them."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, seed: int, words: int, group: np.ndarray):
        """Words are numbered from 0 to words - 1; those without a type have no customers. group: the parent of each context."""
        self.context, self.count, self.words, self.contexts = context, count, words, len(group)
        self.rng = np.random.default_rng(seed)
        # types (word, parent), and the one of each type (word, context)
        self.keys2, self.up = np.unique(word * (ENDINGS + 1) + group[context], return_inverse=True)
        self.word2, self.group2 = self.keys2 // (ENDINGS + 1), self.keys2 % (ENDINGS + 1)
        self.t = np.minimum(count, 1)
        self.c2 = self._sum(self.up, self.t, len(self.keys2))
        self.t2 = np.minimum(self.c2, 1)
        self.c1 = self._sum(self.word2, self.t2, self.words)
        self.t1 = np.minimum(self.c1, 1)

    @staticmethod
    def _sum(at: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at, of, size).astype(np.int64)

    def sweep(self, m: dict) -> None:
        root = root_probability(m, self.c1, self.t1)[self.word2]
        parent = parent_probability(m, self.c2, self.t2, self.group2, root)
        self.t = tables(self.count, (m["theta"] + m["d"] * m["t"][self.context]) * parent[self.up], m["d"], self.rng)
        self.c2 = self._sum(self.up, self.t, len(self.keys2))
        self.t2 = tables(self.c2, (m["theta2"] + m["d2"] * m["t2"][self.group2]) * root, m["d2"], self.rng)
        self.c1 = self._sum(self.word2, self.t2, self.words)
        self.t1 = tables(self.c1, np.full(self.words, m["new1"]), m["d1"], self.rng)

    def totals(self) -> np.ndarray:
        """Tables by context, by parent, and those of the root."""
        return np.r_[np.bincount(self.context, self.t, self.contexts), np.bincount(self.group2, self.t2, ENDINGS + 1), self.t1.sum()]

    def run(self, chain: list[dict], kept: tuple | list = ()) -> dict[int, tuple[np.ndarray, ...]]:
        """Repeat the sweeps of a chain; after those kept: tables by type, the parents' customers and tables, and the root's by word."""
        out = {}
        for r, m in enumerate(chain):
            self.sweep(m)
            if r in kept:
                out[r] = (self.t, self.c2, self.t2, self.c1, self.t1)
        return out


def root_probability(m: dict, customers, seats):
    return (customers - m["d1"] * seats + m["new1"]) / (m["theta1"] + m["C1"])


def parent_probability(m: dict, customers, seats, group, root):
    return (customers - m["d2"] * seats + (m["theta2"] + m["d2"] * m["t2"][group]) * root) / (m["theta2"] + m["c2"][group])


def probabilities(m: dict, customers, seats, context, parent):
    return (customers - m["d"] * seats + (m["theta"] + m["d"] * m["t"][context]) * parent) / (m["theta"] + m["c"][context])


def _word_counts(batches):
    found: Counter = Counter()
    for batch in slices(batches):
        for x in batch.column("text").to_pylist():
            words = (x or "").encode("utf-8", "surrogatepass").lower().split()
            found.update(words)
            found[ALL] += len(words) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def contexts_of(docs: DataFrame, most: int, unit: int = UNIT) -> Contexts:
    """The end and the most frequent words of all training rows, numbered, and the contexts for as many tokens.

    Words kept in arrays are at most `most`, and fewer where contexts are so many that they would not fit
    into CELLS; words with a context of their own are OWN for each bucket at every size.
    """
    rows = docs.where(~held_out()).select("text")
    top = rows.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")
    # no word is met as often as all tokens together
    found = [(bytes(w), n) for w, n in top.limit(most + 1).collect()]
    total = found[0][1] if found else 0
    per = buckets(total, unit)
    if len(found) == most + 1 < OWN * per:  # beyond some 5e15 tokens with the defaults
        found = [(bytes(w), n) for w, n in top.limit(OWN * per).collect()]
    frequent = min(most, max(1, CELLS // ((OWN + ENDINGS) * per + 1)))
    return Contexts([END, *(w for w, _ in found[1:])], per, 1 + frequent, total - sum(n for _, n in found[1 : 1 + frequent]))


_GATHERED = "kind int, shard int, keys binary, counts binary, contexts binary, docs binary"


def _gather(batches, contexts, shards: int, blocks: int):
    """Counts of frequent words (kind 0) by block of words, tokens of rare ones (kind 1) by shard."""
    contexts = contexts.value
    size = -(-len(contexts.words) // blocks) * contexts.size
    total = np.zeros(size * blocks, np.int32)
    names = [x.split()[0] for x in _GATHERED.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    for batch in slices(batches):
        tokens = Tokens(batch.column("text").to_pylist(), contexts)
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        use = (tokens.index >= 0) & ~held[tokens.row]
        np.add.at(total, tokens.index[use] * contexts.size + tokens.context[use], 1)
        name = np.fromiter(map(xxhash.xxh64_intdigest, tokens.rare_words), np.uint64, len(tokens.rare))
        row = tokens.row[tokens.rare]
        context = tokens.context[tokens.rare].astype(contexts.mark) | np.where(held[row], contexts.held, contexts.mark.type(0))
        doc = batch.column("doc_key").to_numpy()[row]
        shard = (name % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(1, s, name[p].tobytes(), b"", context[p].tobytes(), doc[p].tobytes()) for s in np.flatnonzero(np.diff(edges)).tolist() for p in [order[edges[s] : edges[s + 1]]]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    rows = []
    for b in range(blocks):
        at = np.flatnonzero(total[b * size : (b + 1) * size])
        if len(at):
            rows.append((0, b, at.astype("<u4").tobytes(), total[b * size + at].astype("<u4").tobytes(), b"", b""))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _joined(group: pa.Table, column: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in group.column(column)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


SEATED = ["kind", "shard", "names", "types", "counts"]
_COMPACT = "kind int, shard int, names binary, types binary, counts binary, words binary, contexts binary, docs binary"


def _compact(group: pa.Table, size: int, mark: np.dtype, held: np.integer) -> pa.Table:
    """One row for a shard: its distinct words and types, sorted, and the tokens of rare words with their texts."""
    kind, shard = group.column("kind")[0].as_py(), group.column("shard")[0].as_py()
    entries: list[bytes] = [b"", b"", b""]
    if kind == 0:
        types, which = np.unique(_joined(group, "keys", "<u4"), return_inverse=True)
        count = np.bincount(which, _joined(group, "counts", "<u4"))
        names, word = np.unique(types // size, return_inverse=True)
        types = word * size + types % size
    else:
        names, word = np.unique(_joined(group, "keys", "<u8"), return_inverse=True)
        marks, doc = _joined(group, "contexts", mark), _joined(group, "docs", "<i8")
        train = marks < held
        types, count = np.unique(word[train] * size + marks[train], return_counts=True)
        order = np.argsort(doc, kind="stable")
        entries = [word[order].astype("<u4").tobytes(), marks[order].tobytes(), doc[order].tobytes()]
    trim()
    row = [[kind], [shard], [names.astype("<u8").tobytes()], [types.astype("<i8").tobytes()], [count.astype("<i8").tobytes()], *([x] for x in entries)]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.table([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _COMPACT.split(", ")])


class Shard:
    """One shard's words and types, from its compact row. Words met in held-out rows alone have no type."""

    def __init__(self, row: dict, mark: np.dtype, held: np.integer, group: np.ndarray):
        self.kind, self.number = row["kind"], row["shard"]
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.names, self.types, count = read("names", "<u8"), read("types", "<i8"), read("counts", "<i8")
        word, context = self.types // len(group), self.types % len(group)
        if "docs" not in row:  # sweeps don't read the tokens
            row = row | dict.fromkeys(("words", "contexts", "docs"), b"")
        self.entry_word, marks, self.doc = read("words", "<u4").astype(np.int64), read("contexts", mark), read("docs", "<i8")
        self.entry_context = (marks & (held - 1)).astype(np.int64)
        self.rooms = Restaurants(word, context, count, zlib.crc32(f"{self.kind}/{self.number}".encode()), len(self.names), group)
        self.word_count = np.bincount(word, count, len(self.names)).astype(np.int64)


def _shards(batches, form: tuple):
    for batch in batches:
        for i in range(batch.num_rows):
            # bytes are read where they lie in the batch
            yield Shard({c: v.as_buffer() if isinstance(v := batch.column(c)[i], pa.BinaryScalar) else v.as_py() for c in batch.schema.names}, *form)
            trim()


def _values(totals: np.ndarray | None) -> pa.RecordBatch:
    values = np.zeros(0) if totals is None else totals
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values.astype(np.float64))], ["i", "v"])


def _first(batches, form: tuple):
    """Customers and types by context, types by parent, then tokens, words, and what is met once and twice at each level."""
    total = None
    for s in _shards(batches, form):
        r = s.rooms
        more = [r.count.sum(), (s.word_count > 0).sum(), (r.count == 1).sum(), (r.count == 2).sum(), (r.c2 == 1).sum(), (r.c2 == 2).sum(), (r.c1 == 1).sum(), (r.c1 == 2).sum()]
        got = np.r_[np.bincount(r.context, r.count, r.contexts), r.totals()[:-1], more]
        total = got if total is None else total + got
    yield _values(total)


def _swept(batches, form: tuple, chain: list[dict]):
    total = None
    for s in _shards(batches, form):
        s.rooms.run(chain)
        total = s.rooms.totals() if total is None else total + s.rooms.totals()
    yield _values(total)


def _summed(shards: DataFrame, run) -> np.ndarray:
    """Sums over all shards of what run gives each task: as many numbers as there are contexts, twice and a few."""
    found = dict(shards.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect())
    return np.array([found[i] for i in range(len(found))])


def _discount(once: float, twice: float) -> float:
    return float(min(0.95, max(0.05, once / max(1.0, once + 2 * twice))))


def train(shards: DataFrame, form: tuple, burn_in: int = 2, keep: int = 2, theta: float = 1.0) -> tuple[list[dict], list[int], dict]:
    """The chain of totals: before each sweep, and after the last; the sweeps kept; and corpus counts."""
    shards = shards.select(SEATED)
    got = _summed(shards, partial(_first, form=form))
    if not len(got):
        return [], [], {"N": 0, "V": 0}
    group = form[-1]
    size, twice_size = len(group), 2 * len(group)
    c, t, t2, (n, v, *met) = got[:size], got[size:twice_size], got[twice_size : twice_size + ENDINGS + 1], got[twice_size + ENDINGS + 1 :]
    fixed = {"c": c, "theta": theta, "theta2": theta, "theta1": theta} | {k: _discount(*x) for k, x in zip(("d", "d2", "d1"), (met[:2], met[2:4], met[4:]), strict=True)}

    def state(t: np.ndarray, t2: np.ndarray, t1: float) -> dict:
        return fixed | {"t": t, "c2": np.bincount(group, t, ENDINGS + 1), "t2": t2, "C1": t2.sum(), "T1": t1, "new1": (theta + fixed["d1"] * t1) / (v + 1)}

    chain = [state(t, t2, v)]
    for _ in range(burn_in + keep):
        totals = _summed(shards, partial(_swept, form=form, chain=list(chain)))
        chain.append(state(totals[:size], totals[size:-1], totals[-1]))
    return chain, list(range(burn_in, burn_in + keep)), {"N": int(n), "V": int(v)}


def _seated(keys: np.ndarray, key: np.ndarray, word: np.ndarray):
    """For arrays by sorted keys: their values at each key, 0 where it isn't there or the word is unknown."""
    if not len(keys):
        return lambda values: np.zeros(len(key))
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    known = (word >= 0) & (keys[at] == key)
    return lambda values: np.where(known, values[at], 0)


def _mean(shard: Shard, group: np.ndarray, chain: list[dict], kept: list[int], word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Averaged predictive probability of words (numbered in the shard, -1 for unknown) in contexts."""
    rooms, total = shard.rooms, np.zeros(len(word))
    runs = rooms.run(chain[:-1], kept)
    for at in range(0, len(word), 1 << 17):
        part = slice(at, at + (1 << 17))
        w, ctx, above = word[part], context[part], group[context[part]]
        low = _seated(shard.types, w * len(group) + ctx, w)
        high = _seated(rooms.keys2, w * (ENDINGS + 1) + above, w)
        count = low(rooms.count)
        for r in kept:
            m, (t, c2, t2, c1, t1) = chain[r + 1], runs[r]
            root = root_probability(m, np.r_[c1, 0], np.r_[t1, 0])[w]
            total[part] += probabilities(m, count, low(t), ctx, parent_probability(m, high(c2), high(t2), above, root))
    return total / len(kept)


def _table(batches, form: tuple, chain: list[dict], kept: list[int], frequent: int, blocks: int):
    """Log10 probabilities of a block's frequent words in all contexts, and their counts."""
    size, contexts = -(-frequent // blocks), len(form[-1])
    for s in _shards(batches, form):
        place, counts = np.full(size, -1), np.zeros(size, np.int64)
        place[s.names.astype(np.int64)] = np.arange(len(s.names))
        counts[s.names.astype(np.int64)] = s.word_count
        grid = np.log10(_mean(s, form[-1], chain, kept, np.repeat(place, contexts), np.tile(np.arange(contexts), size))).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([s.number], pa.int32()), pa.array([grid.tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["block", "grid", "counts"])


_SUMS = "bucket int, docs binary, sums binary"


def _rare_scores(batches, form: tuple, chain: list[dict], kept: list[int], base: float, buckets: int):
    """Sums over each text's rare tokens of a shard: model and base scores, known tokens, tokens; by bucket of texts."""
    for s in _shards(batches, form):
        p = np.log10(_mean(s, form[-1], chain, kept, s.entry_word, s.entry_context)) if kept else np.zeros(len(s.entry_word))
        count = s.word_count[s.entry_word]
        docs, which = np.unique(s.doc, return_inverse=True)
        sums = np.stack([np.bincount(which, x) for x in (p, np.log10((count + 1) / base), count > 0)] + [np.bincount(which)], 1)
        bucket = (docs.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(k, docs[q].tobytes(), sums[q].tobytes()) for k in np.flatnonzero(np.diff(edges)).tolist() for q in [order[edges[k] : edges[k + 1]]]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "docs", "sums"])


def _bucket_sums(group: pa.Table) -> pa.Table:
    docs, which = np.unique(_joined(group, "docs", "<i8"), return_inverse=True)
    sums = _joined(group, "sums", "<f8").reshape(-1, 4)
    return pa.table([pa.array(docs), *(pa.array(np.bincount(which, sums[:, k])) for k in range(4))], ["doc_key", "rare_score", "rare_base", "rare_known", "rare_tokens"])


def _score(batches, contexts, model, base: float):
    contexts, (grid, base_log) = contexts.value, model.value
    for batch in slices(batches):
        tokens = Tokens(batch.column("text").to_pylist(), contexts)
        use = tokens.index >= 0
        index, row, n = tokens.index[use], tokens.row[use], len(tokens.lens)
        score = np.bincount(row, grid[index, tokens.context[use]], n)
        known = np.bincount(row, base_log[1][index], n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), batch.column("doc_key"), pa.array(tokens.lens), pa.array(known.astype(np.int64)), pa.array(np.bincount(row, base_log[0][index], n)), pa.array(score), pa.array(np.bincount(tokens.row[tokens.rare], minlength=n).astype(np.int64))],
            ["doc_id", "held_out", "doc_key", "n_tokens", "known", "base", "model", "rare"],
        )


@dataclass
class Model:
    """A trained model: frequent words and contexts, the shards of types and how to read them, the chain of totals with the sweeps kept, and corpus counts."""

    contexts: Broadcast
    shards: DataFrame
    form: tuple
    chain: list[dict]
    kept: list[int]
    corpus: dict
    blocks: int
    pieces: int


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", held_out().alias("held_out"), F.xxhash64("doc_id", "text").alias("doc_key"))


def fit(docs: DataFrame, most: int = 1 << 15, burn_in: int = 2, keep: int = 2, unit: int = UNIT) -> Model:
    """Seat all tokens of the rows that are not held out; tokens of the others wait in the shards to be scored.

    most: frequent words, whose counts and probabilities pass the driver as arrays; fewer where contexts are many.
    unit: training tokens for one bucket an ending, whose number grows with their fourth root.
    """
    spark = docs.sparkSession
    contexts = contexts_of(docs, most, unit)
    # blocks of frequent words are as many as partitions, shards of rare ones and buckets of texts more where they would grow too large
    blocks = max(16, partitions(spark))
    pieces = max(blocks, contexts.rare // SHARD)
    shared = spark.sparkContext.broadcast(contexts)
    gathered = _source(docs).select("text", "held_out", "doc_key").mapInArrow(partial(_gather, contexts=shared, shards=pieces, blocks=blocks), _GATHERED)
    # a shard is one row from here on, so that sweeps need no further shuffle
    size, mark, held = contexts.size, contexts.mark, contexts.held
    shards = stored(gathered.groupBy("kind", "shard").applyInArrow(lambda group: _compact(group, size, mark, held), _COMPACT), "shards")
    form = (mark, held, contexts.group)
    return Model(shared, shards, form, *train(shards, form, burn_in, keep), blocks, pieces)


def score_documents(docs: DataFrame, most: int = 1 << 15, burn_in: int = 2, keep: int = 2, unit: int = UNIT) -> DataFrame:
    """Train on the rows that are not held out, score all; see fit() for the parameters."""
    spark, model = docs.sparkSession, fit(docs, most, burn_in, keep, unit)
    chain, kept, corpus, blocks, form = model.chain, model.kept, model.corpus, model.blocks, model.form
    group, n = form[-1], len(model.contexts.value.words)
    base = corpus["N"] + corpus["V"] + 1
    size = -(-n // blocks)
    grid, counts = np.zeros((size * blocks, len(group)), np.float32), np.zeros(size * blocks, np.int64)
    if kept:
        tables_ = model.shards.where("kind = 0").select(SEATED).mapInArrow(partial(_table, form=form, chain=chain, kept=kept, frequent=n, blocks=blocks), "block int, grid binary, counts binary")
        every = np.arange(len(group))
        empty = np.log10(np.mean([probabilities(m, 0, 0, every, parent_probability(m, 0, 0, group, root_probability(m, 0, 0))) for m in (chain[r + 1] for r in kept)], axis=0))
        grid[:] = empty  # words of a block without any training token
        for block, part, count in tables_.toLocalIterator():
            grid[block * size : (block + 1) * size] = np.frombuffer(part, "<f4").reshape(size, len(group))
            counts[block * size : (block + 1) * size] = np.frombuffer(count, "<i8")
    shared = spark.sparkContext.broadcast((grid, np.stack([np.log10((counts + 1) / base), counts > 0])))
    rare = model.shards.where("kind = 1").mapInArrow(partial(_rare_scores, form=form, chain=chain, kept=kept, base=base, buckets=model.pieces), _SUMS)
    rare = rare.groupBy("bucket").applyInArrow(lambda group: _bucket_sums(group), "doc_key long, rare_score double, rare_base double, rare_known double, rare_tokens double")
    columns = f"doc_id {id_type(docs)}, held_out boolean, doc_key long, n_tokens long, known long, base double, model double, rare long"
    rows = _source(docs).mapInArrow(partial(_score, contexts=model.contexts, model=shared, base=base), columns).join(rare, "doc_key", "left")
    # equal rows share a key, whose sums are all of theirs together
    part = F.coalesce(F.col("rare") / F.col("rare_tokens"), F.lit(0.0))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * part
    score = F.col("model") + share("rare_score")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.round(share("rare_known")).cast("long")).alias("n_known"),
        F.lit(corpus["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + share("rare_base")).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
