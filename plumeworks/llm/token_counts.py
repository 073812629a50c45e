"""Token counts by rank-synchronous merging of symbol arrays (operator 5).

A sentencepiece BPE model gives every piece a rank. Pre-tokens are held as one
ragged numpy array of symbols; in each round every sequence applies its own
lowest-rank pair, all sequences at once, until no pair is left. What counts is
how many symbols survive, unknown characters as their UTF-8 bytes.

Cases: null and empty texts have 0 bytes and 0 tokens. Texts of any length are
counted whole. Rows are independent, so repeated rows and ids give repeated
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, slices, texts

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Spaces with the word behind them, spaces alone, or one line break: no piece of the vocabulary spans two of these.
UNIT = re.compile(" *[^ \n]+| +|\n")


class RankMerger:
    """The merge table of one sentencepiece BPE model, applied to many sequences at once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if inner := [x for x in pieces if MARK in x.lstrip(MARK) or "\n" in x]:
            raise ValueError(f"a piece spans words or lines: {inner[0]!r}")
        names = list(pieces)
        code = {x: i for i, x in enumerate(names)}
        self.size = len(names)
        scores = np.array([pieces[x] for x in names])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {}
        safe = np.ones(len(names), bool)  # no longer piece that starts or ends with it comes before it
        for x, i in code.items():
            for k in range(1, len(x)):
                a, b = code.get(x[:k]), code.get(x[k:])
                for part in (a, b):
                    if part is not None and rank[i] <= rank[part]:
                        safe[part] = False
                a = self.size + ord(x[0]) if a is None and k == 1 else a
                b = self.size + ord(x[-1]) if b is None and k == len(x) - 1 else b
                if a is not None and b is not None:
                    pairs[(a << 21) | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank, self.safe = rank[self.made], safe[self.made]
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size  # unknown characters lie above the pieces
        for x, i in code.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        point = np.arange(0x110000)
        self.cost = np.concatenate([np.ones(self.size, np.int8), (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)).astype(np.int8)])

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, -1 for none."""
        key = (a.astype(np.int64) << 21) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def counts(self, units: list[str]) -> np.ndarray:
        """Surviving symbols of each unit; its spaces are already marks."""
        n = len(units)
        lens = np.fromiter(map(len, units), np.int64, n)
        sym = self.symbol[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        seq = np.repeat(np.arange(n), lens)
        total = np.zeros(n, np.int64)
        pair = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            pair[:-1] = np.where(seq[:-1] == seq[1:], self._look(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():  # sequences without a pair are counted and leave
                cost = np.add.reduceat(self.cost[sym].astype(np.int64), starts)
                total[seq[starts[over]]] = cost[over]
                stay = np.repeat(~over, sizes)
                sym, seq, pair, rank = sym[stay], seq[stay], pair[stay], rank[stay]
                sizes, least = sizes[~over], least[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            first = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
            if len(hit) > first.sum():
                run = np.r_[True, hit[1:] != hit[:-1] + 1]  # of touching hits, every other one from the left
                begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[first | (((np.arange(len(hit)) - begin) % 2 == 0) & self._all_safe(pair, hit, first))]
            sym[hit] = self.made[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, pair = sym[keep], seq[keep], pair[keep]
            new = place[hit]
            left = new[new > 0] - 1
            for at in (new, left):
                last = at + 1 >= len(sym)
                nxt = np.where(last, at, at + 1)
                pair[at] = np.where(last | (seq[nxt] != seq[at]), -1, self._look(sym[at], sym[nxt]))
        return total

    def _all_safe(self, pair: np.ndarray, hit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each hit, if its sequence has safe hits only; else the first alone may merge."""
        group = np.cumsum(first) - 1
        bad = np.zeros(group[-1] + 1, bool)
        bad[group[~self.safe[pair[hit]]]] = True
        return ~bad[group]


class CountMemory:
    """Counts of units by one merger; emptied when `limit` units are in it."""

    def __init__(self, merger: RankMerger, limit: int = 500_000):
        self.merger, self.limit, self.known = merger, limit, {}

    def counts(self, units: list[str]) -> np.ndarray:
        distinct = set(units)
        new = distinct.difference(self.known)
        if new and len(new) + len(self.known) > self.limit:
            self.known, new = {}, distinct
        if new:
            new = list(new)
            self.known.update(zip(new, self.merger.counts([x.replace(" ", MARK) for x in new]).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))


_memories: dict[str, CountMemory] = {}


def count_texts(values: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    if path not in _memories:
        _memories[path] = CountMemory(RankMerger(path))
    # the model puts one space before a text and takes its own mark for a space
    units = [UNIT.findall(" " + (x.replace(MARK, " ") if MARK in x else x)) if x else [] for x in values]
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    each = _memories[path].counts([u for x in units for u in x])
    return np.diff(np.r_[0, each.cumsum()][np.r_[0, sizes.cumsum()]])


def _count(batches, path: str, key: str, column: str):
    for batch in slices(batches, column):
        values = texts(batch, column)
        yield pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in values], pa.int64()), pa.array(count_texts(values, path), pa.int64())],
            [key, "n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per row of docs: its key, n_bytes and n_tokens under the sentencepiece model."""
    return docs.select(key, column).mapInArrow(partial(_count, path=model_path, key=key, column=column), f"{key} {id_type(docs, key)}, n_bytes long, n_tokens long")
