"""Benchmark decontamination by pigeonhole edit matching (operator 2).

Texts are reduced to lower-case words joined by single spaces. A benchmark item
of n characters may differ by k edits, n * error_rate and a few; it is split into k + 1
pieces, of which one at least must survive k edits, so an exact hit of a piece
is looked for in one scan over the text. Where the text around a hit lacks no
more of the item's 4-grams than k edits can spoil, Myers' bit-parallel distance
finds the least number of edits with which the item occurs there.

Items are taken in blocks of a bounded number of characters; each block is sent
to all tasks and scans all texts, one block after the other.

Cases: null and empty texts match nothing. Items of fewer than SHORT characters
after reduction bear no edits and must stand between word boundaries; null
items and items without words are matched by none. Repeated items are reported
each under its id, repeated rows each for itself. Of equally good places of an
item the first is given. Texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, slices, stored, texts

WORD = re.compile(r"\w+")
GRAM = 4
#: Items of fewer characters are matched as they are, between word boundaries.
SHORT = 32
SPARE = 2


def reduced(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def cut(text: str, pieces: int) -> list[tuple[int, str]]:
    """Pieces of nearly equal length with their offsets."""
    ends = [len(text) * k // pieces for k in range(pieces + 1)]
    return [(a, text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edits with which the pattern occurs in the text, and where the first such occurrence ends; None beyond `most`."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    vp, vn, score, best = mask, 0, m, None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & mask
        vp = (hn << 1 & mask) | (mask & ~(d0 | hp))
        vn = hp & d0
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def budget(n: int, error_rate: float) -> int:
    """Edits that an item of n characters may bear: a share of them, and up to SPARE more, without which a short item bears no changed word."""
    return 0 if n < SHORT else int(n * error_rate) + min(SPARE, n // 40)


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


class PieceIndex:
    """The pieces of a block of items, searched at once."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(key, text, budget(len(text), error_rate)) for key, text in items]
        self.grams = [grams(text) for _, text, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, edits) in enumerate(self.items):
            for offset, piece in cut(text, edits + 1):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each item that the reduced text holds, at its best and first place."""
        if self.empty or not text:
            return []
        begins: dict[int, list[int]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for i, offset in at:
                begins.setdefault(i, []).append(end + 1 - size - offset)
        found = []
        for i, starts in sorted(begins.items()):
            key, item, most = self.items[i]
            if len(item) < SHORT:
                if whole := [s for s in sorted(starts) if text[s - 1 : s] in ("", " ") and text[s + len(item) : s + len(item) + 1] in ("", " ")]:
                    found.append((key, 0, whole[0], whole[0] + len(item)))
                continue
            best = None
            windows: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - most), s + len(item) + most
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                # an edit spoils GRAM grams of the item at most; where more are missing no occurrence can be
                if len(self.grams[i].difference(grams(text[a:b]))) > most * GRAM:
                    continue
                if (hit := myers(item, text[a:b], most)) and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                edits, end = best
                back = myers(item[::-1], text[max(0, end - len(item) - most) : end][::-1][: len(item) + most], most)
                # the reversed pattern's best end is where the occurrence begins, where it ends as early as here
                found.append((key, edits, max(0, end - back[1]) if back else end, end))
        return found


_indexes: dict[int, PieceIndex] = {}


def _index(items: list[tuple[int, str]], error_rate: float) -> PieceIndex:
    """The index of a block, built once a worker."""
    name = hash((tuple(items), error_rate))
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = PieceIndex(items, error_rate)
    return _indexes[name]


def _matches(batches, items: list[tuple[int, str]], error_rate: float):
    index = _index(items, error_rate)
    for batch in slices(batches, most=1 << 20):
        rows, out = [], []
        for r, text in enumerate(texts(batch)):
            for match in index.matches(reduced(text)):
                rows.append(r)
                out.append(match)
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "edits", "start", "end"])


def _clean(batches, items: list[tuple[int, str]], error_rate: float):
    index = _index(items, error_rate)
    for batch in slices(batches, most=1 << 20):
        yield batch.filter(pa.array([not index.matches(reduced(x)) for x in texts(batch)], pa.bool_()))


def item_blocks(items: DataFrame, block_chars: int):
    """Blocks of reduced items (id, text) of about block_chars characters; the driver holds two at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").toLocalIterator():
        text = reduced(row[1])
        if text:
            block.append((row[0], text))
            size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """One row per document row and benchmark item that it holds: edits, and start and end in the reduced text.

    Where there are several blocks, each block's rows are written before the next is taken.
    """
    schema = f"doc_id {id_type(docs)}, item_id long, edits long, start long, end long"
    found = None
    for block, last in _with_last(item_blocks(items, block_chars)):
        more = docs.select("doc_id", "text").mapInArrow(partial(_matches, items=block, error_rate=error_rate), schema)
        more = more if last and found is None else stored(more, "matches")
        found = more if found is None else found.unionByName(more)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark item."""
    for block, last in _with_last(item_blocks(items, block_chars)):
        docs = docs.mapInArrow(partial(_clean, items=block, error_rate=error_rate), docs.schema)
        docs = docs if last else stored(docs, "clean")
    return docs


def _with_last(blocks):
    """Each block, and if it is the last."""
    blocks = iter(blocks)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        yield block, after is None
        block = after
