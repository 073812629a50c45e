"""Packing of token pieces into sequences by swap-based local search (operator 10).

Documents longer than a sequence are cut, the short piece first. Pieces are
dealt by hash into groups of a bounded expected size; each is packed best-fit
by falling length, and then documents move between underfull sequences, one for
one, two for one or alone, as long as the sum of squared fills rises, which
empties sequences, until no move raises it or no packing can need fewer
sequences. The sequence of each group that is less than half full, one at most,
is packed again with those of other groups.

Cases: null and empty texts are one piece of the end id. Repeated rows are
packed each for itself and dealt to different groups. Pieces of one length are
ordered by document and piece, then by their ids. Empty tables give no row.
Documents of any length are cut; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, slices, stored, texts
from .pretokens import encode_texts


def best_fit(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and all bins' fills: the longest first, each into the fullest bin that takes it."""
    place, fills = np.zeros(len(lens), np.int64), []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what is free in them
    free = 0  # bit r: a bin with r free
    for i in np.argsort(-lens, kind="stable").tolist():
        n = int(lens[i])
        fitting = free >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            b, r = len(fills), size
            fills.append(0)
        fills[b] += n
        place[i] = b
        if r - n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return place, np.array(fills, np.int64)


def improve(lens: np.ndarray, place: np.ndarray, fills: np.ndarray, size: int, rounds: int | None = None) -> None:
    """Moves and swaps between underfull bins that raise the sum of squared fills, in place.

    Underfull bins give, the emptiest first, and all underfull bins take, until no move gains or the
    least number of bins that any packing needs is reached. rounds: stop after so many, None for no limit.
    """
    items = np.flatnonzero(fills[place] < size)
    least = -(-int(lens.sum()) // size)
    for _ in range(rounds) if rounds is not None else count():
        if int((fills > 0).sum()) <= least:
            return
        items = items[fills[place[items]] < size]
        length, at = lens[items], place[items]
        changed = False
        order = np.argsort(at, kind="stable")
        groups = {int(at[g[0]]): list(g) for g in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)} if len(items) else {}
        for a in sorted(groups, key=lambda b: fills[b]):

            def give(parts: list[int], a=a) -> bool:
                """Hand these pieces of bin a over to a fuller one, for the piece of it that gains most or for none."""
                total = int(length[parts].sum())
                other = at != a
                gap = fills[at] - fills[a]
                rest = np.where(other & (fills[at] + total <= size), total * (gap + total), -1)
                if len(parts) == 1 and len(rest) and rest.max() > 0:
                    b = int(at[rest.argmax()])
                    back = None
                else:
                    d = total - length
                    gain = np.where(other & (d > 0) & (fills[at] + d <= size), d * (gap + d), -1)
                    if not len(gain) or gain.max() <= 0:
                        return False
                    back = int(gain.argmax())
                    b = int(at[back])
                for p in parts:
                    groups[a].remove(p)
                    groups[b].append(p)
                    at[p] = b
                fills[b] += total
                fills[a] -= total
                if back is not None:
                    groups[b].remove(back)
                    groups[a].append(back)
                    at[back] = a
                    fills[a] += length[back]
                    fills[b] -= length[back]
                return True

            for p in sorted(groups[a], key=lambda i: -length[i]):
                if at[p] == a and give([p]):
                    changed = True
            pairs = [[p, q] for i, p in enumerate(groups[a]) for q in groups[a][i + 1 :]]
            for pair in pairs:
                if at[pair[0]] == a and at[pair[1]] == a and give(pair):
                    changed = True
        place[items] = at
        if not changed:
            return


def pack(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's sequence, numbered from 0, and its offset there."""
    place, fills = best_fit(lens, size)
    improve(lens, place, fills, size)
    place = np.unique(place, return_inverse=True)[1].reshape(-1)
    order = np.argsort(place, kind="stable")
    ends = lens[order].cumsum()
    first = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0]) if len(order) else order
    begin = ends - lens[order]
    offset = np.zeros(len(lens), np.int64)
    offset[order] = begin - np.repeat(begin[first], np.diff(np.r_[first, len(order)]))
    return place, offset


def _pieces(batches, tokenizer: str, end_id: int, size: int):
    seen: Counter = Counter()  # how often the task has met a row, so that repeated ones are dealt apart
    for batch in slices(batches, most=1 << 20):
        ids, lens = encode_texts(texts(batch), tokenizer)
        keys, ends = batch.column("doc_id"), lens.cumsum()
        row, piece, start, length, crc, nth = [], [], [], [], [], []
        names = keys.to_pylist()
        for i, (a, b) in enumerate(zip(ends - lens, ends, strict=True)):
            raw = np.append(ids[a:b], end_id).astype("<u4")
            n = len(raw)
            seen[name := (names[i], zlib.crc32(raw.tobytes()))] += 1
            cuts = [0, *range(n % size or size, n + 1, size)]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row.append(i)
                piece.append(k)
                start.append(x)
                length.append(y - x)
                crc.append(zlib.crc32(raw[x:y].tobytes()))
                nth.append(seen[name])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(nth, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])


def _pack_group(part: pd.DataFrame, size: int) -> pd.DataFrame:
    part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
    lens = part["length"].to_numpy()
    place, offset = pack(lens, size)
    fill = np.bincount(place, lens)[place].astype(np.int64)
    return part.assign(sequence_id=part["pack_group"].to_numpy() * (1 << 32) + place, offset=offset, fill=fill)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, group: int = 50_000) -> DataFrame:
    """One row per piece of a document: its ids' place in the document and in a packed sequence.

    group: documents that are packed together, about.
    """
    columns = f"doc_id {id_type(docs)}, piece int, start long, length long, ids_crc32 long"
    packed = f"{columns}, pack_group long, sequence_id long, offset long, fill long"
    groups = max(1, round(docs.count() / group))
    pieces = docs.select("doc_id", "text").mapInArrow(partial(_pieces, tokenizer=tokenizer, end_id=end_id, size=size), f"{columns}, nth long")
    dealt = pieces.withColumn("pack_group", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, nth), {groups})")).drop("nth")
    make = partial(_pack_group, size=size)
    rows = dealt.groupBy("pack_group").applyInPandas(lambda part: make(part), packed)
    if groups > 1:
        rows = stored(rows, "packed")
        # a group has one sequence of less than half at most, so `group` groups have no more pieces than documents were packed together before
        rest = rows.where(f"fill * 2 < {size}").select(*(x.split()[0] for x in columns.split(", ")), F.expr(f"{groups} + pack_group div {group}").alias("pack_group"))
        rows = rows.where(f"fill * 2 >= {size}").unionByName(rest.groupBy("pack_group").applyInPandas(lambda part: make(part), packed))
    return rows.drop("pack_group", "fill")
