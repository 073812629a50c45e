"""Keyed streams folded in order of event time, with state that ends.

Rows wait in the state of their key until the watermark has passed them and are
then folded in order. They lie in buckets of BUCKET_MS. An entry of a map state holds
buckets that came at once, up to CHUNK rows, under the first of them, so that a trigger
writes only the entries that it adds to and removes those that have been folded, and
sparse rows don't need an entry each: every one is asked of the JVM for itself. A key has one timer, for the earliest row that waits or for
what its state waits for itself, whichever is sooner; a key whose state has come to
its end and for which no row waits leaves nothing behind.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Width of a bucket of waiting rows.
BUCKET_MS = 10_000
#: Rows of an entry of several buckets.
CHUNK = 256
# The names of Spark's providers of state.
DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Maps and timers need this provider; it is set unless the session names another."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", DEFAULT) == DEFAULT:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def entries(rows: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows in order of time as entries of whole buckets, each with its first bucket."""
    first, held = None, []
    for bucket, more in groupby(rows, lambda r: r[0] // BUCKET_MS):
        more = list(more)
        if held and len(held) + len(more) > CHUNK:
            yield first, held
            held = []
        first = bucket if not held else first
        held += more
    if held:
        yield first, held


class InOrder(StatefulProcessor):
    """What a fold of rows in order needs; a row is a tuple that begins with its time in milliseconds and sorts by its order."""

    #: Types of a row's fields by name, the time first; of the state, without the timer; and the columns of what is returned.
    ROW: dict[str, str] = {}
    STATE: dict[str, str] = {}
    OUT: tuple[str, ...] = ()

    def read(self, row: tuple) -> tuple:
        """A row as it waits, in plain types."""
        raise NotImplementedError

    def begin(self):
        """The state of a key that has none."""
        raise NotImplementedError

    def load(self, values: tuple):
        raise NotImplementedError

    def dump(self, state) -> tuple:
        raise NotImplementedError

    def fold(self, key, state, ready: list[tuple]) -> tuple[object, list[tuple]]:
        """The state after the rows, and what to return for them."""
        raise NotImplementedError

    def settle(self, key, state, mark: int, changed: bool) -> tuple[object, list[tuple]]:
        """The state when all that is older than the mark has been folded, None if it has ended, and what to return."""
        return state, []

    def wakes(self, state) -> int | None:
        """The time at which the state itself wants to be looked at again."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", ", ".join(["due long", "has boolean", *(f"{k} {v}" for k, v in self.STATE.items())]))
        self.waiting = handle.getMapState("waiting", "bucket long", f"rows array<struct<{', '.join(f'{k}: {v}' for k, v in self.ROW.items())}>>")

    def _load(self):
        if not self.kept.exists():
            return None, None
        due, has, *values = self.kept.get()
        return (self.load(tuple(values)) if has else None), due

    def _save(self, state, due: int) -> None:
        self.kept.update((due, state is not None, *(self.dump(state) if state is not None else (None,) * len(self.STATE))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((self.read(r) for part in rows for r in part[list(self.ROW)].itertuples(index=False, name=None)), key=itemgetter(0))
        if new:
            for bucket, more in entries(new):
                held = self.waiting.getValue((bucket,)) if self.waiting.containsKey((bucket,)) else None
                self.waiting.updateValue((bucket,), ([tuple(r) for r in held[0]] + more if held else more,))
            state, due = self._load()
            first = new[0][0] + 1  # a row is ready when the watermark is beyond it
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
                self._save(state, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        state, due = self._load()
        if due is None or due > mark:
            return
        ready, out, rest = [], [], []
        for (bucket,) in sorted(tuple(k) for k in self.waiting.keys()):  # noqa: SIM118  (a state, no dict)
            held = sorted(tuple(r) for r in self.waiting.getValue((bucket,))[0])
            n = bisect_left(held, mark, key=itemgetter(0))
            ready += held[:n]
            if n < len(held):
                rest.append(held[n][0])
                if n:
                    self.waiting.updateValue((bucket,), (held[n:],))
            else:
                self.waiting.removeKey((bucket,))
            if bucket * BUCKET_MS >= mark:  # nor is anything in later entries
                break
        if ready:
            state, out = self.fold(key, self.begin() if state is None else state, sorted(ready))
        first, changed = min(rest, default=None), bool(ready)
        if state is not None:
            state, more = self.settle(key, state, mark, changed)
            out += more
        times = [t for t in (None if first is None else first + 1, None if state is None else self.wakes(state)) if t is not None]
        if times:
            self.handle.registerTimer(min(times))
            self._save(state, min(times))
        elif state is None:
            self.kept.clear()
        else:  # it waits for rows only
            self.kept.update((None, True, *self.dump(state)))
        if out:
            yield pd.DataFrame(out, columns=list(self.OUT))

    def over(self, rows: DataFrame, key: str, returned: str, mode: str = "Append") -> DataFrame:
        """Rows with a watermark and the columns of ROW, folded by key."""
        keep_state_in_rocksdb(rows.sparkSession)
        return rows.groupBy(key).transformWithStateInPandas(self, returned, mode, "EventTime")


def timed(stream: DataFrame, at: str, late: str) -> DataFrame:
    """Rows that have a time, with a watermark and the time in milliseconds, `at_ms`."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).where(F.col(at).isNotNull()).withWatermark(at, late).withColumn("at_ms", F.unix_millis(at))


def milliseconds(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {interval})").first()[0]
