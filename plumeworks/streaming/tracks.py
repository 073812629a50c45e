"""Tracks of clips as a stream.

A clip that is silent for longer than `idle` has ended: its last row says so and its
state goes; what comes later begins a new visit.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.tracking import Tracker, readable
from .ordered import InOrder, milliseconds, timed


class Visit:
    """The tracks of a clip since it began or was last silent for long."""

    def __init__(self, began: int | None = None, last: int | None = None, tracker: Tracker | None = None):
        self.began, self.last, self.tracker = began, last, tracker or Tracker()

    def row(self, clip: str, ended: bool) -> tuple:
        return clip, pd.Timestamp(self.began, unit="ms"), self.tracker.count, self.tracker.step, ended


class TrackClips(InOrder):
    ROW = {"at_ms": "bigint", "frame_index": "bigint", "det_idx": "int", "x": "double", "y": "double", "w": "double", "h": "double"}
    STATE = {"began": "bigint", "last": "bigint", "step": "int", "count": "int", "ids": "array<int>", "lasts": "array<int>", "boxes": "array<array<double>>"}
    OUT = ("clip_id", "began", "tracks", "steps", "ended")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def read(self, row: tuple) -> tuple:
        return (*map(int, row[:3]), *map(float, row[3:]))

    def begin(self) -> Visit:
        return Visit()

    def load(self, values: tuple) -> Visit:
        began, last, step, count, ids, lasts, boxes = values
        return Visit(began, last, Tracker([{"id": i, "last": n, "box": tuple(b) if len(b) else None} for i, n, b in zip(ids, lasts, boxes, strict=True)], step, count))

    def dump(self, state: Visit) -> tuple:
        t = state.tracker
        return state.began, state.last, t.step, t.count, [x["id"] for x in t.tracks], [x["last"] for x in t.tracks], [list(x["box"] or ()) for x in t.tracks]

    def fold(self, key, state: Visit, ready: list[tuple]) -> tuple[Visit, list[tuple]]:
        out = []
        for (at, _), frame in groupby(ready, key=lambda r: r[:2]):
            if state.last is not None and at - state.last > self.idle_ms:
                out.append(state.row(key[0], True))
                state = Visit()
            state.began = at if state.began is None else state.began
            state.last = at
            state.tracker.update([b if readable(b := r[3:]) else None for r in frame])
        return state, out

    def settle(self, key, state: Visit, mark: int, changed: bool) -> tuple[Visit | None, list[tuple]]:
        if self.wakes(state) <= mark:
            return None, [state.row(key[0], True)]
        return state, [state.row(key[0], False)] if changed else []

    def wakes(self, state: Visit) -> int:
        return state.last + self.idle_ms + 1


def track_stream(detections: DataFrame, at: str = "ts", late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """Tracks and steps of each visit of a clip so far, from frames older than the watermark.

    A row for each visit that a trigger changes; `ended` marks a visit after which the clip was silent for
    longer than `idle`. Frames may arrive in any order within `late`; what comes later, or has no time, is
    dropped. A frame is a time and a frame_index of its clip. The last frames wait until newer ones move
    the watermark.
    """
    rows = timed(detections, at, late).fillna({"frame_index": -1, "det_idx": 0})
    idle_ms = milliseconds(detections.sparkSession, idle)
    return TrackClips(idle_ms).over(rows.select("clip_id", at, *TrackClips.ROW), "clip_id", "clip_id string, began timestamp, tracks int, steps int, ended boolean", "Update")
