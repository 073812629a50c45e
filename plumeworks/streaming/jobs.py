"""Admission of runs and their progress writes as streams; the batch forms stand in operators.ingest and operators.tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracking import ENDED, GAP_SECONDS, STAGE_LENGTH
from .ordered import InOrder, milliseconds, timed


class Admissions(InOrder):
    """At most one run in flight for each medium: a request starts one, its end frees the medium."""

    ROW = {"at_ms": "bigint", "event_id": "bigint", "finishes": "boolean", "run_id": "bigint"}
    STATE = {"run": "bigint"}
    OUT = ("media_id", "request_id", "admitted", "run_id")

    def read(self, row: tuple) -> tuple:
        at, event, finishes, run = row
        return int(at), int(event), bool(finishes), -1 if run is None or run != run else int(run)

    def begin(self) -> dict:
        return {"run": None}

    def load(self, values: tuple) -> dict:
        return {"run": values[0]}

    def dump(self, state: dict) -> tuple:
        return (state["run"],)

    def fold(self, key, state: dict, ready: list[tuple]) -> tuple[dict, list[tuple]]:
        out = []
        for _, event, finishes, run in ready:
            if finishes:
                if run in (-1, state["run"]):
                    state["run"] = None
                continue
            admitted = state["run"] is None
            if admitted:
                state["run"] = event
            out.append((key[0], event, admitted, state["run"]))
        return state, out

    def settle(self, key, state: dict, mark: int, changed: bool) -> tuple[dict | None, list[tuple]]:
        return (None if state["run"] is None else state), []


def admission_stream(events: DataFrame, at: str = "ts", late: str = "10 seconds") -> DataFrame:
    """The answer to each request: whether it starts a run, and the run in flight, named by its request.

    events: media_id, event_id, finishes (false: a request), run_id (the run that has ended; null: whichever
    is in flight) and a time. Order is that of times, then event_ids. An end of a run that isn't in flight
    changes nothing; a request that comes again while its run is in flight is answered with it. A medium
    without a run in flight has no state.
    """
    rows = timed(events, at, late).where("event_id is not null").withColumn("finishes", F.coalesce("finishes", F.lit(False)))
    kind = events.schema["media_id"].dataType.simpleString()
    return Admissions().over(rows.select("media_id", at, *Admissions.ROW), "media_id", f"media_id {kind}, request_id bigint, admitted boolean, run_id bigint")


class Progress(InOrder):
    """Progress writes of a run that are neither repeats nor too soon after the last one."""

    ROW = {"at_ms": "bigint", "percent": "int", "stage": "string", "event_id": "bigint", "ended": "boolean"}
    STATE = {"at": "bigint", "percent": "int", "stage": "string"}
    OUT = ("analysis_id", "event_id", "at_ms", "percent", "stage")

    def __init__(self, gap_ms: int, idle_ms: int):
        self.gap_ms, self.idle_ms = gap_ms, idle_ms

    def read(self, row: tuple) -> tuple:
        at, percent, stage, event, ended = row
        return int(at), int(percent), stage, int(event), bool(ended)

    def begin(self) -> tuple:
        return None, None, None

    def load(self, values: tuple) -> tuple:
        return values

    def dump(self, state: tuple) -> tuple:
        return state

    def fold(self, key, state: tuple, ready: list[tuple]) -> tuple[tuple, list[tuple]]:
        out = []
        for at, percent, stage, event, ended in ready:
            if (percent, stage) == state[1:] or (state[0] is not None and percent < 100 and at - state[0] < self.gap_ms):
                continue
            state = (at, percent, stage)
            if not ended:
                out.append((key[0], event, at, percent, stage))
        return state, out

    def settle(self, key, state: tuple, mark: int, changed: bool) -> tuple[tuple | None, list[tuple]]:
        return (None if self.wakes(state) <= mark else state), []

    def wakes(self, state: tuple) -> int:
        return state[0] + self.idle_ms + 1


def progress_stream(reports: DataFrame, at: str = "ts", late: str = "10 seconds", gap: float = GAP_SECONDS, idle: str = "1 day") -> DataFrame:
    """Writes that survive the throttle, as in the batch: analysis_id, event_id, at_ms, percent, stage.

    reports: analysis_id, event_id, percent, stage, status (may be missing) and a time. A run that was silent
    for longer than `idle` leaves no state, and its next report counts as its first.
    """
    if "status" not in reports.columns:
        reports = reports.withColumn("status", F.lit(""))
    rows = timed(reports, at, late).where("event_id is not null")
    rows = rows.withColumns({"percent": F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("percent", F.lit(0)))).cast("int"), "stage": F.substring(F.coalesce("stage", F.lit("")), 1, STAGE_LENGTH), "ended": F.coalesce(F.col("status").isin(*ENDED), F.lit(False))})
    kind = reports.schema["analysis_id"].dataType.simpleString()
    fold = Progress(round(gap * 1000), milliseconds(reports.sparkSession, idle))
    return fold.over(rows.select("analysis_id", at, *Progress.ROW), "analysis_id", f"analysis_id {kind}, event_id bigint, at_ms bigint, percent int, stage string")
