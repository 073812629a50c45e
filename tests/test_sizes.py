"""Cases that the smallest scale doesn't hold: what larger tables bring."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from plumeworks import registry
from plumeworks.functions import text

from .test_parity import rows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def against_sql(spark, tmp_path):
    """Whether a query gives the rows of its SQL over tables of one's own, and these rows."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        found = got.collect()
        assert rows(got.columns, found) == rows(names, want.fetchall())
        return found

    return check


def event(i, value=1.0, user=1, kind="view", seconds=0.0):
    return i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds), user, kind, value, "{}"


def test_best_candidate_ranks_late_events_lower(spark, against_sql):
    made = [event(500, 99.98), event(20_500, 99.99), event(1_000_500, 100.5), event(7, 3.0), event(507, 3.0), event(1007, 3.01)]
    assert sorted(tuple(r) for r in against_sql("best_candidate", events=spark.createDataFrame(made, EVENTS))) == [(0, 500, 100.5), (7, 1007, 3.01)]


def test_sizes_on_a_half_go_to_the_even_digit(spark):
    unit = (1024, 1024**2, 1024**3)
    made = [n * u // 4 for u in unit for n in (5, 7, 1649)] + [422144, 1024**2 - 1, 0]
    got = [r.s for r in spark.createDataFrame([(n,) for n in made], "n long").select(text.human_bytes(F.col("n")).alias("s")).collect()]
    assert got == [*(f"{n / 4:.1f} {u}" for u in ("KB", "MB", "GB") for n in (5, 7, 1649)), "412.2 KB", "1024.0 KB", "0 B"]


def test_media_properties_of_sizes_on_a_half(spark, against_sql):
    # the size of this account's third medium is 412.25 KB
    customers = spark.createDataFrame([(75794, "MACHINERY"), (1, "BUILDING")], "c_custkey long, c_mktsegment string")
    assert "412.2 KB" in {r.size_text for r in against_sql("media_properties", customer=customers)}


class Held(dict):
    """A map state that counts what is asked of it."""

    asked = 0

    def _ask(self, f, *given):
        self.asked += 1
        return f(*given)

    def getValue(self, k):
        return self._ask(self.get, k)

    def containsKey(self, k):
        return self._ask(self.__contains__, k)

    def updateValue(self, k, v):
        self._ask(self.__setitem__, k, v)

    def removeKey(self, k):
        self._ask(self.pop, k)


class Kept(list):
    def exists(self):
        return bool(self)

    def get(self):
        return self[-1]

    def update(self, v):
        self[:] = [v]


def test_sparse_rows_of_a_key_share_an_entry():
    import random
    from types import SimpleNamespace as Box

    import pandas as pd

    from plumeworks.streaming.jobs import Admissions

    fold = Admissions()
    fold.waiting, fold.kept, fold.handle = Held(), Kept(), Box(registerTimer=lambda t: None, deleteTimer=lambda t: None)
    rows = [(i * 36_000_000, i, i % 3 == 2, None) for i in range(1000)]  # ten hours apart
    got, whole = [], Admissions().fold((1,), {"run": None}, [Admissions().read(r) for r in rows[:-1]])[1]
    shuffled = random.Random(1).sample(rows, len(rows))
    for part in (shuffled[:400], shuffled[400:]):  # entries of two triggers overlap
        list(fold.handleInputRows((1,), iter([pd.DataFrame(part, columns=list(Admissions.ROW))]), None))
    for mark in (300 * 36_000_000, rows[-1][0]):
        for out in fold.handleExpiredTimer((1,), Box(getCurrentWatermarkInMs=lambda mark=mark: mark), None):
            got += list(out.itertuples(index=False, name=None))
    assert [(r[1], bool(r[2]), r[3]) for r in got] == [w[1:] for w in whole]
    assert fold.waiting.asked < 50 and fold.kept[-1][0] == rows[-1][0] + 1


def test_tasks_by_clip_grow_in_number_not_in_size(spark, monkeypatch):
    from plumeworks.plans import tracking

    from .test_parity import SF

    monkeypatch.setattr(tracking, "PER_TASK", 100)
    n = tracking.A.vehicles(spark, SF).count()
    assert tracking._vehicles(spark, SF).rdd.getNumPartitions() == -(-n // 100) > 4
    assert tracking._detections(spark, SF).rdd.getNumPartitions() == -(-2 * n // 100)
    assert tracking.step_index(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the window needs no other


def test_index_documents_are_read_once(spark, tmp_path):
    from plumeworks.sources import files

    (tmp_path / "good.json").write_text('[{"file": "a"}, {"file": "a", "label": "last"}]')
    (tmp_path / "cut.json").write_text('[{"file": "b"}, {"fi')
    (tmp_path / "nameless.json").write_text('[{"file": "c"}, {"label": "x"}]')
    got = files.index_entries(spark, str(tmp_path))
    assert [(r.file, r.label) for r in got.collect()] == [("a", "last")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_clips_are_dealt_once_before_they_are_tracked(spark):
    from plumeworks.plans import tracking

    from .test_parity import SF

    assert tracking.greedy_assignments(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_tracker_checks_each_box_once(monkeypatch):
    import random

    from plumeworks.operators import tracking as T

    asked, rng = [], random.Random(2)
    readable = T.readable
    monkeypatch.setattr(T, "readable", lambda b: asked.append(b) or readable(b))
    odd = [None, (1.0, 2.0, 0.0, 5.0), (1.0, float("nan"), 9.0, 9.0), (None, 1.0, 9.0, 9.0), (float("inf"), 1.0, 9.0, 9.0)]
    tracker, seen = T.Tracker(), 0
    for _ in range(60):
        boxes = [rng.choice(odd) if rng.random() < 0.2 else tuple(float(rng.randrange(k, 60)) for k in (0, 0, 20, 20)) for _ in range(12)]
        before = [dict(t) for t in tracker.tracks if tracker.step + 1 - t["last"] <= T.GAP]
        got = tracker.update(boxes)
        taken, used = {}, set()
        for _, d, k in sorted((-v, d, k) for d, b in enumerate(boxes) for k, t in enumerate(before) if (v := T.overlap(b, t["box"])) >= T.MIN_IOU):
            if d not in taken and k not in used:
                taken[d] = before[k]["id"]
                used.add(k)
        assert all(got[d] == taken[d] if d in taken else got[d] not in {t["id"] for t in before} for d in range(12))
        seen += len(boxes)
    assert len(asked) == seen


def test_replaced_rows_are_dealt_by_key_once_in_partitions_of_one_bucket(spark, tmp_path, monkeypatch):
    from plumeworks.sources import commits

    monkeypatch.setattr(commits, "KEYS", 10)
    store = commits.CommittedTables(spark, f"file://{tmp_path}/s", "k", buckets=4)
    rows = spark.range(300).selectExpr("id % 100 as k", "id as v")
    store.replace({"t": rows}, rows.select("k"))
    assert store._partitions(100, []) == 12 and sum(1 for _ in tmp_path.glob("s/data/t/*/_bucket=*/*.parquet")) == 12
    few = rows.where("k in (3, 4)")
    store.replace({"t": few.withColumn("v", -F.col("v")).where("k = 3")}, few.select("k"))
    got = sorted((r.k, r.v) for r in store.read("t").collect())
    assert got == sorted((i % 100, -i if i % 100 == 3 else i) for i in range(300) if i % 100 != 4)
