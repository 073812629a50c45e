"""Replacement of children, index documents and decoded pictures, with real files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeworks.sources import files, images
from plumeworks.sources.commits import CommittedTables, Conflict


def values(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_all_tables_change_or_none(spark, tmp_path):
    store = CommittedTables(spark, f"file://{tmp_path}/store", "k", buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v long")
    with pytest.raises(KeyError):
        store.read("a")
    assert store.replace({"a": make((1, 1), (2, 2), (3, 3)), "b": make((1, 10))}, make((1, 0), (2, 0), (3, 0))) == 1
    before = store.read("a")
    bad = make((2, 0)).withColumn("v", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.replace({"a": make((2, 22)), "b": bad}, make((2, 0)))
    assert store.version() == 1 and values(store.read("a")) == [(1, 1), (2, 2), (3, 3)]
    assert store.replace({"a": make((2, 22), (2, 23), (3, 99)), "b": make()}, make((2, 0), (1, 0))) == 2
    assert values(store.read("a")) == [(2, 22), (2, 23), (3, 3)]  # 1 has no children left, 3 wasn't to be replaced
    assert store.read("b").count() == 0 and values(store.read("b", 1)) == [(1, 10)]
    assert values(before) == [(1, 1), (2, 2), (3, 3)]  # a reader keeps what it has begun with
    assert store.replace({"a": make()}, make((2, 0)), still=lambda: False) == 0 and store.version() == 2
    assert store.replace({"a": make()}, make((2, 0))) == 3 and values(store.read("a")) == [(3, 3)] and store.read("b").count() == 0
    with pytest.raises(Conflict):
        store._publish(3, {})


def test_a_later_commit_wins_the_race(spark, tmp_path):
    store = CommittedTables(spark, f"file://{tmp_path}/store", "k")
    rows = spark.createDataFrame([(1, 1)], "k long, v long")

    def meanwhile() -> bool:
        CommittedTables(spark, store.root, "k").replace({"a": rows}, rows)
        return True

    with pytest.raises(Conflict):
        store.replace({"a": rows.withColumn("v", F.lit(2).cast("long"))}, rows, still=meanwhile)
    assert values(store.read("a")) == [(1, 1)]


def test_index_and_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/index.json").write_text('[{"file": "1.png", "label": "positive"}, {"file": "2.png", "label": "negative", "negative_kind": "fog", "more": 1},\n {"file": "1.png", "label": "negative"}]')
    (tmp_path / "b/index.json").write_text('[{"file": "3.png", "label": "posi')
    (tmp_path / "b/manifest.json").write_text("{")
    (tmp_path / "a/manifest.json").write_text('{"name": "x", "generator_version": "2.0.0", "seed": 7, "totals": {"samples": 3}, "splits": {"val": {"count": 1}}}')
    rows = files.index_entries(spark, str(tmp_path), "index.json").collect()
    assert {(r.file, r.label, r.negative_kind) for r in rows} == {("1.png", "negative", None), ("2.png", "negative", "fog")}
    (tmp_path / "c.json").write_text('[{"label": "positive"}, {"file": "4.png"}]')
    assert files.index_entries(spark, str(tmp_path), "c.json").count() == 0
    found = files.manifests(spark, str(tmp_path))
    assert {(r.readable, r.seed, r.totals and r.totals.samples) for r in found.collect()} == {(True, 7, 3), (False, None, None)}
    assert files.reusable(found, "2.0.0", 7).count() == 1 and files.reusable(found, "2.0.0", 8).count() == 0
    known = spark.createDataFrame(found.select("path", "modified").collect())
    assert files.to_read_again(found, known).count() == 0
    assert files.to_read_again(found, known.withColumn("modified", F.col("modified") - F.expr("INTERVAL 1 SECOND"))).count() == 2


def bmp(pixels: np.ndarray, bits: int, up: bool = True, palette: bytes = b"") -> bytes:
    height, width = pixels.shape[:2]
    rows = [r.astype(np.uint8).tobytes() for r in (pixels[::-1] if up else pixels)]
    body = b"".join(r + b"\0" * (-len(r) % 4) for r in rows)
    n = lambda v, s=4: int(v).to_bytes(s, "little", signed=True)
    start = 54 + len(palette)
    return b"BM" + n(start + len(body)) + n(0) + n(start) + n(40) + n(width) + n(height if up else -height) + n(1, 2) + n(bits, 2) + n(0) + n(len(body)) + n(0) + n(0) + n(len(palette) // 4) + n(0) + palette + body


def test_decoders(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (3, 5, 3), np.uint8)
    grey = rng.integers(0, 256, (3, 5), np.uint8)
    three = np.stack([grey] * 3, -1)
    alpha = np.concatenate([rgb, rng.integers(0, 256, (3, 5, 1), np.uint8)], -1)
    palette = rng.integers(0, 256, (7, 4), np.uint8)
    index = rng.integers(0, 7, (3, 5), np.uint8)
    text = lambda x: " ".join(map(str, x.reshape(-1))).encode()
    cases = {
        "p6": (b"P6\n# made\n5 3\n255\n" + rgb.tobytes(), rgb[..., ::-1]), "p5": (b"P5 5 3 255 " + grey.tobytes(), three), "p3": (b"P3 5 3 255\n" + text(rgb), rgb[..., ::-1]), "p2": (b"P2 5 3 255\n# rows\n" + text(grey), three),
        "wide": (b"P5 5 3 65535 " + (grey.astype(">u2") << 8 | 7).astype(">u2").tobytes(), three), "b24": (bmp(rgb, 24), rgb), "down": (bmp(rgb, 24, up=False), rgb), "b32": (bmp(alpha, 32), rgb), "b8": (bmp(index, 8, palette=palette.tobytes()), palette[index][..., :3]),
    }
    for bad, content in {"short": cases["p6"][0][:-1], "cut": cases["b24"][0][:-2], "head": b"P5 5 3", "zero": b"P5 0 3 255 ", "other": b"GIF89a....", "gap": b"P2 2 1 255\n1 x", "rle": cases["b8"][0][:30] + b"\1" + cases["b8"][0][31:], "lies": b"P6 99999 99999 255\n12"}.items():
        cases[bad] = (content, None)
    for name, (content, _) in cases.items():
        (tmp_path / name).write_bytes(content)
    rows = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = rows.unionByName(spark.createDataFrame([("null", None), ("empty", bytearray())], "name string, content binary"))
    got = {r.name: r for r in images.decoded(rows).collect()}
    for name, (_, want) in {**cases, "null": (None, None), "empty": (None, None)}.items():
        r = got[name]
        if want is None:
            assert (r.height, r.width, r.bgr) == (None, None, None), name
        else:
            assert (r.height, r.width) == (3, 5) and np.array_equal(np.frombuffer(r.bgr, np.uint8).reshape(3, 5, 3), want), name


def test_more_decoders(spark):
    flat = lambda content: np.full((1, 2, 1), content[4], np.uint8)
    rows = spark.createDataFrame([(1, bytearray(b"FLAT\x09"))], "k long, content binary")
    assert images.decoded(rows).first().bgr is None
    assert bytes(images.decoded(rows, decoders={**images.DECODERS, b"FLAT": flat}).first().bgr) == b"\x09" * 6


def test_budgets_count_what_was_written(spark):
    from plumeworks.operators.tracking import artifact_budget

    rows = [("c", i, i, 0.5 if i % 2 else None, i not in (1, 4), i not in (3,)) for i in range(12)] + [("c", 20, 20, 0.5, None, None)]
    got = artifact_budget(spark.createDataFrame(rows, "clip_id string, frame int, vehicle_id int, intensity double, crop_written boolean, mask_written boolean"), 2, 3, 4)
    assert sorted((r.frame, r.crop, r.mask) for r in got.collect()) == [(0, True, False), (1, False, True), (2, True, False), (3, True, False), (5, True, True), (6, True, False), (7, False, True), (9, False, True)]
