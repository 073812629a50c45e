"""Labelling, edges, plume features, splits and the darkness balance against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeworks.operators import masks as M
from plumeworks.operators import splits


def flood(on: np.ndarray) -> np.ndarray:
    out, n = np.zeros(on.shape, int), 0
    for start in zip(*np.nonzero(on), strict=True):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            r, c = todo.pop()
            for i in range(max(0, r - 1), min(on.shape[0], r + 2)):
                for j in range(max(0, c - 1), min(on.shape[1], c + 2)):
                    if on[i, j] and not out[i, j]:
                        out[i, j] = n
                        todo.append((i, j))
    return out


@pytest.mark.parametrize("density", [0.0, 0.2, 0.4, 0.6, 1.0])
def test_labels_equal_a_flood_fill(density):
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (1, 9), (9, 1), (7, 13), (40, 31)):
        on = rng.random(shape) < density
        assert np.array_equal(M.labelled(on), flood(on))


def slow_edges(image: np.ndarray, low: int, high: int) -> np.ndarray:
    """Pixel by pixel, from the definition."""
    h, w = image.shape
    g = lambda r, c: int(image[min(max(r, 0), h - 1), min(max(c, 0), w - 1)])
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for r in range(h):
        for c in range(w):
            dx[r, c] = sum(k * (g(r + i, c + 1) - g(r + i, c - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy[r, c] = sum(k * (g(r + 1, c + i) - g(r - 1, c + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
    size = lambda r, c: abs(dx[r, c]) + abs(dy[r, c]) if 0 <= r < h and 0 <= c < w else 0
    weak, strong = set(), []
    for r in range(h):
        for c in range(w):
            x, y, m = abs(dx[r, c]), abs(dy[r, c]), size(r, c)
            if m <= low:
                continue
            near = x * 13573
            if y * 32768 < near:
                peak = m > size(r, c - 1) and m >= size(r, c + 1)
            elif y * 32768 > near + x * 65536:
                peak = m > size(r - 1, c) and m >= size(r + 1, c)
            else:
                s = -1 if (dx[r, c] < 0) != (dy[r, c] < 0) else 1
                peak = m > size(r - 1, c - s) and m > size(r + 1, c + s)
            if peak:
                weak.add((r, c))
                if m > high:
                    strong.append((r, c))
    out = np.zeros((h, w), bool)
    while strong:
        p = strong.pop()
        if not out[p]:
            out[p] = True
            strong += [q for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if q in weak]
    return out


def test_edges_equal_the_plain_version():
    rng = np.random.default_rng(2)
    pictures = [rng.integers(0, 256, (12, 17)) for _ in range(4)] + [np.full((12, 17), 90)]
    smooth = np.add.outer(np.arange(12) * 9, np.arange(17) * 5)
    step = np.where(np.add.outer(np.arange(12), np.arange(17)) > 14, 200, 20)
    ring = np.where((np.arange(12)[:, None] - 6) ** 2 + (np.arange(17)[None] - 8) ** 2 < 20, 160, 60)
    pictures = np.stack([*pictures, smooth, step, ring, np.where(rng.random((12, 17)) < 0.1, 140, 120)]).astype(np.uint8)
    got = M.canny(pictures)
    for image, edges in zip(pictures, got, strict=True):
        assert np.array_equal(edges, slow_edges(image, 50, 140))
    assert got[6].any() and got[7].any() and not got[4].any()


def test_tan_of_the_sector():
    assert M.TAN == 13573


def test_resizing():
    ramp = np.arange(8, dtype=np.float32).reshape(1, 8).repeat(4, 0)
    assert np.allclose(M.resized(ramp, 4, 4), [[0.5, 2.5, 4.5, 6.5]] * 4)
    assert np.allclose(M.resized(np.float32([[1, 3]]), 2, 4), [[1, 1.5, 2.5, 3]] * 2)
    assert np.allclose(M.resized(np.float32([[5]]), 3, 2), 5)


def test_grey_and_probabilities():
    assert M.grey(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]])).tolist() == [[255, 0, 29, 150, 76]]
    assert M.grey(np.array([[[0, 255, 0, 7]]])).tolist() == [[150]]
    assert np.allclose(M.probabilities(np.array([[0, 255.0, 51]])), [[0, 1, 0.2]])
    assert np.allclose(M.probabilities(np.array([[-1, 0.5, float("nan")]])), [[0, 0.5, 0]])


PLUME = "key long, mask array<double>, mw int, image array<int>, iw int"


def features(spark, rows):
    got = M.plume_features(spark.createDataFrame(rows, PLUME), "key", F.col("mask"), F.col("mw"), F.col("image"), F.col("iw"))
    return {r.key: tuple(r)[1:] for r in got.collect()}


def test_plume_features(spark):
    square = [1.0 if 2 <= i // 8 < 6 and 2 <= i % 8 < 6 else 0.0 for i in range(64)]
    dark = [20 if 2 <= i // 8 < 6 and 2 <= i % 8 < 6 else 220 for i in range(64)]
    small = [1.0, 0.0, 0.0, 0.0]
    got = features(spark, [
        (1, square, 8, dark, 8), (2, [0.0] * 64, 8, dark, 8), (3, None, 8, dark, 8), (4, square, 8, None, 8), (5, [], 8, dark, 8), (6, square, 7, dark, 8), (7, [255 * x for x in square], 8, dark, 8),
        (8, small, 2, [100] * 16, 4), (9, square, 8, dark, 0), (10, square, 8, dark, None), (11, [1.0, None], 2, dark, 8), (12, [1.0] * 6, 3, [0, 50, 100, 150, 200, 250], 3),
    ])
    zeros = (0.0,) * 9
    edges = slow_edges(np.array(dark, np.uint8).reshape(8, 8), 50, 140) & (np.array(square).reshape(8, 8) > 0)
    assert got[1] == (0.25, 1.0, round(edges.sum() / 16, 6), round(1 - 20 / 255, 6), round(4 * np.pi * 9 / 144, 6), 0.25, 16.0, 16.0, 64.0)
    assert got[7] == got[1]
    assert got[2] == (*zeros[:8], 64.0)
    assert all(got[k] == zeros for k in (3, 4, 5, 6, 9, 10, 11))
    # values of a quarter pixel share: 1, 3/4, 1/4, 0 along each side, and their products
    assert got[8][7] == sum(a * b >= 0.5 for a in (1, 0.75, 0.25, 0) for b in (1, 0.75, 0.25, 0))
    assert got[12][3] == round(1 - 125 / 255, 6) and got[12][8] == 6.0


def test_split_takes_an_exact_number_at_every_size(spark):
    for n in (0, 1, 2, 7, 8, 12, 13, 500):
        rows = spark.range(n * 3).select((F.col("id") % n if n else F.col("id")).alias("k"), "id")
        got = splits.split_disjoint(rows, "k")
        parts = got.groupBy("k").agg(F.count_distinct("validation").alias("kinds"), F.max("validation").alias("v"), F.max("training").alias("t"))
        found = parts.collect()
        assert all(r.kinds == 1 for r in found)
        assert sum(r.v for r in found) == (splits.part_size(n, 0.2) if n else 0)
        assert sum(r.t for r in found) == (1 if n == 1 else n - sum(r.v for r in found))
    assert [splits.part_size(n, 0.2) for n in (1, 2, 7, 8, 12, 13)] == [1, 1, 1, 2, 2, 3] and splits.part_size(5, 0.5) == 2


def test_split_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(splits, "FEW", 1)
    monkeypatch.setattr(splits, "DIGITS", 1)
    hashes = spark.range(300).select(splits.split_hash(F.col("id"), 7).alias("h"))
    ordered = sorted(r.h for r in hashes.collect())
    assert [splits.kth_hash(hashes, k) for k in (1, 60, 300)] == [ordered[0], ordered[59], ordered[299]]
    with pytest.raises(ValueError):
        splits.kth_hash(hashes, 301)


def test_split_of_rows_without_a_key(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("a",), ("b",)], "k string")
    got = sorted((r.k or "", r.validation, r.training) for r in splits.split_disjoint(rows, "k").collect())
    assert got[0] == ("", False, True) and [g[1] for g in got].count(True) in (1, 2)


def test_balance_of_odd_samples(spark):
    rows = [
        ("a", "positive", 0.5, True, [10, 10, 200, 200], [True, True, False, False], "s", None, None), ("a", "positive", None, None, [10, 10, 20, 20], [True, True, False, False], None, None, "white"),
        ("a", "negative", 0.9, True, [10, 10, 200, 200], [True, True, False, False], "s", "fog", "white"), ("b", "negative", None, None, None, None, None, None, None), ("b", "positive", None, None, [5, None], [True, True], None, None, None),
    ]
    samples = spark.createDataFrame(rows, "split string, label string, coverage double, on_cast_shadow boolean, image array<int>, inside array<boolean>, source string, negative_kind string, smoke_colour string")
    got = {r.split: r for r in M.dataset_balance(samples).collect()}
    assert (got["a"].positive, got["a"].shadowlike_positives, got["a"].positives_on_cast_shadow, got["a"].mean_positive_coverage) == (2, 1, 1, 0.25)
    assert got["a"].p_smoke == 0.5 and got["a"].p_smoke_given_dark == 0.75 and got["a"].lift == 1.5
    assert got["all"].n == 5 and got["b"].negative == 1
    groups = {(r.split, r.dimension, r.value): r.n for r in M.dataset_groups(samples).collect()}
    assert groups["a", "smoke_colour", "?"] == 1 and groups["a", "negative_kind", "fog"] == 1 and groups["b", "source", "?"] == 2
