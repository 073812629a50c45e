"""Operators on vectors and the Merkle manifest against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeworks.llm import embedding_dedup, hard_negatives, merkle, queries

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int, n_links string, component_id int, place long, leaf string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, place string, h int, grp string, leaf string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, 2, "y") for i, v, l in rows], VECTORS).repartition(3)


def planted(n: int, seed: int = 1):
    """Random vectors, dense groups of near copies, exact copies."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16), int(rng.integers(3))) for i in range(n)]
    centre = rng.standard_normal(16)
    rows += [(n + i, centre + 0.2 * rng.standard_normal(16), 0) for i in range(n // 2)]
    rows += [(2 * n + i, rows[i % 7][1] * (1 + i % 2), rows[i % 7][2]) for i in range(n // 3)]
    return [(i, v.tolist(), label) for i, v, label in rows]


def valid(v) -> bool:
    return v is not None and None not in v and all(np.isfinite(v)) and any(v)


def brute_links(rows):
    links = [0] * len(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if a is None or a != b or not valid(v) or not valid(w) or len(v) != len(w):
                continue
            x, y = (np.array(z) / max(map(abs, z)) for z in (v, w))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i, (key, _, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    out = []
    for i, (key, _, _) in enumerate(rows):
        least = min((k for k in groups[root(i)] if k is not None), default=None)
        out.append((key, links[i], least, key == least))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("block", [512, 20])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # 20: groups are dealt in many blocks
    rows = planted(120)
    assert ordered(embedding_dedup.near_vectors(vectors(spark, rows)).collect()) == ordered(brute_links(rows))


def test_near_vectors_with_a_listed_or_joined_crowd(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "FEW", 0)
    rows = planted(60, seed=2)
    assert ordered(embedding_dedup.near_vectors(vectors(spark, rows)).collect()) == ordered(brute_links(rows))


ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None),
    (8, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (10, [1e300, 2e300], 1), (11, [1e-300, 2e-300], 1), (12, [1.0, 2.0], 2), (None, [1.0, 2.0], 3), (None, [2.0, 4.0], 3), (None, None, None),
    (13, [1.0, 2.0, 0.0], 1), (14, [-1.0, -2.0], 1), (15, [1.0, 2.1], 1),
]


def test_near_vectors_with_odd_rows(spark):
    assert ordered(embedding_dedup.near_vectors(vectors(spark, ODD)).collect()) == ordered((k, n, c, k == c) for k, n, c, _ in brute_links(ODD))


def test_near_vectors_of_nothing(spark):
    assert embedding_dedup.near_vectors(vectors(spark, ODD).where("false")).count() == 0


def test_tables_keep_the_chance_of_a_miss():
    for largest in (0, 10, 10_000, 10**7, 10**12):
        planes, tables = embedding_dedup.shape(largest)
        agree = (1 - np.arccos(0.93) / np.pi) ** planes
        assert (1 - agree) ** tables <= embedding_dedup.MISS
        assert largest / 2**planes <= embedding_dedup.CELL or planes == embedding_dedup.MOST_PLANES


def test_recall_on_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x, y = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        angle = np.arccos(0.9301)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (np.cos(angle) * x + np.sin(angle) * y).tolist(), 0)]
    found = embedding_dedup.near_vectors(vectors(spark, rows)).where("n_links > 0").count()
    assert found >= 0.99 * len(rows)


def brute_negatives(rows, k=5):
    use = [(i, [int(np.floor(256.0 * x)) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and None not in v and all(np.isfinite(v))]
    out = []
    for at, (key, q, label) in enumerate(use):
        if key % 4:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i, own) for n, (i, v, own) in enumerate(use) if n != at and len(v) == len(q)))
        for p, i, _ in [x for x in scored if x[2] == label][:k]:
            inside = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(key, i, rank, n, -p, -s) for rank, (s, n, _) in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_hard_negatives(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    rng = random.Random(4)
    # few distinct values: scores tie often
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)], rng.randrange(4)) for i in range(300)]
    rows += [(1000 + i, [0.75 + 0.01 * (i % 3)] * 6, i % 2) for i in range(120)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.expr("vec_id % 4 = 0"))
    want = brute_negatives(rows)
    assert len(want) > 500 and ordered(got.collect()) == ordered(want)


def test_hard_negatives_with_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 10]
    rows += [(16, [0.5, 0.5], 2), (16, [0.5, 0.5], 2), (20, [0.5, 0.5], 1), (24, [-0.5, -0.25], 1), (28, [0.0, 0.0], 2), (32, [], 2), (36, [1e6, 1e5], 1), (37, [1e5, 1e6], 2), (40, [1.0], 7)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.expr("vec_id % 4 = 0"))
    assert ordered(got.collect()) == ordered(brute_negatives(rows))
    assert hard_negatives.hard_negatives(vectors(spark, rows).where("false"), F.expr("true")).count() == 0


def test_scores_beyond_64_bits_are_an_error():
    shard = hard_negatives.Shard(np.array([1]), np.array([1]), np.array([0]), np.array([[1e15, 1e15]]))
    with pytest.raises(OverflowError):
        shard.search(np.array([1e15, 1e15]), [(hard_negatives.LOWEST, hard_negatives.HIGHEST)], 5)


def test_search_stops_early_and_reads_on_at_ties():
    n = 5000
    x = np.zeros((n, 2))
    x[:, 0] = np.arange(n)[::-1]
    shard = hard_negatives.Shard(np.arange(n), np.arange(n), np.zeros(n, np.int64), x)
    scored = []
    product = shard.product
    shard.product = lambda rows, q: scored.append(len(rows)) or product(rows, q)
    (at, scores), = shard.search(np.array([1.0, 1.0]), [(0, 10**9)], 5)
    assert at.tolist() == [0, 1, 2, 3, 4] and sum(scored) < 300
    flat = hard_negatives.Shard(np.arange(n)[::-1].copy(), np.arange(n), np.zeros(n, np.int64), np.ones((n, 2)))
    (at, _), = flat.search(np.array([1.0, -1.0]), [(-5, 5)], 3)
    assert flat.ids[at].tolist() == [0, 1, 2]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(digests):
    nodes, paths = [(d, [i]) for i, d in enumerate(digests)], [[] for _ in digests]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k, (_, members) in enumerate(run):
                for i in members:
                    paths[i].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            above.append((H(*(d for d, _ in run)), [i for _, members in run for i in members]))
        nodes = above
    return nodes[0][0], paths


def brute_audit(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    made = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        made.append((own, *brute_tree([leaf_of(r) for r in own])))
    root, above = brute_tree([m[1] for m in made])
    out = []
    for (own, subroot, paths), rest in zip(made, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            path, h = path + rest, leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf_of((*r[:4], r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])))
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], leaf_of(r), subroot, root, H(*(a + b for a, b in path)), h, h == root))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], DOCS).repartition(3)


def check_audit(spark, rows):
    assert ordered(merkle.audit(documents(spark, rows)).collect()) == ordered(brute_audit(rows))


def test_manifest_of_many_shapes(spark):
    rng = random.Random(6)
    rows = [(i, None, "en", 3, f"No source {i}") for i in range(17)]
    rows += [(i * 1000, "wide", "fr", None, f"É{i}Ä") for i in range(273)]
    rows += [(rng.randrange(-(1 << 62), 1 << 62), "sparse", None, i, "T" * i) for i in range(40)]
    rows += [(5, "alone", "en", 1, "")] + [(i, f"s{i:02}", "en", 1, None) for i in range(20)] + [(1, "", "en", 1, "Long " * 50_000), (2, "é", "x", 1, "b"), (3, "z", "x", 1, "c")]
    check_audit(spark, rows)


def test_manifest_of_repeated_ids(spark):
    rows = [(None, "a", "en", 1, f"t{i % 9}") for i in range(40)] + [(7, "a", "en", 1, f"t{i % 5}") for i in range(50)] + [(i, "a", "en", 1, "x") for i in (6, 8, 64, -1, 70, 70)]
    rows += [(7, "b", "en", 1, "same")] * 30 + [(None, None, None, None, None)] * 3
    check_audit(spark, rows)


def test_manifest_of_one_row_and_of_none(spark):
    check_audit(spark, [(3, "a", "en", 1, "Only")])
    assert merkle.audit(documents(spark, [(3, "a", "en", 1, "Only")]).where("false")).count() == 0


def test_manifest_needs_whole_numbers(spark):
    with pytest.raises(TypeError):
        merkle.manifest(spark.createDataFrame([("a", "b")], "doc_id string, source string"), fields=("doc_id",))


def test_paths_prove_leaves(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"t{i}") for i in range(100)]
    made = merkle.manifest(documents(spark, rows), fields=("doc_id", "text"))
    assert made.where(merkle.fold(F.col("path"), F.col("leaf")) == F.col("root")).count() == 100
    assert {(r.doc_id, r.place) for r in made.collect()} == {(i, i // 2) for i in range(100)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert ordered(queries.QUERIES[name](spark, SF).select(names).collect()) == ordered(want.fetchall())
