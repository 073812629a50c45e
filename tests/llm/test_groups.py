"""Near-duplicates, substring dedup, the language model, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plumeworks.llm import packing, toxicity
from plumeworks.llm import pitman_yor as P
from plumeworks.llm import simhash as S
from plumeworks.llm import substring_dedup as D
from plumeworks.llm.components import components
from plumeworks.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for e in links for x in e if e[0] != e[1]}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aB cÉ\n\x1c\x85 .")), max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_bound_is_from_below(a, b):
    x, y = np.array([a], np.uint64), np.array([b], np.uint64)
    segments = lambda v: [((v >> 2 * i) & 3).bit_count() for i in range(32)]
    d = int(S.manhattan(S.popcounts(x), S.popcounts(y))[0])
    assert d == sum(abs(p - q) for p, q in zip(segments(a), segments(b))) <= (a ^ b).bit_count()


def test_links_lose_nothing(spark):
    rng = random.Random(7)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):  # chains and dense groups
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = roots(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    got = S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in got)
    assert roots(signed, [(r.a, r.b) for r in got]) == want


def test_near_duplicates_of_odd_rows(odd, none):
    got = S.near_duplicates(odd).collect()
    rows = odd.collect()
    assert len(got) == len(rows) and S.near_duplicates(none).count() == 0
    fps = [brute_fingerprint(r.text) for r in rows]
    label = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[label[i]].append(r.doc_id)
    want = Counter((r.doc_id, fps[i], min(least[label[i]], default=None)) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def brute_windows(rows):
    """Removed words of each (doc_id, text)."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for k in range(len(w) - 12):
            if d is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        out.append((d, w, gone))
    return out


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_substring_dedup(request, name):
    df = request.getfixturevalue(name)
    want = Counter()
    for d, w, gone in brute_windows([(r.doc_id, r.text) for r in df.collect()]):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = D.substring_dedup(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert D.substring_dedup(df.where("false")).count() == 0


def test_full_filter_changes_nothing(corpus):
    small = sorted((r.doc_id, sorted(r.starts)) for r in D.repeated_windows(corpus, filter_bytes=(1, 1)).collect())
    assert small == sorted((r.doc_id, sorted(r.starts)) for r in D.repeated_windows(corpus).collect()) and small


@pytest.mark.parametrize("hot_count", [0, 1, 2, 5])
def test_hot_minimizers_and_small_shards_change_nothing(corpus, odd, hot_count):
    for df in (corpus, odd):
        starts = lambda rows: sorted((r.doc_id, r.text_hash, sorted(r.starts)) for r in rows.collect())
        assert starts(D.repeated_windows(df, shard_bytes=5000, hot_count=hot_count)) == starts(D.repeated_windows(df))


def test_hot_phrase_is_dealt_by_other_words():
    phrase = [f"p{i}" for i in range(5)]
    rng = np.random.default_rng(3)
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 10**6, 12)), *phrase, *(f"w{x}" for x in rng.integers(0, 10**6, 12))]) for _ in range(200)]
    words = D.Words(pa.array(texts))
    _, _, plain, changed = words.runs()
    name, times = np.unique(plain, return_counts=True)
    assert not changed.any() and times.max() > 10
    hot = name[times > 10]
    start, windows, least, changed = words.runs(lambda gram: np.isin(gram, hot))
    assert np.unique(least, return_counts=True)[1].max() <= 2 and changed.any()
    # the same windows, each once
    every = lambda s, n: np.concatenate([np.arange(a, a + k) for a, k in zip(s, n)])
    assert np.array_equal(np.sort(every(start, windows)), np.sort(every(*words.runs()[:2])))


def test_rewritten_texts(corpus, odd):
    for df in (corpus, odd):
        rows = df.collect()
        want = Counter()
        for (d, w, gone), r in zip(brute_windows([(r.doc_id, r.text) for r in rows]), rows):
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            if kept or not any(gone):
                want[d, kept] += 1
        got = D.drop_repeated(df)
        assert got.columns == df.columns
        assert Counter((r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in got.collect()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=13, max_size=80))
def test_fm_index(symbols):
    text = np.array([*symbols, 0])
    index = FMIndex(text, 5, 13)
    ends = np.arange(12, len(symbols))
    lo, hi, length = index.intervals(text, ends, 13)
    for e, a, b, n in zip(ends, lo, hi, length):
        pattern = symbols[e - n + 1 : e + 1]
        places = {i for i in range(len(symbols)) if symbols[i : i + n] == pattern}
        assert set(index.order[a:b].tolist()) == places
        assert n == 13 or len(places) == 1


def test_words_by_bytes():
    import pyarrow as pa

    values = ["", None, "a b", " x\ty\n", "é\x85z ñ", "a" * 50]
    w = D.Words(pa.array(values))
    raw = w.raw.tobytes()
    got = defaultdict(list)
    for d, a, b in zip(w.doc, w.starts, w.ends):
        got[d].append(raw[a:b].decode())
    assert [got[i] for i in range(len(values))] == [WORD.findall(v or "") for v in values]
    assert w.hashes[0] != w.hashes[1] and len(set(w.hashes.tolist())) == len({x for v in got.values() for x in v})


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_language_model(request, name):
    df = request.getfixturevalue(name)
    got = P.score_documents(df, most=30).collect()
    rows = df.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        t = tokens(r.text)
        want[r.doc_id, held(r.doc_id), len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if name == "corpus":
        assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert P.score_documents(df.where("false")).count() == 0


def test_frequent_words_are_those_of_all_training_rows(spark):
    rows = [(None, f"a w{i} w{i % 7}") for i in range(9000)]
    count = Counter(t for _, x in rows for t in x.split())
    want = [b"", *(w.encode() for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:8])]
    contexts = P.contexts_of(spark.createDataFrame(rows, "doc_id long, text string"), 8, unit=500)
    assert list(contexts.words) == want
    assert contexts.buckets == round((9000 * 4 / 500) ** 0.25) == 3 and contexts.size == len(contexts.group) == 1 + 3 * 127
    assert [contexts.of(w) for w in want] == [1 + i for i in range(9)]
    assert 1 + 3 * P.OWN <= contexts.of(b"other") < contexts.size
    assert contexts.group[contexts.of(b"other")] == contexts.group[contexts.of(b"another")] == 1 + P.ending(b"her")


def test_contexts_grow_with_the_tokens():
    assert [P.buckets(n, 1 << 24) for n in (0, 1 << 20, 1 << 24, 1 << 28, 1 << 32, 1 << 44)] == [1, 1, 1, 2, 4, 32]
    words = {f"w{i}".encode(): i for i in range(3000)}
    for per in (1, 2, 40, 300):
        contexts = P.Contexts(list(words), per, frequent=100)
        found = [contexts.of(w) for w in words] + [contexts.of(f"v{i}".encode()) for i in range(3000)]
        assert 1 <= min(found) and max(found) < contexts.size == len(contexts.group) <= int(contexts.held)
        assert [contexts.group[c] for c in found[:3000]] == [1 + P.ending(w) for w in words]
        own = min(3000, P.OWN * per)
        assert found[:own] == list(range(1, 1 + own)) and len(contexts.words) == 100


def test_arrays_do_not_bound_own_contexts(spark, monkeypatch):
    monkeypatch.setattr(P, "CELLS", 2000)
    rows = spark.createDataFrame([(None, " ".join(f"w{(7 * i + j) % 200}" for j in range(40))) for i in range(2000)], "doc_id long, text string")
    made = [P.contexts_of(rows, 1 << 15, unit) for unit in (1 << 20, 1 << 12, 1 << 8)]
    assert [len(c.own) for c in made] == [63, 2 * 63, 201] and [c.buckets for c in made] == [1, 2, 4]
    assert [len(c.words) for c in made] == [1 + 15, 1 + 7, 1 + 3]  # while the arrays hold fewer and fewer words
    got = P.score_documents(rows.limit(50), unit=4)
    assert all(r.score < 0 for r in got.collect())



def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    group = P.Contexts([b"", b"one"], 2).group
    size = len(group)
    key = np.unique(rng.integers(0, 40 * size, 3000))
    word, context, count = key // size, key % size, rng.integers(1, 200, len(key))
    rooms = P.Restaurants(word, context, count, 3, 40, group)
    c = np.bincount(context, count, size)
    fixed = {"d": 0.6, "d2": 0.5, "d1": 0.7, "theta": 1.0, "theta2": 1.0, "theta1": 1.0, "c": c}

    def state(totals):
        t, t2, t1 = totals[:size], totals[size:-1], totals[-1]
        return fixed | {"t": t, "c2": np.bincount(group, t, P.ENDINGS + 1), "t2": t2, "C1": t2.sum(), "T1": t1, "new1": (1.0 + 0.7 * t1) / 41}

    m = state(rooms.totals())
    for _ in range(3):
        rooms.sweep(m)
        m = state(rooms.totals())
    for seats, guests in ((rooms.t, count), (rooms.t2, rooms.c2), (rooms.t1, rooms.c1)):
        assert ((seats >= 1) & (seats <= guests)).all()
    assert rooms.c2.sum() == rooms.t.sum() and rooms.c1.sum() == rooms.t2.sum()
    root = P.root_probability(m, np.r_[rooms.c1, 0], np.r_[rooms.t1, 0])
    assert root.sum() == pytest.approx(1)
    for ctx in range(size):
        customers, seats, customers2, seats2 = np.zeros((4, 41))
        at, at2 = context == ctx, rooms.group2 == group[ctx]
        customers[word[at]], seats[word[at]] = count[at], rooms.t[at]
        customers2[rooms.word2[at2]], seats2[rooms.word2[at2]] = rooms.c2[at2], rooms.t2[at2]
        parent = P.parent_probability(m, customers2, seats2, np.full(41, group[ctx]), root)
        assert parent.sum() == pytest.approx(1)
        assert P.probabilities(m, customers, seats, np.full(41, ctx), parent).sum() == pytest.approx(1)


def test_tables_follow_their_conditional():
    d, a, c = 0.5, 0.8, 5
    s = np.exp(P.stirling(d)[c, 1 : c + 1]) * a ** np.arange(1, c + 1)
    drawn = P.tables(np.full(200_000, c), np.full(200_000, a), d, np.random.default_rng(2))
    assert np.bincount(drawn, minlength=c + 1)[1:] / 200_000 == pytest.approx(s / s.sum(), abs=0.01)


@pytest.mark.parametrize("d", [0.1, 0.6, 0.9])
def test_tables_of_many_customers(d):
    for c in (P.EXACT, 300, 1000):
        row = np.array([0.0])  # logarithms of Stirling numbers of n customers at 1 ... n tables
        for n in range(1, c):
            row = np.logaddexp(np.r_[row + np.log(n - np.arange(1, n + 1) * d), -np.inf], np.r_[-np.inf, row])
        k = np.arange(1, c + 1)
        for a in (0.01, 0.5, 3.0, 60.0, 5000.0, 1e6):
            p = np.exp(row + k * math.log(a) - (row + k * math.log(a)).max())
            mean = (p * k).sum() / p.sum()
            deviation = math.sqrt((p * (k - mean) ** 2).sum() / p.sum())
            drawn = P.tables(np.full(20_000, c), np.full(20_000, a), d, np.random.default_rng(4))
            assert drawn.min() >= 1 and drawn.max() <= c
            assert drawn.mean() == pytest.approx(mean, rel=0.045) and drawn.std() == pytest.approx(deviation, rel=0.1, abs=0.02)


@pytest.mark.parametrize("unit", [1 << 24, 400])
def test_scores_equal_brute_force_over_the_seating(corpus, unit):
    """Each text's score from plain dictionaries of the seating that the shards hold."""
    most = 25
    model = P.fit(corpus, most=most, burn_in=1, keep=2, unit=unit)
    contexts = model.contexts.value
    size, group = contexts.size, contexts.group
    assert (contexts.buckets > 1) == (unit == 400)
    names = {xxhash.xxh64_intdigest(w): w for r in corpus.collect() for w in tokens(r.text)}
    by_number = {i: w for w, i in contexts.words.items()}
    seats, parents, roots = ([{} for _ in model.kept] for _ in range(3))
    for row in model.shards.collect():
        shard = P.Shard(row.asDict(), *model.form)
        runs = shard.rooms.run(model.chain[:-1], model.kept)
        block = -(-len(by_number) // model.blocks)  # frequent words of a block
        own = [by_number[row.shard * block + int(x)] if row.kind == 0 else names[int(x)] for x in shard.names]
        for k, r in enumerate(model.kept):
            t, c2, t2, c1, t1 = runs[r]
            for i, key in enumerate(shard.types.tolist()):
                seats[k][own[key // size], key % size] = (int(shard.rooms.count[i]), int(t[i]))
            for i, key in enumerate(zip(shard.rooms.word2.tolist(), shard.rooms.group2.tolist())):
                parents[k][own[key[0]], key[1]] = (int(c2[i]), int(t2[i]))
            for i, w in enumerate(own):
                roots[k][w] = (int(c1[i]), int(t1[i]))
    for k, r in enumerate(model.kept):  # guests of a parent are the tables below it, totals those of the chain
        below = Counter()
        for (w, ctx), (_, t) in seats[k].items():
            below[w, group[ctx]] += t
        assert below == Counter({key: c for key, (c, _) in parents[k].items()})
        assert sum(t for _, t in seats[k].values()) == model.chain[r + 1]["t"].sum()
        assert sum(t for _, t in parents[k].values()) == model.chain[r + 1]["C1"]

    def probability(w, ctx):
        total = 0.0
        for k, r in enumerate(model.kept):
            m, g = model.chain[r + 1], group[ctx]
            c1, t1 = roots[k].get(w, (0, 0))
            root = (c1 - m["d1"] * t1 + (m["theta1"] + m["d1"] * m["T1"]) / (model.corpus["V"] + 1)) / (m["theta1"] + m["C1"])
            c2, t2 = parents[k].get((w, g), (0, 0))
            parent = (c2 - m["d2"] * t2 + (m["theta2"] + m["d2"] * m["t2"][g]) * root) / (m["theta2"] + m["c2"][g])
            c, t = seats[k].get((w, ctx), (0, 0))
            total += (c - m["d"] * t + (m["theta"] + m["d"] * m["t"][ctx]) * parent) / (m["theta"] + m["c"][ctx])
        return total / len(model.kept)

    want = {}
    for r in corpus.collect():
        ctx, score = 0, 0.0
        for w in tokens(r.text):
            score += math.log10(probability(w, ctx))
            ctx = contexts.of(w)
        want[r.doc_id] = score
    for r in P.score_documents(corpus, most=most, burn_in=1, keep=2, unit=unit).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-5)
        assert r.perplexity == pytest.approx(10 ** (-want[r.doc_id] / r.n_tokens), rel=1e-4)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(12)
    bench = [" ".join(f"q{i}b{k}" for k in range(30)) for i in range(3)]
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(15, 90))) for _ in range(120)]
    shared = " ".join(f"s{k}" for k in range(60))
    for i in range(0, 30, 6):
        texts[i] += " " + shared
    texts[50] += " " + bench[1]
    texts[51] = texts[52]
    toxic = set(range(60, 120, 2))
    for i in toxic:
        texts[i] += " vile scummy rotten vile awful"
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(120, "", "en", "s", 0), (121, None, None, None, None), (51, texts[51], "en", "s", len(texts[51]))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(d, t) for d, t, *_ in docs if d not in toxic]
    fps = [brute_fingerprint(t) for _, t in left]
    label = roots(range(len(left)), [(i, j) for i in range(len(left)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {k: min(left[i][0] for i in range(len(left)) if label[i] == k) for k in set(label.values())}
    left = sorted({(d, t) for i, (d, t) in enumerate(left) if d == least[label[i]]}, key=lambda r: r[0])
    cut = [(d, " ".join(x for x, g in zip(w, gone) if not g), any(gone)) for d, w, gone in brute_windows(left)]
    left = [(d, t, c) for d, t, c in cut if (t or not c) and not any(b in t for b in bench)]
    assert {r.doc_id for r in got} == {d for d, *_ in left}
    assert 50 not in {r.doc_id for r in got} and 0 in {r.doc_id for r in got} and 120 in {r.doc_id for r in got}
    from tests.llm.test_tokens import BYTES

    for r in got:
        text = {d: t for d, t, _ in left}[r.doc_id]
        if r.doc_id % 6 == 0 and 0 < r.doc_id < 30:  # a cut text; white space between kept words may differ
            assert r.length < len(BYTES.encode(texts[r.doc_id]).ids)
        elif r.doc_id < 120:
            assert r.length == len(BYTES.encode(text, add_special_tokens=False).ids) + 1


def test_stages_keep_columns_and_clean_rows(spark, odd):
    base = odd.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("fp"))
    kept = corpus_pipeline.near_dedup(spark, base, "")
    assert kept.columns == base.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and ids.count(3) == 1 and 4 not in ids


def jaccard(a, b, width=5):
    def shingles(text):
        w = [x.lower() for x in WORD.findall(text or "")]
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1


def test_near_dedup_finds_all_of_similarity(spark):
    rng = random.Random(21)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for i in range(25):
        base = [f"b{i}w{rng.randrange(500)}" for _ in range(rng.randrange(40, 250))]
        if i % 3 == 0:  # a common passage alone makes no group
            base += passage.split()
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((" ".join(words),))
    chain = [f"c{k}" for k in range(80)]
    for _ in range(12):  # a chain, whose ends are not alike
        rows.append((" ".join(chain),))
        chain = chain[6:] + [f"c{rng.randrange(10**6)}" for _ in range(6)]
    docs = [(i, t, "en", "s", len(t)) for i, (t,) in enumerate(rows)]
    label = roots(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(docs[i][1], docs[j][1]) >= 0.8])
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(got) == sorted(set(label.values())) and len(got) < len(docs) - 20


def test_near_dedup_decides_by_row(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    docs = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (2, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3])]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "").collect()
    assert Counter(map(tuple, got)) == Counter([(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3])])


def test_what_grows_is_never_broadcast(spark):
    from plumeworks.llm.components import with_least

    rows = spark.range(30_000).selectExpr("id", "id div 2 as node")
    least = rows.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("degree"))
    for links in (10, 30_000):
        got = with_least(rows, least, "node", links)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.where("first = node * 2").count() == 30_000
    hub = rows.unionByName(spark.range(25_000).selectExpr("id", "-1L as node"))
    least = hub.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("degree"))
    assert with_least(hub, least, "node", 55_000).where("first = greatest(node, 0) * 2").count() == 55_000


def test_grid_over_counts_misses_no_pair():
    from fractions import Fraction

    import numpy as np

    from plumeworks.llm import near_texts as N

    grid, rng = N.Grid(Fraction("0.8")), np.random.default_rng(4)
    for n in [*range(1, 90), *rng.integers(90, 3000, 12).tolist()]:
        base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        sets = [base]
        for gone in range(0, n, 1 + n // 90):  # pairs on the very edge: some shingles go, as many as may come
            new = next((k for k in range(n, -1, -1) if 5 * (n - gone) >= 4 * (n + k)), None)
            if new is None:
                break
            sets.append(np.unique(np.r_[rng.permutation(base)[gone:], rng.integers(0, 1 << 64, new, np.uint64)]))
        each, keys = N.cells(sets, grid)
        own = np.split(keys, each.cumsum()[:-1])
        assert all(len(np.intersect1d(own[0], x)) for x in own[1:])
        assert (each < 0.75 * np.array([len(x) for x in sets]) + 20).all() or n < 90
    # sets of 300 that share a passage of 60 meet in few cells
    passage = rng.integers(0, 1 << 64, 60, np.uint64)
    each, keys = N.cells([np.unique(np.r_[passage, rng.integers(0, 1 << 64, 240, np.uint64)]) for _ in range(100)], grid)
    assert np.unique(keys, return_counts=True)[1].max() < 25
    # a set that fills few groups of its class by chance has its single shingles too
    narrow = np.arange(40, dtype=np.uint64)
    each, keys = N.cells([narrow, np.r_[narrow[4:], narrow[:4] + np.uint64(1 << 63)]], grid)
    assert len(np.intersect1d(keys[: each[0]], keys[each[0] :]))
    assert N.cells([np.zeros(0, np.uint64)], grid)[0].tolist() == [0]


def test_pairs_of_blocks_are_all_compared():
    from fractions import Fraction

    import numpy as np
    import pyarrow as pa

    from plumeworks.llm import near_texts as N

    rng = np.random.default_rng(8)
    kind = [rng.integers(0, 1 << 64, 60, np.uint64) for _ in range(3)]
    sets = [np.unique(np.r_[kind[k % 3][k % 5 :], rng.integers(0, 1 << 64, 3, np.uint64)]) for k in range(30)]
    text = [{"n": len(s), "sig": i, "component": i // 2, "bins": N.bins(s).tobytes()} for i, s in enumerate(sets)]
    schema = pa.schema([(c, pa.list_(pa.struct([("n", pa.int32()), ("sig", pa.int64()), ("component", pa.int64()), ("bins", pa.binary())]))) for c in ("left", "right")])
    made = [(text[:7], None), (text[7:8], None), (text[8:15], text[15:20]), (text[20:], None), (text[:1], text[29:])]
    near = lambda i, j: i // 2 != j // 2 and 9 * int(np.abs(N.bins(sets[i]).astype(int) - N.bins(sets[j])).sum()) <= len(sets[i]) + len(sets[j])
    want = set()
    for left, right in made:
        a, b = [r["sig"] for r in left], [r["sig"] for r in right or left]
        want |= {(i, j) for i in a for j in b if i < j and near(i, j)}
    for members in (1, 10, 1 << 15):
        batch = pa.RecordBatch.from_pylist([{"left": x, "right": y} for x, y in made], schema)
        got = [p for out in N._pairs(iter([batch, batch.slice(0, 0)]), Fraction("0.8"), None, members=members) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
        assert set(got) == want and len(want) > 20


def test_workers_keep_and_need_little(spark, corpus, monkeypatch):
    """an executor counts what its workers hold between tasks, how many they are, and what a slice of texts takes."""
    rng = np.random.default_rng(2)
    n = 3 * D._STEP + 5
    values, starts = rng.integers(0, 256, n, dtype=np.uint8), np.array([0, D._STEP - 2, D._STEP, n - 3, n])
    ends = np.minimum(starts + 4, n)
    base, mask = D._BASE, (1 << 64) - 1
    want = [sum((int(x) + 1) * pow(base, i, 1 << 64) for i, x in enumerate(values[a:b])) + b - a & mask for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert D.range_hashes(values, starts, ends).tolist() == D.mix(np.array(want, np.uint64)).tolist()
    D.range_hashes(np.zeros(1 << 20, np.uint8), starts, ends)
    assert sum(x.nbytes for x in D._powers.values()) <= 1 << 17

    plans = []
    to_arrow = type(corpus).toArrow
    monkeypatch.setattr(type(corpus), "toArrow", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or to_arrow(self))
    D.repeated_windows(corpus)
    assert plans and all(len(re.findall("(?:MapInArrow|FlatMapGroupsInArrow)", stage)) <= 1 for plan in plans for stage in re.split("Exchange", plan))

    # 4 MB in one batch: no step takes more than 1 MB and a text at once
    texts = pa.array(["word " * 2000] * 400)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), texts, pa.array([0] * 400)], ["doc_id", "text", "grade"])
    taken = []

    class Counting:
        def exceed(self, values):
            taken.append(sum(map(len, values)))
            return np.zeros((len(values), 1))

    encoded = packing.encode_texts
    monkeypatch.setattr(packing, "encode_texts", lambda values, path: taken.append(sum(map(len, values))) or encoded(values, path))
    assert sum(x.num_rows for x in packing._pieces([batch], public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)) >= 400
    assert sum(x.num_rows for x in toxicity._keep([batch], Counting(), 0.3)) == 400
    assert sum(x.num_rows for x in toxicity._score([batch], Counting(), 0.3)) == 400
    assert sum(taken) == 3 * 4_000_000 and max(taken) <= 1_100_000
