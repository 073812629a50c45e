"""HTML text, decontamination, toxicity and quality."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeworks.llm import decontamination as X
from plumeworks.llm import quality as Q
from plumeworks.llm import toxicity as T
from plumeworks.llm.html_text import extract_text, line_sizes, main_text, page_lines

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this now, it is long enough to surge over any threshold there is, buy it.</div>{}<footer>&copy; us</footer></body>"
PAGES = {
    PAGE.format("<article><h1>A &amp; b</h1><p><b>Title.<br><p>One\n  two.</p><p>Be.</p></article>"): "A & b\nTitle.\nOne two.\nBe.",
    PAGE.format("<article><p>x</p><aside>no</aside><div class='comments'><article><p>me too</p></article></div><p>y</p></article>"): "x\ny",
    PAGE.format(""): "",
    "": "",
    "plain": "plain",
    "<p>a < b &lt; c &#233;</p>": "a < b < c é",
    "<div id='sidebar'>no</div><div>" + "long text " * 12 + "</div><p>short</p>": ("long text " * 12).strip() + "\nshort",
    "<article><p>open <script>never closed": "open",
    "<article><p>cut <b": "cut < b".replace("< b", "<b"),
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page) == PAGES[page]


LONG = ("A sentence of a body that goes on and on. " * 5).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article class='card'><h3>Read on</h3></article>", f"{LONG}\n{LONG}"),
        (f"<p>{LONG}</p><div class='ad'>Buy.</div><p>The end.</p>", f"{LONG}\nThe end."),
        (f"<div><div>{LONG}</div><div class='ad'>Buy.</div><div>The end.</div></div>", f"{LONG}\nThe end."),
        (f"<div class='no-sidebar search-results'><p>{LONG}</p></div>", LONG),
        (f"<div>A line.</div><article><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    ],
)
def test_surge_and_dive_on_every_page(page, want):
    got = main_text(page).split("\n")
    assert [x for x in got if x != "Read on"] == want.split("\n")


def brute_main_text(page, window=3, surge=80, dive=10):
    """The rule by definition: a line is kept if some run of full windows that begins with a surge reaches it."""
    lines = page_lines(page, window)
    plain, size = line_sizes(lines, 0.5)
    total = lambda i: sum(size[i : i + window])
    most = max(map(total, range(len(size))), default=0)
    enough = lambda i: min(surge, most) if lines[i].weight == 1 else max(1.6, most / 8)
    little = lambda i: min(dive, most) if lines[i].weight == 1 else 0.1
    kept = set()
    for a in range(len(size)):
        if not size[a] or total(a) < enough(a):
            continue
        b = a
        while b + 1 < len(size) and total(b + 1) >= little(b + 1):
            b += 1
        solid = [i for i in range(a, b + 1) if size[i] >= little(i) or (plain[i] and lines[i].main)]
        if solid and total(a) >= little(a):
            kept |= {i for i in range(solid[0], solid[-1] + 1) if size[i]}
    first = {}
    for i in sorted(kept):
        first.setdefault((lines[i].container, lines[i].weight), i)
    kept |= {i for i, x in enumerate(lines) if size[i] and first.get((x.container, x.weight), len(lines)) < i}
    return "\n".join(lines[i].text for i in sorted(kept))


PARTS = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "<div class='ad'>", "<a href=x>", "</a>", "<br>", "<h1>", "</h1>", "word", "A short line.", "A sentence of a body that goes on and on, long enough to matter. ", "&amp;", "<b>", "<footer>", "</footer>", "<!-- x -->", "<script>y</script>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_line_blocks_equal_brute_force(parts):
    assert main_text("".join(parts)) == brute_main_text("".join(parts))


def test_windows_decide(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    # the filters without the windows: all lines that weigh something
    weighed = ["\n".join(x.text for x, s in zip(lines, line_sizes(lines, 0.5)[1], strict=True) if s) for lines in (page_lines(p, 3) for p in pages)]
    got = list(map(main_text, pages))
    assert got == list(map(brute_main_text, pages))
    assert np.mean([a != b for a, b in zip(got, weighed, strict=True)]) > 0.9


AROUND = ["comment-list", "user-comments", "ad-box", "site-footer", "share-bar", "comments_area", "ad", "related posts", "cookie-notice"]


@pytest.mark.parametrize("name", AROUND)
@pytest.mark.parametrize("page", ["<article>{}{}</article>", "<div>{}{}</div>", "<article>{}</article>{}", "<div>{}</div>{}", "{1}<article>{0}</article>", "{1}<div>{0}</div>"])
@pytest.mark.parametrize("mark", ["class", "id"])
def test_surroundings_by_parts_of_names(name, page, mark):
    body = f"<p>{LONG}</p><p>{LONG}</p><p>Short.</p>"
    around = f"<div {mark}='{name}'><p>NO. {LONG}</p><p>NO. {LONG}</p><p>NO.</p></div>"
    assert main_text(page.format(body, around)) == f"{LONG}\n{LONG}\nShort."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><div class='header'><h1>Headline</h1></div><p>{LONG}</p></article>", f"Headline\n{LONG}"),
        (f"<article><header class='entry-header'><h1>Headline</h1></header><p>{LONG}</p></article>", f"Headline\n{LONG}"),
        (f"<article><section class='social'><p>{LONG}</p><p>{LONG}</p></section></article>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='social'>Tweet this now</div><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<form><div class='nav-menu'>Home, news</div><p>{LONG}</p><p>{LONG}</p><p>Bye.</p></form><footer>us</footer>", f"{LONG}\n{LONG}\nBye."),
        ("<div class='user-comments'><p>Nice.</p></div><footer>us</footer>", ""),
        (f"<nav>Menu</nav><div class='comments'><p>{LONG}</p></div>", ""),
    ],
)
def test_names_that_do_not_decide_alone(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("piece", ["<a \"'", "<a ", "<b>x<br>", "</p>", "<!x ", "<div></b>", '<a href="x> <p>'])
def test_bad_markup_takes_linear_time(piece):
    import time

    began = time.process_time()
    main_text(piece * (200_000 // len(piece)))
    assert time.process_time() - began < 5


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("<>/ap \"'=&;!-dn")), max_size=80))
def test_any_markup_ends(page):
    assert isinstance(main_text(page), str)


def test_pages_table(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>hi", "y"), (2, "v", "<p>" + "a " * 50_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.text[:3], r.n_chars) for r in extract_text(pages).collect())
    assert got == Counter({(1, "", 0): 2, (None, "hi", 2): 1, (2, "a a", 99_999): 1})
    assert extract_text(pages.where("false")).count() == 0


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120), st.integers(0, 90))
def test_myers_equals_dynamic_programming(pattern, text, most):
    want = edits(pattern, text)
    got = X.myers(pattern, text, most)
    if want[0] >= len(pattern):
        assert got is None or got[0] == len(pattern)
    else:
        assert got == (want if want[0] <= most else None)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(30))) for i in range(12)]
    return spark.createDataFrame([*rows, (90, None), (91, ""), (92, "short"), (None, rows[0][1]), (93, rows[3][1])], "item_id long, text string")


def test_contaminated_equals_brute_force(spark, items):
    rng = random.Random(2)
    known = {r.item_id: X.reduced(r.text) for r in items.collect() if r.item_id is not None and X.reduced(r.text)}
    docs = []
    for d in range(60):
        text = list(known[rng.randrange(12)]) if d % 2 else []
        for _ in range(rng.randrange(0, 14)):
            if text:
                k = rng.randrange(len(text))
                text[k : k + rng.randrange(2)] = rng.choice(["", "z", " "])
        around = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(2)]
        around[0] += ["", " short", " shortest", " a-short!"][d % 4]
        docs.append((d, around[0] + " " + "".join(text) + " " + around[1]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = set()
    for d, text in docs:
        for i, item in known.items():
            e, _ = edits(item, X.reduced(text))
            if e <= X.budget(len(item), 0.08) if len(item) >= X.SHORT else f" {item} " in f" {X.reduced(text)} ":
                want.add((d, i, e))
    got = X.contaminated(df, items).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and want
    # blocks of items change nothing
    assert sorted(map(tuple, X.contaminated(df, items, block_chars=100).collect())) == sorted(map(tuple, got))
    clean = {r.doc_id for r in X.drop_contaminated(df, items).collect()}
    assert clean == {d for d, _ in docs} - {w[0] for w in want}
    texts = dict(docs)
    for r in got:  # the reported place is the occurrence
        assert edits(known[r.item_id], X.reduced(texts[r.doc_id])[r.start : r.end])[0] <= r.edits + 1


def test_contamination_of_odd_rows(odd, none, items):
    assert X.contaminated(odd, items).count() == 0
    assert X.drop_contaminated(odd, items).count() == odd.count() and X.drop_contaminated(odd, items).columns == odd.columns
    assert X.contaminated(none, items).count() == 0 and X.contaminated(odd, items.where("false")).count() == 0


def toxic_corpus(spark, n=400):
    rng = random.Random(4)
    rows, grades = [], []
    for i in range(n):
        grade = i % 4 if i % 4 < 3 else 0
        words = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(3 * grade):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "scummy", "rotten"]) if grade < 2 else rng.choice(["beastly", "vile", "horrid"]))
        rows.append((i, " ".join(words)))
        grades.append((i, grade))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")


def test_toxicity_on_held_out_rows(spark):
    docs, grades = toxic_corpus(spark)
    model = T.fit_toxicity(docs, grades.where("doc_id < 300"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in T.score_toxicity(docs, model, 0.5).collect()}
    truth = {r.doc_id: r.grade for r in grades.collect()}
    tested = [i for i in truth if i >= 300]
    assert np.mean([got[i].rejected == (truth[i] > 0) for i in tested]) > 0.97
    mean = [np.mean([got[i].expected_severity for i in tested if truth[i] == g]) for g in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]
    kept = {r.doc_id for r in T.drop_toxic(docs, model, 0.5).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}


def test_severity_equals_brute_force(spark):
    """Scores from the model's weights and thresholds by the definition of the cumulative link."""
    docs, grades = toxic_corpus(spark)
    model = T.fit_toxicity(docs, grades)
    assert model.weights and list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in T.score_toxicity(docs, model).collect()}
    for r in docs.collect():
        score = sum(model.weights.get(f, 0.0) for f in T.features(r.text or ""))
        over = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert got[r.doc_id].expected_severity == pytest.approx(sum(over), abs=1e-9)
        assert got[r.doc_id].grade == sum(p > 0.5 for p in over) and got[r.doc_id].rejected == (over[0] >= 0.3)


def test_ordinal_gradient_lowers_the_loss():
    rows, cols = np.array([0, 1, 2, 3, 3]), np.array([0, 1, 2, 0, 2])
    w, t = T.fit(rows, cols, 3, np.array([0, 1, 2, 1]), 1e-4, 800)
    assert w[0] < w[2] and t[0] < t[1]


def test_toxicity_of_odd_rows(spark, odd, none):
    docs, grades = toxic_corpus(spark)
    model = T.fit_toxicity(docs, grades)
    assert T.score_toxicity(odd, model).count() == odd.count()
    assert T.drop_toxic(odd, model).columns == odd.columns and T.drop_toxic(none, model).count() == 0
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, grade int")
    nothing = T.fit_toxicity(odd, no_labels)
    assert {(r.p_toxic, r.expected_severity, r.rejected) for r in T.score_toxicity(odd, nothing).collect()} == {(0.0, 0.0, False)}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in T.label_grades(labels).orderBy("doc_id").collect()] == [0, 2, 1, None]


def brute_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts_equal_brute_force(spark, odd):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "c#", "D|"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(12))) for _ in range(150)] + [" ".join("abc"[i % 3] for i in range(40)), "x\x0by\x85z"]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = Q.base_columns(docs).collect()
    want = Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


@pytest.mark.parametrize("p", [0.01, 0.05, 0.3])
def test_binomial_tail(spark, p):
    cases = [(n, k) for n in (1, 2, 7, 50, 400, 5000) for k in {0, 1, n // 20, n // 10, n} if k <= n]
    got = spark.createDataFrame(cases, "n long, k long").selectExpr("n", "k", f"{Q.binomial_tail('n', 'k', p)} AS tail").collect()
    for r in got:
        log = lambda j, n=r.n: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)
        exact = sum(math.exp(log(j)) for j in range(r.k + 1))
        assert r.tail == (pytest.approx(exact, rel=1e-4, abs=1e-12) if r.k <= r.n * p else 1.0)


def test_binomial_tail_of_many_labels(spark):
    p = 0.05
    cases = [(n, int(n * p - z * math.sqrt(n * p * (1 - p)))) for n in (10**7, 10**8) for z in (0, 2, 4)]
    got = {(r.n, r.k): r.tail for r in spark.createDataFrame(cases, "n long, k long").selectExpr("n", "k", f"{Q.binomial_tail('n', 'k', p)} AS tail").collect()}
    for n, k in cases:
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        total, j = 0.0, k
        while term > 1e-25:
            total += term
            term *= j / (n - j + 1) * (1 - p) / p
            j -= 1
        assert got[n, k] == pytest.approx(total, rel=1e-3)


def test_rules_together_keep_the_risk(spark):
    # two rules that reject different good documents, each less than 5 % of them
    texts = []
    for i in range(6000):
        end = "##" if i < 180 else ""
        texts.append(" ".join(f"u{i}x{k}{end}".upper() if 180 <= i < 360 else f"u{i}x{k}{end}" for k in range(30)))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    rejected = Q.quality_verdicts(docs, marks).where("not kept and not base_failed").count()
    assert rejected <= 0.05 * 6000


def test_cutoffs_keep_false_rejections_low(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(2400):
        good = i % 3 > 0
        noise = rng.random() < (0.001 if good else 0.9)
        words = [f"u{i}x{k}" + ("##" if noise else "") for k in range(40)]
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in Q.quality_verdicts(docs, marks, risk=0.05).collect()}
    for lang in (0, 1):
        good = [i for i, q in labels if q and i % 2 == lang]
        assert np.mean([not got[i] for i in good]) <= 0.05
    assert np.mean([not got[i] for i, q in labels if not q]) > 0.8


def test_too_few_labels_keep_all(spark, odd, none):
    marks = spark.createDataFrame([(3, 1), (5, None), (None, 1), (404, 1)], "doc_id long, quality int")
    for labels in (marks, marks.where("false")):
        got = Q.quality_verdicts(odd, labels)
        assert got.count() == odd.count() and got.where("kept = base_failed").count() == 0
    assert Q.quality_verdicts(none, marks).count() == 0


def test_quality_is_native(odd, spark):
    marks = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    plan = Q.quality_verdicts(odd.select("doc_id", "text", "lang").where(F.col("doc_id") > 0), marks)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
