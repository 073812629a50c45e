"""Quality rules with risk-controlled thresholds (operator 1, native).

A rule is a score that rises with badness; a cutoff rejects what scores above
it. For each stratum and rule, labelled good documents test the cutoffs from
the most lenient to the strictest: a cutoff stands if the exact binomial tail
P(X <= rejected | n, share) is at most the error level, and testing stops at the
first that fails, so that the sequence needs no further correction. A rule's
share is `risk` divided by the number of rules, so that the rules together
reject no more than `risk` even where each rejects other documents; the error
level is `delta` divided by the number of tests that run side by side
(Bonferroni over strata and rules). With probability 1 - delta the chosen
cutoffs reject no more than `risk` of any stratum's good documents, all rules
together. A stratum or rule without a standing cutoff rejects nothing.

All of it is DataFrame functions. Windows of words are compared inside each
row; the only shuffles are of counts and of a few numbers a document.

Cases: null and empty texts have no words and fail the base rules. Null strata
are one stratum. Labels that are null, or without a document, take no part;
without labels every verdict keeps. Repeated rows count each for itself. Texts
are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SPACES = " \t\n\x0b\x0c\r"
#: Rules by name: the score's SQL over the base columns, in percent or in characters.
RULES = {
    "symbols": "100.0 * n_symbols / greatest(word_chars, 1)",
    "dup_lines": "100.0 * n_dup_lines / greatest(n_lines, 1)",
    "repeats": "100.0 * n_repeat_words / greatest(n_words, 1)",
    "shouting": "100.0 * n_upper / greatest(word_chars, 1)",
}
#: Cutoffs from lenient to strict.
CUTOFFS = (90, 75, 60, 50, 40, 32, 25, 20, 16, 12, 10, 8, 6, 5)


def _without(column: Column, characters: str) -> Column:
    return F.translate(column, characters, "")


def base_columns(docs: DataFrame, key: str = "doc_id", column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each document's words, characters, lines and repeated windows."""
    text = F.coalesce(F.col(column), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "")
    rows = docs.select(key, *carry, text.alias("t"), words.alias("w"), lines.alias("l"))
    rows = rows.select(
        key,
        *carry,
        F.length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(_without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("w").cast("long").alias("n_words"),
        # each word by its hash, so that windows need not read words eight times
        F.expr(f"CASE WHEN size(w) >= {WINDOW} THEN transform(w, x -> xxhash64(x)) END").alias("g"),
    )
    # a window's hash from those of its halves: of 2, then 4, then 8 words. XXH64 of XXH64, so two windows of a text
    # share one by chance in one of 2^64 cases. Texts of fewer words than a window have none.
    for name, of, step in (("g2", "g", 1), ("g4", "g2", 2), ("h", "g4", 4)):
        halves = f"zip_with(slice({of}, 1, size({of}) - {step}), slice({of}, {step + 1}, size({of}) - {step}), (a, b) -> xxhash64(a, b))"
        rows = rows.withColumn(name, F.expr(f"CASE WHEN {of} IS NOT NULL THEN {halves} END")).drop(of)
    rows = rows.withColumn("h", F.coalesce("h", F.expr("array()")))
    # texts with a repeated window: places sorted by window, those with an equal neighbour, and the words they cover
    placed = "array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    twice = "transform(filter(transform(s, (e, k) -> struct(e.i AS i, (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x) AS r)), e -> e.r), e -> e.i)"
    covered = f"aggregate(array_sort(p), struct(0L AS n, 0 AS e), (a, i) -> struct(a.n + i + {WINDOW} - greatest(i, a.e) AS n, i + {WINDOW} AS e), a -> a.n)"
    rows = rows.withColumn("s", F.expr(f"CASE WHEN size(array_distinct(h)) < size(h) THEN {placed} END"))
    rows = rows.withColumn("p", F.expr(f"CASE WHEN s IS NOT NULL THEN {twice} END"))
    return rows.withColumn("n_repeat_words", F.expr(f"CASE WHEN p IS NOT NULL THEN {covered} ELSE 0L END")).drop("h", "s", "p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL for P(X <= k) with X binomial (n, p): terms from the last down, until they no longer matter.

    For k <= np the term t below the last is less than it by exp(-t^2 / 2np(1-p)) at least, so that
    those more than nine standard deviations below are under 1e-17 of it.
    """
    # log C(n, k) by Stirling's series for the factorials, then each term from the one above it
    lf = "(CASE WHEN {x} < 2 THEN 0D ELSE ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}) + 1D / (1260D * pow({x}, 5)) - 1D / (1680D * pow({x}, 7)) END)".format
    top = f"exp({lf(x=f'cast({n} AS double)')} - {lf(x=f'cast({k} AS double)')} - {lf(x=f'cast({n} - {k} AS double)')} + {k} * ln({p}D) + ({n} - {k}) * ln({1 - p!r}D))"
    steps = f"least({k}, 50 + ceil(9 * sqrt({n} * {p * (1 - p)!r}D)))"
    ratio = f"({k} - j + 1) / ({n} - {k} + j) * {(1 - p) / p!r}D"
    return f"CASE WHEN {k} >= {n} THEN 1D WHEN {k} > {n} * {p}D THEN 1D ELSE {top} * aggregate(CASE WHEN {k} > 0 THEN sequence(1, cast({steps} AS int)) ELSE array() END, struct(1D AS s, 1D AS t), (a, j) -> struct(a.s + a.t * ({ratio}) AS s, a.t * ({ratio}) AS t), a -> a.s) END"


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.05, delta: float = 0.05, key: str = "doc_id") -> DataFrame:
    """One row per stratum and rule with a standing cutoff: the strictest of them.

    risk: the share of good documents that all rules together may reject.
    scored has the key, the stratum and the base columns; labels has the key and quality (1: good).
    """
    good = labels.where("quality = 1").select(key).distinct()
    rows = scored.where(~base_failed()).join(good, key)
    scores = F.array(*(F.struct(F.lit(name).alias("rule"), F.expr(sql).cast("double").alias("score")) for name, sql in RULES.items()))
    rows = rows.select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.explode(scores).alias("r")).select("stratum", "r.*")
    counts = rows.groupBy("stratum", "rule").agg(F.count("*").alias("n"), *(F.count_if(F.col("score") > c).alias(f"k{i}") for i, c in enumerate(CUTOFFS)))
    tests = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, c in enumerate(CUTOFFS)))
    side_by_side = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))  # one row, of a count
    tested = counts.select("stratum", "rule", "n", F.explode(tests).alias("t")).select("stratum", "rule", "n", "t.*").join(F.broadcast(side_by_side))
    tested = tested.withColumn("fails", F.expr(binomial_tail("n", "k", risk / len(RULES))) > F.lit(delta) / F.col("tests"))
    first = tested.groupBy("stratum", "rule").agg(F.min(F.when(F.col("fails"), F.col("i"))).alias("end"), F.max("n").alias("n_good"))
    standing = tested.join(first, ["stratum", "rule"]).where("end IS NULL OR i < end")
    return standing.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.max("n_good").alias("n_good"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: its base columns, base_failed, and kept."""
    scored = stored(base_columns(docs, key, carry=(stratum,)), "quality")
    chosen = cutoffs(scored, labels, stratum, risk, delta, key)
    # one row a stratum: as many rows as there are strata, joined as Spark finds it best
    chosen = chosen.groupBy(F.col("stratum").alias("s_")).agg(*(F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"c_{name}") for name in RULES))
    rows = scored.join(chosen, F.coalesce(F.col(stratum), F.lit("")) == F.col("s_"), "left")
    rejected = F.lit(False)
    for name, sql in RULES.items():
        rejected = rejected | F.coalesce(F.expr(sql).cast("double") > F.col(f"c_{name}"), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("s_", *(f"c_{name}" for name in RULES))
