from __future__ import annotations

import random

import pytest

#: Columns that clash with what operators make.
EXTRA = "n_words long, n_tokens long, start long, fp long, component_id string, starts string, length string"


def words_of(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    long = words_of(rng, 30_000, 5000)
    base = words_of(rng, 60)
    texts = [(1, ""), (2, None), (None, "a text without an id"), (None, None), (3, base), (3, base), (4, base), (5, long), (6, " \t\n "), (7, "one"), (8, "two words"), (9, base + " and its own end"), (10, "x" * 5000), (11, "ſtrange Σ text ñé 中文 \x00 \x85 <|endoftext|> <s>")]
    rows = [(i, t, None if i == 4 else "en", None, None, 1, 2, 3, 4, "a", "b", "c") for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies and shared passages among random texts."""
    rng = random.Random(3)
    shared = [words_of(rng, 40) for _ in range(4)]
    texts = [words_of(rng, rng.randrange(0, 120)) for _ in range(60)]
    for i in range(0, 60, 5):
        a, b = texts[i].split(), rng.choice(shared).split()
        texts[i] = " ".join(a[:20] + b + a[20:])
    texts += [texts[0], texts[5], "\n".join(texts[7].split()), "  ".join(["tail", *texts[10].split()])]
    texts += [" ".join(["again"] * 50), " ".join(["again"] * 30)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).cache()
