"""Toxicity by cumulative-link ordinal regression on sparse text features (operator 4).

Features are the distinct words of a text and their stems, which catch inflected
and compounded words that the sample never saw. One weight a feature is shared by all
thresholds between severity grades: P(grade > j) = s(w.x - t_j) with ascending
thresholds t. The model is fitted by accelerated proximal gradient steps under
an L1 penalty, which leaves weights to the words that carry severity and none
to the rest, so that long clean texts gather no score.

The fit takes a bounded sample of labelled rows, at most `per_grade` of each
grade, chosen by hash; scoring covers every row and whole texts.

Cases: null and empty texts have no features and the grade that the thresholds
alone give. Labels without grade or without document are not used; without
labels of two grades nothing is toxic and severity is 0. Repeated rows get equal
rows; a document with several grades is a row of each. Ties in the sample's order
are broken by doc_id. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, slices, texts

WORD = re.compile(r"[^\W\d_]+")


#: Stems are the first characters of words, by these lengths; a stem of several distinct words of a text is a feature for each count up to the last.
STEMS, COUNTS = (4, 5), 3


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(text: str) -> list[str]:
    """The distinct words of a text, and its stems with the counts they reach."""
    found = words(text)
    stems = Counter(w[:k] for k in STEMS for w in found if len(w) >= k)
    return sorted([*found, *(f"{s}*{c + 1}" for s, n in stems.items() for c in range(min(n, COUNTS)))])


class OrdinalModel:
    """Word weights and thresholds; grades are 0 to the number of thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.stems: dict[str, list[float]] = {}  # of each stem, what its first 1, 2, ... words add in all
        for name in {x.partition("*")[0] for x in weights if "*" in x}:
            each = [weights.get(f"{name}*{c + 1}", 0.0) for c in range(COUNTS)]
            self.stems[name] = [sum(each[: c + 1]) for c in range(COUNTS)]

    def score(self, text: str) -> float:
        found, get, stems = words(text), self.weights.get, self.stems
        total = sum(get(w, 0.0) for w in found)
        for s, n in Counter(s for k in STEMS for w in found if len(w) >= k and (s := w[:k]) in stems).items():
            total += stems[s][min(n, COUNTS) - 1]
        return total

    def exceed(self, values: list[str]) -> np.ndarray:
        """P(grade > j) of each text, a column for each threshold."""
        score = np.array([self.score(x) if self.weights else 0.0 for x in values])
        away = self.thresholds[None, :] - score[:, None]
        return np.where(np.isinf(away), 0.0, 1 / (1 + np.exp(np.minimum(away, 700))))


def fit(rows: np.ndarray, cols: np.ndarray, n_cols: int, grade: np.ndarray, penalty: float, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for binary features (rows[i], cols[i]) and grades 0, 1, ..."""
    n, levels = len(grade), int(grade.max())
    weight = np.full(n, 1 / n)
    above = grade[:, None] > np.arange(levels)[None, :]
    share = (weight[:, None] * above).sum(0)
    first = np.log((1 - share) / share)

    def split(z: np.ndarray) -> np.ndarray:
        return np.r_[z[0], z[0] + np.exp(z[1:]).cumsum()]

    def gradient(w: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.bincount(rows, w[cols], n)
        edge = np.hstack([np.full((n, 1), -np.inf), np.broadcast_to(split(z), (n, levels)), np.full((n, 1), np.inf)]) - s[:, None]
        cdf = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
        lo, hi = np.take_along_axis(cdf, grade[:, None], 1)[:, 0], np.take_along_axis(cdf, grade[:, None] + 1, 1)[:, 0]
        p = np.maximum(hi - lo, 1e-9)
        dlo, dhi = lo * (1 - lo), hi * (1 - hi)
        ds = weight * (dhi - dlo) / p  # of the loss, by the score
        dt = np.zeros(levels)
        np.add.at(dt, grade[grade < levels], (-weight * dhi / p)[grade < levels])
        np.add.at(dt, grade[grade > 0] - 1, (weight * dlo / p)[grade > 0])
        tail = dt[::-1].cumsum()[::-1]
        return np.bincount(cols, ds[rows], n_cols), np.r_[tail[0], tail[1:] * np.exp(z[1:])]

    v = np.full(n_cols, n_cols**-0.5)  # the largest curvature, by power steps
    for _ in range(20):
        u = np.bincount(cols, (weight * np.bincount(rows, v[cols], n))[rows], n_cols)
        v = u / max(1e-12, np.linalg.norm(u))
    rate = 1 / max(1e-6, np.linalg.norm(u) + 1)
    w, z = np.zeros(n_cols), np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    yw, yz, k = w, z, 1.0
    for _ in range(steps):
        gw, gz = gradient(yw, yz)
        nw = yw - rate * gw
        nw, nz = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0), yz - rate * gz
        k, old = (1 + (1 + 4 * k * k) ** 0.5) / 2, k
        yw, yz = nw + (old - 1) / k * (nw - w), nz + (old - 1) / k * (nz - z)
        w, z = nw, nz
    return w, split(z)


def _features(batches):
    for batch in slices(batches, most=1 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([features(x) for x in texts(batch)], pa.list_(pa.string()))], ["grade", "words"])


def fit_toxicity(docs: DataFrame, grades: DataFrame, per_grade: int = 1500, least_docs: int = 4, penalty: float = 1e-3) -> OrdinalModel:
    """Fit on labelled rows: grades has doc_id and grade (0, 1, ...).

    per_grade: rows of each grade in the sample at most; the driver holds their
    distinct words, and nothing else of the corpus. least_docs: a word in fewer
    sampled rows, or in over half of them, is no feature.
    """
    order = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = grades.where("doc_id is not null and grade is not null").select("doc_id", F.col("grade").cast("int").alias("grade")).distinct()
    chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_grade).drop("place")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInArrow(_features, "grade int, words array<string>").toArrow()
    grade, lists = sample.column("grade").to_numpy().astype(np.int64), sample.column("words").combine_chunks()
    present = np.unique(grade)
    if len(present) < 2:
        return OrdinalModel({}, np.array([np.inf]))
    grade = np.searchsorted(present, grade)
    coded = pc.dictionary_encode(lists.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    cols = coded.indices.to_numpy()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    seen = np.bincount(cols, minlength=len(coded.dictionary))
    kept = np.flatnonzero((seen >= least_docs) & (seen <= len(lists) / 2))
    if not len(kept):
        return OrdinalModel({}, np.array([np.inf]))
    place = np.full(len(seen), -1)
    place[kept] = np.arange(len(kept))
    use = place[cols] >= 0
    w, thresholds = fit(rows[use], place[cols[use]], len(kept), grade, penalty)
    names = coded.dictionary.take(pa.array(kept[w != 0])).to_pylist()
    return OrdinalModel(dict(zip(names, w[w != 0].tolist(), strict=True)), thresholds)


def _score(batches, model: OrdinalModel, limit: float):
    for batch in slices(batches, most=1 << 20):
        over = model.exceed(texts(batch))
        toxic = over[:, 0]
        grade = (over > 0.5).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(over.sum(1)), pa.array(toxic), pa.array(grade, pa.int32()), pa.array(toxic >= limit)], ["doc_id", "expected_severity", "p_toxic", "grade", "rejected"])


def score_toxicity(docs: DataFrame, model: OrdinalModel, limit: float = 0.3) -> DataFrame:
    """One row per row of docs: expected grade, P(grade > 0), the median grade, and if P(grade > 0) reaches the limit."""
    return docs.select("doc_id", "text").mapInArrow(partial(_score, model=model, limit=limit), f"doc_id {id_type(docs)}, expected_severity double, p_toxic double, grade int, rejected boolean")


def _keep(batches, model: OrdinalModel, limit: float):
    for batch in slices(batches, most=1 << 20):
        yield batch.filter(pa.array(model.exceed(texts(batch))[:, 0] < limit))


def drop_toxic(docs: DataFrame, model: OrdinalModel, limit: float = 0.3) -> DataFrame:
    """The rows of docs, with all columns, that are not rejected."""
    return docs.mapInArrow(partial(_keep, model=model, limit=limit), docs.schema)


def label_grades(labels: DataFrame) -> DataFrame:
    """Severity grades from the labels table: 0 clean, 1 toxic, 2 toxic and of low quality besides."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
