"""Evaluation, audits, latency and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import masks as M
from ..operators import splits
from ..sources import adapters as A
from .base import query
from .views import sql

_CELLS = "count(*) FILTER (p >= {t} AND y >= 0.5) AS tp, count(*) FILTER (p >= {t} AND y < 0.5) AS fp, count(*) FILTER (p < {t} AND y >= 0.5) AS fn, count(*) FILTER (p < {t} AND y < 0.5) AS tn".format
_DIV = "CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE)/({b}) ELSE 0.0 END".format
_P, _R = _DIV(a="tp", b="(tp+fp)"), _DIV(a="tp", b="(tp+fn)")
_RATES = ", ".join(f"round({v}, 6) AS {k}" for k, v in {"precision_": _P, "recall_": _R, "f1": f"CASE WHEN ({_P})+({_R}) > 0 THEN 2*({_P})*({_R})/(({_P})+({_R})) ELSE 0.0 END", "iou": _DIV(a="tp", b="(tp+fp+fn)"), "dice": _DIV(a="2*tp", b="(2*tp+fp+fn)"), "accuracy": "CAST(tp+tn AS DOUBLE)/greatest(tp+fp+fn+tn, 1)", "positive_rate": "CAST(tp+fn AS DOUBLE)/greatest(tp+fp+fn+tn, 1)"}.items())
_SWEEP = " UNION ALL ".join(f"SELECT {t:.2f}::DOUBLE AS threshold, {_CELLS(t=t)} FROM scored" for t in E.THRESHOLDS)


@query(sql(f"SELECT tp, fp, fn, tn, {_RATES} FROM c", "scored", c=f"SELECT {_CELLS(t=0.5)} FROM scored"))
def confusion_at_threshold(spark, sf_dir):
    return E.confusion(A.scored_items(spark, sf_dir))


@query(sql("SELECT count(*) AS items, round(avg(CASE WHEN 2*tp+fp+fn = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE*tp/(2*tp+fp+fn) END), 6) AS macro_dice FROM c", "scored", c=f"SELECT item, {_CELLS(t=0.5)} FROM scored GROUP BY item"))
def macro_dice(spark, sf_dir):
    return E.macro_dice(A.scored_items(spark, sf_dir))


@query(sql(f"SELECT threshold, tp, fp, fn, tn, {_RATES} FROM c", "scored", c=_SWEEP))
def threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(A.scored_items(spark, sf_dir))


@query(sql("SELECT threshold, f1, iou FROM r ORDER BY f1 DESC, iou DESC, threshold LIMIT 1", "scored", c=_SWEEP, r=f"SELECT threshold, {_RATES} FROM c"))
def best_threshold(spark, sf_dir):
    return E.best_threshold(E.threshold_sweep(A.scored_items(spark, sf_dir))).select("threshold", "f1", "iou")


@query(sql("SELECT group_name, tp, fp, fn, tn, CASE WHEN tp+fn > 0 THEN dice END AS dice, CASE WHEN tp+fn > 0 THEN iou END AS iou, round(CAST(fp AS DOUBLE)/greatest(fp+tn, 1), 6) AS false_positive_rate FROM r", "scored", c=f"SELECT CASE WHEN label = 'negative' THEN 'negative:' || coalesce(negative_kind, 'unknown') ELSE label END AS group_name, {_CELLS(t=0.5)} FROM scored GROUP BY 1", r=f"SELECT *, {_RATES} FROM c"))
def per_group_report(spark, sf_dir):
    return E.group_report(A.scored_items(spark, sf_dir))


@query(sql("SELECT label, negative_kind, CAST(grouping(label)*2 + grouping(negative_kind) AS BIGINT) AS level, count(*) AS n, round(avg(p), 6) AS mean_p FROM scored GROUP BY GROUPING SETS ((label), (negative_kind), ())", "scored"))
def dataset_audit(spark, sf_dir):
    return E.dataset_audit(A.scored_items(spark, sf_dir))


_SAMPLES = "SELECT event_type AS endpoint, round(value/20, 6) AS elapsed, event_id%17 <> 0 AS ok, event_id%5 <> 0 AS measured FROM events"


def _samples(spark, sf_dir):
    c = F.col
    return A.table(spark, sf_dir, "events").select(c("event_type").alias("endpoint"), F.round(c("value") / 20, 6).alias("elapsed"), (c("event_id") % 17 != 0).alias("ok"), (c("event_id") % 5 != 0).alias("measured"))


def _rank(q):
    return f"coalesce(took[CAST(least(len(took), greatest(1, round_even({q}/100.0::DOUBLE*len(took), 0))) AS INTEGER)], 0)"


@query(sql(f"SELECT endpoint, n, errors, {_rank(50)} AS p50, {_rank(95)} AS p95, {_rank(100)} AS max_elapsed, errors = 0 AND {_rank(95)} <= 2.0 AS passed FROM t", s=_SAMPLES, t="SELECT endpoint, count(*) AS n, count(*) FILTER (NOT ok) AS errors, list(elapsed ORDER BY elapsed) FILTER (measured) AS took FROM s GROUP BY endpoint"))
def nearest_rank_latency(spark, sf_dir):
    return E.latency_report(_samples(spark, sf_dir))


_RESULTS = "SELECT CASE doc_id%3 WHEN 0 THEN 'truck_smoking_' WHEN 1 THEN 'car_clean_' ELSE 'street_' END || doc_id AS filename, CASE WHEN doc_id%2 = 0 THEN 'image' ELSE 'video' END AS media_type, CASE WHEN doc_id%3 = 0 THEN doc_id%11 <> 0 ELSE doc_id%13 = 0 END AS found, round(0.2 + (doc_id%7)/10.0::DOUBLE, 6) AS elapsed, CAST(doc_id%50 AS INTEGER) AS frames FROM documents"


@query(sql("SELECT *, round(CASE WHEN clean > 0 THEN false_alarms::DOUBLE/clean ELSE 0.0 END, 6) AS false_alarm_rate, CASE WHEN clean > 0 THEN false_alarms::DOUBLE/clean ELSE 0.0 END <= 0.10 AND CASE WHEN media_type = 'image' THEN slowest < 10 ELSE fps >= 5 END AS passed FROM t", s=_RESULTS, t="SELECT media_type, count(*) FILTER (contains(filename, 'clean')) AS clean, count(*) FILTER (contains(filename, 'clean') AND found) AS false_alarms, count(*) FILTER (contains(filename, 'smok') AND found) AS caught, round(max(elapsed), 6) AS slowest, round(sum(frames)/sum(elapsed), 6) AS fps FROM s GROUP BY media_type"))
def selftest_verdict(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.when(k % 3 == 0, "truck_smoking_").when(k % 3 == 1, "car_clean_").otherwise("street_"), k)
    rows = A.table(spark, sf_dir, "documents").select(name.alias("filename"), F.when(k % 2 == 0, "image").otherwise("video").alias("media_type"), F.when(k % 3 == 0, k % 11 != 0).otherwise(k % 13 == 0).alias("found"), F.round(0.2 + (k % 7) / 10.0, 6).alias("elapsed"), (k % 50).cast("int").alias("frames"))
    return E.selftest(rows)


@query("SELECT vec_id, round(coalesce(list_avg(list_filter(embedding, lambda v: v >= 0.1::FLOAT)::DOUBLE[]), 0), 5) AS confidence FROM embeddings")
def mask_confidence(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(E.mask_confidence(F.col("embedding"), F.lit(0.1).cast("float")), 5).alias("confidence"))


@query("SELECT vec_id, count(*) FILTER (v >= 0.1::FLOAT) AS mask_pixels, round(coalesce(avg(v::DOUBLE) FILTER (v >= 0.1::FLOAT), 0), 5) AS mean_opacity, round(coalesce(count(*) FILTER (v >= 0.1::FLOAT AND (i%8 IN (0, 7) OR i//8 IN (0, 7)))::DOUBLE / nullif(count(*) FILTER (v >= 0.1::FLOAT), 0), 0), 6) AS edge_share FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY vec_id")
def mask_features(spark, sf_dir):
    """Pixels, opacity and border share of masks, with pixels as rows."""
    rows = A.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    inside = F.col("v") >= F.lit(0.1).cast("float")
    border = (F.col("i") % 8).isin(0, 7) | F.floor(F.col("i") / 8).isin(0, 7)
    n = F.count_if(inside)
    return rows.groupBy("vec_id").agg(n.alias("mask_pixels"), F.round(F.coalesce(F.avg(F.when(inside, F.col("v").cast("double"))), F.lit(0.0)), 5).alias("mean_opacity"), F.round(F.coalesce(F.count_if(inside & border) / F.when(n > 0, n), F.lit(0.0)), 6).alias("edge_share"))


@query()
def largest_component(spark, sf_dir):
    return E.component_features(A.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 0.05)


_SPLIT = "SELECT r.*, coalesce(place <= greatest(1, round_even(0.2::DOUBLE*n, 0)), false) AS validation, NOT coalesce(place <= greatest(1, round_even(0.2::DOUBLE*n, 0)), false) OR n = 1 AS training FROM r LEFT JOIN (SELECT {key}, row_number() OVER (ORDER BY md5({key} || ':7')) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM r WHERE {key} IS NOT NULL)) USING ({key})".format


@query(sql(_SPLIT(key="doc_id"), r="SELECT doc_id, lang FROM documents"))
def split_disjoint(spark, sf_dir):
    return splits.split_disjoint(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query(sql(_SPLIT(key="conv_id"), r="SELECT conv_id, turn FROM conversations"))
def split_disjoint_groups(spark, sf_dir):
    """A split of conversations: no turn of a conversation is in another part than the rest."""
    return splits.split_disjoint(A.table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id")


@query()
def plume_features(spark, sf_dir):
    """Features of masks over grey images; every second mask has half the image's side."""
    rows = A.table(spark, sf_dir, "embeddings")
    level = lambda c, low, by: F.transform(c, lambda v: low + by * v.cast("double"))
    half = F.col("vec_id") % 2 == 1
    mask = level(F.when(half, F.slice("embedding", 1, 16)).otherwise(F.col("embedding")), 0.5, 2.0)
    return M.plume_features(rows, "vec_id", mask, F.when(half, 4).otherwise(8), level(F.col("embedding"), 128.0, 600.0), F.lit(8))


_SAMPLES_SQL = "SELECT vec_id, CASE WHEN vec_id%5 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN label%3 = 0 THEN 'negative' ELSE 'positive' END AS label, CASE WHEN label%2 = 0 THEN 'shadow' END AS negative_kind, 'photo' || vec_id%4 AS source, CASE WHEN label < 8 THEN (['white', 'grey', 'black'])[label%3 + 1] END AS smoke_colour, round((vec_id%50)/100.0::DOUBLE, 6) AS coverage, vec_id%6 = 0 AS on_cast_shadow, embedding FROM embeddings"
_PIXELS_SQL = "SELECT vec_id, count(*) FILTER (m AND g < 80) AS dark_smoke, count(*) FILTER (NOT m AND g < 80) AS dark_ground, count(*) FILTER (m) AS smoke, count(*) AS pixels, avg(g) FILTER (m) AS mean_in, avg(g) FILTER (NOT m) AS mean_out FROM (SELECT vec_id, CAST(floor(least(255, greatest(0, 90 + 600*v::DOUBLE))) AS BIGINT) AS g, v < -0.02::FLOAT AS m FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings)) GROUP BY vec_id"


def _dataset(spark, sf_dir):
    k, label = F.col("vec_id"), F.col("label")
    return A.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(k % 5 == 0, "val").otherwise("train").alias("split"),
        F.when(label % 3 == 0, "negative").otherwise("positive").alias("label"),
        F.when(label % 2 == 0, "shadow").alias("negative_kind"),
        F.concat(F.lit("photo"), k % 4).alias("source"),
        F.when(label < 8, F.element_at(F.array(*map(F.lit, ("white", "grey", "black"))), (label % 3 + 1).cast("int"))).alias("smoke_colour"),
        F.round(k % 50 / 100.0, 6).alias("coverage"),
        (k % 6 == 0).alias("on_cast_shadow"),
        F.transform("embedding", lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 90 + 600 * v.cast("double"))))).alias("image"),
        F.transform("embedding", lambda v: v < F.lit(-0.02).cast("float")).alias("inside"),
    )


@query(
    sql(
        "SELECT coalesce(split, 'all') AS split, n, positive, negative, mean_positive_coverage, positives_on_cast_shadow, round(base, 6) AS p_smoke, round(given, 6) AS p_smoke_given_dark, round(given/greatest(base, 1e-9), 4) AS lift, shadowlike_positives, round(shadowlike_positives::DOUBLE/greatest(positive, 1), 4) AS shadowlike_positive_fraction, round(dg::DOUBLE/greatest(ds, 1), 3) AS dark_background_px_per_dark_smoke_px FROM t",
        s=_SAMPLES_SQL,
        p=_PIXELS_SQL,
        t="SELECT split, count(*) AS n, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label <> 'positive') AS negative, round(avg(coverage) FILTER (label = 'positive'), 5) AS mean_positive_coverage, count(*) FILTER (label = 'positive' AND on_cast_shadow) AS positives_on_cast_shadow, count(*) FILTER (label = 'positive' AND mean_in < 80 AND mean_in - mean_out < -25) AS shadowlike_positives, CAST(sum(dark_smoke) AS BIGINT) AS ds, CAST(sum(dark_ground) AS BIGINT) AS dg, sum(smoke)::DOUBLE/greatest(sum(pixels), 1) AS base, sum(dark_smoke)::DOUBLE/greatest(sum(dark_smoke) + sum(dark_ground), 1) AS given FROM s JOIN p USING (vec_id) GROUP BY GROUPING SETS ((split), ())",
    )
)
def dataset_balance(spark, sf_dir):
    return M.dataset_balance(_dataset(spark, sf_dir))


@query(sql("SELECT split, 'source' AS dimension, source AS value, count(*) AS n FROM s GROUP BY 1, 3 UNION ALL SELECT split, 'negative_kind', coalesce(negative_kind, '?') AS k, count(*) FROM s WHERE label <> 'positive' GROUP BY 1, 3 UNION ALL SELECT split, 'smoke_colour', coalesce(smoke_colour, '?') AS k, count(*) FROM s WHERE label = 'positive' GROUP BY 1, 3", s=_SAMPLES_SQL))
def dataset_groups(spark, sf_dir):
    return M.dataset_groups(_dataset(spark, sf_dir))


@query(sql("SELECT analysis_id, CASE max(r) WHEN 2 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END AS dominant FROM (SELECT analysis_id, CASE WHEN intensity < 0.33 THEN 0 WHEN intensity < 0.66 THEN 1 ELSE 2 END AS r FROM regions) GROUP BY analysis_id", "regions"))
def dominant_severity(spark, sf_dir):
    from ..functions.severity import classify

    return E.dominant_severity(A.regions(spark, sf_dir).withColumn("severity", classify(F.col("intensity"))), ["analysis_id"])


@query(sql("SELECT s.doc_id, coalesce(d.lang, 'unknown') AS lang, p FROM scored s LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'fr') d USING (doc_id)", "scored"))
def sample_index_default(spark, sf_dir):
    """Samples joined with an index that lacks some of them."""
    index = A.table(spark, sf_dir, "documents").where("lang <> 'fr'").select("doc_id", "lang")
    return A.scored_items(spark, sf_dir).join(index, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), "p")
