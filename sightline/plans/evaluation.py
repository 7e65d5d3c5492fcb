"""Folds, pairs and ROC figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import evaluation as E
from sightline.tables import table

from .neighbours import _PAIRS, vector_pairs
from .registry import query

_SPREAD = "((vec_id % 2147483648 + 42) % 2147483648 * 2654435761) % 4294967296"
_PLACED = f"placed AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY {_SPREAD}, vec_id) AS place FROM embeddings)"
_NEGATIVE = f"""neg AS (SELECT DISTINCT least(a.id, b.id) AS i, greatest(a.id, b.id) AS j
  FROM placed a JOIN placed b ON b.place = a.place + 7 AND a.label <> b.label)"""


@query("adjacent_pairs", "SELECT * FROM (SELECT vec_id AS i, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS j, label FROM embeddings) WHERE j IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    return E.adjacent_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "label")


@query("negative_pairs_hash", f"WITH {_PLACED}, {_NEGATIVE} SELECT i, j FROM neg")
def negative_pairs_hash(spark, sf_dir):
    return E.negative_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "label")


_FOLDS = f"SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {_SPREAD}, vec_id) - 1) % 5)::INT AS fold FROM embeddings"


@query("stratified_folds", _FOLDS)
def stratified_folds(spark, sf_dir):
    return E.stratified_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 5, "vec_id", "label")


@query("fold_training_rows", f"WITH f AS ({_FOLDS}) SELECT vec_id, label FROM f WHERE fold <> 2")
def fold_training_rows(spark, sf_dir):
    return E.train_of(stratified_folds(spark, sf_dir), 2, "vec_id").select("vec_id", "label")


_SCORED = _PAIRS.replace("WITH p AS", f"WITH {_PLACED}, {_NEGATIVE}, p AS") + """, s AS (
  SELECT round((1 - greatest(-1.0, least(1.0, ab / (na * nb)))) / 2, 4) AS distance, true AS same FROM q
  UNION ALL
  SELECT round((1 - greatest(-1.0, least(1.0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda x: x * x))))))) / 2, 4), false
  FROM neg JOIN embeddings a ON a.vec_id = neg.i JOIN embeddings b ON b.vec_id = neg.j
)
"""


def scored_pairs(spark, sf_dir):
    """distance, same: adjacent pairs of a label and as spread out pairs of different labels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_doubles(F.col("embedding")).alias("v"))
    neg = E.negative_pairs(e, "vec_id", "label")
    neg = neg.join(e.select(F.col("vec_id").alias("i"), F.col("v").alias("a")), "i").join(e.select(F.col("vec_id").alias("j"), F.col("v").alias("b")), "j")
    distance = F.round(V.cosine_half(F.col("a"), F.col("b")), 4).alias("distance")
    same = vector_pairs(spark, sf_dir).select(distance, F.lit(True).alias("same"))
    return same.unionByName(neg.select(distance, F.lit(False).alias("same")))


_CURVE = """, per AS (SELECT distance AS threshold, sum(same::INT)::BIGINT AS pos, sum((NOT same)::INT)::BIGINT AS neg FROM s GROUP BY 1),
run AS (SELECT *, sum(pos) OVER (ORDER BY threshold)::BIGINT AS tp, sum(neg) OVER (ORDER BY threshold)::BIGINT AS fp,
  sum(pos) OVER ()::BIGINT AS p, sum(neg) OVER ()::BIGINT AS n FROM per)
"""


@query("pair_stats", _SCORED + "SELECT sum(same::INT)::BIGINT AS n_same, sum((NOT same)::INT)::BIGINT AS n_different, round(avg(distance) FILTER (same), 6) AS mean_same, round(avg(distance) FILTER (NOT same), 6) AS mean_different FROM s")
def pair_stats(spark, sf_dir):
    return E.pair_stats(scored_pairs(spark, sf_dir), "distance", "same")


@query("roc_curve", _SCORED + _CURVE + "SELECT threshold, tp, fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM run")
def roc_curve(spark, sf_dir):
    c = E.roc_curve(scored_pairs(spark, sf_dir), "distance", "same")
    return c.select("threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


_SUMMARY = """, c AS (SELECT threshold, tp / p AS tpr, fp / n AS fpr, (tp - pos) / p AS tpr0, (fp - neg) / n AS fpr0 FROM run),
g AS (SELECT *, fpr - (1 - tpr) AS gap, fpr0 - (1 - tpr0) AS gap0, round(greatest(fpr, 1 - tpr), 9) AS worse FROM c)
SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS auc, round(min(fpr + 1 - tpr), 6) AS sum_error_min,
  round(min(CASE WHEN gap0 <= 0 AND gap >= 0 THEN fpr0 + CASE WHEN gap - gap0 > 0 THEN -gap0 / (gap - gap0) ELSE 0 END * (fpr - fpr0) END), 6) AS eer,
  round(1 - min(worse), 6) AS best_accuracy, round(arg_min(threshold, (worse, threshold)), 6) AS best_threshold
FROM g
"""


@query("roc_summary", _SCORED + _CURVE + _SUMMARY)
def roc_summary(spark, sf_dir):
    return E.roc_summary(scored_pairs(spark, sf_dir), "distance", "same")


@query(
    "roc_quality",
    "WITH s AS (SELECT -n_chars::DOUBLE AS distance, quality = 1 AS same FROM labels JOIN documents USING (doc_id))" + _CURVE + _SUMMARY,
)
def roc_quality(spark, sf_dir):
    """How well a document's length alone separates its quality label."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scored = joined.select((-F.col("n_chars").cast("double")).alias("distance"), (F.col("quality") == 1).alias("same"))
    return E.roc_summary(scored, "distance", "same")
