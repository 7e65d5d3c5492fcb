"""Vector distances and nearest-neighbour identification over `embeddings`.

Searches take as queries the rows whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import evaluation as E
from sightline.operators import neighbours as N
from sightline.operators.ordered import with_next
from sightline.tables import table

from .registry import query

EVERY = 20

_PAIRS = """
WITH p AS (
  SELECT vec_id AS i, lead(vec_id) OVER w AS j, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER w AS b
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)
), q AS (SELECT i, j, a, b, list_sum(list_transform(range(1, len(a) + 1), lambda k: a[k] * b[k])) AS ab,
  sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb FROM p WHERE j IS NOT NULL)
"""


def vector_pairs(spark, sf_dir: str):
    """i, j, a, b: each embedding with the next one of its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_doubles(F.col("embedding")).alias("v"))
    pairs = with_next(e, ["label"], "vec_id", ["vec_id", "v"]).where("next IS NOT NULL")
    return pairs.select(F.col("vec_id").alias("i"), F.col("next.vec_id").alias("j"), F.col("v").alias("a"), F.col("next.v").alias("b"))


@query("dist_cosine_half", _PAIRS + "SELECT i, j, round((1 - greatest(-1.0, least(1.0, ab / (na * nb)))) / 2, 6) AS distance FROM q")
def dist_cosine_half(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("i", "j", F.round(V.cosine_half(F.col("a"), F.col("b")), 6).alias("distance"))


@query("dist_cosine_full", _PAIRS + "SELECT i, j, round(1 - greatest(-1.0, least(1.0, ab / (na * nb))), 6) AS distance FROM q")
def dist_cosine_full(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("i", "j", F.round(V.cosine_full(F.col("a"), F.col("b")), 6).alias("distance"))


@query("dist_euclid", _PAIRS + "SELECT i, j, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) ** 2))), 6) AS distance FROM q")
def dist_euclid(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("i", "j", F.round(V.euclidean(F.col("a"), F.col("b")), 6).alias("distance"))


@query(
    "dist_chi2",
    _PAIRS
    + """SELECT i, j, round(0.5 * list_sum(list_transform(range(1, len(a) + 1), lambda k:
    CASE WHEN abs(a[k] ** 2 + b[k] ** 2) > 1e-12 THEN (a[k] ** 2 - b[k] ** 2) ** 2 / (a[k] ** 2 + b[k] ** 2) ELSE 0 END)), 6) AS distance FROM q""",
)
def dist_chi2(spark, sf_dir):
    """Over squared elements: unit vectors become histograms."""
    square = lambda c: F.transform(c, lambda x: x * x)
    return vector_pairs(spark, sf_dir).select("i", "j", F.round(V.chi_square(square(F.col("a")), square(F.col("b"))), 6).alias("distance"))


@query(
    "vector_algebra",
    _PAIRS
    + """SELECT i, j, round(ab, 6) AS dot, round(na, 6) AS norm_a,
    round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] + b[k]) ** 2))), 6) AS norm_sum,
    round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) ** 2))), 6) AS norm_difference,
    round(2.5 * list_sum(a), 6) AS scaled_sum, round(list_sum(list_transform(a, lambda x: x / na)), 6) AS unit_sum FROM q""",
)
def vector_algebra(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return vector_pairs(spark, sf_dir).select(
        "i",
        "j",
        F.round(V.dot(a, b), 6).alias("dot"),
        F.round(V.norm(a), 6).alias("norm_a"),
        F.round(V.norm(V.add(a, b)), 6).alias("norm_sum"),
        F.round(V.norm(V.subtract(a, b)), 6).alias("norm_difference"),
        F.round(total(V.scale(a, 2.5)), 6).alias("scaled_sum"),
        F.round(total(V.normalised(a)), 6).alias("unit_sum"),
    )


def _found(spark, sf_dir, k: int, metric: str = "cosine_half", squared: bool = False):
    e = table(spark, sf_dir, "embeddings")
    if squared:
        e = e.withColumn("embedding", F.transform(V.as_doubles(F.col("embedding")), lambda x: x * x))
    return N.nearest(e.where(F.col("vec_id") % EVERY == 0), e, k, metric)


def _ranked(distance: str, squared: bool = False) -> str:
    v = "list_transform(embedding::DOUBLE[], lambda x: x * x)" if squared else "embedding::DOUBLE[]"
    return f"""
WITH e AS (SELECT vec_id, label::INT AS label, {v} AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
d AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, g.vec_id AS gallery_id, g.label AS gallery_label,
         round({distance}, 6) + 0.0 AS distance
  FROM n q JOIN n g ON q.vec_id % {EVERY} = 0 AND q.vec_id <> g.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, gallery_id) AS rank FROM d),
two AS (SELECT query_id, query_label, max(CASE WHEN rank = 1 THEN gallery_label END) AS label,
  max(CASE WHEN rank = 1 THEN distance END) AS best, max(CASE WHEN rank = 2 THEN distance END) AS second
  FROM r WHERE rank <= 2 GROUP BY ALL)
"""


_HALF = _ranked("(1 - greatest(-1.0, least(1.0, list_dot_product(q.v, g.v) / (q.norm * g.norm)))) / 2")
_EUCLID = _ranked("sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda k: (q.v[k] - g.v[k]) ** 2)))")
_CHI2 = _ranked(
    "0.5 * list_sum(list_transform(range(1, len(q.v) + 1), lambda k: CASE WHEN abs(q.v[k] + g.v[k]) > 1e-12 THEN (q.v[k] - g.v[k]) ** 2 / (q.v[k] + g.v[k]) ELSE 0 END))",
    squared=True,
)
_CONFIDENCE = "CASE WHEN second > 0 THEN 1 - best / second ELSE 0 END"


@query("knn_top1", _HALF + f"SELECT query_id, query_label, label, best, second, round({_CONFIDENCE}, 6) AS confidence, best < 0.3 AS named FROM two")
def knn_top1(spark, sf_dir):
    """Eigenfaces' rule: nearest by half cosine, confidence from the two best distances."""
    return N.predict_nearest(_found(spark, sf_dir, 2), 0.3).withColumn("confidence", F.round("confidence", 6))


@query("knn_best_second", _HALF + "SELECT query_id, query_label, label, best, second FROM two")
def knn_best_second(spark, sf_dir):
    return N.predict_nearest(_found(spark, sf_dir, 2), 0.3).select("query_id", "query_label", "label", "best", "second")


@query(
    "knn_histogram",
    _CHI2 + f"SELECT query_id, query_label, label, best, second, round(greatest(0.0, least(1.0, {_CONFIDENCE})), 6) AS confidence, best < 50 AS named FROM two",
)
def knn_histogram(spark, sf_dir):
    """The histogram model's rule: nearest by chi-square, confidence clamped."""
    return N.predict_nearest(_found(spark, sf_dir, 2, "chi_square", squared=True), 50.0, clamp=True).withColumn("confidence", F.round("confidence", 6))


@query(
    "knn_mean_distance",
    _EUCLID
    + """, won AS (SELECT query_id, gallery_label AS label, distance AS best FROM r WHERE rank = 1)
SELECT query_id, query_label, label, best, round(avg(distance), 6) AS mean_distance,
       round(1 / (1 + avg(distance) / 100), 6) AS confidence, avg(distance) < 5000 AS named
FROM r JOIN won USING (query_id) WHERE gallery_label = label GROUP BY query_id, query_label, label, best""",
)
def knn_mean_distance(spark, sf_dir):
    """Fisherfaces' rule: the mean distance to all samples of the winning class decides."""
    e = table(spark, sf_dir, "embeddings")
    found = N.predict_mean_distance(e.where(F.col("vec_id") % EVERY == 0), e)
    return found.withColumn("mean_distance", F.round("mean_distance", 6)).withColumn("confidence", F.round("confidence", 6))


@query(
    "knn_vote",
    _HALF
    + """, v AS (SELECT query_id, query_label, gallery_label AS label, count(*) AS votes, sum(distance) AS total FROM r WHERE rank <= 5 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, round(total / votes, 6), label) AS place FROM v)
SELECT query_id, query_label, label, votes, round(votes / 5 / (1 + total / 100), 6) AS confidence FROM o WHERE place = 1""",
)
def knn_vote(spark, sf_dir):
    return N.vote(_found(spark, sf_dir, 5), 5).withColumn("confidence", F.round("confidence", 6))


@query(
    "knn_top5_hit",
    _HALF + "SELECT query_id, query_label, bool_or(rank = 1 AND gallery_label = query_label) AS top1, bool_or(gallery_label = query_label) AS topk FROM r WHERE rank <= 5 GROUP BY ALL",
)
def knn_top5_hit(spark, sf_dir):
    return N.top_hits(_found(spark, sf_dir, 5))


@query(
    "topk_accuracy",
    _HALF
    + """, h AS (SELECT query_id, query_label, bool_or(rank = 1 AND gallery_label = query_label) AS top1, bool_or(gallery_label = query_label) AS topk
FROM r WHERE rank <= 5 GROUP BY ALL)
SELECT query_label AS label, count(*) AS n, round(avg(top1::INT), 6) AS top1, round(avg(topk::INT), 6) AS top5_samples FROM h GROUP BY ALL""",
)
def topk_accuracy(spark, sf_dir):
    """Leave-one-out identification: per label, how often its nearest sample, or one of the five nearest, is of that label."""
    hits = N.top_hits(_found(spark, sf_dir, 5))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return hits.groupBy(F.col("query_label").alias("label")).agg(F.count("*").alias("n"), rate("top1").alias("top1"), rate("topk").alias("top5_samples"))


@query("confusion", _HALF + "SELECT query_label AS true_label, label AS pred_label, count(*) AS n FROM two GROUP BY ALL")
def confusion(spark, sf_dir):
    return E.confusion(N.predict_nearest(_found(spark, sf_dir, 2), 0.3), "query_label", "label")


@query("per_class_accuracy", _HALF + "SELECT query_label AS label, count(*) AS n, round(avg((label = query_label)::INT), 6) AS accuracy FROM two GROUP BY query_label")
def per_class_accuracy(spark, sf_dir):
    found = N.predict_nearest(_found(spark, sf_dir, 2), 0.3)
    return E.accuracy_by_class(found, "query_label", F.col("label") == F.col("query_label"))


@query(
    "worst_classes",
    _HALF + "SELECT query_label AS label, count(*) AS n, round(avg((label = query_label)::INT), 6) AS accuracy FROM two GROUP BY query_label ORDER BY accuracy, query_label LIMIT 3",
)
def worst_classes(spark, sf_dir):
    """Report section: the three classes of least accuracy."""
    return per_class_accuracy(spark, sf_dir).orderBy("accuracy", "label").limit(3)
