"""Nearest-neighbour search in blocks, and the classification rules that read its result.

Queries and gallery are packed into blocks of rows as matrices; each pair of blocks is one matrix product in a
task, which passes on the `k` nearest of the block per query, and a window keeps the `k` nearest of all. Memory
per task is two blocks and their distances, whatever the size of the gallery; Spark broadcasts a side's blocks only
under its own size limit.

Ties go to the smaller id, on distances rounded to `places`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.vectors import matrix_distance
from sightline.scratch import written

BLOCK = 1024


def blocks(df: DataFrame, id_col: str, vec_col: str, label_col: str, prefix: str, size: int) -> DataFrame:
    """One row per up to `size` rows of a partition: ids, labels and the vectors end to end."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), size):
                own = pdf.iloc[a : a + size]
                flat = np.stack([np.asarray(v, np.float64) for v in own["v"]])
                yield pd.DataFrame({"ids": [own["id"].tolist()], "labels": [own["label"].tolist()], "flat": [flat.tobytes()], "width": [flat.shape[1]]})

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vec_col).alias("v"))
    slim = slim.where(F.col("v").isNotNull() & (F.size("v") > 0))
    packed = slim.mapInPandas(pack, "ids array<bigint>, labels array<int>, flat binary, width int")
    return packed.select(*(F.col(c).alias(prefix + c) for c in packed.columns))


def nearest(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    metric: str = "cosine_half",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    leave_out_self: bool = True,
    places: int = 6,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, query_label, rank (from 1), gallery_id, gallery_label, distance. Widths of the vectors must agree."""
    # written: a block is read once per block of the other side, and its true size decides how they meet
    q = written(blocks(queries, id_col, vec_col, label_col, "q_", block), "queries")
    g = written(blocks(gallery, id_col, vec_col, label_col, "g_", block), "gallery")
    return _nearest_blocks(q, g, k, metric, leave_out_self, places)


def _block_distances(row, metric: str, leave_out_self: bool, places: int) -> np.ndarray:
    """Rounded distances of a row's two blocks; infinite between a row and itself if it is left out."""
    a = np.frombuffer(row.q_flat).reshape(-1, row.q_width)
    b = np.frombuffer(row.g_flat).reshape(-1, row.g_width)
    width = min(row.q_width, row.g_width)
    # adding zero turns a negative zero into the positive one
    d = np.floor(matrix_distance(metric, a[:, :width], b[:, :width]) * 10**places + 0.5) / 10**places + 0.0
    if leave_out_self:
        d[np.asarray(row.q_ids)[:, None] == np.asarray(row.g_ids)[None, :]] = np.inf
    return d


def _nearest_blocks(q: DataFrame, g: DataFrame, k: int, metric: str, leave_out_self: bool, places: int) -> DataFrame:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                d = _block_distances(row, metric, leave_out_self, places)
                q_ids, g_ids = np.asarray(row.q_ids), np.asarray(row.g_ids)
                order = np.lexsort((np.broadcast_to(g_ids, d.shape), d), axis=1)[:, :k]
                best = np.take_along_axis(d, order, axis=1)
                real = np.isfinite(best)
                who = np.nonzero(real)[0]
                found = order[real]
                yield pd.DataFrame(
                    {
                        "query_id": q_ids[who],
                        "query_label": np.asarray(row.q_labels)[who],
                        "gallery_id": g_ids[found],
                        "gallery_label": np.asarray(row.g_labels)[found],
                        "distance": best[real],
                    }
                )

    # blocks against blocks: rows are matrices, so this is the block loop of a matrix product
    pairs = g.crossJoin(q)
    some = pairs.mapInPandas(search, "query_id bigint, query_label int, gallery_id bigint, gallery_label int, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "gallery_id")
    ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "query_label", "rank", "gallery_id", "gallery_label", "distance")


def _two_best(found: DataFrame) -> DataFrame:
    """Per query: best and second distance, and the best's label."""
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    return found.groupBy("query_id", "query_label").agg(
        first("gallery_label").alias("label"),
        first("gallery_id").alias("gallery_id"),
        first("distance").alias("best"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"),
    )


def predict_nearest(found: DataFrame, threshold: float, clamp: bool = False) -> DataFrame:
    """Nearest label; confidence 1 - best / second (0 where there is no second); named if best < threshold.

    Eigenfaces and, with clamp, LBPH.
    """
    two = _two_best(found)
    confidence = F.when(F.coalesce(F.col("second"), F.lit(0.0)) > 0, 1 - F.col("best") / F.col("second")).otherwise(0.0)
    if clamp:
        confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return two.select("query_id", "query_label", "label", "best", "second", confidence.alias("confidence"), (F.col("best") < threshold).alias("named"))


def predict_mean_distance(
    queries: DataFrame,
    gallery: DataFrame,
    threshold: float = 5000.0,
    metric: str = "euclidean",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    leave_out_self: bool = True,
    places: int = 6,
    block: int = BLOCK,
) -> DataFrame:
    """Fisherfaces: nearest label; the mean distance to all gallery samples of the winning class decides confidence and name.

    A second pass over the blocks, with each query's winning label, passes on one sum and count per query and block.
    """
    q = written(blocks(queries, id_col, vec_col, label_col, "q_", block), "queries")
    g = written(blocks(gallery, id_col, vec_col, label_col, "g_", block), "gallery")
    first = _nearest_blocks(q, g, 1, metric, leave_out_self, places)
    won = written(first.select("query_id", "query_label", F.col("gallery_label").alias("label"), F.col("distance").alias("best")), "won")
    slim = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vec_col).alias("v")).join(won.select("query_id", "label"), "query_id")
    asked = written(blocks(slim, "query_id", "v", "label", "q_", block), "asked")

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                d = _block_distances(row, metric, leave_out_self, places)
                own = (np.asarray(row.q_labels)[:, None] == np.asarray(row.g_labels)[None, :]) & np.isfinite(d)
                some = own.any(axis=1)
                yield pd.DataFrame({"query_id": np.asarray(row.q_ids)[some], "total": np.where(own, d, 0.0).sum(axis=1)[some], "n": own.sum(axis=1)[some]})

    sums = g.crossJoin(asked).mapInPandas(add, "query_id bigint, total double, n bigint")
    mean = sums.groupBy("query_id").agg((F.sum("total") / F.sum("n")).alias("mean_distance"))
    got = won.join(mean, "query_id").select("query_id", "query_label", "label", "best", "mean_distance")
    return got.withColumn("confidence", 1 / (1 + F.col("mean_distance") / 100)).withColumn("named", F.col("mean_distance") < threshold)


def vote(found: DataFrame, k: int) -> DataFrame:
    """k-NN vote: most votes, then the smaller mean distance, then the smaller label."""
    per_label = found.where(F.col("rank") <= k).groupBy("query_id", "query_label", "gallery_label").agg(
        F.count("*").alias("votes"), F.sum("distance").alias("total")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), F.round(F.col("total") / F.col("votes"), 6), "gallery_label")
    best = per_label.withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.select(
        "query_id", "query_label", F.col("gallery_label").alias("label"), "votes",
        (F.col("votes") / k / (1 + F.col("total") / 100)).alias("confidence"),
    )


def top_hits(found: DataFrame, k: int = 5) -> DataFrame:
    """Whether the true label is the nearest sample's, and whether it is among the k nearest samples'."""
    return found.where(F.col("rank") <= k).groupBy("query_id", "query_label").agg(
        F.bool_or((F.col("rank") == 1) & (F.col("gallery_label") == F.col("query_label"))).alias("top1"),
        F.bool_or(F.col("gallery_label") == F.col("query_label")).alias("topk"),
    )
