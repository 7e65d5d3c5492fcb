"""Connected components of an edge table: union-find within the tasks, then star rounds, each a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.scratch import removed, written_at


def _forest(keys: list[str]):
    """Edges (keys, a < b) to the edges of a forest of stars that joins the same nodes, batch by batch."""

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            a, b = (pdf[[*keys, c]].set_axis([*keys, "node"], axis=1) for c in "ab")
            # nodes in order within their keys, so that the smallest number is the smallest node
            names = pd.concat([a, b], ignore_index=True).drop_duplicates().sort_values([*keys, "node"], ignore_index=True)
            number = pd.MultiIndex.from_frame(names) if keys else pd.Index(names["node"])
            x, y = (number.get_indexer(pd.MultiIndex.from_frame(e) if keys else e["node"]) for e in (a, b))
            parent = list(range(len(names)))
            for p, q in zip(x.tolist(), y.tolist()):
                while parent[p] != p:
                    parent[p] = p = parent[parent[p]]
                while parent[q] != q:
                    parent[q] = q = parent[parent[q]]
                if p < q:
                    parent[q] = p
                else:
                    parent[p] = q
            for k in range(len(parent)):  # parents are smaller, so one pass flattens
                parent[k] = parent[parent[k]]
            root = np.array(parent)
            inner = np.flatnonzero(root != np.arange(len(root)))
            out = names.iloc[inner][keys].reset_index(drop=True)
            out["a"] = names["node"].to_numpy()[root[inner]]
            out["b"] = names["node"].to_numpy()[inner]
            yield out

    return forest


def components(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, node, root: the smallest node that each node of an edge reaches within its keys (which may be none).

    Tasks join what they can by union-find, a batch at a time; with keys, the edges of one key meet in a task for this,
    so that mostly nothing is left to do. Then each round moves a node's larger neighbours to the smallest it sees, then
    a node and its smaller neighbours to the smallest of them, until every node stands under its root. Neighbours are
    aggregated, not gathered. A round's tables are deleted when the next is done.
    """
    k, spark = keys, edges.sparkSession
    slim = edges.where(f"{a} <> {b}").select(*k, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    dealt = slim.repartition(*k) if k else slim
    now, now_path = written_at(dealt.mapInPandas(_forest(k), slim.schema).distinct())
    while True:
        both = now.unionByName(now.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*k, "a").agg(F.min("b").alias("low")).select(*k, "a", F.least("a", "low").alias("low"))
        large, large_path = written_at(both.join(low, [*k, "a"]).where("b > a").select(*k, F.col("low").alias("a"), "b").distinct())
        low = large.groupBy(*k, "b").agg(F.min("a").alias("low"))
        small = large.join(low, [*k, "b"])
        moved = small.select(*k, F.col("low").alias("a0"), F.col("a").alias("b")).unionByName(small.select(*k, F.col("low").alias("a0"), "b"))
        after, after_path = written_at(moved.withColumnRenamed("a0", "a").where("a <> b").distinct())
        # done when no node stands under two others, and none under another has nodes of its own
        ends = after.select(*k, F.col("b").alias("n"), F.lit(1).alias("under"), F.lit(0).alias("over")).unionByName(
            after.select(*k, F.col("a").alias("n"), F.lit(0).alias("under"), F.lit(1).alias("over"))
        )
        per = ends.groupBy(*k, "n").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
        more = per.where("under > 1 OR (under > 0 AND over > 0)").limit(1).count()
        for path in (now_path, large_path):
            removed(spark, path)
        now, now_path = after, after_path
        if not more:
            break
    roots = now.select(*k, "a").distinct().select(*k, F.col("a").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(*k, F.col("b").alias("node"), F.col("a").alias("root")))
