"""Exact deduplication by content sort.

Rows are dealt by range over (leading code points of the text, its MD5 digest, id): Spark samples the
splitters from these bounded keys, so what reaches the driver does not grow with the texts' lengths. Texts that
differ in their first LEAD code points are thus in the order of their content; of those that share them the digest
decides which partition they go to, and the external sort goes on with the whole text, so equal texts stand side by
side, and neighbours are compared in full. The id is part of the range key, so the copies of one text, however many,
are spread over as many partitions as their number asks for; a run that crosses partitions is put together from the
texts at the partitions' edges, which are compared in full too: two texts a partition.

Defined cases: null text counts as empty; a very long text is sorted and compared whole; of rows with equal text and
equal id (repeated rows) one stays; a null id sorts before every other id; an empty table gives an empty result;
other columns are carried (`drop_copies`) or ignored (`copy_groups`) whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Code points of the text in the range key, and rows of closed runs that are passed on together.
LEAD, FLUSH = 32, 8192

_REPORT = (
    "doc_id bigint, text_sha256 string, part int, run bigint, run_size bigint, run_keep bigint, "
    "run_last boolean, edge_text string"
)


def _sorted(df: DataFrame, text: str, order_id: Column) -> DataFrame:
    """df with _lead, _hash, _id, in partitions by range and in order within them."""
    return (
        df.withColumns(
            {
                "_sl_lead": F.substring(F.col(text), 1, LEAD),
                "_sl_hash": F.md5(F.col(text).cast("binary")),
                "_sl_id": order_id,
            }
        )
        .repartitionByRange("_sl_lead", "_sl_hash", "_sl_id")
        .sortWithinPartitions("_sl_lead", "_sl_hash", text, "_sl_id")
    )


def _partition_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _same_as_previous(texts: pa.Array, last: str | None) -> np.ndarray:
    """For each text, whether it equals the one before it; last is the text before the first."""
    same = np.zeros(len(texts), bool)
    if len(texts) > 1:
        same[1:] = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
    same[0] = last is not None and texts[0].as_py() == last
    return same


def _report_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its run's number, size and last id; the first row of a partition's first and last run has the text.

    What is held of a run is its ids, eight bytes a row of one partition.
    """
    part, run, last = _partition_number(), 0, None
    ids: list[np.ndarray] = []  # of the open run
    nulls: list[np.ndarray] = []
    sha = ""
    closed: list[tuple] = []  # runs to be passed on: ids, nulls, digest, number, text if at an edge
    rows = 0

    def out() -> pa.RecordBatch:
        sizes = np.array([len(c[0]) for c in closed])
        of = np.repeat(np.arange(len(closed)), sizes)
        last_of, none = np.cumsum(sizes) - 1, np.concatenate([c[1] for c in closed])
        own = np.concatenate([c[0] for c in closed])
        ends = np.zeros(len(own), bool)
        ends[last_of] = True
        edge: list = [None] * len(own)
        for at, c in zip((last_of - sizes + 1).tolist(), closed):
            edge[at] = c[4]
        return pa.record_batch(
            [
                pa.array(own, pa.int64(), mask=none),
                pa.array([c[2] for c in closed], pa.string()).take(pa.array(of)),
                pa.array(np.full(len(own), part, np.int32)),
                pa.array(np.array([c[3] for c in closed], np.int64)[of]),
                pa.array(sizes.astype(np.int64)[of]),
                pa.array(own[last_of][of], pa.int64(), mask=none[last_of][of]),
                pa.array(ends),
                pa.array(edge, pa.string()),
            ],
            names=["doc_id", "text_sha256", "part", "run", "run_size", "run_keep", "run_last", "edge_text"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, doc = batch.column("text"), batch.column("doc_id")
        same = _same_as_previous(texts, last)
        values = doc.fill_null(0).to_numpy(zero_copy_only=False)
        none = doc.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same).tolist()
        bounds = ([0] if not starts or starts[0] else []) + starts + [batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if not same[a]:
                if ids:
                    last_text = texts[a - 1].as_py() if a else last
                    closed.append((np.concatenate(ids), np.concatenate(nulls), sha, run, last_text if run == 0 else None))
                    rows += len(closed[-1][0])
                    run += 1
                    if rows >= FLUSH:
                        yield out()
                        closed, rows = [], 0
                ids, nulls = [], []
                sha = hashlib.sha256(texts[a].as_py().encode()).hexdigest()
            ids.append(values[a:b])
            nulls.append(none[a:b])
        last = texts[batch.num_rows - 1].as_py()
    if ids:
        closed.append((np.concatenate(ids), np.concatenate(nulls), sha, run, last))
        yield out()


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group stays.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _sorted(slim, "text", F.col("doc_id")).select("doc_id", "text")
    runs = written(rows.mapInArrow(_report_runs, _REPORT), "runs")
    # runs at partitions' edges that go on: at most two rows a partition, a size bound that the texts don't change
    whole = runs.where("edge_text IS NOT NULL").groupBy("edge_text").agg(
        F.sum("run_size").alias("all_size"),
        F.max_by("run_keep", "part").alias("all_keep"),
        F.max("part").alias("last_part"),
        F.collect_list(F.struct("part", "run")).alias("pieces"),
    )
    edges = whole.where(F.size("pieces") > 1).select(F.explode("pieces").alias("p"), "all_size", "all_keep", "last_part").select("p.*", "all_size", "all_keep", "last_part")
    joined = runs.join(F.broadcast(edges), ["part", "run"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("run_last") & (F.col("last_part").isNull() | (F.col("part") == F.col("last_part")))).alias("kept"),
        "text_sha256",
    )


def _last_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each run; the first and last of them have the partition's first and last text."""
    part = _partition_number()
    held: pa.RecordBatch | None = None  # the last row so far, whose run may go on
    head = None

    def out(rows: pa.RecordBatch, first: bool, tail: bool) -> pa.RecordBatch:
        n = rows.num_rows
        marks = [
            pa.array(np.full(n, part, np.int32)),
            pa.array([None] * (n - 1) + [rows.column("_sl_text")[n - 1].as_py() if tail else None], pa.string()),
            pa.array([head if first else None] + [None] * (n - 1), pa.string()),
        ]
        keep = [c for c in rows.schema.names if c != "_sl_text"]
        return pa.record_batch([*(rows.column(c) for c in keep), *marks], names=[*keep, "_sl_part", "_sl_tail", "_sl_head"])

    emitted = False
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("_sl_text")
        if head is None:
            head = texts[0].as_py()
        same = _same_as_previous(texts, held.column("_sl_text")[0].as_py() if held is not None else None)
        ends = np.append(~same[1:], False)
        if held is not None and not same[0]:
            yield out(held, not emitted, False)
            emitted = True
        if ends.any():
            yield out(batch.filter(pa.array(ends)), not emitted, False)
            emitted = True
        held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield out(held, not emitted, True)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose text is that of a row with a larger id; all columns stay as they are."""
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    rows = _sorted(
        renamed.withColumn("_sl_text", F.coalesce(F.col(at[text_col]), F.lit(""))), "_sl_text", F.col(at[id_col])
    ).drop("_sl_lead", "_sl_hash", "_sl_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema)
    kept = written(
        rows.mapInArrow(_last_of_runs, schema + ", _sl_part int, _sl_tail string, _sl_head string"), "kept"
    )
    # one row a partition, its first and last text: which last texts does the next partition go on with
    edges = (
        kept.where("_sl_tail IS NOT NULL OR _sl_head IS NOT NULL")
        .groupBy("_sl_part")
        .agg(F.max("_sl_tail").alias("tail"), F.max("_sl_head").alias("head"))
        .withColumn("next", F.lead("head").over(Window.orderBy("_sl_part")))
    )
    goes_on = [r._sl_part for r in edges.where("tail = next").select("_sl_part").collect()]
    left = kept
    if goes_on:
        left = kept.where(~(F.col("_sl_tail").isNotNull() & F.col("_sl_part").isin(goes_on)))
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return copy_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP3 = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
