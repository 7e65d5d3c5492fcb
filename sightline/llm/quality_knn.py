"""Quality by nearest-neighbour voting in a latent semantic space.

Features of a text are counts of hashed tokens: each word itself (A-Z as a-z), its shape (letters by case, digits,
other characters as they are, runs shortened), its last characters, its pair of shapes with the next word, its
length, and whether it repeats the two words before it. The counts are taken over the whole text, as shares, damped by a square root and weighed by
rarity in the sample. A truncated singular value decomposition of the labelled sample gives the latent space.

The labelled vectors and the projection go to all tasks; their size is bounded by SAMPLE x RANK and
BUCKETS x RANK numbers. Each task multiplies its documents with all labelled vectors in blocks: the cosine is
exact. The NEIGHBOURS nearest vote, weighted by a power of their similarity.

Fitting: at most SAMPLE labelled rows, those of the smallest hash of their id, so it doesn't depend on order.
Rows held out (crc32 of the id as text, modulo 3, is 1) are never used. Only the text is an input of a score.

Defined cases: a text without words has the zero vector and scores the sample's share of label 1, as does any
text while there are no labels at all (then 0.5); null text is empty; a very long text costs its own length; repeated
rows, and rows that tie in id, score each by its text, and a label counts for all documents of its id; a null id is
passed on and isn't held out; an empty table gives an empty result; other columns are ignored (or carried, by
`keep_good`), whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import U64, blocks, mix64, step, word_bounds, word_hashes

BUCKETS, RANK, SAMPLE, NEIGHBOURS, POWER = 2048, 48, 4096, 25, 8
#: Documents whose counts are held at a time, and documents in a block of the cosine product.
_DOCS, _BLOCK = 256, 512

# bytes to shape classes: lower a, upper A, digit 0, others themselves, non-ASCII as lower letters
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def _token_blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of a block of texts and their rows."""
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    whole = word_hashes(data, starts, ends, fold=True)
    # the shape: the word's characters by class, without repeats of the class
    cls = _SHAPE[data]
    changes = np.ones(len(cls), bool)
    changes[1:] = cls[1:] != cls[:-1]
    changes[starts] = True
    at = np.flatnonzero(changes)
    short = cls[at]
    place = np.zeros(len(data) + 1, np.int64)
    place[1:] = np.cumsum(changes)
    shape = word_hashes(short, place[starts], place[ends], fold=False)
    tail = word_hashes(data, np.maximum(starts, ends - 2), ends, fold=True)
    follows = rows[1:] == rows[:-1]
    pair = mix64(shape[:-1] * U64(3) + shape[1:])[follows]
    same = follows & (whole[1:] == whole[:-1])
    again = rows[2:][same[1:] & same[:-1]]  # twice by chance is no sign of anything
    length = np.minimum(ends - starts, 24).astype(U64)
    tokens = [whole + step(4), shape + step(1), tail + step(2), pair + step(3), length + step(5), np.full(len(again), step(20))]
    where = [rows, rows, rows, rows[1:][follows], rows, again]
    return mix64(np.concatenate([mix64(t) for t in tokens])), np.concatenate(where)


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, shares of the hashed tokens by row)."""
    for a, b, data, offsets in blocks(column, 1 << 20):
        for c in range(0, b - a, _DOCS):
            d = min(c + _DOCS, b - a)
            tokens, rows = _token_blocks(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])
            flat = rows * BUCKETS + (tokens % U64(BUCKETS)).astype(np.int64)
            found = np.bincount(flat, minlength=(d - c) * BUCKETS).reshape(d - c, BUCKETS).astype(np.float32)
            total = found.sum(axis=1, keepdims=True)
            np.divide(found, total, out=found, where=total > 0)
            yield a + c, a + d, np.sqrt(found, out=found)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


@dataclass(frozen=True)
class Model:
    """Weights of the buckets (BUCKETS), projection (BUCKETS x RANK), labelled unit vectors and their labels."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS
    power: float = POWER

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def scores(self, shares: np.ndarray) -> np.ndarray:
        out = np.full(len(shares), self.prior)
        if not len(self.labels):
            return out
        x = _unit((shares * self.weights) @ self.projection)
        for a in range(0, len(x), _BLOCK):
            own = x[a : a + _BLOCK]
            cosine = own @ self.vectors.T
            k = min(self.neighbours, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** self.power
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            known = total > 0
            out[a : a + _BLOCK][known] = vote[known] / total[known]
        return np.clip(out, 0.0, 1.0)


def fit(shares: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """The latent space and the labelled vectors of a sample."""
    n = len(labels)
    if not n:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0))
    weights = np.log((n + 1) / ((shares > 0).sum(axis=0) + 0.5)).astype(np.float32) + 0.3
    x = shares * weights
    values, vectors = np.linalg.eigh(x.T @ x)
    top = np.argsort(values)[::-1][:rank]
    projection = vectors[:, top].astype(np.float32)
    return Model(weights, projection, _unit(x @ projection), labels.astype(np.float64))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _shares_of_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for a, b, shares in counts(batch.column("text")):
            yield pa.record_batch(
                [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array([x.tobytes() for x in shares], pa.binary())],
                names=["doc_id", "label", "shares"],
            )


def _fitted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the one partition that holds the sample, as one row."""
    found = [row for batch in frames for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shares", "label")))]
    found.sort(key=lambda r: r[:2])
    shares = np.zeros((len(found), BUCKETS), np.float32)
    for k, (_, row, _) in enumerate(found):
        shares[k] = np.frombuffer(row, np.float32)
    labels = np.array([label for _, _, label in found])
    found.clear()
    yield pa.record_batch([pa.array([pickle.dumps(fit(shares, labels))], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows that aren't held out, fitted in a task: the driver gets the model alone."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .where(~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)  # the documented bound on what is fitted, and so on what is broadcast
    )
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = joined.mapInArrow(_shares_of_rows, "doc_id bigint, label double, shares binary")
    # ids may repeat among the documents: the bound holds for the rows too
    bounded = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "shares").limit(sample)
    found = bounded.mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(np.zeros((0, BUCKETS), np.float32), np.zeros(0))


def _scorer(shared):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.string(), from_pandas=True)
        out = np.zeros(len(column))
        for a, b, shares in counts(column):
            out[a:b] = shared.value.scores(shares)
        return pd.Series(out)

    return score


def score_column(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Column:
    """A column of scores over docs, from a model that is trained now."""
    model = train(docs, labels, id_col, text_col, label_col)
    return _scorer(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = score_column(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs without those that score under 0.5; all columns stay."""
    return docs.where(score_column(docs, labels, id_col, text_col, label_col) >= 0.5)


def op4_quality_knn(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
