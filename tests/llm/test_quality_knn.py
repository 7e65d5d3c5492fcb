"""Quality classifier: held-out accuracy, the vote against brute force, and awkward rows."""

import itertools
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("sightline.llm")

from sightline.llm import quality_knn as q  # noqa: E402
from sightline.llm import textblocks as tb  # noqa: E402

SF = "/root/testdata/sf0.01"


def area_under_curve(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = q.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    score, label = np.array([r.score for r in held]), np.array([r.quality for r in held])
    assert area_under_curve(score, label) > 0.98
    assert ((score >= 0.5) == (label == 1)).mean() > 0.97
    kept = {r.doc_id for r in q.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in got.collect() if r.predicted}


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a = {r.doc_id: r.score for r in q.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in q.classify(docs, turned.repartition(5)).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    """The sample's counts are 8 KB a row: they are gathered and decomposed in a task."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taken, collect = [], type(docs).collect

    def spy(self):
        rows = collect(self)
        taken.extend(len(pickle.dumps(tuple(r))) for r in rows)
        return rows

    monkeypatch.setattr(type(docs), "collect", spy)
    model = q.train(docs, labels, "doc_id", "text", "quality")
    assert len(model.labels) > 150 and 0 < sum(taken) < model.projection.nbytes + model.vectors.nbytes + model.weights.nbytes + model.labels.nbytes + 2000
    none = q.train(docs, labels.limit(0), "doc_id", "text", "quality")
    assert len(none.labels) == 0 and none.prior == 0.5


def test_vote_is_exact():
    rng = np.random.default_rng(4)
    vectors = q._unit(rng.normal(size=(90, 6)).astype(np.float32))
    labels = rng.integers(0, 2, 90).astype(float)
    model = q.Model(np.ones(6, np.float32), np.eye(6, dtype=np.float32), vectors, labels, neighbours=7, power=3)
    x = rng.normal(size=(1200, 6)).astype(np.float32)
    x[5] = 0
    got = model.scores(x)
    for k in (0, 5, 600, 1199):
        if k == 5:
            assert got[k] == model.prior
            continue
        cosine = vectors @ (x[k] / np.linalg.norm(x[k]))
        near = np.argsort(-cosine)[:7]
        weight = np.clip(cosine[near], 0, 1) ** 3
        assert got[k] == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-5)


_MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def hashed(word, fold):
    table = tb._FOLDED if fold else tb._BYTE
    raw = sum(int(table[b]) * pow(tb._ODD, i, 1 << 64) for i, b in enumerate(word))
    return mixed((raw + len(word) * 0x9E3779B97F4A7C15) & _MASK)


def kind(b):
    return "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)


def brute_shares(text, memo):
    """The tokens of a text word by word."""
    found = np.zeros(q.BUCKETS)
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    seen = []
    for w in words:
        if w not in memo:
            shape = "".join(k for k, _ in itertools.groupby(map(kind, w))).encode()
            memo[w] = (hashed(w, True), hashed(shape, False), hashed(w[-2:], True))
        seen.append(memo[w])
    step = lambda k: int(tb.step(k))
    for i, (w, (whole, shape, tail)) in enumerate(zip(words, seen)):
        tokens = [whole + step(4), shape + step(1), tail + step(2), min(len(w), 24) + step(5)]
        if i:
            tokens.append(mixed((seen[i - 1][1] * 3 + shape) & _MASK) + step(3))
        if i > 1 and whole == seen[i - 1][0] == seen[i - 2][0]:
            tokens.append(step(20))
        for t in tokens:
            found[mixed(mixed(t & _MASK)) % q.BUCKETS] += 1
    return np.sqrt(found / max(1, found.sum()))


def test_classify_by_brute_force(spark):
    """Every score of the whole table: tokens word by word, the space by a full decomposition, the vote by sorting."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    texts, label = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    memo = {}
    shares = {i: brute_shares(t, memo) for i, t in texts.items()}
    sample = [i for i in sorted(label) if zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.stack([shares[i] for i in sample])
    weights = np.log((len(sample) + 1) / ((x > 0).sum(axis=0) + 0.5)) + 0.3
    space = np.linalg.svd(x * weights, full_matrices=False)[2][: q.RANK].T
    near_to = np.stack([v / np.linalg.norm(v) for v in (x * weights) @ space])
    y = np.array([label[i] for i in sample])
    assert got.keys() == texts.keys()
    for i, s in shares.items():
        own = (s * weights) @ space
        if not np.linalg.norm(own) > 1e-9:
            assert got[i].score == pytest.approx(y.mean())
            continue
        cosine = near_to @ (own / np.linalg.norm(own))
        near = np.argsort(-cosine)[: q.NEIGHBOURS]
        weight = np.clip(cosine[near], 0, 1) ** q.POWER
        assert got[i].score == pytest.approx((weight * y[near]).sum() / weight.sum(), abs=0.01), i


def test_counts_do_not_depend_on_the_block():
    texts = ["The cat sat. The cat", None, "", "x", "ÉÈ!! 12-34 %%%", "a a a a b"] * 5
    whole = np.concatenate([x for _, _, x in q.counts(pa.array(texts))])
    alone = np.concatenate([x for t in texts for _, _, x in q.counts(pa.array([t], pa.string()))])
    assert np.array_equal(whole, alone)


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some words here", "y"), (3, "word " * 40000, "z"), (3, "word " * 40000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(3, 0), (None, 1)], "doc_id bigint, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert q.classify(docs, labels.limit(0)).where("score = 0.5").count() == 5
    assert q.classify(docs.limit(0), labels).count() == 0
    assert q.keep_good(docs, labels).columns == docs.columns
