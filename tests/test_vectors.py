"""Distances: columns against numpy, and the edge cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import evaluation as E
from sightline.operators import neighbours as N
from sightline.operators import ordered as O

PAIRS = [
    ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0, 3.0], [1.0, 2.0]),
    ([0.2, 0.3, 0.5], [0.5, 0.5, 0.0]), ([0.0, 0.0, 1.0], [0.0, 0.0, 1.0]), ([1e-14], [1.0]),
]


def test_edges(spark):
    df = spark.createDataFrame(PAIRS, "a array<double>, b array<double>")
    rows = df.select("a", "b", *(f(F.col("a"), F.col("b")).alias(n) for n, f in V.COLUMNS.items())).collect()
    for r in rows:
        n = min(len(r.a), len(r.b))
        a, b = np.array([r.a[:n]]), np.array([r.b[:n]])
        for name in ("cosine_half", "euclidean", "chi_square"):
            assert r[name] == pytest.approx(V.matrix_distance(name, a, b)[0, 0]), (name, r)
    by = {(tuple(r.a), tuple(r.b)): r for r in rows}
    assert by[((1.0, 0.0), (-1.0, 0.0))].cosine_half == 1 and by[((1.0, 0.0), (-1.0, 0.0))].cosine_full == 2
    assert by[((0.0, 0.0), (1.0, 2.0))].cosine_half == 1 and by[((0.0, 0.0), (1.0, 2.0))].cosine_full == 1
    assert math.isinf(by[((1.0, 2.0, 3.0), (1.0, 2.0))].cosine_full) and by[((1.0, 2.0, 3.0), (1.0, 2.0))].euclidean == 0


def test_blocks_do_not_change_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 5)).round(1)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(3)
    for metric in ("cosine_half", "euclidean"):
        d = np.round(V.matrix_distance(metric, x, x), 6)
        np.fill_diagonal(d, np.inf)
        for block in (7, 1000):
            got = N.nearest(df, df, 4, metric, block=block).collect()
            by = {(r.query_id, r["rank"]): r.gallery_id for r in got}
            for i in range(70):
                want = sorted(range(70), key=lambda j: (d[i, j], j))[:4]
                assert [by[(i, k)] for k in (1, 2, 3, 4)] == want


def test_mean_distance_takes_the_whole_winning_class(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(2)
    labels = np.arange(300) % 3  # 100 samples a class, more than any list of nearest ones held
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "vec_id bigint, embedding array<double>, label int").repartition(3)
    d = np.round(V.matrix_distance("euclidean", x, x), 6)
    np.fill_diagonal(d, np.inf)
    for block in (64, 1000):
        got = N.predict_mean_distance(df.where("vec_id % 20 = 0"), df, threshold=2.5, block=block).collect()
        assert sorted(r.query_id for r in got) == list(range(0, 300, 20))
        for r in got:
            i = r.query_id
            label = labels[min(range(300), key=lambda j: (d[i, j], j))]
            own = d[i][(labels == label) & np.isfinite(d[i])]
            assert len(own) in (99, 100) and r.label == label and r.query_label == labels[i] and r.best == pytest.approx(d[i].min())
            assert r.mean_distance == pytest.approx(own.mean()) and r.named == (own.mean() < 2.5)
            assert r.confidence == pytest.approx(1 / (1 + own.mean() / 100))


def test_recognizer_averages_the_whole_winning_class(spark):
    from sightline.operators import models as M

    x = np.random.default_rng(3).normal(size=(240, 3)).round(2)
    rows = [(i, i % 2, f"n{i % 2}", v.tolist()) for i, v in enumerate(x)]
    gallery = spark.createDataFrame(rows, "sample_id bigint, label int, name string, vec array<double>")
    got = M.Recognizer("fisherfaces", None, gallery, 5000.0).predict(gallery.where("sample_id < 5")).collect()
    d = V.matrix_distance("euclidean", x, x)
    assert len(got) == 5
    for r in got:
        mean = d[r.query_id][np.arange(240) % 2 == r.label].mean()
        assert r.label == r.query_id % 2 and r.name == f"n{r.label}" and r.confidence == pytest.approx(1 / (1 + mean / 100))


def test_folds_and_shuffle():
    folds = E.folds_of([0] * 4 + [1] * 4 + [2] * 4, 4, 42)
    assert [len(f) for f in folds] == [3] * 4 and sorted(sum(folds, [])) == list(range(12))
    assert all({i // 4 for i in f} == {0, 1, 2} for f in folds)
    shuffled = E.XorShift(1).shuffle(list(range(100)))
    assert sorted(shuffled) == list(range(100)) and shuffled != list(range(100))
    assert E.XorShift(0).next() == E.XorShift(0x9E3779B97F4A7C15).next()



def test_two_level_windows(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), int(rng.integers(0, 3)), f"n{rng.integers(0, 10**9)}") for k in rng.permutation(500) * 3 - 700]
    df = spark.createDataFrame(rows, "at bigint, key int, name string").repartition(4)
    order = sorted(rows)
    for width in (1, 50, 1 << 20):
        prev = {r.at: r.previous and r.previous.at for r in O.with_previous(df, ["key"], "at", ["at"], width=width).collect()}
        nxt = {r.at: r.next and r.next.at for r in O.with_next(df, ["key"], "at", ["at"], width=width).collect()}
        number = {r.at: r.n for r in O.numbered(df, ["key"], ["at"], "n", width).collect()}
        for key in range(3):
            own = [r[0] for r in order if r[1] == key]
            assert [prev[a] for a in own] == [None, *own[:-1]] and [nxt[a] for a in own] == [*own[1:], None]
            assert [number[a] for a in own] == list(range(1, len(own) + 1))
    sums = {r.at: r.s for r in O.running_sums(df, "at", {"s": "key"}, ranges=7).collect()}
    assert [sums[r[0]] for r in order] == np.cumsum([r[1] for r in order]).tolist()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = {r.name: r.n for r in O.numbered_whole(df, ["name"], "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [whole[n] for n in sorted(r[2] for r in rows)] == list(range(1, 501))


CASES = {
    "perfect": ([(0.1, True), (0.2, True), (0.3, True), (0.9, False), (1.0, False), (1.1, False)], (1.0, 0.0, 0.0, 1.0)),
    "tied": ([(0.5, True), (0.5, True), (0.5, False), (0.5, False)], (0.5, 1.0, 0.5, 0.0)),
    "reversed": ([(0.1, False), (0.9, True)], (0.0, 1.0, 1.0, 0.0)),
    "one class": ([(0.1, True), (0.2, True)], (0.5, 1.0, 1.0, 0.0)),
    "empty": ([], (0.0, 1.0, 1.0, 0.0)),
}


@pytest.mark.parametrize("case", CASES)
def test_roc_cases(spark, case):
    rows, want = CASES[case]
    r = E.roc_summary(spark.createDataFrame(rows, "distance double, same boolean"), "distance", "same").first()
    assert (r.auc, r.sum_error_min, r.eer, r.best_accuracy) == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=2, max_size=60))
def test_roc_is_the_share_of_ordered_pairs(spark, rows):
    pos, neg = [d for d, s in rows if s], [d for d, s in rows if not s]
    if not pos or not neg:
        return
    df = spark.createDataFrame([(float(d), s) for d, s in rows], "distance double, same boolean")
    want = sum((p < n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert E.roc_summary(df, "distance", "same").first().auc == pytest.approx(want, abs=1e-6)
