"""Near-duplicates against brute force on planted groups, and the parts of the method."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("sightline.llm")

from sightline.llm import near_dedup as nd  # noqa: E402
from sightline.llm import textblocks as tb  # noqa: E402


def shingle_set(text, width):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    words = [w for w in folded.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    """component and size by id"""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randrange(1, 7)))
    texts = []
    for n, copies, edits in ((120, 40, 4), (60, 30, 2), (400, 30, 14), (12, 10, 1), (200, 25, 6)):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(copies):
            own = list(base if rnd.random() < 0.5 else texts[-1].split())
            for _ in range(rnd.randrange(edits + 1)):
                k = rnd.randrange(len(own))
                own[k : k + 1] = rnd.choice([[], [word()], [own[k], word()]])
            texts.append(rnd.choice([" ", "\n", "  "]).join(own))
    texts += [texts[0]] * 20 + [texts[0].upper(), None, "", " \n\t", "a", "A", "a b", "a  b c", "a b c d", "A B\nC D e"]
    passage = " ".join(word() for _ in range(30))
    texts += [f"{passage} {' '.join(word() for _ in range(30))}" for _ in range(40)]
    rnd.shuffle(texts)
    return list(enumerate(texts, start=3))


@pytest.mark.parametrize("width", [4, 5])
def test_planted_groups(spark, width):
    rows = planted(width)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in nd.near_duplicates(df, width=width).collect()}
    want = brute(rows, width, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_awkward_tables(spark):
    schema = "doc_id bigint, text string, bucket string, cid string, n string, kept string"
    rows = [(1, "x y z w v", "", "", "", ""), (1, "x y z w v", "", "", "", ""), (None, "x y z w v", "", "", "", ""), (2, None, "", "", "", "")]
    df = spark.createDataFrame(rows, schema)
    got = nd.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert nd.near_duplicates(df.limit(0)).count() == 0
    assert nd.drop_near_duplicates(spark.createDataFrame([(4, "a b c d e f", "s"), (2, "A b c d e f", "t")], "doc_id bigint, text string, gone string")).collect()[0].doc_id == 2


def test_distinct_texts_without_ids_or_under_one(spark):
    """Near pairs whose rows have no id, or all the same one, are found among themselves in a time that grows with the rows."""
    import time

    rnd = random.Random(6)
    texts = []
    for k in range(1500):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(40)]
        texts += [" ".join(base), " ".join(base[:-1] + [f"end{k}"])]
    took = []
    for own in (texts[:600], texts):
        rows = [(None if k < len(own) // 2 else 7, t, "g") for k, t in enumerate(own)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
        began = time.perf_counter()
        kept = nd.drop_near_duplicates(df).collect()
        took.append(time.perf_counter() - began)
        assert len(kept) == len(own) // 2 and len({r.text.rsplit(" ", 1)[0] for r in kept}) == len(kept)
    assert took[1] < 3 * took[0] + 10


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(5, words, "a"), (5, words, "b"), (5, words + " x", "c"), (5, "another text of its own words here", "d"), (None, words, "e"), (9, words + " x y", "f"),
            (None, None, "g"), (None, "", "h"), (5, "", "i"), (3, "unlike " + " ".join(f"v{k}" for k in range(20)), "j"), (6, "w " * 200_000, "k"), (4, "w " * 200_001, "l")]
    got = nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, first string")).collect()
    group = [r for r in got if r.text and r.text.startswith("w0")]
    assert len(group) == 1 and group[0].doc_id == 5
    assert {r.first for r in got} - {group[0].first} == {"d", "g", "h", "i", "j", "l"}


def test_groups_in_one_bucket_are_compared_across(spark):
    """Links that a bucket's first class has no part in are found by the second step; far sets aren't paired."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    far = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = {1: far, 2: far[:99], 3: base, 4: base[3:], 5: np.concatenate([base[:60], far[:40]])}
    values = np.concatenate(list(sets.values()))
    odd = nd.odd_sketches(values, np.cumsum([0, *map(len, sets.values())])).view(np.int64)
    sketches = spark.createDataFrame([(c, odd[k].tolist(), [8, 7, 9 + c]) for k, c in enumerate(sets)], "cid bigint, odd array<bigint>, bands array<bigint>")
    members = spark.createDataFrame([(b, c, len(v), 0, 0, 0, None) for c, v in sets.items() for b in (7, 8)], nd._MEMBERS)
    comp = spark.createDataFrame([(1, 1), (2, 1)], "cid bigint, root bigint")
    tested = spark.createDataFrame([(1, 3)], "a bigint, b bigint")
    assert [(r.a, r.b) for r in nd._across_groups(members, comp, sketches, tested, 80).collect()] == [(3, 4)]


def test_odd_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 30, 800):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        for k in (0, n // 10, n // 3):
            b = np.concatenate([a[k:], rng.integers(0, 2**63, k, dtype=np.uint64)])
            x, y = nd.odd_sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            assert np.bitwise_count(x ^ y).sum() <= 2 * k


def test_components(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, 300 + k) for k in range(60)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(150)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {r.cid: r.root for r in nd.components(df).collect()} == {x: find(x) for x in parent}
    assert nd.components(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8):
        n = 400
        common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        agree = []
        for _ in range(60):
            rest = rng.integers(0, 2**63, 2 * (n - len(common)), dtype=np.uint64)
            a, b = np.concatenate([common, rest[::2]]), np.concatenate([common, rest[1::2]])
            common = rng.integers(0, 2**63, len(common), dtype=np.uint64)
            s = nd.superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 160)
            agree.append((s[0] == s[1]).mean())
        true = share / (2 - share)
        assert abs(np.mean(agree) - true) < 0.02
        assert np.std(agree) < 1.05 * np.sqrt(true * (1 - true) / 160)  # no worse than independent ranks
    for n in (1, 2, 7, 50, 5000):
        one = nd.superminhash(rng.integers(0, 2**63, n, dtype=np.uint64), np.array([0, n]), 160)
        assert (one < 2**40).all()


def test_words_across_rows():
    texts = ["", "Ab  cd", None, "cd", "\tab\n", "cd ab", "x"]
    for step in (1, 5, 1 << 20):
        found = []
        for a, b, data, offsets in tb.blocks(pa.array(texts), step):
            starts, ends, rows = tb.word_bounds(data, offsets)
            hashes = tb.word_hashes(data, starts, ends, fold=True)
            found += [(int(r) + a, data[s:e].tobytes().decode(), int(h)) for r, s, e, h in zip(rows, starts, ends, hashes)]
        assert [(r, w) for r, w, _ in found] == [(1, "Ab"), (1, "cd"), (3, "cd"), (4, "ab"), (5, "cd"), (5, "ab"), (6, "x")]
        by_word = {}
        for _, w, h in found:
            by_word.setdefault(w.lower(), set()).add(h)
        assert all(len(h) == 1 for h in by_word.values()) and len(by_word) == 3
