"""Packing: same ids as the tokenizers library, exact round trip of the pieces, and close to the bound."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sightline.llm")

from sightline.llm import packing  # noqa: E402


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers as public

    return packing.Encoder(public.path("byte_bpe_50k.json"), public.PATTERN)


def test_same_ids_as_the_library(encoder, spark):
    rnd = random.Random(5)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    alphabet = "ab 'sS\n\t\r  .,!?0123é日本語🙂‍́ßͅ\u0000'll'RE_-²Ⅷ"
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    texts += ["", " ", "a<|endoftext|>b", "x" * 5000, " " * 3000]
    for text in texts:
        assert encoder.ids(text) == encoder.exact(text), repr(text)


def test_ranks_are_checked_when_loaded(encoder, tmp_path):
    """A file whose merges don't stand in the order of their ids, or that normalises or cuts otherwise, goes through the library."""
    import json

    import public_tokenizers as public

    assert encoder.fast is not None
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    changes = {
        "swapped": lambda m: m["model"]["merges"].insert(0, m["model"]["merges"].pop(5)),
        "lower": lambda m: m.update(normalizer={"type": "Lowercase"}),
        "prefix": lambda m: m["pre_tokenizer"].update(add_prefix_space=True),
        "uncut": lambda m: m["pre_tokenizer"].update(use_regex=False),
    }
    for name, change in changes.items():
        model = json.loads(text)
        change(model)
        assert packing.by_ranks(model, public.PATTERN) is None, name
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(model), encoding="utf-8")
        other = packing.Encoder(str(path), public.PATTERN)
        assert other.fast is None and other.ids("The old Bridge, twice") == other.exact("The old Bridge, twice"), name
    assert packing.by_ranks(json.loads(text), r"\S+|\s+") is None


def test_copies_spread_over_groups(spark):
    """A million rows of one text, asked into many groups: none gets far more than its share."""
    rows = spark.range(1_000_000).select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("piece"), F.lit(77).cast("bigint").alias("ids_crc32"))
    sizes = [r["count"] for r in rows.groupBy(packing.group_of(20)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1.05 * 50_000
    same = spark.range(6000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("one and the same text of some words").alias("text"))
    got = packing.pack(same, room=64, group=500).collect()
    per = {}
    for r in got:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + r.length
    assert len(got) == 6000 and max(per.values()) <= 64 and len({s // 2 % 12 for s in per}) == 12
    assert len(per) <= 1.05 * math.ceil(sum(per.values()) / (64 // got[0].length * got[0].length)) + 12


def check_packed(rows, texts, encoder, room=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = encoder.exact(texts[doc] or "") + [2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == room for r in pieces[1:])
        for r in pieces:
            own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(own)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= room
    return len(by_sequence), math.ceil(sum(r.length for r in rows) / room)


def test_whole_table(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    used, least = check_packed(packing.pack(docs).collect(), texts, encoder)
    assert used <= 1.005 * least + 1


def test_awkward(spark, encoder):
    schema = "doc_id bigint, text string, length string, row string, piece string"
    rows = [(1, None, "x", "y", "z"), (2, "", "x", "y", "z"), (3, "word " * 5000, "", "", ""), (4, "word " * 1023, "", "", "")]
    df = spark.createDataFrame(rows, schema)
    check_packed(packing.pack(df).collect(), {r[0]: r[1] for r in rows}, encoder)
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.union(df)).count() == 2 * packing.pack(df).count()
    assert packing.pack(spark.createDataFrame([(None, "a", "", "", "")], schema)).collect()[0].length == 2


def test_buffered_stream_packs_closely():
    rnd = random.Random(4)
    lengths = np.array([rnd.randrange(1, 1024) for _ in range(30000)])
    order = packing.buffered(lengths, packing.BUFFER)
    assert sorted(order) == list(range(30000)) and (order[: packing.BUFFER] < packing.BUFFER).all()
    bins, _ = packing.best_fit(lengths[order].tolist(), 1024, packing.OPEN_BINS)
    assert len(set(bins)) <= 1.005 * math.ceil(lengths.sum() / 1024)


def test_bounded_space():
    rnd = random.Random(2)
    lengths = [rnd.randrange(1, 100) for _ in range(3000)]
    for open_bins in (1, 4, 1000):
        bins, places = packing.best_fit(lengths, 100, open_bins)
        fill = {}
        for b, p, n in zip(bins, places, lengths):
            assert fill.get(b, 0) == p
            fill[b] = p + n
            assert fill[b] <= 100
    assert packing.best_fit([60, 50, 40, 50], 100, 10) == ([0, 1, 0, 1], [0, 0, 60, 50])
    # with one open bin the fuller one has closed
    assert packing.best_fit([60, 50, 40, 50], 100, 1)[0] == [0, 1, 1, 2]
