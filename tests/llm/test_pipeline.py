"""The pipeline stage by stage against brute force, and op3, op6, op7, op9 on awkward rows."""

import math
import os
import re
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sightline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sightline.llm import exact_dedup, line_quality, quality_knn, source_mix, url_filter  # noqa: E402

from .test_near_dedup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "source mix", "best-fit packing"]
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if len(seen) < 4:
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen.append([r.asDict() for r in out.collect()])
        docs = spark.createDataFrame(out.collect(), out.schema)
    start = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_knn.classify(start, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert Counter(r["doc_id"] for r in seen[0]) == Counter(good)
    last = {}
    for r in seen[0]:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in seen[1]} == set(last.values()) and len(seen[1]) == len(last)
    groups = brute([(r["doc_id"], r["text"]) for r in seen[1]], 5, 80)
    assert {r["doc_id"] for r in seen[2]} == {i for i, (_, c) in groups.items() if c == i}
    # the mix: whole copies and one threshold per source, near the targets
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in seen[2]}
    times = Counter(r["doc_id"] for r in seen[3])
    by_source = {}
    for r in seen[2]:
        by_source.setdefault(r["source"], []).append(r["doc_id"])
    total = sum(size.values())
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(by_source))}
    words = {s: sum(size[i] for i in ids) for s, ids in by_source.items()}
    target = brute_targets(words, weights, 1.5 * total)
    for s, ids in by_source.items():
        taken = sum(times[i] * size[i] for i in ids)
        assert abs(taken - target[s]) <= max(size[i] for i in ids), s
        assert max(times[i] for i in ids) <= 2 and max(times[i] for i in ids) - min(times[i] for i in ids if size[i]) <= 1
    # the packing, with repeated rows: every copy of a document is there with all its pieces
    length = Counter()
    for r in seen[4]:
        length[(r["doc_id"], r["piece"])] += 1
    assert all(length[(i, 0)] == n for i, n in times.items())
    used = len({r["sequence_id"] for r in seen[4]})
    assert used <= 1.05 * math.ceil(sum(r["length"] for r in seen[4]) / 1024) + 2
    assert sorted(corpus_pipeline.run(spark, SF).columns) == sorted(seen[4][0])


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, clashing names, no rows: every stage runs and keeps the columns."""
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    words = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, words, "en", "a", 5, "x", 1.0), (2, words, "en", "a", 5, "x", 1.0), (2, words, "en", "a", 5, "x", 1.0), (3, words + " more", None, None, None, None, None),
        (None, words + " of it", "en", "a", 5, "x", 2.0), (None, None, None, None, None, None, None), (4, None, "en", "b", 0, "y", 3.0), (5, "", "en", "b", 0, "y", 3.0),
        (6, " \n\t ", "en", "b", 0, "y", 3.0), (7, "z " * 60000, "en", "b", 0, "y", 3.0),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _sl_id string, _sl_times double"
    start = spark.createDataFrame(rows, schema)
    for docs in (start, start.limit(0), start.where("text IS NULL")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= docs.count()


def brute_targets(words, weights, budget):
    """Shares by weight; what lies above twice a source's words is shared again among the others."""
    capped = {}
    while True:
        rest = budget - sum(capped.values())
        free = [s for s in words if s not in capped]
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * words[s]]
        if not over:
            return capped | share
        capped |= {s: 2 * words[s] for s in over}


def test_mix_awkward(spark):
    rows = [(k, "w " * (k % 7) if k % 11 else None, [None, "é", "a", "Z", "empty"][k % 5] if k % 5 < 4 else "empty", "c") for k in range(400)]
    rows = [(i, None if s == "empty" else t, s, x) for i, t, s, x in rows] + [(9, "again and again", "a", "c")] * 30 + [(None, "no id", "a", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows)
    words = Counter()
    for i, t, s, _ in rows:
        words[s] += len((t or "").split())
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    target = brute_targets({s: words[s] for s in order if words[s]}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(words.values()))
    source_of = {(i, len((t or "").split())): s for i, t, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source_of[(r.doc_id, r.size)]
        assert r.source_size == words[s] and r.target == pytest.approx(target.get(s, 0))
        assert r.taken == r.times * r.size and r.times <= 2
        taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 6  # thirty rows share one id and one text
    assert sorted(map(repr, source_mix.mix(df.repartition(7)).collect())) == sorted(map(repr, got))
    assert source_mix.mix(df.limit(0)).count() == 0
    carried = source_mix.mix(df, carry=True)
    assert carried.columns == df.columns
    assert carried.count() == sum(r.times for r in got)


def test_mix_of_rows_without_ids(spark, tmp_path):
    """A source whose rows have no id, and one whose rows repeat, come within one document of their targets; as by SQL."""
    rows = [(None, f"{'w ' * (k % 5 + 1)}{k}", "a") for k in range(900)] + [(7, "one and the same text", "b")] * 700 + [(k, "x y z", "c") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = source_mix.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).drop("times")
    target, taken = {}, Counter()
    for r in got.collect():
        target[r.source_size] = r.target
        taken[r.source_size] += r.taken
    assert len(target) == 3 and all(abs(taken[s] - t) <= 6 for s, t in target.items()), (target, taken)
    assert any(t % s for s, t in target.items())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = got.columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({source_mix.ORACLE_OP6})").fetchall()
    assert Counter(map(repr, map(tuple, got.collect()))) == Counter(map(repr, want))
    carried = source_mix.mix(df.withColumn("size", F.lit("s")).withColumn("h0", F.lit(1)), carry=True)
    assert carried.columns == ["doc_id", "text", "source", "size", "h0"]
    words = Counter()
    for r in carried.collect():
        words[r.source] += len(r.text.split())
    assert sorted(words.values()) == sorted(taken.values())


def test_exact_dedup_awkward(spark):
    long = "x" * 200000
    rows = [(k, "same", "a") for k in range(3000)] + [(k, None if k % 2 else "", "b") for k in range(3000, 3010)]
    rows += [(4000, long + "y", ""), (4001, long + "z", ""), (4002, long + "y", ""), (4000, long + "y", ""), (None, "nul", ""), (None, "nul", "")]
    rows += [(5000 + k, f"{'p' * 40}{k % 50}", "") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, run string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = exact_dedup.copy_groups(df).collect()
        kept = exact_dedup.drop_copies(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    best, size = {}, Counter()
    text_of = {}
    for i, t, _ in rows:
        t = t or ""
        size[t] += 1
        best[t] = max(best.get(t, -1), -1 if i is None else i)
        text_of[i] = t
    assert len(got) == len(rows)
    for r in got:
        t = text_of[r.doc_id]
        assert r.group_size == size[t] and (-1 if r.keep_id is None else r.keep_id) == best[t]
    assert sum(r.kept for r in got) == len(size) == len(kept)
    assert Counter(r.text or "" for r in kept) == Counter(size.keys())
    assert all((-1 if r.doc_id is None else r.doc_id) == best[r.text or ""] for r in kept)
    assert exact_dedup.copy_groups(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_oracles_on_awkward_rows(spark, tmp_path):
    texts = [None, "", " \t\r\n", "a", "a b c a b c a b c", "a b\na b\n\na b\n \nx", "one two three four " * 20, "É | ü | ñ |\nfine words here.\n" * 30,
             "CLICK HERE\n" + "plain words of a text. " * 30, "NO!! WAY!! " * 40 + "\nok", "x%%% y&&& " * 60, "\x0bw\x0c" * 70, "a\u00a0b\u2003c " * 60,
             "A heading of no mark\nEin Satz (ganz).\n" * 40, "Tous droits réservés.\nHier klicken!\nleer más;\r\n" * 25, "He said \"so.\"\u201d \t\nas 'it'\n" * 30, "v%d " * 300_000]
    docs = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(texts)] + [(None, texts[4], "")], "doc_id bigint, text string, kept string")
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/en/1x?y#z", "http://example.org/es/", "http://notexample.org/es/",
            "x://u@h.com:80/de/a", "http://b.com", "http://b.com/fr/?/de/", "a\nb://example.org/en/10", "http://q.org?x", "//x.org/", "http://h.net/de/",
            "http://a.b.co.uk/de/", "http://b.co.uk", "http://co.uk/", "http://x.b.com.au/fr/", "http://" + "a." * 30_000 + "com/de/", "http://h.com/" + "p" * 50_000]
    pages = spark.createDataFrame([(k, u, "n") for k, u in enumerate(urls * 3)], "page_id bigint, url string, host string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for df, sql in ((line_quality.judge(docs).drop("clean_text"), line_quality.ORACLE_OP9), (url_filter.judge(pages), url_filter.ORACLE_OP7)):
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, got.fetchall()))
        assert df.limit(0).count() == 0
    hosts = spark.createDataFrame([(x,) for x in ("a.b.co.uk", "co.uk", "uk", "", "x.y.z.com", "z.com")], "host string")
    assert [tuple(r) for r in hosts.select(*url_filter.registered(F.col("host"))).collect()] == [
        ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("", ""), ("z.com", "com"), ("z.com", "com")
    ]
    assert url_filter.judge(pages.limit(0)).count() == 0 and line_quality.judge(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.clean_text for r in line_quality.judge(docs).collect()}
    assert clean[13] == "\n".join(["Ein Satz (ganz)."] * 40) + "\n" and clean[14] == ""
    assert clean[7] == "fine words here.\n" * 30 and clean[8].startswith("plain")


def test_entry_survives_without_the_subpackage(tmp_path):
    """__spark_entry__ imports, and has the other queries, when llm and the pipeline are gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/sightline", tmp_path / "sightline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op1') for k in q); print('fine')"

    def run(code):
        return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})

    done = run(code)
    assert done.stdout.strip() == "fine", done.stderr
    shutil.copytree(f"{root}/sightline/llm", tmp_path / "sightline" / "llm")
    done = run(code)  # without the pipeline alone
    assert done.stdout.strip() == "fine", done.stderr
    # a library that the operators need and lack isn't taken for their absence
    shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    done = run("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__")
    assert done.returncode and "ahocorasick" in done.stderr
