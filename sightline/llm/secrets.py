"""Secret scan with corpus-wide ownership frequency.

Candidates are found in each text and known by a hash of their value. The hashes are counted over the whole
corpus by distinct repositories and owners. A value that COPIED_OWNERS owners share, or that COPIED_REPOS
repositories hold whoever owns them, is a copied example; one that few share and that looks random is a live
credential, and gets a span of kind `live` beside its base span.

The texts are read once: what goes on is a few dozen bytes per candidate. The counts are summed before each
shuffle (repository, then owner, then value), so a value that a third of all rows hold costs no more than
another; the join back to the candidates is on small rows, which AQE can split.

Base kinds: assign, access, hex. Added: `live`, and `key` for the header line of a private key block.

Defined cases: null text is empty and has no spans; null owners or repositories count as one owner or
repository; repeated rows, and rows that tie in id, are separate rows with the same result, and count as one
repository; a very long text costs its own length and its candidates; a null id is passed on; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("assign", "access", "hex", "key", "live")
#: A value that so many owners, or so many repositories of any owners, hold is an example that was copied.
COPIED_OWNERS, COPIED_REPOS = 3, 20
#: Bits a character that a live value has at least, and words that mark a placeholder.
LIVE_BITS = 2.5
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "redacted", "xxxx", "1234567")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")


def looks_live(value: str) -> bool:
    """Letters and digits, no placeholder word, and as many bits a character as a random value has."""
    low = value.lower()
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value) or any(p in low for p in PLACEHOLDERS):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= LIVE_BITS


def candidates(text: str) -> list[tuple[int, int, int, int, str]]:
    """(start, kind number, end, start of the value, value), in order; the value ends where the span does."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            out.append((m.start(), 0, m.end(), m.start(2), m[2]))
    for number, pattern in ((1, _ACCESS), (2, _HEX), (3, _KEY)):
        for m in pattern.finditer(text):
            out.append((m.start(), number, m.end(), m.start(), m[0]))
    return sorted(out)


_SCHEMA = (
    "doc_id bigint, owner string, repo string, row bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "found array<struct<at:bigint,kind:int,until:bigint,value_at:bigint,hash:string,looks:boolean>>"
)
_FOUND = pa.list_(
    pa.struct([("at", pa.int64()), ("kind", pa.int32()), ("until", pa.int64()), ("value_at", pa.int64()), ("hash", pa.string()), ("looks", pa.bool_())])
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, found = ([], [], []), [], []
        for text in batch.column("text"):
            own = candidates(text.as_py() or "")
            for k in range(3):
                counts[k].append(sum(c[1] == k for c in own))
            told = ",".join(f"{KINDS[c[1]]}:{c[0]}:{c[2]}" for c in own if c[1] < 3)
            shas.append(hashlib.sha256(told.encode()).hexdigest())
            found.append(
                [
                    {"at": a, "kind": k, "until": b, "value_at": v, "hash": hashlib.sha256(s.encode()).hexdigest()[:32], "looks": k < 3 and looks_live(s)}
                    for a, k, b, v, s in own
                ]
            )
        yield pa.record_batch(
            [
                *(batch.column(c) for c in ("doc_id", "owner", "repo", "row")),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array(shas, pa.string()),
                pa.array(found, _FOUND),
            ],
            names=["doc_id", "owner", "repo", "row", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def find_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    copied_owners: int = COPIED_OWNERS,
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """Per row: base counts, digest of the base spans, all spans, and how many candidates are live or copied."""
    slim = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    rows = written(slim.mapInArrow(_scan, _SCHEMA), "candidates")
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    held = (
        each.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    judged = each.select("row", "at", "kind", "until", "value_at", "hash", "looks").join(held, "hash").select(
        "row", "at", "kind", "until", "value_at", copied.alias("copied"), "looks", "owners", "repos"
    )
    live = ~F.col("copied") & F.col("looks")
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "kind", "until"))).alias("base"),
        F.sort_array(F.collect_list(F.when(live, F.struct(F.col("value_at").alias("at"), F.lit(4).alias("kind"), "until")))).alias("live"),
        F.sum(live.cast("bigint")).alias("n_live"),
        F.sum(F.col("copied").cast("bigint")).alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    spans = F.array_join(
        F.transform(
            F.sort_array(F.array_union("base", "live")),
            lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["at"].cast("string"), s["until"].cast("string")),
        ),
        ",",
    )
    base = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    with_spans = rows.where(F.size("found") > 0).select("row", *base).join(
        per_row.select("row", spans.alias("spans"), "n_live", "n_copied", "most_owners", "most_repos"), "row"
    )
    zero = F.lit(0).cast("bigint")
    without = rows.where(F.size("found") == 0).select(
        *base, F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_copied"), zero.alias("most_owners"), zero.alias("most_repos")
    )
    return with_spans.drop("row").unionByName(without)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """A document stands for a repository and its source for the owner."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
