"""Near-duplicates by SuperMinHash, banding, verification on full sets and union-find grouping.

Signature: every shingle ranks the `m` slots by its own permutation and puts rank + fraction into the slot of
each rank; a slot keeps its minimum. Ranks are tried level by level for all shingles of a block of texts, and a
text stops as soon as all its slots are filled, which for long texts is after the first level.

Copies: rows with the same shingle set form one class (128-bit sum of the set's hashes), and all that
follows is between classes, so exact copies are never paired.

Banding: a class is in one bucket per band. Buckets are dealt by range over (bucket, class), so a bucket of any
size is spread over tasks, and read as a sorted stream: each class is paired with the first class of its run
only, if their sizes and sketches of one bit per slot allow. What these pairs link is grouped. Then, in buckets
that still hold several groups, the classes outside the bucket's largest group are paired with all classes of
other groups, filtered inside the join by size and by an odd sketch: a bit per cell, flipped by each shingle that
falls into it. Two odd sketches never differ in more bits than the sets have elements apart, so for sets of up to
some thousand shingles this filter loses nothing and lets hardly a pair through that is not a link. So no link
between different texts that share a bucket is lost, and linked groups cost as many pairs as they have members.

Verification: the texts of both sides are read again and compared by their full shingle sets, a shingle being known
by a 64-bit hash of its words (two of a pair's shingles are taken for one with a probability of n^2 / 2^65).

Misses: two texts of similarity exactly 0.8 share no bucket with probability (1 - 0.8^5)^32 = 3e-6, and the
sketches, 5.5 standard deviations wide, drop one in a million.

Defined cases: null or blank text has an empty set, is linked with nothing and keeps its own id; fewer words
than a shingle make one shingle of the whole sequence; a very long text costs its own length, and a task holds
its set; of repeated ids the rows are separate rows, be their texts equal or not, and of rows that tie in id
`near_duplicates` reports all as kept where one is; a null id takes part in links and is never the smallest, and
many rows without one are as quickly told apart as rows with one; an empty table gives an empty result; other
columns are ignored (or carried, by `drop_near_duplicates`), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import components as stars

from .common import written
from .textblocks import U64, mix64, shingle_sets, step

_TOP = U64(0xFFFFFFFFFFFFFFFF)
_LOW = U64(0xFFFFFFFF)
#: Bands, and slots in a band.
BANDS, ROWS = 32, 5
#: Bits of an odd sketch.
CELLS = 1024
#: Standard deviations by which a sketch may differ from what the least similarity expects.
SKETCH_WIDTH = 5.5


def superminhash(values: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """One row of m slots per set; values[offsets[k]:offsets[k + 1]] is the k-th set. Empty sets stay at the top."""
    n_sets = len(offsets) - 1
    slots = np.full(n_sets * m, _TOP, U64)
    base = np.repeat(np.arange(n_sets, dtype=np.int64) * m, np.diff(offsets))
    order = None  # per element, the permutation as far as it was drawn
    for level in range(m):
        drawn = mix64(values + step(level + 1))
        place = (((drawn >> U64(32)) * U64(m - level)) >> U64(32)).astype(np.int64) + level
        rank = (drawn & _LOW) | (U64(level) << U64(32))
        if order is None:
            slot = place
        else:
            at = np.arange(len(values))
            slot = order[at, place].astype(np.int64)
            order[at, place] = order[:, level]
        np.minimum.at(slots, base + slot, rank)
        unfilled = (slots.reshape(n_sets, m) == _TOP).any(axis=1)
        stay = unfilled[base // m]
        if not stay.any():
            break
        if order is None:
            values, base, place = values[stay], base[stay], place[stay]
            order = np.empty((len(values), m), np.uint16 if m > 256 else np.uint8)
            order[:] = np.arange(m, dtype=order.dtype)
            at = np.arange(len(values))
            order[at, place] = 0
        elif np.count_nonzero(stay) * 2 < len(values):
            values, base, order = values[stay], base[stay], order[stay]
    return slots.reshape(n_sets, m)


def set_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's hashes; zero for an empty set."""
    full = np.flatnonzero(np.diff(offsets))
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.zeros(len(offsets) - 1, U64)
        if len(full):
            sums[full] = np.add.reduceat(mix64(values ^ U64(salt)), offsets[full])
        out.append(sums.view(np.int64))
    return out[0], out[1]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def odd_sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CELLS bits per set, as 64-bit words: whether an odd number of the set's hashes falls into the cell."""
    n_sets = len(offsets) - 1
    cell = (mix64(values + step(977)) >> U64(33)).astype(np.int64) % CELLS
    at = np.repeat(np.arange(n_sets, dtype=np.int64) * CELLS, np.diff(offsets)) + cell
    odd = (np.bincount(at, minlength=n_sets * CELLS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_sets, CELLS), axis=1).view(U64)


_SIGNED = "doc_id bigint, digest binary, n bigint, k0 bigint, k1 bigint, s0 bigint, s1 bigint, s2 bigint, bands array<bigint>, odd array<bigint>"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), _longs(x.reshape(-1)))


def _digest(text: Column) -> Column:
    """128 bits that stand for a text, null like the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _sign(width: int, bands: int, rows: int):
    m = bands * rows
    if m > 192:
        raise ValueError("the sketch has room for 192 slots")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, digest = batch.column("doc_id"), batch.column("digest")
            for a, b, values, offsets in shingle_sets(batch.column("text"), width):
                slots = superminhash(values, offsets, m)
                keys = set_keys(values, offsets)
                bits = np.zeros((b - a, 192), np.uint8)
                bits[:, :m] = (mix64(slots) >> U64(17)).astype(np.uint8) & 1
                sketch = np.packbits(bits, axis=1).view(U64)
                found = np.empty((b - a, bands), U64)
                for k in range(bands):
                    own = np.full(b - a, k + 1, U64)
                    for r in range(rows):
                        own = mix64(own * U64(3) + slots[:, k * rows + r])
                    found[:, k] = own
                yield pa.record_batch(
                    [doc.slice(a, b - a), digest.slice(a, b - a), pa.array(np.diff(offsets)), *map(pa.array, keys), *(_longs(sketch[:, k]) for k in range(3)), _lists(found), _lists(odd_sketches(values, offsets))],
                    names=["doc_id", "digest", "n", "k0", "k1", "s0", "s1", "s2", "bands", "odd"],
                )

    return sign


def _sketch_room(m: int, percent: int) -> int:
    """Bits in which the sketches of two sets of the least similarity may differ."""
    t = percent / 100
    return math.ceil(m * (1 - t) / 2 + SKETCH_WIDTH * math.sqrt(m * (1 - t * t) / 4))


_MEMBERS = "bucket bigint, cid bigint, n bigint, s0 bigint, s1 bigint, s2 bigint, hub bigint"


def _hubs(percent: int, room: int):
    """Rows sorted by (bucket, cid) to the members of buckets of two or more, with the run's first class as hub
    where that may be similar. A run at a partition's edge is passed on even if it has one row here."""

    def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "cid", "n", "s0", "s1", "s2"]
        held = None  # a run of one row so far
        hub = None  # of the run that the last rows belonged to
        first_run = True

        def out(x: np.ndarray, hub_of: np.ndarray) -> pa.RecordBatch:
            bits = sum(np.bitwise_count((x[:, k] ^ hub_of[:, k]).view(U64)).astype(np.int64) for k in (3, 4, 5))
            small, large = np.minimum(x[:, 2], hub_of[:, 2]), np.maximum(x[:, 2], hub_of[:, 2])
            alike = (x[:, 1] != hub_of[:, 1]) & (bits <= room) & (100 * small >= percent * large)
            return pa.record_batch(
                [*(pa.array(x[:, k]) for k in range(6)), pa.array(hub_of[:, 1], mask=~alike)], names=[*names, "hub"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            if held is not None:
                x, held = np.concatenate([held, x]), None
            new = np.ones(len(x), bool)
            new[1:] = x[1:, 0] != x[:-1, 0]
            goes_on = hub is not None and x[0, 0] == hub[0]
            if goes_on:
                new[0] = False
            else:
                hub = None
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1  # -1: the run that goes on
            at = starts[np.maximum(run, 0)] if len(starts) else np.zeros(len(x), np.int64)
            hub_of = x[at]
            if goes_on:
                hub_of[run < 0] = hub
            sizes = np.bincount(run + 1, minlength=len(starts) + 1)
            keep = (sizes[run + 1] > 1) | (run < 0)
            if first_run and len(starts):
                keep[starts[0]] = True
            if len(starts) and sizes[-1] == 1 and not (first_run and len(starts) == 1):
                held, keep[-1] = x[-1:], False
            first_run = first_run and not len(starts)
            if keep.any():
                yield out(x[keep], hub_of[keep])
            hub = hub_of[-1].copy()
            if held is not None:
                hub = None
        if held is not None:
            yield out(held, held)

    return hubs


def _similar(width: int, percent: int):
    """Pairs with both texts to the pairs whose full sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a_key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "a0", "a1")]
            b_key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "b0", "b1")]
            a_text, good = batch.column("text_a"), np.zeros(batch.num_rows, bool)
            for start, stop, values, offsets in shingle_sets(batch.column("text_b"), width):
                b0, b1 = set_keys(values, offsets)
                for i in range(start, stop):
                    j = i - start
                    if b0[j] != b_key[1][i] or b1[j] != b_key[2][i]:
                        continue  # another row's text under the same id
                    who = (a_key[1][i], a_key[2][i], a_text[i])
                    if last is None or who[:2] != last[:2] or not who[2].equals(last[2]):
                        _, _, own, own_offsets = next(shingle_sets(a_text.slice(i, 1), width))
                        k0, k1 = set_keys(own, own_offsets)
                        last, last_set = who, own if (k0[0], k1[0]) == who[:2] else None
                    if last_set is None:
                        continue
                    mine = values[offsets[j] : offsets[j + 1]]
                    both = np.concatenate([mine, last_set])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    good[i] = 100 * common >= percent * (len(both) - common)
            keep = pa.array(good)
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return similar


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among pairs (a < b). Only the texts of the pairs' classes go through the joins.

    A class's text is found by the id and the digest of one of its rows, so neither many rows without an id nor many
    texts under one id meet; rows that repeat both are made one.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "doc", "digest", "k0", "k1"), "cid")
    here = docs["doc_id"].eqNullSafe(wanted["doc"]) & (docs["digest"] == wanted["digest"])
    texts = written(docs.join(wanted, here).select("cid", "k0", "k1", "text"), "texts")
    if texts.groupBy("cid").count().where("count > 1").limit(1).count():
        texts = written(texts.dropDuplicates(["cid"]), "texts")
    a = texts.select(F.col("cid").alias("a"), F.col("k0").alias("a0"), F.col("k1").alias("a1"), F.col("text").alias("text_a"))
    b = texts.select(F.col("cid").alias("b"), F.col("k0").alias("b0"), F.col("k1").alias("b1"), F.col("text").alias("text_b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "a0", "a1", "text_a", "b", "b0", "b1", "text_b")
    return written(both.mapInArrow(_similar(width, percent), "a bigint, b bigint"), "links").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's links: (node, smallest node that it reaches here), block by block."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(names)))
        for x, y in zip(where[: len(a)].tolist(), where[len(a) :].tolist()):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x < y:
                parent[y] = x
            else:
                parent[x] = y
        for x in range(len(names)):  # parents are smaller, so one pass flattens
            parent[x] = parent[parent[x]]
        root = names[np.array(parent, np.int64)] if len(names) else names
        inner = root != names
        yield pa.record_batch([pa.array(root[inner]), pa.array(names[inner])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """cid, root: the smallest cid that each linked cid reaches. links: a, b.

    Tasks join what they can by union-find; the rest are star rounds, in which a node's neighbours are only ever
    aggregated, never gathered.
    """
    forest = links.select("a", "b").mapInArrow(_forest, "a bigint, b bigint").distinct()
    return stars.components(forest, [], "a", "b").withColumnRenamed("node", "cid")


def _may_be_similar(x: DataFrame, y: DataFrame, percent: int) -> Column:
    """Whether two sets' sizes and odd sketches allow the least similarity.

    Sets as similar as that are at most (1 - t) / (1 + t) of both sizes apart. Their sketches then differ in no
    more bits; where the cells fill up, in no more than expected and SKETCH_WIDTH standard deviations.
    """
    apart = (100 - percent) * (x["n"] + y["n"]) / (100 + percent)
    expected = CELLS / 2 * (1 - F.exp(-2 * apart / CELLS))
    spread = F.sqrt(CELLS / 4 * (1 - F.exp(-4 * apart / CELLS)))
    bits = F.lit(0)
    for k in range(CELLS // 64):
        bits = bits + F.bit_count(x["odd"][k].bitwiseXOR(y["odd"][k]))
    return (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & (bits <= F.least(apart, expected + SKETCH_WIDTH * spread))


def _across_groups(members: DataFrame, comp: DataFrame, sketches: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket and different groups that may be similar and weren't tested. sketches: cid, odd, bands.

    A pair that shares several buckets is made in the one of the smallest number only."""
    placed = written(
        members.select("bucket", "cid", "n").join(comp, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "placed"
    )
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    own = written(placed.join(mixed, "bucket").join(sketches, "cid"), "mixed")
    x = own.where("root <> most").select(*(F.col(c).alias(c) for c in own.columns))
    y = own.select(F.col("bucket").alias("bucket_y"), *(F.col(c).alias(c) for c in own.columns if c != "bucket"))
    once = (y["root"] == y["most"]) | (x["cid"] < y["cid"])
    here = F.array_min(F.array_intersect(x["bands"], y["bands"])) == x["bucket"]
    met = x.join(y, (x["bucket"] == y["bucket_y"]) & (x["root"] != y["root"]) & once & _may_be_similar(x, y, percent) & here)
    pairs = met.select(F.least(x["cid"], y["cid"]).alias("a"), F.greatest(x["cid"], y["cid"]).alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def _grouped(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row per row of df: doc_id, digest, n, component_id, and `first`, whether the row is its group's first by id (null
    last), then digest. Rows of an empty set are groups of their own."""
    text = F.col(text_col)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), _digest(text).alias("digest"), text.alias("text"))
    room = _sketch_room(bands * rows, percent)
    signed = written(docs.mapInArrow(_sign(width, bands, rows), _SIGNED), "signed")
    classes = written(
        signed.where("n > 0")
        .groupBy("k0", "k1")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "digest")).alias("low"),
            F.first(F.struct("n", "s0", "s1", "s2", "bands", "odd")).alias("x"),
        )
        .select("k0", "k1", "low.doc", "low.digest", "x.*", F.monotonically_increasing_id().alias("cid")),
        "classes",
    )
    in_buckets = classes.select(F.explode("bands").alias("bucket"), "cid", "n", "s0", "s1", "s2")
    members = written(
        in_buckets.repartitionByRange("bucket", "cid").sortWithinPartitions("bucket", "cid").mapInArrow(_hubs(percent, room), _MEMBERS),
        "members",
    )
    starred = written(members.where("hub IS NOT NULL").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    links = _verified(starred, classes, docs, width, percent)
    comp = written(components(links), "groups")
    more = written(_across_groups(members, comp, classes.select("cid", "odd", "bands"), starred, percent), "across")
    if more.limit(1).count():
        links = comp.where("cid <> root").select(F.col("root").alias("a"), F.col("cid").alias("b")).unionByName(
            _verified(more, classes, docs, width, percent)
        )
        comp = written(components(links), "groups")
    low = F.struct(F.col("doc").isNull().alias("none"), "doc", "digest")
    named = comp.join(classes.select("cid", "doc", "digest"), "cid").groupBy("root").agg(F.min(low).alias("low"))
    by_class = (
        classes.select("k0", "k1", "cid", low.alias("own"))
        .join(comp.join(named, "root").select("cid", "low"), "cid", "left")
        .select("k0", "k1", F.coalesce("low", "own").alias("low"))
    )
    full = signed.where("n > 0").select("doc_id", "digest", "n", "k0", "k1").join(by_class, ["k0", "k1"], "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("low.doc")) & (F.col("digest") == F.col("low.digest"))
    empty = signed.where("n = 0").select("doc_id", "digest", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return full.select("doc_id", "digest", "n", F.col("low.doc").alias("component_id"), is_first.alias("first")).unionByName(empty)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept."""
    return _grouped(df, id_col, text_col, width, percent, bands, rows).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group: that of the smallest id (null last), of one id that of the smallest digest, and any one
    of rows that repeat both. Rows are told apart by id and digest, so distinct texts under one id, or without one, are
    judged each by itself. Rows of an empty set stay."""
    found = written(_grouped(df, id_col, text_col, width, percent, BANDS, ROWS).select("doc_id", "digest", "n", "first"), "judged")
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(df.columns)))}
    keyed = renamed.withColumns({"_sl_id": at[id_col].cast("bigint"), "_sl_digest": _digest(at[text_col])})

    def same_row(other: DataFrame) -> Column:
        return keyed["_sl_id"].eqNullSafe(other["doc_id"]) & (keyed["_sl_digest"] == other["digest"])

    gone = found.where("NOT first").select("doc_id", "digest").distinct()
    left = keyed.join(gone, same_row(gone), "left_anti")
    several = written(found.where("first AND n > 0").groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"), "several")
    if several.limit(1).count():
        once = left.join(several, same_row(several), "left_semi").dropDuplicates(["_sl_id", "_sl_digest"])
        left = left.join(several, same_row(several), "left_anti").unionByName(once)
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE_OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS sh
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid
), common AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x
), low AS (SELECT r.x AS rid, min(w.doc_id) AS low FROM reach r JOIN w ON w.rid = r.y GROUP BY r.x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM w LEFT JOIN n USING (rid) LEFT JOIN low USING (rid)
"""
