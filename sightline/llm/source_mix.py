"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Each document has a 60-bit hash of its id. Words are summed by source and the hash's leading digits; per
source, the running sum over these buckets finds the bucket in which the source's budget is reached. Only
that bucket's documents are summed again by the next digits, and so on, until the threshold is known to the
last digit. Where several documents share even that, as those with one id or without any do, the boundary goes
on through the digits of a hash of the text, and where whole rows repeat, of a hash of the row's number. A
document is taken when its hashes lie under its source's threshold, so nothing is sorted, and a smaller budget
takes a subset of what a larger one takes.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share `share` of all words; a target
above `most` times its source's words stops there and the excess is shared among the others by weight.
A target above its source's words takes every document whole times first and the rest by hash.

The sources' sums meet in one task for ranks and water-filling, some fifty bytes a source, sorted and spilled by
Spark: a hundred million sources would be five gigabytes there. Everything else is per document or per bucket.

Defined cases: null text has no words and is never taken; a very long text counts as one document, and its source
comes as near to its target as that allows; documents with equal ids are told apart by their texts, and repeated
rows by their number, so that a source that is rich in either misses its target by no more than one document; a
null id hashes as the empty string; a source without words has target 0; an empty table gives an empty result;
other columns are ignored, or carried with `carry`, whatever their names. Of the two thresholds around the budget,
the nearer one is used. Reruns over the same files take the same documents; of repeated rows, which are alike, as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, written

WEIGHTS = (3, 1, 2)
#: Hexadecimal digits of a hash that each refinement looks at; together all 15.
DIGITS = (3, 4, 4, 4)
#: Hashes in the order in which they decide: of the id, of the text, of the row's number.
HASHES = ("h0", "h1", "h2")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    pieces = F.split(F.coalesce(text, F.lit("")), WHITE)
    # split leaves an empty first or last piece where the text begins or ends with white space
    empty = F.when(pieces[0] == "", 1).otherwise(0) + F.when(
        (F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1
    ).otherwise(0)
    return (F.size(pieces) - empty).cast("bigint")


def _targets(sizes: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """src, source_size, target: water-filling, solved in closed form over the sources in order of cap/weight."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))
    weighed = per.withColumn("place", (place - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1).cast("double")
    )
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        capped.withColumn("rest", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("open"))
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
        # the water level is that of the first source which its share doesn't fill
        .withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    )
    share_of = F.when(F.col("full") | F.col("water").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("water"))
    return level.select("src", "source_size", F.greatest(share_of, F.lit(0.0)).alias("target"))


def _digest(value: Column) -> Column:
    return F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, sum(DIGITS))


def _thresholds(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[str]]:
    """By source, the hashes under which its documents are taken once more, and whether those at them are; and the hashes it took.

    The state per source is (what is fixed so far of each hash, budget left among the documents that have this).
    """
    budget = F.when(F.col("source_size") > 0, F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size"))
    state = targets.select("src", F.coalesce(budget, F.lit(0.0)).alias("left"))
    used: list[str] = []
    for h in HASHES:
        fixed = [f"at_{x}" for x in used]
        state = state.withColumn(f"at_{h}", F.lit(""))
        done = 0
        for width in DIGITS:
            state = state.drop("size", "n")
            same = sizes["src"].eqNullSafe(state["src"])
            for x in used:
                same = same & (sizes[x] == state[f"at_{x}"])
            if done:
                same = same & (F.substring(sizes[h], 1, done) == state[f"at_{h}"])
            by = [state["src"], *(state[c] for c in fixed), state[f"at_{h}"], state["left"]]
            inside = sizes.join(state, same)
            sums = inside.groupBy(*by, F.substring(sizes[h], done + 1, width).alias("step")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            names = ["src", *fixed, f"at_{h}", "left"]
            order = Window.partitionBy(*names).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
            running = sums.withColumn("upto", F.sum("size").over(order))
            # the first bucket that reaches the budget; where none does, the last one
            over = F.col("upto") >= F.col("left")
            bucket = F.struct("step", "size", "upto", "n")
            chosen = running.groupBy(*names).agg(F.coalesce(F.min(F.when(over, bucket)), F.max(bucket)).alias("b"))
            state = written(
                chosen.select(
                    "src",
                    *fixed,
                    F.concat(f"at_{h}", "b.step").alias(f"at_{h}"),
                    (F.col("left") - (F.col("b.upto") - F.col("b.size"))).alias("left"),
                    F.col("b.size").alias("size"),
                    F.col("b.n").alias("n"),
                ),
                "bucket",
            )
            done += width
        used.append(h)
        if not state.where("n > 1 AND left > 0 AND left < size").limit(1).count():
            break
    # documents at the boundary itself are taken if that comes nearer to the budget
    nearer = F.abs(F.col("left") - F.col("size")) <= F.abs(F.col("left"))
    return state.select("src", *(f"at_{x}" for x in used), (nearer & (F.col("left") > 0)).alias("with_cut")), used


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    carry: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, times, taken; with carry, df's rows, each as often as it is taken."""
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(df.columns)))}
    sizes = written(
        renamed.select(
            at[id_col].alias("doc_id"),
            at[source_col].alias("src"),
            word_count(at[text_col]).alias("size"),
            _digest(at[id_col]).alias("h0"),
            _digest(at[text_col]).alias("h1"),
            _digest(F.monotonically_increasing_id()).alias("h2"),
            *(renamed.columns if carry else ()),  # the rows themselves, so that they keep their numbers
        ),
        "sizes",
    )
    targets = written(_targets(sizes, weights, share, most), "targets")
    cuts, used = _thresholds(sizes, targets)
    plan = written(targets.join(cuts, targets["src"].eqNullSafe(cuts["src"]), "left").drop(cuts["src"]), "plan")
    whole = F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0))
    under = F.col("with_cut")
    for h in reversed(used):
        under = (F.col(h) < F.col(f"at_{h}")) | ((F.col(h) == F.col(f"at_{h}")) & under)
    n = F.when(F.col("size") > 0, whole + F.when(F.coalesce(under, F.lit(False)), 1).otherwise(0)).otherwise(F.lit(0)).cast("bigint")
    rows = sizes.join(plan, sizes["src"].eqNullSafe(plan["src"]), "left")
    if not carry:
        return rows.select("doc_id", "size", "source_size", "target", n.alias("times"), (n * F.col("size")).alias("taken"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_sl_times").cast("int")))
    repeated = rows.withColumn("_sl_times", n).where("_sl_times > 0").select(*renamed.columns, copies.alias("_sl_copy"))
    return repeated.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("times")


ORACLE_OP6 = r"""
WITH s AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h, substr(md5(coalesce(text, '')), 1, 15) AS h1, row_number() OVER () AS rid
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), weighed AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM per
), filled AS (
  SELECT *,
    (sum(source_size) OVER () * 1.5::DOUBLE
       - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
       - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), water AS (
  SELECT arg_min(level, cap / weight) AS w FROM filled WHERE cap > weight * level
), targets AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level OR w IS NULL THEN cap ELSE weight * w END AS target
  FROM filled LEFT JOIN water ON true
), run AS (
  SELECT s.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, h1, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
         size AS own
  FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0
             ELSE size * (whole + CASE WHEN budget <= 0 THEN 0 WHEN upto < budget THEN 1
                                       WHEN upto - own < budget AND abs(budget - upto) <= abs(budget - (upto - own)) THEN 1 ELSE 0 END)
        END)::BIGINT AS taken
FROM run
"""
