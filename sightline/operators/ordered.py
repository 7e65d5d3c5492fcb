"""Window results over few, long partitions, in two levels.

A window partition is sorted by one task. Where a key (a video, a label) may hold a large share of all rows,
these functions cut its rows by ranges of the order column first: a window inside each (key, range), and
another over one summary row per range. Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.scratch import written


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    found = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        found = found & a[k].eqNullSafe(b[k])
    return found


def _neighbour(df: DataFrame, keys: list[str], order: str, cols: list[str], as_col: str, width: int, back: bool) -> DataFrame:
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    one = F.struct(*cols)
    near = (F.lag if back else F.lead)(one).over(inside)
    edge = (F.max_by if back else F.min_by)(one, F.col(order))
    per = ranged.groupBy(*keys, "_range").agg(edge.alias("_edge"))
    over = Window.partitionBy(*keys).orderBy("_range")
    per = per.select(*keys, "_range", (F.lag if back else F.lead)("_edge").over(over).alias("_beyond"))
    a = ranged.withColumn("_near", near)
    joined = a.join(per, _on(a, per, [*keys, "_range"]), "left")
    return joined.select(*(a[c] for c in df.columns), F.coalesce("_near", "_beyond").alias(as_col))


def with_previous(df: DataFrame, keys: list[str], order: str, cols: list[str], as_col: str = "previous", width: int = 1 << 16) -> DataFrame:
    """df with a struct of `cols` of the row before, by `order` (unique whole numbers within the keys)."""
    return _neighbour(df, keys, order, cols, as_col, width, back=True)


def with_next(df: DataFrame, keys: list[str], order: str, cols: list[str], as_col: str = "next", width: int = 1 << 16) -> DataFrame:
    """df with a struct of `cols` of the row after."""
    return _neighbour(df, keys, order, cols, as_col, width, back=False)


def numbered(df: DataFrame, keys: list[str], order: list[str], as_col: str, width: int) -> DataFrame:
    """df with the row's number from 1 by `order`, whose first column is a whole number that ranges are cut by."""
    ranged = df.withColumn("_range", F.floor(F.col(order[0]) / width))
    per = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    a = ranged.withColumn("_own", F.row_number().over(inside))
    joined = a.join(per, _on(a, per, [*keys, "_range"]))
    return joined.select(*(a[c] for c in df.columns), (F.col("_own") + F.col("_before")).alias(as_col))


def numbered_whole(df: DataFrame, order: list[str], as_col: str) -> DataFrame:
    """df with each row's number from 1 by columns of any type, over the whole table.

    Rows are dealt by range and sorted in their partitions, where each has a place; partitions' counts, one row
    each, give the offsets. The table is written in between, so places and counts come from the same deal.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(dealt, "numbered")
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row a partition
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).alias(as_col))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], ranges: int = 64) -> DataFrame:
    """df with running totals by a unique numeric column: sums maps new names to columns.

    The ranges' bounds are approximate quantiles (at most `ranges` numbers on the driver); one summary row per
    range is all that meets in one task.
    """
    bounds = sorted(set(df.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.5 / ranges)))
    which = F.lit(0)
    if bounds:
        which = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order)))
    ranged = df.withColumn("_range", which)
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.select("*", *(F.sum(c).over(inside).alias(f"_r_{n}") for n, c in sums.items()))
    # at most `ranges` rows
    joined = run.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, *((F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums))
