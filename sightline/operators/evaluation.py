"""Folds, pairs, confusion, accuracy and ROC figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.scratch import written

from .ordered import numbered, running_sums, with_next

_MASK = (1 << 64) - 1


class XorShift:
    """64-bit xorshift (13, 7, 17) for index lists on the driver: the same draws for the same seed."""

    def __init__(self, seed: int) -> None:
        self.state = seed & _MASK or 0x9E3779B97F4A7C15

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & _MASK
        x ^= x >> 7
        x ^= x << 17 & _MASK
        self.state = x
        return x

    def below(self, n: int) -> int:
        return self.next() % n

    def shuffle(self, items: list) -> list:
        """In place, from the end, each with one at or before it."""
        for i in range(len(items) - 1, 0, -1):
            j = self.below(i + 1)
            items[i], items[j] = items[j], items[i]
        return items


def folds_of(labels: list[int], k: int, seed: int) -> list[list[int]]:
    """Index lists of k stratified folds; one generator serves all classes in order of label. For small label lists."""
    rng, out = XorShift(seed), [[] for _ in range(k)]
    for label in sorted(set(labels)):
        own = rng.shuffle([i for i, x in enumerate(labels) if x == label])
        for i, at in enumerate(own):
            out[i % k].append(at)
    return out


def spread(id_col: Column, seed: int = 42) -> Column:
    """An order of ids that looks random and that any SQL engine can compute: multiplicative hashing modulo 2^32 of
    the id's lower 31 bits, so that no product overflows."""
    low = F.pmod(F.pmod(id_col, F.lit(1 << 31)) + F.lit(seed), F.lit(1 << 31))
    return F.pmod(low * F.lit(2654435761), F.lit(1 << 32))


def stratified_folds(df: DataFrame, k: int, id_col: str, label_col: str, seed: int = 42) -> DataFrame:
    """df with `fold`: each label's rows dealt in turn, in spread order."""
    placed = numbered(df.withColumn("_spread", spread(F.col(id_col), seed)), [label_col], ["_spread", id_col], "_place", 1 << 24)
    return placed.select(*df.columns, ((F.col("_place") - 1) % k).cast("int").alias("fold"))


def train_of(df: DataFrame, fold: int, id_col: str) -> DataFrame:
    """All rows but the fold's: an anti join on the id."""
    return df.join(df.where(F.col("fold") == fold).select(id_col), id_col, "left_anti")


def adjacent_pairs(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Each row with the next one of its label, by id: a positive pair."""
    found = with_next(df.select(F.col(id_col).alias("i"), F.col(label_col).alias("label")), ["label"], "i", ["i"])
    return found.select("i", F.col("next.i").alias("j"), "label").where("j IS NOT NULL")


def negative_pairs(df: DataFrame, id_col: str, label_col: str, step: int = 7) -> DataFrame:
    """Pairs of different labels, each unordered pair at most once: every row and the one `step` places on in
    spread order, by an equi-join on the place."""
    slim = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), spread(F.col(id_col)).alias("at"), F.lit(0).alias("all"))
    placed = numbered(slim, ["all"], ["at", "id"], "place", 1 << 24).select("id", "label", "place")
    other = placed.select(F.col("id").alias("id_b"), F.col("label").alias("label_b"), (F.col("place") - step).alias("place"))
    pairs = placed.join(other, "place").where("label <> label_b")
    return pairs.select(F.least("id", "id_b").alias("i"), F.greatest("id", "id_b").alias("j")).dropDuplicates(["i", "j"])


def confusion(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    return df.groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label")).agg(F.count("*").alias("n"))


def accuracy_by_class(df: DataFrame, true_col: str, hit: Column) -> DataFrame:
    return df.groupBy(F.col(true_col).alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


def pair_stats(df: DataFrame, distance_col: str, same_col: str) -> DataFrame:
    """Counts of same and different pairs and their mean distances; 0 where there are none."""
    same = F.col(same_col)
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col(distance_col))), F.lit(0.0)), 6)
    return df.agg(
        F.sum(same.cast("bigint")).alias("n_same"),
        F.sum((~same).cast("bigint")).alias("n_different"),
        mean(same).alias("mean_same"),
        mean(~same).alias("mean_different"),
    )


def roc_curve(df: DataFrame, distance_col: str, same_col: str) -> DataFrame:
    """threshold, pos, neg, tp, fp, tpr, fpr: one row per distinct distance, smaller being more alike."""
    per = df.groupBy(F.col(distance_col).alias("threshold")).agg(
        F.sum(F.col(same_col).cast("bigint")).alias("pos"), F.sum((~F.col(same_col)).cast("bigint")).alias("neg")
    )
    per = written(per, "distances")  # read four times below
    run = running_sums(per, "threshold", {"tp": "pos", "fp": "neg"})
    totals = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    with_totals = run.crossJoin(F.broadcast(totals))  # one row
    return with_totals.select("threshold", "pos", "neg", "tp", "fp", "p", "n", rate("tp", "p").alias("tpr"), rate("fp", "n").alias("fpr"))


def roc_summary(df: DataFrame, distance_col: str, same_col: str, places: int = 6) -> DataFrame:
    """One row: auc, sum_error_min (least FPR + FNR), eer (where FPR and FNR meet, between curve points),
    best_accuracy (1 - the larger of FPR and FNR, at its best) and its threshold.

    No pairs: 0, 1, 1, 0, 0. One class only: 0.5, 1, 1, 0, 0.
    """
    c = roc_curve(df, distance_col, same_col)
    tpr0 = F.when(F.col("p") > 0, (F.col("tp") - F.col("pos")) / F.col("p")).otherwise(0.0)
    fpr0 = F.when(F.col("n") > 0, (F.col("fp") - F.col("neg")) / F.col("n")).otherwise(0.0)
    fnr, fnr0 = 1 - F.col("tpr"), 1 - tpr0
    # between two points fpr rises and fnr falls linearly: they cross where the gap's sign changes
    gap, gap0 = F.col("fpr") - fnr, fpr0 - fnr0
    share = F.when(gap - gap0 > 0, -gap0 / (gap - gap0)).otherwise(0.0)
    crossing = F.when((gap0 <= 0) & (gap >= 0), fpr0 + share * (F.col("fpr") - fpr0))
    worse = F.round(F.greatest(F.col("fpr"), fnr), 9)
    best = F.min(F.struct(worse.alias("worse"), F.col("threshold")))
    sums = c.agg(
        F.sum((F.col("fpr") - fpr0) * (F.col("tpr") + tpr0) / 2).alias("auc"),
        F.min(F.col("fpr") + fnr).alias("sum_error_min"),
        F.min(crossing).alias("eer"),
        best.alias("best"),
        F.max("p").alias("p"),
        F.max("n").alias("n"),
    )
    both = (F.coalesce(F.col("p"), F.lit(0)) > 0) & (F.coalesce(F.col("n"), F.lit(0)) > 0)
    none = F.col("p").isNull()
    pick = lambda x, one, empty: F.round(F.when(both, x).when(none, F.lit(empty)).otherwise(F.lit(one)), places)
    return sums.select(
        pick(F.col("auc"), 0.5, 0.0).alias("auc"),
        pick(F.col("sum_error_min"), 1.0, 1.0).alias("sum_error_min"),
        pick(F.col("eer"), 1.0, 1.0).alias("eer"),
        pick(1 - F.col("best.worse"), 0.0, 0.0).alias("best_accuracy"),
        pick(F.col("best.threshold"), 0.0, 0.0).alias("best_threshold"),
    )
