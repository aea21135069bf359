"""Folds: stratified, leave-one-subject-out, and what leaks between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..shared import written


def shuffle_key(seed: int, row: Column) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string")))


def stratified_kfold(df: DataFrame, y: str, row: str, folds: int = DEFAULTS.folds, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: rows of a class are dealt in shuffled order, so fold sizes of a class differ by one at most.

    Rows are sorted by range partitions, which part a large class too; a row's place in its class is
    its place in the partition and the sizes of the parts before, a row for each class and partition.
    """
    sort = [F.col(y), F.col("__order"), F.col(row)]
    ordered = df.withColumn("__order", shuffle_key(seed, F.col(row))).repartitionByRange(*sort).sortWithinPartitions(*sort)
    # written, as a second run could draw other bounds
    ordered = written(ordered.withColumn("__at", F.monotonically_increasing_id()).drop("__order"), "ordered")
    part = F.shiftright("__at", 33)
    parts = ordered.groupBy(F.col(y).alias("__y"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__y").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__y", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = ordered.join(parts, F.col(y).eqNullSafe(F.col("__y")) & (part == F.col("__part")))
    return placed.select(*df.columns, ((F.col("__at") - F.col("__first") + F.col("__base")) % folds).cast("int").alias("fold"))


def loso(df: DataFrame, subj: str = "subj") -> DataFrame:
    """``df`` with ``fold``, the subject's place in order; subjects are few beside their windows."""
    order = df.select(subj).distinct().withColumn("fold", (F.row_number().over(Window.orderBy(subj)) - 1).cast("int"))
    return df.join(order, subj)


def loso_sizes(df: DataFrame, subj: str = "subj") -> DataFrame:
    """subj, n_test and n_train of each fold, from counts by subject alone."""
    own = df.groupBy(subj).agg(F.count("*").alias("n_test"))
    total = own.agg(F.sum("n_test").alias("n"))
    return own.join(F.broadcast(total)).select(subj, "n_test", (F.col("n") - F.col("n_test")).alias("n_train"))


def loso_stats(df: DataFrame, value: str, subj: str = "subj") -> DataFrame:
    """subj, mean and sd (population) of everyone else's values: totals less the subject's own part.

    Sums are taken about the global mean, so nothing cancels.  The work is linear in the rows, not
    in rows times subjects.
    """
    center = df.agg(F.avg(value).alias("c"))
    moved = df.join(F.broadcast(center)).withColumn("d", F.col(value) - F.col("c"))
    own = moved.groupBy(subj).agg(F.count("d").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.first("c").alias("c"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    rest = own.join(F.broadcast(total)).select(subj, "c", (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tq") - F.col("q")).alias("q"))
    mean = F.try_divide("s", "n")
    return rest.select(subj, F.col("n").alias("n_train"), (F.col("c") + mean).alias("mean"), F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))).alias("sd"))


def leakage(df: DataFrame, series: Sequence[str], widx: str, fold: str = "fold", overlap: int = 1) -> DataFrame:
    """n windows and n_leaking: those with an overlapping neighbour (up to ``overlap`` places away) in another fold."""
    w = Window.partitionBy(*series).orderBy(widx)
    leaks = F.lit(False)
    for k in range(1, overlap + 1):
        for side in (F.lag, F.lead):
            there = (F.abs(side(F.col(widx), k).over(w) - F.col(widx)) <= overlap) & (side(F.col(fold), k).over(w) != F.col(fold))
            leaks = leaks | F.coalesce(there, F.lit(False))
    return df.withColumn("__leaks", leaks).agg(F.count("*").alias("n"), F.sum(F.col("__leaks").cast("bigint")).alias("n_leaking"))


def batch_plan(n: Column, batch: int = DEFAULTS.batch) -> tuple[Column, Column, Column]:
    """(batch size used, full batches, rows of an epoch left over); a split smaller than a batch is one batch."""
    size = F.least(n, F.lit(batch))
    return size, F.floor(n / size), n % size
