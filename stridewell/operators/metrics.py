"""Metrics of predictions (y, p), whole or by group.

Everything comes from the counts of (y, p): one aggregation with partial sums, then small tables.
Accuracy is over rows; balanced accuracy averages recall over classes that occur; macro F1 averages
over all labels of the dimension, absent ones as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, labels: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """y, p, n for every pair of labels."""
    grid = labels.select(F.col("label").alias("y")).crossJoin(labels.select(F.col("label").alias("p")))  # classes squared
    counts = pred.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(pred: DataFrame, labels: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """by, label, tp, support, predicted, precision, recall and f1 (0 where undefined)."""
    pairs = pred.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    side = F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("q"), F.lit(0).cast("bigint").alias("t"))))
    sums = pairs.select(*by, side.alias("e")).select(*by, "e.*").groupBy(*by, "label").agg(F.sum("t").alias("tp"), F.sum("s").alias("support"), F.sum("q").alias("predicted"))
    frame = sums.select(*by).distinct().crossJoin(labels.select("label")) if by else labels.select("label")
    full = frame.join(sums, [*by, "label"], "left").select(*by, "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "support", "predicted")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return full.select("*", zero(F.col("tp"), F.col("predicted")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def summary(pred: DataFrame, labels: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """by, accuracy, balanced_accuracy and macro_f1, pooled over all rows of a group."""
    each = per_class(pred, labels, by, y, p)
    total = F.sum("support")
    return each.groupBy(*by).agg((F.sum("tp") / total).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def report(pred: DataFrame, labels: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """label, precision, recall, f1, support, with rows for the macro and the weighted average."""
    each = per_class(pred, labels, (), y, p)
    cols = ("precision", "recall", "f1")
    macro = each.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support"))
    return each.select("label", *cols, "support").unionByName(macro).unionByName(weighted)


def over_seeds(by_seed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each metric over seeds."""
    names = ("accuracy", "balanced_accuracy", "macro_f1")
    return by_seed.groupBy(*by).agg(*[f(m).alias(f"{m}_{s}") for m in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "sd"))])
