"""Batch normalisation: moments of each batch and channel that merge, and their ordered running average.

``x`` holds the channels one after another, each as long as the others.  Counts, means and sums of squares
about the mean merge pairwise (Spark's own aggregates do), so a batch may lie anywhere.  A running value after batch
T is (1 - m) ** T times its start plus the sum of m (1 - m) ** (T - t) times that of batch t: a sum with weights,
so it needs no pass in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-5
MOMENTUM = 0.1


def batch_statistics(df: DataFrame, batch: str, x: str, channels: int) -> DataFrame:
    """batch, ch, n, mean and var (population) of each batch and channel; null values are left out."""
    long = df.select(F.col(batch).alias("batch"), F.posexplode(x).alias("pos", "v"), F.size(x).alias("size"))
    at = F.floor(F.col("pos") / (F.col("size") / channels)).cast("int")
    return long.groupBy("batch", at.alias("ch")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def running_statistics(stats: DataFrame, momentum: float = MOMENTUM) -> DataFrame:
    """ch, mean and var after all batches in order, from 0 and 1; a batch's variance counts as that of a sample.

    Batches are numbered from 0 without gaps; one of a single value keeps its variance.
    """
    last = stats.groupBy("ch").agg(F.max("batch").alias("last"))
    weight = momentum * F.pow(F.lit(1.0 - momentum), F.col("last") - F.col("batch"))
    sample = F.col("var") * F.when(F.col("n") > 1, F.col("n") / (F.col("n") - 1)).otherwise(1.0)
    start = F.pow(F.lit(1.0 - momentum), F.max("last") + 1)
    return stats.join(F.broadcast(last), "ch").groupBy("ch").agg(F.sum(weight * F.col("mean")).alias("mean"), (start + F.sum(weight * sample)).alias("var"))


def _normal(x: str, mean: Column, var: Column, channels: int, gamma: float, beta: float, eps: float) -> Column:
    of = lambda a, i: F.get(a, F.floor(i / (F.size(x) / channels)).cast("int"))
    return F.transform(x, lambda v, i: (v - of(mean, i)) / F.sqrt(of(var, i) + eps) * gamma + beta)


def _arrays(stats: DataFrame, *by: str) -> DataFrame:
    """Means and variances of all channels in two arrays."""
    rows = F.sort_array(F.collect_list(F.struct("ch", "mean", "var")))
    return stats.groupBy(*by).agg(rows.alias("s")).select(*by, F.col("s.mean").alias("__mean"), F.col("s.var").alias("__var"))


def normalize_batches(df: DataFrame, batch: str, x: str, channels: int, gamma: float = 1.0, beta: float = 0.0, eps: float = EPS) -> DataFrame:
    """``df`` with ``x`` in the form of training: by the statistics of each row's own batch."""
    stats = _arrays(batch_statistics(df, batch, x, channels), "batch").withColumnRenamed("batch", "__batch")
    out = df.join(stats, F.col(batch).eqNullSafe(F.col("__batch")))
    return out.withColumn(x, _normal(x, F.col("__mean"), F.col("__var"), channels, gamma, beta, eps)).drop("__batch", "__mean", "__var")


def normalize_running(df: DataFrame, stats: DataFrame, x: str, channels: int, gamma: float = 1.0, beta: float = 0.0, eps: float = EPS) -> DataFrame:
    """``df`` with ``x`` in the form of inference: by running_statistics(), one row of two arrays."""
    out = df.join(F.broadcast(_arrays(stats)))
    return out.withColumn(x, _normal(x, F.col("__mean"), F.col("__var"), channels, gamma, beta, eps)).drop("__mean", "__var")
