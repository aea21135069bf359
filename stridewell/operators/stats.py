"""Labels, class weights and standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_index(df: DataFrame, y: str) -> DataFrame:
    """y and its place in order, from 0: the dimension of labels."""
    return df.select(y).distinct().withColumn("idx", (F.row_number().over(Window.orderBy(y)) - 1).cast("int"))


def encode(df: DataFrame, y: str) -> DataFrame:
    """``df`` with ``idx``; classes are few, so Spark broadcasts the dimension itself where it fits."""
    return df.join(label_index(df, y), y)


def class_weights(df: DataFrame, y: str, labels: DataFrame) -> DataFrame:
    """y, cnt and weight for every label of the dimension: total / (classes * count).

    A class without rows counts as one, in the total too.
    """
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    own = labels.join(counts, y, "left").select(y, F.coalesce("n", F.lit(0)).alias("cnt"))
    used = F.greatest(F.col("cnt"), F.lit(1))
    every = Window.partitionBy()
    return own.withColumn("weight", F.sum(used).over(every) / (F.count("*").over(every) * used))


def positions(df: DataFrame, row: str, x: str, *others: str) -> DataFrame:
    """row, others, pos, v: an array column as rows."""
    return df.select(row, *others, F.posexplode(x).alias("pos", "v"))


def standard_stats(long: DataFrame) -> DataFrame:
    """pos, mu and sd (population; a constant has 1) of long rows."""
    sd = F.stddev_pop("v")
    return long.groupBy("pos").agg(F.avg("v").alias("mu"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def standardize(df: DataFrame, x: str = "x", fold: str | None = None, test_fold: int | None = None) -> DataFrame:
    """``df`` with x standardised position by position, by statistics of the rows outside ``test_fold`` (or of all).

    The statistics are a row for each position, gathered into two arrays and broadcast.
    """
    train = df if fold is None else df.filter(F.col(fold) != test_fold)
    stats = standard_stats(train.select(F.posexplode(x).alias("pos", "v")))
    one = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "mu", "sd"))).alias("__s"))
    out = df.join(F.broadcast(one))
    return out.withColumn(x, F.zip_with(F.col(x), F.col("__s"), lambda v, s: ((v - s["mu"]) / s["sd"]).cast("float"))).drop("__s")
