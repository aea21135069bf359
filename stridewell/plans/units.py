"""Units of work that commit once, and what they took.

A part of the plan, the units of one (task, mode, protocol, seed), is written over its own directory, so a second
attempt replaces what the first left.  Its marker comes last: rows count only where a marker stands, and
the marker names their number and the wall seconds.  A run that ends between the two, or
within either, leaves nothing that counts, and the next run does that part anew.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .experiment import BY_SEED, PREDICTIONS, UNIT

PART = (*BY_SEED, "settings")
MARKERS = "task string, mode string, protocol string, seed int, settings string, folds array<int>, n_rows long, runtime_sec double, finished long"
_KINDS = dict(c.split() for c in PREDICTIONS.split(", "))
_OWN = [c for c in _KINDS if c not in PART]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def markers(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each time that a part was committed, or taken back (without folds) to be done anew: the last one counts."""
    path = f"{folder}/markers"
    return spark.read.schema(MARKERS).json(path) if _exists(spark, path) else spark.createDataFrame([], MARKERS)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """PART, folds, n_rows and runtime_sec of each committed part, once."""
    last = markers(spark, folder).groupBy(*PART).agg(F.max_by(F.struct("folds", "n_rows", "runtime_sec"), "finished").alias("m")).select(*PART, "m.*")
    return last.filter(F.size("folds") > 0)


def remaining_units(plan: DataFrame, folder: str) -> DataFrame:
    """The plan's units that no marker names."""
    done = committed(plan.sparkSession, folder).select(*PART, F.explode("folds").alias("fold"))
    return plan.join(done, [*PART, "fold"], "left_anti")


def _where(row: object, columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(row[c]) for c in columns])


def run_units(plan: DataFrame, folder: str, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Predict for the parts of the plan that have a unit left, and return the committed predictions of the plan.

    ``predict`` takes the units of a part and returns PREDICTIONS rows.  A part is done anew as a whole, with
    the folds that its marker already names, so that its directory always holds all of it.
    """
    spark = plan.sparkSession
    for own in remaining_units(plan, folder).select(*PART).distinct().orderBy(*PART).collect():  # configurations times seeds at most
        begin, seen = time.monotonic(), Observation()
        before = [f for r in committed(spark, folder).filter(_where(own, PART)).collect() for f in r.folds]
        units = plan.filter(_where(own, PART))
        folds = sorted({*before, *(r.fold for r in units.select("fold").distinct().collect())})
        if before:
            known = spark.createDataFrame([tuple(own[c] for c in PART) + (f,) for f in before], f"{', '.join(f'{c} {_KINDS[c]}' for c in PART)}, fold int")
            units = units.select(*UNIT, "settings").unionByName(known.select(*UNIT, "settings")).distinct()
            mark(spark, folder, tuple(own[c] for c in PART), [], 0, 0.0)
        rows = predict(units).select(*_KINDS).observe(seen, F.count("*").alias("n"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PART).parquet(f"{folder}/rows")
        mark(spark, folder, tuple(own[c] for c in PART), folds, seen.get["n"], time.monotonic() - begin)
    return predictions(spark, folder).join(plan.select(*UNIT, "settings"), [*UNIT, "settings"], "left_semi")


def mark(spark: SparkSession, folder: str, part: tuple, folds: list[int], n: int, seconds: float) -> None:
    """Commits a part: from here on its rows count."""
    row = spark.createDataFrame([(*part, folds, n, seconds, time.time_ns())], MARKERS)
    row.coalesce(1).write.mode("append").json(f"{folder}/markers")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """PREDICTIONS rows of committed parts; only their directories are read."""
    if not _exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], PREDICTIONS)
    # configurations times seeds at most
    parts = ["\x1f".join(str(v) for v in r) for r in committed(spark, folder).select(*PART).collect()]
    return spark.read.schema(PREDICTIONS).parquet(f"{folder}/rows").filter(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in PART]).isin(parts)).select(*_KINDS)


def clean(spark: SparkSession, folder: str) -> int:
    """Deletes the directories of parts without a marker, and says how many; the committed ones stay."""
    if not _exists(spark, f"{folder}/rows"):
        return 0
    # a directory for each configuration and seed
    names = spark.read.schema(PREDICTIONS).parquet(f"{folder}/rows").select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("at"), *[F.col(c).cast(_KINDS[c]).alias(c) for c in PART]).distinct()
    loose = names.join(committed(spark, folder).select(*PART), list(PART), "left_anti").select("at").collect()
    for r in loose:
        where = spark._jvm.org.apache.hadoop.fs.Path(r["at"])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(loose)


def timed(results: DataFrame, folder: str) -> DataFrame:
    """``results`` of an experiment with ``runtime_sec``, the wall seconds of each seed's part by seed."""
    took = committed(results.sparkSession, folder).groupBy("task", "mode", "protocol").agg(F.sort_array(F.collect_list(F.struct("seed", "runtime_sec"))).alias("runtime_sec"))
    return results.join(took, ["task", "mode", "protocol"], "left")
