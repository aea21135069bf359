"""Experiments: a plan of units of work, what is left of it, and results.

A unit is (task, mode, protocol, seed, fold).  Done units are found by an anti-join on the unit and
a hash of the settings, so a run takes up where another ended, and changed settings run anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, MODES, PROTOCOLS, TASKS, Settings
from ..functions.formats import mean_sd
from ..operators import metrics

UNIT = ("task", "mode", "protocol", "seed", "fold")
BY_SEED = ("task", "mode", "protocol", "seed")
PREDICTIONS = "task string, mode string, protocol string, seed int, fold int, settings string, window_id long, y string, p string"


def settings_hash(settings: Settings = DEFAULTS) -> str:
    return hashlib.sha256(repr(sorted(asdict(settings).items())).encode()).hexdigest()[:16]


def work_plan(spark: SparkSession, folds: DataFrame, tasks: Sequence[str] = tuple(TASKS), modes: Sequence[str] = MODES, protocols: Sequence[str] = PROTOCOLS, settings: Settings = DEFAULTS) -> DataFrame:
    """Every unit; ``folds`` has (protocol, fold).  Small: configurations times seeds times folds."""
    seeds = [(p, s) for p in protocols for s in (settings.seeds_cv if p == "cv" else settings.seeds_loso)]
    grid = spark.createDataFrame([(t, m, p, s) for t in tasks for m in modes for p, s in seeds], "task string, mode string, protocol string, seed int")
    return grid.join(folds, "protocol").select(*UNIT).withColumn("uses_features", F.col("mode").isin("fic", "sam_fic")).withColumn("settings", F.lit(settings_hash(settings)))


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select(*UNIT, "settings").distinct(), [*UNIT, "settings"], "left_anti")


def run(plan: DataFrame, folder: str, predict: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Predict for the units that ``folder`` lacks, append, and return all predictions of the plan.

    ``predict`` takes units and returns PREDICTIONS rows.  Units that differ in the columns ``by``
    (as BY_SEED) are predicted and written apart, so a run that ends early loses one such part alone.
    """
    spark = plan.sparkSession
    done = spark.createDataFrame([], PREDICTIONS)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        done = spark.read.schema(PREDICTIONS).parquet(folder)
    todo = remaining(plan, done)
    for own in todo.select(*by, F.lit(1).alias("__all")).distinct().orderBy(*by, "__all").collect():  # configurations times seeds at most
        units = todo.filter(reduce(lambda a, b: a & b, [F.col(c) == F.lit(own[c]) for c in by], F.lit(True)))
        predict(units).select(*[c.split()[0] for c in PREDICTIONS.split(", ")]).write.mode("append").parquet(folder)
    return spark.read.schema(PREDICTIONS).parquet(folder).join(plan.select(*UNIT, "settings"), [*UNIT, "settings"], "left_semi")


def results(predictions: DataFrame, labels: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """A record for each configuration: metrics by seed (pooled over folds), their mean and deviation,
    the confusion matrix and report of the last seed, fold sizes, and the settings of the two modes that use features."""
    config = ("task", "mode", "protocol")
    by_seed = metrics.summary(predictions, labels, [*config, "seed"])
    last = predictions.join(predictions.groupBy(*config).agg(F.max("seed").alias("seed")), [*config, "seed"], "left_semi")
    cells = last.groupBy(*config, "y", "p").agg(F.count("*").alias("n")).groupBy(*config).agg(F.sort_array(F.collect_list(F.struct("y", "p", "n"))).alias("confusion_last_seed"))
    report = metrics.per_class(last, labels, config).groupBy(*config).agg(F.sort_array(F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))).alias("report_last_seed"))
    folds = predictions.groupBy(*config, "seed", "fold").agg(F.count("*").alias("n_test")).groupBy(*config).agg(F.sort_array(F.collect_list(F.struct("seed", "fold", "n_test"))).alias("folds"))
    seeds = by_seed.groupBy(*config).agg(F.sort_array(F.collect_list(F.struct("seed", "accuracy", "balanced_accuracy", "macro_f1"))).alias("per_seed"))
    extra = F.when(F.col("mode").isin("fic", "sam_fic"), F.struct(F.lit(settings.consistency_weight).alias("consistency_weight"), F.lit(settings.var_threshold).alias("var_threshold"), F.lit(settings.corr_threshold).alias("corr_threshold"), F.when(F.col("mode") == "sam_fic", "SAM").otherwise("Adam").alias("optimizer")))
    out = metrics.over_seeds(by_seed, config)
    for part in (seeds, cells, report, folds):
        out = out.join(part, list(config))
    return out.withColumn("feature_settings", extra)


def summary_rows(results: DataFrame) -> DataFrame:
    names = ("accuracy", "balanced_accuracy", "macro_f1")
    return results.select("task", "mode", "protocol", *[mean_sd(F.col(f"{m}_mean"), F.col(f"{m}_sd")).alias(m) for m in names])


def generalization_gap(results: DataFrame) -> DataFrame:
    """task, mode and how far each mean falls from cross-validation to left-out subjects."""
    names = ("accuracy", "balanced_accuracy", "macro_f1")
    sides = [F.max(F.when(F.col("protocol") == p, F.col(f"{m}_mean"))).alias(f"{m}_{p}") for m in names for p in PROTOCOLS]
    return results.groupBy("task", "mode").agg(*sides).select("task", "mode", *[(F.col(f"{m}_cv") - F.col(f"{m}_loso")).alias(f"{m}_gap") for m in names])
