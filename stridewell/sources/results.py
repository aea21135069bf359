"""Results of experiments: JSON lines by configuration, and a summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_results(results: DataFrame, folder: str) -> None:
    """Append one JSON record for each configuration under task=/mode=/protocol=."""
    results.write.mode("append").partitionBy("task", "mode", "protocol").json(folder)


def read_results(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    """The whole summary again, as one CSV file with a header: a row for each configuration, so small."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).csv(folder)
