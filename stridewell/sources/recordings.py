"""Recordings: annotated CSV files by activity code, and tables that stand in for them.

A recording is ``<root>/<CODE>/<CODE>_<subject>_<trial>_annotated.csv``.  The reader prunes by
directory, takes names apart in Spark, and reads files of one header together, so that columns bind
by name: a missing channel is 0, a null inside a channel stays null, other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ALL_CODES, CHANNELS

SUFFIX = "_annotated.csv"


def name_parts(name: Column) -> Column:
    """The parts of a file name without its suffix, as an array."""
    return F.split(F.regexp_replace(name, f"{SUFFIX.replace('.', '[.]')}$", ""), "_")


def parse_names(df: DataFrame, name: str) -> DataFrame:
    """Adds code, subj and trial; keeps names with the suffix and three parts or more.

    A subject that isn't an integer raises.
    """
    parts = name_parts(F.col(name))
    kept = df.filter(F.col(name).endswith(SUFFIX)).withColumn("__parts", parts).filter(F.size("__parts") >= 3)
    out = kept.withColumns({"code": F.element_at("__parts", 1), "subj": F.element_at("__parts", 2).cast("bigint"), "trial": F.element_at("__parts", 3)})
    return out.drop("__parts")


def prune(df: DataFrame, code_col: str, codes: Sequence[str]) -> DataFrame:
    """Rows of the codes asked for; pushed down to the scan, or to its partitions."""
    return df.filter(F.col(code_col).isin(list(codes)))


def label_filter(df: DataFrame, label: str = "label", code: str = "code") -> DataFrame:
    """Rows labelled with their recording's own code; null labels never are."""
    return df.filter(F.col(label) == F.col(code))


def _existing(spark: SparkSession, root: str, codes: Sequence[str]) -> list[str]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for code in codes:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{code}")
        if path.getFileSystem(conf).exists(path):
            found.append(f"{root}/{code}")
    return found


def read_recordings(spark: SparkSession, root: str, codes: Sequence[str] = ALL_CODES, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """code, subj, trial, rec (file), idx (order in the file), label and the channels, label-filtered.

    Directories that don't exist and files without a label column contribute nothing.
    """
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("subj", T.LongType()), T.StructField("trial", T.StringType()), T.StructField("rec", T.StringType()), T.StructField("block", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("label", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in channels])
    nothing = spark.createDataFrame([], schema)
    folders = _existing(spark, root, codes)
    if not folders:
        return nothing
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folders)
    head = F.regexp_replace(F.substring_index(F.decode(F.substring("content", 1, 65536), "UTF-8"), "\n", 1), "\r$", "")
    groups: dict[str, list[str]] = defaultdict(list)
    for row in files.select("path", head.alias("head")).toLocalIterator():  # one short row for each file
        groups[row.head].append(row.path)
    parts = []
    for header, paths in groups.items():
        names = [n.strip().strip('"') for n in header.split(",")]
        if "label" not in names:
            continue
        own = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.schema(own).option("header", True).option("enforceSchema", True).csv(sorted(paths))
        pick = lambda n: F.col(f"c{names.index(n)}")
        named = raw.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("rec"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("idx"), pick("label").alias("label"), *[(F.expr(f"try_cast(c{names.index(c)} as double)") if c in names else F.lit(0.0)).alias(c) for c in channels])
        parts.append(label_filter(parse_names(named, "name")).select(*schema.names))
    return reduce(DataFrame.unionByName, parts, nothing)
