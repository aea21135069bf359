"""The folder that the driver and all executors share, and tables that jobs keep there between steps."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir`` as a URI.

    A session of one machine (``local``) without that setting gets a folder of its own; a cluster
    without it raises, as files in a folder of one machine would be lost to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/") if ":/" in folder else f"file://{folder.rstrip('/')}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage and outlives executors.

    With ``by``, rows lie in a folder for each value of these columns, so that a filter on them reads no others.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads, nor any result not yet taken."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
