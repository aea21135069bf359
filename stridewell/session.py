"""What every job needs of a Spark session."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()

#: Bytes of a batch that goes to a Python worker, instead of Spark's default: long texts come by the thousand, and
#: JVM and worker each hold a batch in every running task.
BATCH = "4MB"
_BYTES, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application.

    Python code that runs in tasks imports it by name, wherever the driver was started.
    Where the session leaves the size of Arrow batches at Spark's default, it becomes BATCH.
    """
    if spark.conf.get(_BYTES) == _DEFAULT:
        spark.conf.set(_BYTES, BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    files = sorted(_HERE.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(), f"stridewell-{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f"{_HERE.name}/{f.relative_to(_HERE)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
