"""What jobs set in a session, and what they leave alone."""

from __future__ import annotations

from stridewell import session


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        session.ship_package(spark)
        assert spark.conf.get(key) == session.BATCH
        spark.conf.set(key, "16MB")
        session.ship_package(spark)
        assert spark.conf.get(key) == "16MB"
    finally:
        spark.conf.set(key, before)
