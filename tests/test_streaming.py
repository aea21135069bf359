from __future__ import annotations

from stridewell.streaming.count_windows import count_windows


def test_windows_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for k, (a, b) in enumerate([(0, 7), (7, 9), (9, 23)]):
        spark.createDataFrame([("r", i, float(i)) for i in range(a, b)] + [("s", k, 0.0)], "rec string, pos long, value double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("rec string, pos long, value double").option("maxFilesPerTrigger", 1).parquet(src)
    q = count_windows(stream, 6, 3).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.widx, tuple(r.x)) for r in spark.table("w").collect()}
    assert got == {(k, tuple(float(v) for v in range(3 * k, 3 * k + 6))) for k in range((23 - 6) // 3 + 1)}
