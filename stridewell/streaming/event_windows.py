"""Count windows over a stream by event time.

A recording's order is that of its timestamps, ties by position.  Samples wait in state until the watermark
has passed them, as until then an earlier one may come; an event-time timer then releases them in order, and
complete windows go out.  So a stream gives the rows that a batch over the same samples gives, however they are
dealt out over micro-batches and whether or not it is stopped and restarted in between.

Out of order within the watermark's delay: put in order.  Repeated (recording, timestamp, position): one sample, of
the least value.  Later than the watermark: dropped, as Spark drops late rows (a stream's first watermark is
1970, so nothing up to then counts).  A null value is a sample; rows
with a null timestamp have no place and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "rec string, widx long, x array<double>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A sample in state; a null value is NaN.
_SAMPLE = np.dtype([("us", "<i8"), ("pos", "<i8"), ("value", "<f8")])


class _Windows(StatefulProcessor):
    """State holds samples packed as bytes, a row for those that came together: a call and a row cost more than many samples."""

    def __init__(self, win: int, step: int):
        self.win, self.step = win, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: samples that the watermark hasn't passed, in any order
        self.waiting = handle.getListState("waiting", "samples binary")
        #: the values (doubles) from the next window's first on, its number, and how many more to leave out before it
        self.open = handle.getValueState("open", "held binary, widx long, skip long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if not len(batch):
                continue
            new = np.empty(len(batch), _SAMPLE)
            for name in _SAMPLE.names:
                new[name] = batch[name].to_numpy()
            self.waiting.appendValue((new.tobytes(),))
            first = int(new["us"].min()) if first is None else min(first, int(new["us"].min()))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        came = np.frombuffer(b"".join(bytes(row[0]) for row in self.waiting.get()), _SAMPLE)
        late = came["us"] > passed
        ready, rest = came[~late], came[late]
        if not len(ready):
            return iter([])
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self.handle.registerTimer(-(-int(rest["us"].min()) // 1000))
        else:
            self.waiting.clear()
        ready = ready[np.lexsort((ready["value"], ready["pos"], ready["us"]))]  # NaN is last
        new = np.ones(len(ready), bool)
        new[1:] = (ready["us"][1:] != ready["us"][:-1]) | (ready["pos"][1:] != ready["pos"][:-1])
        fresh = ready["value"][new]
        state = self.open.get()
        held, widx, skip = (np.frombuffer(bytes(state[0]), "<f8"), *state[1:]) if state is not None else (np.zeros(0), 0, 0)
        values, out = np.concatenate([held, fresh[skip:]]), []
        skip, at = max(0, skip - len(fresh)), 0
        while len(values) - at >= self.win:
            x = values[at : at + self.win]
            out.append((key[0], widx, [None if v != v else v for v in x.tolist()]))
            widx += 1
            skip += max(0, self.step - (len(values) - at))
            at += self.step
        self.open.update((values[at:].tobytes(), widx, skip))
        return iter([pd.DataFrame(out, columns=["rec", "widx", "x"])] if out else [])

    def close(self) -> None:
        pass


def event_windows(stream: DataFrame, win: int = 50, step: int = 25, delay: str = "10 minutes") -> DataFrame:
    """(rec, widx, x) from a stream of (rec string, ts timestamp, pos long, value double), in append mode.

    Windows of ``win`` samples, ``step`` apart, numbered from 0 for each recording; samples may come ``delay`` late.
    State of a recording is what waits for the watermark and fewer than ``win + step`` values.  It is never
    forgotten, so numbers go on however long a recording pauses.  The session must keep its state in RocksDB
    (use_rocksdb).
    """
    rows = stream.select(F.col("rec").cast("string").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("pos").cast("long"), F.lit(0)).alias("pos"), F.col("value").cast("double").alias("value")).filter("ts is not null and rec is not null")
    rows = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("rec").transformWithStateInPandas(_Windows(win, step), OUT, "append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Lists and timers of state need this store."""
    spark.conf.set(_PROVIDER, _ROCKS)


def windows_so_far(source: DataFrame, folder: str, win: int, step: int, delay: str) -> DataFrame:
    """The windows of all that a streaming ``source`` has now, written to ``folder``; called again, it goes on from there.

    Output and checkpoint share the folder, which must outlive the machines; files count by Spark's own log of
    the sink, so a batch that is written twice counts once.
    """
    spark = source.sparkSession
    use_rocksdb(spark)
    out = event_windows(source, win, step, delay)
    run = out.writeStream.format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/windows")
