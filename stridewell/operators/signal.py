"""Resampling and fixed-length windows of recordings.

Series of any length (``resampled_rows``, ``windows_of_rows``) stay rows: they are numbered by range
partitions, and a window is a group of its own samples.  Recordings known to fit one row each can be
taken as arrays (``resample``, ``windows``), in one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, FALL_CODES
from ..shared import written


def task_label(task: str, code: Column) -> Column:
    """The class of a code under a task: two classes for ``binary``, else the code itself."""
    return F.when(code.isin(list(FALL_CODES)), "FALL").otherwise("ADL") if task == "binary" else code


def target_length(n: Column, ratio: float) -> Column:
    """Samples after resampling: rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(n / F.lit(float(ratio)), 0).cast("bigint"))


def _interpolated(values: str, n: str, m: str) -> str:
    """Linear interpolation at j * n / m; on an exact knot the next sample has no part, null or NaN as it may be."""
    at, rest = f"cast((j * {n}) div {m} as int)", f"((j * {n}) % {m})"
    here, after = f"{values}[{at}]", f"{values}[cast(least((j * {n}) div {m} + 1, {n} - 1) as int)]"
    return f"transform(sequence(0L, {m} - 1L), j -> cast(if({rest} = 0, {here}, {here} + ({after} - {here}) * {rest} / {m}) as float))"


def resample(df: DataFrame, keys: Sequence[str], order: Sequence[str], channels: Mapping[str, str | None] | Sequence[str] = CHANNELS, ratio: float = 4.0) -> DataFrame:
    """keys, n, m and ``sig``, an array of m floats for each channel, in order.

    ``channels`` names a column for each channel; None stands for a channel that is absent, all 0.
    """
    named = channels if isinstance(channels, Mapping) else {c: c for c in channels}
    present = [c for c in named.values() if c is not None]
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(present)])
    out = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows")).withColumn("n", F.size("rows").cast("bigint"))
    out = out.withColumn("m", target_length(F.col("n"), ratio))
    for i in range(len(present)):
        out = out.withColumn(f"__v{i}", F.col(f"rows.v{i}"))
    arrays = [F.expr(_interpolated(f"__v{present.index(c)}", "n", "m")) if c is not None else F.expr("transform(sequence(0L, m - 1L), j -> cast(0 as float))") for c in named.values()]
    return out.withColumn("sig", F.array(*arrays)).select(*keys, "n", "m", "sig")


def resampled_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], channels: Mapping[str, str | None] | Sequence[str] = CHANNELS, ratio: float = 4.0) -> DataFrame:
    """keys, n, m, j and ``v``, an array of one float for each channel: the samples of ``resample``, one a row.

    Rows are sorted by range partitions, which part a long series too; a row's position is its number
    in its part and the sizes of the parts before.  The row yields the outputs between it and the next.
    """
    named = channels if isinstance(channels, Mapping) else {c: c for c in channels}
    present = [c for c in named.values() if c is not None]
    key = [f"k{i}" for i in range(len(keys))]
    sort = [*key, *(f"o{i}" for i in range(len(order))), *(f"v{i}" for i in range(len(present)))]
    own = df.select(*[F.col(c).alias(k) for c, k in zip(keys, key, strict=True)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(present)])
    # written, as a second run could draw other bounds
    rows = written(own.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()), "series")
    inside = Window.partitionBy(*key, "part").orderBy(*sort)
    here = F.struct(*[f"v{i}" for i in range(len(present))], F.lit(0).alias("some"))
    rows = rows.select(*key, "part", here.alias("here"), (F.row_number().over(inside) - 1).cast("bigint").alias("at"), F.lead(here).over(inside).alias("after"))
    whole = Window.partitionBy(*key)
    parts = rows.groupBy(*key, "part").agg(F.count("*").alias("size"), F.min_by("here", "at").alias("head"))
    before = whole.orderBy("part")
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("part").alias("_part"), F.sum("size").over(whole).alias("n"), (F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("base"), F.lead("head").over(before).alias("next"))
    same = F.col("part") == F.col("_part")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = rows.join(parts, same).withColumn("m", target_length(F.col("n"), ratio)).withColumn("i", F.col("at") + F.col("base"))
    out = out.withColumn("after", F.coalesce("after", "next", "here"))
    out = out.withColumn("lo", F.expr("(i * m + n - 1) div n")).withColumn("hi", F.expr("((i + 1) * m + n - 1) div n - 1"))
    out = out.filter("lo <= hi").select("*", F.explode(F.expr("sequence(lo, hi)")).alias("j")).withColumn("rest", F.expr("(j * n) % m"))
    value = [F.lit(0.0).cast("float") if c is None else F.expr(f"cast(if(rest = 0, here.v{i}, here.v{i} + (after.v{i} - here.v{i}) * rest / m) as float)") for c, i in ((c, present.index(c) if c is not None else 0) for c in named.values())]
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, key, strict=True)], "n", "m", "j", F.array(*value).alias("v"))


def _pieces(batches: Iterator[pa.RecordBatch], keys: int, win: int, step: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, m, j, v) sorted by keys and j as pieces of windows: keys, widx, j of the first sample, and x, a list for each channel.

    A stretch of consecutive samples of a series in a batch gives each window that it meets its part of it, mostly the whole.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        m, j = batch.column(keys).to_numpy(), batch.column(keys + 1).to_numpy()
        v = batch.column(keys + 2).flatten()
        breaks = np.ones(n, bool)
        breaks[1:] = np.diff(j) != 1
        for c in batch.columns[:keys]:
            breaks[1:] |= np.diff(c.dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
        start = np.flatnonzero(breaks)
        low, stop = j[start], j[start] + np.diff(np.append(start, n))
        first = np.maximum(0, -((win - 1 - low) // step))
        last = np.minimum((stop - 1) // step, (m[start] - win) // step)
        count = np.maximum(last - first + 1, 0)
        run = np.repeat(np.arange(len(start)), count)
        ragged = lambda lengths: np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        widx = first[run] + ragged(count)
        a, b = np.maximum(low[run], widx * step), np.minimum(stop[run], widx * step + win)
        inside = b > a  # none in the gap between windows that don't touch
        run, widx, a, b = run[inside], widx[inside], a[inside], b[inside]
        at, channels = start[run] + a - low[run], len(v) // n
        lengths = np.repeat(b - a, channels)
        rows = np.repeat(np.repeat(at, channels), lengths) + ragged(lengths)
        values = v.take(pa.array(rows * channels + np.repeat(np.tile(np.arange(channels), len(at)), lengths)))
        each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * channels), each)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:keys]), pa.array(widx, pa.int64()), pa.array(a, pa.int64()), x], [*batch.schema.names[:keys], "widx", "j", "x"])


def windows_of_rows(rows: DataFrame, keys: Sequence[str], win: int = 50, step: int = 25) -> DataFrame:
    """The windows of ``windows`` from samples of ``resampled_rows``.

    Samples are packed where they lie: a partition gives each window that it meets one piece, so what is shuffled is a
    row for each window, and one more for those that partitions cut.  Null keys are a series; repeated samples of
    a series are no series.
    """
    own = rows.filter(f"m >= {win}").select(*keys, "m", "j", "v").sortWithinPartitions(*keys, "j")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    pieces = own.mapInArrow(lambda batches: _pieces(batches, len(keys), win, step), f"{kinds}, widx long, j long, x array<array<float>>")
    cut = pieces.groupBy(*keys, "widx").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("__p"))
    joined = F.when(F.size("__p") == 1, F.col("__p")[0]["x"]).otherwise(F.expr("transform(sequence(0, size(__p[0].x) - 1), c -> flatten(transform(__p, p -> p.x[c])))"))
    return cut.select(*keys, F.col("widx").cast("int").alias("widx"), joined.alias("x"))


def samples(resampled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ch, j, v: one row for each sample."""
    per = resampled.select(*keys, F.posexplode("sig").alias("ch", "values"))
    return per.select(*keys, "ch", F.posexplode("values").alias("j", "v"))


def windows(resampled: DataFrame, keys: Sequence[str], win: int = 50, step: int = 25) -> DataFrame:
    """keys, widx and x, an array of ``win`` values for each channel; only complete windows.

    A series shorter than a window has none, also those near its length.
    """
    starts = f"if(m >= {win}, sequence(0L, m - {win}L, {step}L), cast(array() as array<bigint>))"
    cut = resampled.select(*keys, "sig", F.posexplode(F.expr(starts)).alias("widx", "start"))
    return cut.select(*keys, "widx", F.expr(f"transform(sig, c -> slice(c, cast(start as int) + 1, {win}))").alias("x"))


def flatten_window(x: str = "x") -> Column:
    """The window as one array in the order of time, then channel."""
    return F.expr(f"flatten(transform(sequence(0, size({x}[0]) - 1), t -> transform({x}, c -> c[t])))")


def runs_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, code: str) -> DataFrame:
    """Numbers the stretches of consecutive rows with the recording's label, for callers that don't want them joined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = F.coalesce(F.col(label) == F.col(code), F.lit(False))
    marked = df.withColumn("__own", own).withColumn("__begin", (F.col("__own") & ~F.lag("__own", 1, False).over(w)).cast("int"))
    return marked.withColumn("run", F.sum("__begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__own").drop("__own", "__begin")
