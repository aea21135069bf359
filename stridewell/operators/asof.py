"""Neighbours in time: as-of joins, and resampling at a fixed rate of samples with timestamps of their own.

Rows are sorted by range partitions of (keys, time), which part a long series too.  What a row needs from
beyond its partition is the last row that partitions before it hold of the series, or the first one after;
a row for each series and partition carries them over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Outputs of a gap that are made at once; longer gaps are made of several such blocks.
_AT_ONCE = 4096


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str | None = None, ties: Sequence[str] = (), within: str | None = None) -> DataFrame:
    """Each row of ``left`` with ``match``, a struct of the last row of ``right`` of equal keys that is not later.

    Of right rows at one time the one greatest in ``ties`` counts.  ``within`` is an interval ("2 hours"): older
    matches are none.  Without a match, or with a null key or time, ``match`` is null; repeated rows of ``left`` stay.
    Column names may clash.  Both sides are shuffled once by (keys, time) and once by parts of series.
    """
    right_on = right_on or on
    k = [f"k{i}" for i in range(len(keys))]
    tie = [f"o{i}" for i in range(len(ties))]
    here, there = left.schema, right.schema
    own = left.select(*[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)], F.col(on).alias("t"), F.lit(1).alias("side"), *[F.lit(None).cast(right.schema[c].dataType).alias(o) for c, o in zip(ties, tie, strict=True)], F.struct(*left.columns).alias("l"), F.lit(None).cast(there).alias("r"))
    other = right.select(*[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)], F.col(right_on).alias("t"), F.lit(0).alias("side"), *[F.col(c).alias(o) for c, o in zip(ties, tie, strict=True)], F.lit(None).cast(here).alias("l"), F.struct(*right.columns).alias("r"))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*k, "t"]])
    sort = [*k, "t", "side", *tie]
    both = own.unionByName(other.filter(known)).repartitionByRange(*sort).sortWithinPartitions(*sort)
    # written, as a second run could draw other bounds
    rows = written(both.withColumn("part", F.spark_partition_id()), "asof")
    inside = Window.partitionBy(*k, "part").orderBy("t", "side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("found", F.last("r", True).over(inside)).filter("side = 1")
    # a row for each series and partition: the last right row of the partitions before it
    lasts = rows.groupBy(*k, "part").agg(F.max_by(F.when(F.col("side") == 0, F.col("r")), F.when(F.col("side") == 0, F.struct("t", *tie))).alias("last"))
    before = Window.partitionBy(*k).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("part").alias("_part"), F.last("last", True).over(before).alias("carry"))
    out = found.join(carried, _same([*k, "part"], [f"_{c}" for c in [*k, "part"]]), "left")
    match = F.when(known, F.coalesce("found", "carry"))
    if within is not None:
        match = F.when(match[right_on] >= F.col("t") - F.expr(f"interval {within}"), match)
    return out.select("l.*", match.alias("match"))


def resample_times(df: DataFrame, keys: Sequence[str], ts: str, values: Mapping[str, str], period: int, ties: Sequence[str] = ()) -> DataFrame:
    """keys, j, ts and a column for each of ``values``: each series at its first timestamp plus j times ``period`` microseconds.

    Values are interpolated between the last sample that is not later and the next one; at a sample's own time they are
    its value, whatever the next one is.  Nothing is made after the last sample.  Where samples share a timestamp, what is
    before leads to the first of them in the order of ``ties``, and what is after starts from the last.  A null
    value makes those beside it null; rows with a null timestamp are left out; null keys are a series.
    """
    k = [f"k{i}" for i in range(len(keys))]
    v, o = [f"v{i}" for i in range(len(values))], [f"o{i}" for i in range(len(ties))]
    sort = [*k, "us", *o, *v]
    own = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)], F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), *[F.col(c).alias(a) for c, a in zip(ties, o, strict=True)], *[F.col(c).cast("double").alias(a) for c, a in zip(values.values(), v, strict=True)])
    # written, as a second run could draw other bounds
    rows = written(own.filter("us is not null").repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()), "times")
    here = F.struct("us", *v)
    inside = Window.partitionBy(*k, "part").orderBy(*sort[len(k) :])
    rows = rows.select(*k, "part", here.alias("here"), F.lead(here).over(inside).alias("after"), F.col("us"), *o)
    whole = Window.partitionBy(*k)
    parts = rows.groupBy(*k, "part").agg(F.min("us").alias("start"), F.min_by("here", F.struct("us", *o, "here")).alias("head"))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("part").alias("_part"), F.min("start").over(whole).alias("t0"), F.lead("head").over(whole.orderBy("part")).alias("next"))
    out = rows.join(parts, _same([*k, "part"], [f"_{c}" for c in [*k, "part"]])).withColumn("after", F.coalesce("after", "next"))
    first = F.expr(f"(here.us - t0 + {period - 1}L) div {period}L")
    # the last sample of a series yields its own time at most
    stop = F.expr(f"if(after is null, (here.us - t0) div {period}L + 1, (after.us - t0 + {period - 1}L) div {period}L)")
    out = out.withColumn("lo", first).withColumn("hi", stop).filter("lo < hi")
    out = out.select("*", F.explode(F.expr(f"sequence(0L, (hi - lo - 1) div {_AT_ONCE})")).alias("block"))
    out = out.select("*", F.explode(F.expr(f"sequence(lo + block * {_AT_ONCE}, least(hi, lo + (block + 1) * {_AT_ONCE}) - 1)")).alias("j"))
    out = out.withColumn("at", F.col("t0") + F.col("j") * F.lit(period))
    share = "(at - here.us) / (after.us - here.us)"
    made = [F.expr(f"if(at = here.us, here.{c}, here.{c} + (after.{c} - here.{c}) * {share})").alias(name) for c, name in zip(v, values, strict=True)]
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)], "j", F.timestamp_micros("at").alias("ts"), *made)
