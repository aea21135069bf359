from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stridewell.operators import epochs


def plain(i, n, seed, epoch):
    """The same arithmetic with Python's numbers."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    keys = [(seed * 1000003 + epoch * 7919 + (k + 1) * 104729 + 12345) * 69069 % 2**31 for k in range(4)]

    def mix(x, key):
        t = (x % 2**30 * 2654435761 + key) % 2**32
        return (t ^ t >> 15) * 40503 // 256

    while True:
        l, r = divmod(i, b)  # noqa: E741
        for k in range(4):
            if k % 2 == 0:
                l = (l + mix(r, keys[k])) % a  # noqa: E741
            else:
                r = (r + mix(l, keys[k])) % b
        i = l * b + r
        if i < n:
            return i


def places(spark, n, seed=3, epoch=1):
    out = epochs.placed(spark.range(n), "id", F.lit(n), seed, F.lit(epoch), "p").collect()
    return [r.p for r in sorted(out, key=lambda r: r.id)]


def test_every_size_up_to_2000_is_a_permutation_in_plain_arithmetic():
    for n in range(1, 2001):
        assert sorted(plain(i, n, 3, 1) for i in range(n)) == list(range(n))


def test_every_size_up_to_2000_is_a_permutation(spark):
    """All sizes in one job: 2,001,000 rows."""
    rows = spark.range(1, 2001).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("i")).repartition(8)
    p = epochs.placed(rows, "i", F.col("n"), 5, F.lit(0), "p")
    bad = p.groupBy("n").agg(F.countDistinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi")).filter("d <> n or lo <> 0 or hi <> n - 1")
    assert bad.collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 512, 1000])
def test_equals_plain_arithmetic(spark, n):
    assert places(spark, n) == [plain(i, n, 3, 1) for i in range(n)]


def test_large_numbers_stay_below_n(spark):
    n = 2**48 - 59
    rows = [0, 1, n - 1, n // 2, 12345678901]
    df = spark.createDataFrame([(i,) for i in rows], "i long")
    assert [r.p for r in epochs.placed(df, "i", F.lit(n), 9, F.lit(2), "p").collect()] == [plain(i, n, 9, 2) for i in rows]


def test_epochs_differ_and_neighbours_part(spark):
    a, b = places(spark, 1000, 3, 0), places(spark, 1000, 3, 1)
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 20
    assert sum(abs(x - y) < 10 for x, y in zip(a, a[1:], strict=False)) < 60


@pytest.mark.parametrize("n,size,batches", [(0, 4, 0), (3, 4, 1), (4, 4, 1), (11, 4, 2), (40, 4, 10)])
def test_batches(spark, n, size, batches):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(n)], "k int, v double").repartition(3)
    rows = epochs.numbered(df, ["k", "v"])
    if n:
        assert [r.row for r in rows.orderBy("k", "v").collect()] == list(range(n)) and rows.first().n == n
    out = epochs.epoch_batches(rows, 2, batch=size).collect()
    for e in (0, 1):
        own = [r for r in out if r.epoch == e]
        assert len({r.row for r in own}) == len(own) == batches * min(size, n)
        assert sorted({r.batch for r in own}) == list(range(batches))


def plain_runs(rows):
    out = []
    for k in {r[0] for r in rows}:
        own, run = sorted((o, l is not None, l or "", l) for q, o, l in rows if q == k), -1
        for i, (_, _, _, l) in enumerate(own):
            if i == 0 or l != own[i - 1][3]:
                run += 1
                out.append([k, run, l, i, 0])
            out[-1][4] += 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_runs_equal_plain_ones(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("ab"), i, rng.choice(["x", "x", "y", None])) for i in range(120)]
    rows += [("one run", i, "z") for i in range(100)] + [(None, 1, "x"), (None, None, "x"), ("null", 1, None), ("tie", 1, "b"), ("tie", 1, "a"), ("tie", 1, "a")]
    df = spark.createDataFrame(rows, "k string, o long, label string").withColumn("run", F.lit(9)).withColumn("size", F.lit("s"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = epochs.label_runs(df, ["k"], ["o"], "label")
        want = plain_runs([(k, -1 if o is None else o, l) for k, o, l in rows])
        assert sorted(map(tuple, out.collect()), key=str) == want
        assert epochs.label_runs(df.filter("false"), ["k"], ["o"], "label").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
