from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stridewell.operators import asof

RNG = random.Random(5)


def series(n, keys="abc"):
    return [(RNG.choice(keys), RNG.randrange(0, n), i, float(RNG.randrange(100))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, i long, v double").withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_last_row_before(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # of "d" the right side has one row, long before the left ones, so partitions lie in between
        left, right = series(300) + [("d", 200 + i, 1000 + i, 0.0) for i in range(60)], series(200) + [("d", 1, 5, 5.0)]
        got = {r.i: r.match and (r.match.i, r.match.v) for r in asof.asof_join(frame(spark, left), frame(spark, right), ["k"], "ts", ties=["i"]).collect()}
        for k, t, i, _ in left:
            before = [(u, j, v) for q, u, j, v in right if q == k and u <= t]
            assert got[i] == (max(before)[1:] if before else None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows_of_a_join(spark):
    left = frame(spark, [("a", 5, 1, 1.0), ("a", 5, 1, 1.0), ("a", None, 2, 1.0), (None, 5, 3, 1.0), ("b", 5, 4, 1.0), ("a", 100, 5, None)])
    right = frame(spark, [("a", 5, 7, None), ("a", 4, 9, 2.0), (None, 1, 8, 1.0), ("a", None, 6, 1.0)])
    got = sorted(((r.i, r.match and r.match.i) for r in asof.asof_join(left, right, ["k"], "ts", ties=["i"], within="10 seconds").collect()), key=str)
    assert got == [(1, 7), (1, 7), (2, None), (3, None), (4, None), (5, None)]
    assert asof.asof_join(left.filter("false"), right, ["k"], "ts").collect() == []
    assert {r.match for r in asof.asof_join(left, right.filter("false"), ["k"], "ts").collect()} == {None}


def plain(rows, period):
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, i, v) for q, t, i, v in rows if q == k and t is not None)
        for j in range((own[-1][0] - own[0][0]) // period + 1 if own else 0):
            t = own[0][0] + j * period
            a = [s for s in own if s[0] <= t][-1]
            after = [s for s in own if s[0] > t]
            v = a[2] if a[0] == t else None if a[2] is None or after[0][2] is None else a[2] + (after[0][2] - a[2]) * (t - a[0]) / (after[0][0] - a[0])
            out[k, j] = (t, v)
    return out


@pytest.mark.parametrize("parts,period", [(1, 3), (9, 3), (40, 1), (9, 50)])
def test_resampling_equals_a_plain_one(spark, parts, period, monkeypatch):
    monkeypatch.setattr(asof, "_AT_ONCE", 16)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = series(150) + [(None, 7, 1, 1.0), (None, 9, 2, 3.0), ("one", 4, 1, 2.0), ("gap", 0, 1, 0.0), ("gap", 500, 2, 50.0), ("null", 0, 1, None), ("null", 9, 2, 1.0), ("a", None, 3, 1.0)]
        out = asof.resample_times(frame(spark, rows), ["k"], "ts", {"value": "v"}, period * 10**6, ["i"])
        assert out.columns == ["k", "j", "ts", "value"]
        got = {(r.k, r.j): (int(r.us) // 10**6, r.value) for r in out.withColumn("us", F.unix_micros("ts")).collect()}
        want = plain(rows, period)
        assert got.keys() == want.keys()
        for p, (t, v) in want.items():
            assert got[p][0] == t and (got[p][1] == v or abs(got[p][1] - v) < 1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_samples(spark):
    assert asof.resample_times(frame(spark, []), ["k"], "ts", {"v": "v"}, 10**6).collect() == []
