from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.operators import signal, stats

from .conftest import DATA


def series(spark, values):
    return spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)], "rec long, i long, v double")


def resampled(spark, values, ratio=4.0):
    row = signal.resample(series(spark, values), ["rec"], ["i"], {"v": "v"}, ratio).first()
    return row.m, row.sig[0]


@pytest.mark.parametrize("n,m", [(1, 1), (2, 1), (3, 1), (6, 2), (10, 2), (14, 4), (18, 4), (22, 6)])
def test_length_rounds_half_to_even(spark, n, m):
    assert resampled(spark, range(n))[0] == m


@pytest.mark.parametrize("n", [1, 5, 7, 40, 173, 199])
def test_values_equal_numpy(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    m, got = resampled(spark, v)
    want = np.interp(np.linspace(0, n / 200, m, endpoint=False), np.linspace(0, n / 200, n, endpoint=False), v).astype(np.float32)
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_multiples_are_decimated_and_ratio_one_is_identity(spark):
    assert resampled(spark, range(40))[1] == [4.0 * j for j in range(10)]
    assert resampled(spark, range(7), 1.0)[1] == [float(j) for j in range(7)]


def test_nan_beside_a_knot_stays_away(spark):
    assert resampled(spark, [1.0, float("nan"), 3.0, 4.0, 5.0, float("nan"), 7.0, 8.0])[1] == [1.0, 5.0]


def test_null_samples_stay_null(spark):
    assert resampled(spark, [None, 1.0, 2.0, 3.0, 5.0, 6.0, 7.0, 8.0])[1] == [None, 5.0]


@pytest.mark.parametrize("m,n", [(44, 0), (45, 0), (49, 0), (50, 1), (74, 1), (75, 2), (100, 3)])
def test_window_counts(spark, m, n):
    out = signal.windows(signal.resample(series(spark, range(m)), ["rec"], ["i"], {"v": "v"}, 1.0), ["rec"])
    assert out.count() == n


def test_absent_channel_is_zero(spark):
    row = signal.resample(series(spark, range(8)), ["rec"], ["i"], {"v": "v", "w": None}, 4.0).first()
    assert row.sig[1] == [0.0, 0.0]


def test_flatten_is_time_then_channel(spark):
    df = spark.range(1).select(F.expr("array(array(1, 2, 3), array(4, 5, 6))").alias("x"))
    assert df.select(signal.flatten_window().alias("f")).first().f == [1, 4, 2, 5, 3, 6]


@pytest.mark.parametrize("ratio,win,step", [(4.0, 50, 25), (1.0, 8, 4), (0.4, 7, 9), (2.0, 50, 60)])
def test_rows_equal_arrays_and_a_long_series_is_parted(spark, ratio, win, step):
    # one key has most rows; some are null, NaN or equal, and a key is null
    size = {1: 3000, 2: 201, 3: 1, None: 77}
    rows = [(k, i // 2, None if i % 17 == 3 else float("nan") if i % 19 == 4 else float((i * 7919) % 101), float(i)) for k, n in size.items() for i in range(n)]
    df = spark.createDataFrame(rows, "rec long, i long, v double, w double").repartition(3)
    args = ["rec"], ["i"], {"v": "v", "none": None, "w": "w"}, ratio
    long, wide = signal.resampled_rows(df, *args), signal.resample(df, *args)
    got = {(r.rec, r.n, r.m, r.j): str(r.v) for r in long.collect()}
    want = {(r.rec, r.n, r.m, j): str([c[j] for c in r.sig]) for r in wide.collect() for j in range(r.m)}
    assert got == want
    cut = lambda out: sorted(str((r.rec, r.widx, r.x)) for r in out.collect())
    assert cut(signal.windows_of_rows(long, ["rec"], win, step)) == cut(signal.windows(wide, ["rec"], win, step))


def test_queries_keep_no_series_in_a_row(spark):
    from stridewell.plans import queries

    for f in (queries.e_resampled, queries.l_resampled):
        assert "collect_list" not in f(spark, DATA)._jdf.queryExecution().toString()


def test_runs_are_told_apart(spark):
    df = spark.createDataFrame([(1, i, lab, "A") for i, lab in enumerate("AABAAB")], "rec long, i long, label string, code string")
    assert [r.run for r in signal.runs_split(df, ["rec"], ["i"], "label", "code").orderBy("i").collect()] == [1, 1, 2, 2]


def test_scaler_sees_training_rows_only(spark):
    def run(last):
        df = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [last])], "fold int, x array<double>")
        return [r.x[0] for r in stats.standardize(df, "x", "fold", 1).collect() if r.fold == 0]

    assert run(5.0) == run(500.0) == [-1.0, 1.0]


def test_constant_position_has_deviation_one(spark):
    df = spark.createDataFrame([([2.0],), ([2.0],)], "x array<double>")
    assert [r.x[0] for r in stats.standardize(df).collect()] == [0.0, 0.0]
