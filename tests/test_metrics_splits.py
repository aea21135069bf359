from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridewell.operators import features, metrics, splits


def test_worked_example(spark):
    pred = spark.createDataFrame(list(zip("AAAABBBCC", "AABDBBACA", strict=True)), "y string, p string")
    labels = spark.createDataFrame([(c,) for c in "ABCD"], "label string")
    s = metrics.summary(pred, labels).first()
    assert (round(s.accuracy, 4), round(s.balanced_accuracy, 4), round(s.macro_f1, 4)) == (0.5556, 0.5556, 0.4583)
    assert metrics.confusion(pred, labels).count() == 16


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from("ABC")), min_size=1, max_size=30))
def test_metrics_are_shares(spark, rows):
    labels = spark.createDataFrame([(c,) for c in "ABC"], "label string")
    s = metrics.summary(spark.createDataFrame(rows, "y string, p string"), labels).first()
    assert all(0 <= v <= 1 for v in s)
    assert s.accuracy == pytest.approx(sum(a == b for a, b in rows) / len(rows))


def test_folds_are_disjoint_even_and_repeatable(spark):
    df = spark.range(103).select("id", (F.col("id") % 3).alias("y"))
    a, b = ({r.id: r.fold for r in splits.stratified_kfold(df, "y", "id", 5, 1).collect()} for _ in range(2))
    assert a == b and len(a) == 103
    for y in range(3):
        sizes = [sum(1 for i, f in a.items() if i % 3 == y and f == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_left_out_statistics_equal_recomputing(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("subj"), (F.col("id") * F.col("id") + 1e6).alias("v"))
    for r in splits.loso_stats(df, "v").collect():
        want = df.filter(F.col("subj") != r.subj).agg(F.avg("v"), F.stddev_pop("v")).first()
        assert (r.mean, r.sd) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_selection_drops_constant_and_correlated(spark):
    df = spark.range(20).select(F.array(F.col("id").cast("double"), F.lit(1.0), F.col("id") * 2.0 + 1, F.rand(3)).alias("feat"))
    assert features.select_positions(df) == [0, 3]


def test_leakage_counts_neighbours_in_other_folds(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 4, 0)], "s int, w int, fold int")
    assert tuple(splits.leakage(df, ["s"], "w").first()) == (4, 2)
