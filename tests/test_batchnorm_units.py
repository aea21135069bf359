from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.operators import batchnorm
from stridewell.plans import experiment, units
from stridewell.shared import written

RNG = np.random.default_rng(2)


def test_batch_normalisation_equals_numpy(spark):
    x = RNG.normal(3, 2, (23, 12))  # 3 channels of 4
    df = spark.createDataFrame([(i, i // 5, v.tolist()) for i, v in enumerate(x)], "id long, batch long, x array<double>").repartition(3)
    stats = batchnorm.batch_statistics(df, "batch", "x", 3)
    train = {r.id: r.x for r in batchnorm.normalize_batches(df, "batch", "x", 3, gamma=2.0, beta=1.0).collect()}
    mean, var = np.zeros(3), np.ones(3)
    for b in range(5):
        own = x[b * 5 : b * 5 + 5].reshape(-1, 3, 4)
        mu, v = own.mean((0, 2)), own.var((0, 2))
        mean, var = 0.9 * mean + 0.1 * mu, 0.9 * var + 0.1 * own.transpose(1, 0, 2).reshape(3, -1).var(1, ddof=1)
        for i, rows in enumerate(own):
            np.testing.assert_allclose(np.reshape(train[b * 5 + i], (3, 4)), (rows - mu[:, None]) / np.sqrt(v[:, None] + 1e-5) * 2 + 1, atol=1e-9)
    running = batchnorm.running_statistics(stats)
    got = sorted(running.collect())
    np.testing.assert_allclose([[r.mean, r.var] for r in got], np.column_stack([mean, var]), rtol=1e-12)
    for r in batchnorm.normalize_running(df, running, "x", 3).collect():
        np.testing.assert_allclose(np.reshape(r.x, (3, 4)), (x[r.id].reshape(3, 4) - mean[:, None]) / np.sqrt(var[:, None] + 1e-5), atol=1e-9)
    assert batchnorm.normalize_batches(df.filter("false"), "batch", "x", 3).collect() == []


def plan_of(spark):
    folds = spark.createDataFrame([("cv", 0), ("cv", 1), ("loso", 0)], "protocol string, fold int")
    return experiment.work_plan(spark, folds, ["binary"], ["erm", "fic"])


def predict(todo):
    rows = todo.withColumn("window_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    return rows.withColumn("y", F.lit("A")).withColumn("p", F.when(F.col("protocol") == "cv", "A").otherwise("B"))


def keys(df):
    return sorted(tuple(r) for r in df.select(*experiment.UNIT, "window_id").collect())


def test_a_run_that_ends_between_rows_and_marker_leaves_each_row_once(spark, tmp_path, monkeypatch):
    plan, folder = plan_of(spark), str(tmp_path / "u")
    marked = units.mark
    calls = []

    def dies(*args):
        calls.append(args)
        if len(calls) == 3:
            raise KeyboardInterrupt
        marked(*args)

    monkeypatch.setattr(units, "mark", dies)
    with pytest.raises(KeyboardInterrupt):
        units.run_units(plan, folder, predict)
    monkeypatch.setattr(units, "mark", marked)
    # two parts stand, the third has rows but no marker
    assert units.committed(spark, folder).count() == 2
    assert spark.read.parquet(f"{folder}/rows").count() > units.predictions(spark, folder).count() == 2 * 2 * 2
    assert units.remaining_units(plan, folder).count() == plan.count() - 2 * 2
    out = units.run_units(plan, folder, predict)
    assert len(set(keys(out))) == out.count() == 2 * plan.count()
    assert spark.read.parquet(f"{folder}/rows").count() == out.count()
    assert units.remaining_units(plan, folder).collect() == []


def test_a_part_that_fails_while_it_is_written_counts_nothing(spark, tmp_path):
    plan, folder = plan_of(spark).filter("mode = 'erm'"), str(tmp_path / "u")
    units.run_units(plan.filter("seed = 0"), folder, predict)

    def breaks(todo):
        return predict(todo).withColumn("y", F.when(F.col("window_id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("y")))

    with pytest.raises(Exception, match="broken"):
        units.run_units(plan, folder, breaks)
    assert units.predictions(spark, folder).count() == 2 * plan.filter("seed = 0").count()
    assert len(set(keys(units.run_units(plan, folder, predict)))) == 2 * plan.count()


def test_folds_added_later_are_done_with_those_before(spark, tmp_path):
    plan, folder = plan_of(spark).filter("mode = 'erm' and protocol = 'cv' and seed = 0"), str(tmp_path / "u")
    units.run_units(plan.filter("fold = 0"), folder, predict)
    seen = []

    def counted(todo):
        seen.extend(r.fold for r in todo.collect())
        return predict(todo)

    out = units.run_units(plan, folder, counted)
    assert sorted(seen) == [0, 1] and len(set(keys(out))) == out.count() == 4
    assert units.run_units(plan, folder, counted).count() == 4 and len(seen) == 2


def test_clean_deletes_what_has_no_marker(spark, tmp_path):
    plan, folder = plan_of(spark).filter("mode = 'erm'"), str(tmp_path / "u")
    assert units.clean(spark, folder) == 0
    out = units.run_units(plan, folder, predict)
    n = out.count()
    loose = out.limit(2).withColumn("mode", F.lit("sam"))
    loose.write.mode("append").partitionBy(*units.PART).parquet(f"{folder}/rows")
    assert units.clean(spark, folder) >= 1 and spark.read.parquet(f"{folder}/rows").count() == n


def test_seconds_and_rows_of_each_part(spark, tmp_path):
    plan, folder = plan_of(spark), str(tmp_path / "u")
    out = units.run_units(plan, folder, predict)
    took = units.committed(spark, folder).collect()
    assert len(took) == 2 * 4 and all(r.runtime_sec > 0 and r.n_rows == 2 * len(r.folds) for r in took)
    res = units.timed(experiment.results(written(out, "predictions"), spark.createDataFrame([("A",), ("B",)], "label string")), folder).collect()
    assert {(r.mode, r.protocol): [s.seed for s in r.runtime_sec] for r in res} == {(m, p): [0, 1, 2] if p == "cv" else [0] for m in ("erm", "fic") for p in ("cv", "loso")}
