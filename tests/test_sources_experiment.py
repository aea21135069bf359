from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stridewell.plans import experiment
from stridewell.sources import recordings, results


def write(root, code, name, header, rows):
    folder = root / code
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(header + "\n" + "\n".join(rows) + "\n")


def test_csv_recordings(spark, tmp_path):
    write(tmp_path, "WAL", "WAL_3_1_annotated.csv", "label,acc_x,acc_y", ["WAL,1.5,2", "STD,9,9", "WAL,,4"])
    write(tmp_path, "WAL", "WAL_4_1_annotated.csv", "acc_y,extra,label", ["7,x,WAL"])
    write(tmp_path, "WAL", "WAL_5_annotated.csv", "label,acc_x", ["WAL,1"])
    write(tmp_path, "WAL", "WAL_6_1_annotated.csv", "acc_x,acc_y", ["1,2"])
    write(tmp_path, "WAL", "WAL_7_1.csv", "label,acc_x", ["WAL,1"])
    write(tmp_path, "SIT", "SIT_1_1_annotated.csv", "label,acc_x", ["SIT,1"])
    out = recordings.read_recordings(spark, str(tmp_path), ["WAL", "STD"]).orderBy("subj", "block", "idx")
    got = [(r.code, r.subj, r.acc_x, r.acc_y, r.gyro_z) for r in out.collect()]
    assert got == [("WAL", 3, 1.5, 2.0, 0.0), ("WAL", 3, None, 4.0, 0.0), ("WAL", 4, 0.0, 7.0, 0.0)]


def test_no_directories(spark, tmp_path):
    assert recordings.read_recordings(spark, str(tmp_path), ["WAL"]).count() == 0


def test_subject_must_be_a_number(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        recordings.parse_names(spark.createDataFrame([("WAL_x_1_annotated.csv",)], "f string"), "f").collect()


def predictions(todo):
    return todo.withColumn("window_id", F.lit(1).cast("long")).withColumn("y", F.lit("A")).withColumn("p", F.when(F.col("protocol") == "cv", "A").otherwise("B"))


def test_runs_resume_by_unit_and_settings(spark, tmp_path):
    folds = spark.createDataFrame([("cv", 0), ("cv", 1), ("loso", 0)], "protocol string, fold int")
    plan = experiment.work_plan(spark, folds, ["binary"], ["erm", "fic"])
    assert plan.count() == 2 * (3 * 2 + 1)
    seen = []

    def predict(todo):
        seen.append(todo.count())
        return predictions(todo)

    folder = str(tmp_path / "predictions")
    experiment.run(plan.filter("seed = 0"), folder, predict)
    out = experiment.run(plan, folder, predict)
    assert out.count() == plan.count() == sum(seen)
    experiment.run(plan, folder, predict)
    assert len(seen) == 2
    labels = spark.createDataFrame([("A",), ("B",)], "label string")
    res = experiment.results(out, labels)
    gap = experiment.generalization_gap(res).first()
    assert gap.accuracy_gap == 1.0
    assert {r["mode"]: r.feature_settings is not None for r in res.collect()} == {"erm": False, "fic": True}
    results.write_results(res, str(tmp_path / "results"))
    assert results.read_results(spark, str(tmp_path / "results"), res.schema).count() == 4
    results.write_summary(experiment.summary_rows(res), str(tmp_path / "summary"))
    assert results.read_summary(spark, str(tmp_path / "summary")).filter("protocol = 'cv'").first().accuracy == "1.0000 +/- 0.0000"


def test_a_run_that_ends_early_loses_one_seed(spark, tmp_path):
    folds = spark.createDataFrame([("cv", 0), ("cv", 1)], "protocol string, fold int")
    plan, folder, seen = experiment.work_plan(spark, folds, ["binary"], ["erm"], ["cv"]), str(tmp_path / "predictions"), []

    def predict(todo):
        seen.append([r.seed for r in todo.select("seed").distinct().collect()])
        if len(seen) == 3:
            raise RuntimeError("lost")
        return predictions(todo)

    with pytest.raises(RuntimeError, match="lost"):
        experiment.run(plan, folder, predict, experiment.BY_SEED)
    assert spark.read.parquet(folder).select("seed").distinct().count() == 2
    assert experiment.run(plan, folder, predict, experiment.BY_SEED).count() == plan.count()
    assert len(seen) == 4 and seen[2] == seen[3] and all(len(s) == 1 for s in seen)


def test_seed_of_another_settings_hash_is_run_again(spark):
    from stridewell.config import Settings

    assert experiment.settings_hash(Settings(epochs=1)) != experiment.settings_hash()
