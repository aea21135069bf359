"""Networks are trained on every window outside their fold, whatever the chunks."""

from __future__ import annotations

import hashlib
import io
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.config import DEFAULTS
from stridewell.models import train
from stridewell.operators.epochs import numbered

SETTINGS = replace(DEFAULTS, batch=16)
LABELS = ["a", "b", "c"]


def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(130):
        c = i % 3
        x = np.stack([rng.normal(c, 1, 12), rng.normal(1e4, 3, 12), np.full(12, 0.1)])
        f = rng.normal(c, 1, 4)
        rows.append((i, LABELS[c], x.astype("float32").tolist(), [*f.tolist(), 0.1, float(f[0]) * 2], 0 if i < 20 else 1 + i % 2))
    df = spark.createDataFrame(rows, "window_id long, y string, x array<array<float>>, feat array<double>, fold int").repartition(4)
    return rows, df


def planned(df):
    """Numbered rows, and each fold's fit for the seeds 0 and 5."""
    rows = numbered(train.hashed(df), ("fold", "__hash", "window_id")).drop("n", "__hash")
    parts = rows.groupBy("fold").agg(F.min("row").alias("gap"), F.count("*").alias("held")).orderBy("fold").collect()
    return rows, [(s, r.fold, r.gap, r.held, 130 - r.held) for s in (0, 5) for r in parts]


def loaded(state):
    return dict(np.load(io.BytesIO(state)))


def test_windows_beyond_a_bound_are_learned(spark):
    order = sorted(range(20_600), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    edge = hashlib.md5(str(order[20_000]).encode()).hexdigest()
    rare = F.md5(F.col("id").cast("string")) >= edge
    sample = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: (F.rand(1) + F.when(rare, 3).otherwise(0) + j * 0.1).cast("float"))
    df = spark.range(0, 20_600, numPartitions=4).select(F.col("id").alias("window_id"), F.when(rare, "b").otherwise("a").alias("y"), F.array(sample).alias("x"), F.array(F.lit(0.0)).alias("feat"), (F.col("id") % 2).cast("int").alias("fold"))
    out = train.fit_predict(df, mode="erm", epochs=1, settings=replace(DEFAULTS, lr=0.01)).groupBy("y").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("p")).cast("int")).alias("right"))
    got = {r.y: (r.n, r.right) for r in out.collect()}
    assert got["a"][0] == 20_000 and got["b"][0] == 600 and got["a"][1] > 0.9 and got["b"][1] > 0.9


def test_an_epoch_has_every_window_outside_the_fold(spark):
    data, df = frame(spark)
    rows, fits = planned(df)
    fold = {r[0]: r[4] for r in data}
    plan = spark.createDataFrame([(i, *f) for i, f in enumerate(fits)], "slot int, seed int, own int, gap long, held long, trains long")
    coded = rows.withColumn("label", F.lit(0))
    seen = []
    for epoch in (0, 1):
        by_step, order = defaultdict(list), defaultdict(list)
        for r in train.epoch_steps(coded, plan, epoch, 16).orderBy("slot", "place").collect():
            by_step[r.slot, r.step].append(r.window_id)
            order[r.slot].append(r.window_id)
        for slot, (_, own, _, _, n) in enumerate(fits):
            ids = order[slot]
            assert len(ids) == len(set(ids)) == n // 16 * 16 and all(fold[i] != own for i in ids)
            assert [len(by_step[slot, s]) for s in range(n // 16)] == [16] * (n // 16)
        seen.append(order)
    assert seen[0][0] != seen[1][0] and seen[0][0] != seen[0][3]
    # fewer windows than a batch are one, with all of them
    whole = train.epoch_steps(coded, plan, 0, 512).groupBy("slot", "step").count().collect()
    assert sorted((r.slot, r.step, r["count"]) for r in whole) == [(i, 0, f[4]) for i, f in enumerate(fits)]


def test_statistics_are_those_of_all_training_windows(spark):
    data, df = frame(spark)
    rows, fits = planned(df)
    plan = spark.createDataFrame([(i, *f) for i, f in enumerate(fits)], "slot int, seed int, own int, gap long, held long, trains long")
    states = {r.slot: loaded(r.state) for r in train.first_states(rows, plan, LABELS, "fic", SETTINGS).collect()}
    assert sorted(states) == list(range(len(fits)))
    for slot, (seed, own, *_) in enumerate(fits):
        s, mine = states[slot], [r for r in data if r[4] != own]
        x = np.array([np.array(r[2], "float32").T.ravel() for r in mine], float)
        feat = np.array([r[3] for r in mine])
        np.testing.assert_allclose(s["mu"], x.mean(0), rtol=1e-9)
        constant = np.arange(x.shape[1]) % 3 == 2
        np.testing.assert_allclose(s["sd"], np.where(constant, 1.0, x.std(0)), rtol=1e-7)
        assert s["of"].tolist() == [seed, own] and s["keep"].tolist() == train.select(feat, SETTINGS).tolist() == [0, 1, 2, 3]
        np.testing.assert_allclose(s["fmu"], feat[:, s["keep"]].mean(0), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(s["fsd"], feat[:, s["keep"]].std(0), rtol=1e-9)
        np.testing.assert_allclose(s["weight"], train.class_weights(np.array([LABELS.index(r[1]) for r in mine]), 3))


@pytest.mark.parametrize("mode", ["fic", "sam"])
def test_chunks_equal_one_chain(spark, monkeypatch, mode):
    data, df = frame(spark)
    rows, fits = planned(df)
    by_id = {r[0]: r for r in data}
    monkeypatch.setattr(train, "CHUNK", 2)
    got = {(r.seed, r.fold): loaded(r.model) for r in train.trained(rows, fits, LABELS, mode, 2, SETTINGS).collect()}
    assert sorted(got) == sorted(f[:2] for f in fits)
    plan = spark.createDataFrame([(i, *f) for i, f in enumerate(fits)], "slot int, seed int, own int, gap long, held long, trains long")
    first = {r.slot: r.state for r in train.first_states(rows, plan, LABELS, mode, SETTINGS).collect()}
    orders = []
    for epoch in (0, 1):
        found = train.epoch_steps(rows.withColumn("label", F.lit(0)), plan, epoch, 16).select("slot", "step", "place", "window_id").orderBy("slot", "place").collect()
        orders.append(found)
    for slot, (seed, own, *_, n) in enumerate(fits):
        fit = train.Fit(bytes(first[slot]), mode, SETTINGS)
        for epoch, found in enumerate(orders):
            for step in range(n // 16):
                batch = [by_id[r.window_id] for r in found if r.slot == slot and r.step == step]
                x = np.array([np.array(r[2], "float32").T for r in batch], float)
                fit.step(x, np.array([LABELS.index(r[1]) for r in batch]), np.array([r[3] for r in batch]), (epoch, step))
        want, model = loaded(fit.packed()), got[seed, own]
        assert want["t"] == 2 * (n // 16) == model["t"]
        for k in model:
            # a step moves parameters by about 1e-3; a bias before a batch normalisation moves by rounding alone
            if k.startswith("p_") and not (k.startswith("p_conv") and k.endswith("_b")):
                assert np.abs(model[k] - want[k]).mean() < 5e-5, k


def test_more_models_than_are_broadcast(spark, monkeypatch):
    data, df = frame(spark)
    want = sorted(map(tuple, train.fit_predict(df, "fic", (0, 5), 1, SETTINGS).collect()))
    assert len(want) == 260 and {w[0] for w in want} == {0, 5}
    monkeypatch.setattr(train, "MODELS", 2)
    assert sorted(map(tuple, train.fit_predict(df, "fic", (0, 5), 1, SETTINGS).collect())) == want
