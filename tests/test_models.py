from __future__ import annotations

import numpy as np
import pytest

from stridewell.models.kernels import Adam, Network, SharpnessAware, Var
from stridewell.models.train import class_weights, fit, select


@pytest.mark.parametrize("n_feat", [0, 5])
def test_gradients_equal_differences(n_feat):
    rng = np.random.default_rng(0)
    net = Network(3, 4, n_feat, rng, d=8, heads=2)
    x, y, f = rng.normal(size=(6, 20, 3)), np.array([0, 1, 2, 3, 0, 1]), rng.normal(size=(6, 5)) if n_feat else None
    weight = np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        net.rng = np.random.default_rng(7)
        return net.loss(x, y, weight, f, 0.3)[0]

    out = loss()
    out.backward()
    for name, p in net.p.items():
        g = p.grad.copy()
        at = tuple(rng.integers(0, s) for s in p.value.shape)
        keep, eps = p.value[at], 1e-6
        p.value[at] = keep + eps
        high = float(loss().value)
        p.value[at] = keep - eps
        low = float(loss().value)
        p.value[at] = keep
        assert g[at] == pytest.approx((high - low) / (2 * eps), rel=2e-3, abs=1e-6), name


def test_sharpness_aware_returns_to_its_place():
    p = {"w": Var(np.array([1.0, 2.0]))}
    p["w"].grad = np.array([3.0, 4.0])
    sam = SharpnessAware(Adam(p, lr=0.0), rho=0.5)
    sam.first_step()
    np.testing.assert_allclose(p["w"].value, [1.3, 2.4])
    sam.second_step()
    np.testing.assert_allclose(p["w"].value, [1.0, 2.0])
    with pytest.raises(RuntimeError):
        sam.step()
    with pytest.raises(ValueError):
        SharpnessAware(Adam(p), rho=-1)


@pytest.mark.parametrize("mode", ["erm", "sam", "fic", "sam_fic"])
def test_every_mode_learns(mode):
    rng = np.random.default_rng(1)
    y = np.arange(40) % 2
    x = rng.normal(size=(40, 20, 2)) + 2.0 * y[:, None, None]
    feat = x.mean(axis=1) if "fic" in mode else None
    net, losses = fit(x, y, 2, mode, feat, (0, 0), 12)
    assert len(losses) == 12 and losses[-1][1] < losses[0][1]
    assert (net.forward(x, feat)[0].value.argmax(axis=1) == y).mean() > 0.8
    again, _ = fit(x, y, 2, mode, feat, (0, 0), 12)
    np.testing.assert_array_equal(net.p["out"].value, again.p["out"].value)


def test_guards():
    with pytest.raises(ValueError):
        fit(np.zeros((0, 20, 2)), np.zeros(0, int), 2, "erm", None, (0,), 1)
    with pytest.raises(ValueError):
        fit(np.zeros((2, 20, 2)), np.zeros(2, int), 2, "fic", None, (0,), 1)


def test_weights_count_absent_classes_once():
    np.testing.assert_allclose(class_weights(np.array([0, 0, 0, 1]), 3), [5 / 9, 5 / 3, 5 / 3])


def test_selection():
    a = np.random.default_rng(0).normal(size=50)
    assert select(np.stack([a, np.ones(50), a * 2, a**2], axis=1)).tolist() == [0, 3]


def test_training_windows_go_to_their_fits_and_not_through_the_driver(spark, monkeypatch):
    import hashlib

    from pyspark.sql import DataFrame

    from stridewell.models import train

    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], rng.normal(i % 2, 1, (2, 12)).tolist(), rng.normal(size=3).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "window_id long, y string, x array<array<float>>, feat array<double>, fold int").repartition(4)
    least = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(90))
    for n in (7, 30, 90, 500):
        assert [r["__hash"] for r in train.training_sample(df, n).orderBy("__hash").collect()] == least[:n]
    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(self.columns) or collect(self))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("rows went to the driver"))
    out = train.fit_predict(df.withColumn("subj", df.fold), mode="fic", epochs=1, max_train=60)
    assert not any({"x", "feat"} & set(columns) for columns in seen)
    got = out.select("seed", "fold", "window_id", "y", "p").collect()
    assert sorted((r.window_id, r.y, r.fold) for r in got) == [(i, y, f) for i, y, _, _, f in rows] and {r.p for r in got} <= {"a", "b"}
    with pytest.raises(ValueError, match="no windows to train on"):
        train.fit_predict(df.filter("fold = 1"), epochs=1)
