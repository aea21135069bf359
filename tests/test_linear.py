from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from stridewell.config import DEFAULTS
from stridewell.models import linear

RNG = np.random.default_rng(11)
SETTINGS = replace(DEFAULTS, lr=0.1)


def data(n=240, classes=3, folds=5):
    y = RNG.integers(0, classes, n)
    x = RNG.normal(0, 1, (n, 6)) + np.eye(classes, 6)[y] * 2 + 100
    x[:, 4] = x[:, 0] * 3  # goes, correlated
    x[:, 5] = 7  # goes, constant
    return x, y, np.arange(n) % folds


def plain(x, y, fold, mode, steps, s=SETTINGS):
    """The same steps on one machine, fold by fold, written out anew."""
    classes, p = y.max() + 1, np.zeros(len(y), int)
    for f in range(fold.max() + 1):
        tr = fold != f
        kept = []
        for i in np.flatnonzero(x[tr].var(0) > s.var_threshold):
            if not any(abs(np.corrcoef(x[tr, i], x[tr, j])[0, 1]) > s.corr_threshold for j in kept):
                kept.append(i)
        mu, sd = x[tr][:, kept].mean(0), x[tr][:, kept].std(0)
        z = np.column_stack([(x[:, kept] - mu) / sd, np.ones(len(x))])
        counts = np.maximum(np.bincount(y[tr], minlength=classes), 1)
        cw = counts.sum() / (classes * counts)
        w, m, v = (np.zeros((z.shape[1], classes)) for _ in range(3))

        def grad(w, z=z, tr=tr, cw=cw):
            e = np.exp(z[tr] @ w)
            d = (e / e.sum(1, keepdims=True) - np.eye(classes)[y[tr]]) * cw[y[tr]][:, None]
            return z[tr].T @ d / cw[y[tr]].sum()

        for t in range(1, steps + 1):
            g = grad(w)
            if mode == "sam":
                g = grad(w + s.rho * g / (np.sqrt((g**2).sum()) + 1e-12))
            g = g + s.weight_decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            w = w - s.lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[fold == f] = (z[fold == f] @ w).argmax(1)
        yield f, kept, w, p


def frame(spark, x, y, fold):
    rows = [(i, "abc"[c], int(f), v.tolist()) for i, (v, c, f) in enumerate(zip(x, y, fold, strict=True))]
    return spark.createDataFrame(rows, "window_id long, y string, fold int, feat array<double>").repartition(5)


@pytest.mark.parametrize("mode", ["erm", "sam"])
def test_equals_the_same_steps_on_one_machine(spark, mode):
    x, y, fold = data()
    from pyspark.sql import functions as F

    coded = frame(spark, x, y, fold).withColumn("y", (F.ascii("y") - 97).cast("int"))
    model = linear.LinearTrainer(coded, 3, 5, SETTINGS).fit(mode, 8)
    p = None
    for f, kept, w, p in plain(x, y, fold, mode, 8):
        np.testing.assert_allclose(model.w[f][[*kept, -1]], w, atol=1e-9)
        assert not model.w[f][[i for i in range(6) if i not in kept]].any()
    assert len(model.losses) == 8 and all(a >= b for a, b in zip(model.losses[0], model.losses[-1], strict=True))
    out = {r.window_id: r for r in linear.fit_predict_linear(frame(spark, x, y, fold), mode, 8, SETTINGS).collect()}
    assert [out[i].p for i in range(len(y))] == ["abc"[c] for c in p] and [out[i].y for i in range(len(y))] == ["abc"[c] for c in y]
    assert (p == y).mean() > 0.7


def test_modes_differ_and_bad_ones_raise(spark):
    x, y, fold = data(60)
    df = frame(spark, x, y, fold)
    with pytest.raises(ValueError, match="modes"):
        linear.fit_predict_linear(df, "fic", 1)
    with pytest.raises(ValueError, match="rho"):
        linear.fit_predict_linear(df, "sam", 1, replace(SETTINGS, rho=-1.0))


def test_nulls_and_an_empty_table(spark):
    x, y, fold = data(30)
    df = frame(spark, x, y, fold)
    odd = df.unionByName(spark.createDataFrame([(99, None, 0, [0.0] * 6), (98, "a", None, [0.0] * 6), (97, "a", 0, None)], df.schema))
    assert linear.fit_predict_linear(odd, steps=2).count() == 30
    assert linear.fit_predict_linear(df.filter("false"), steps=2).collect() == []
