from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from stridewell.operators import features, moments

RNG = np.random.default_rng(3)


def rows(n, k=6, groups=7):
    x = RNG.normal(1000, 1, (n, k))
    x[:, 2] = x[:, 0] * 2 + RNG.normal(0, 0.01, n)
    x[:, 3] = 5
    g = np.minimum(RNG.integers(0, groups * 2, n), groups - 1)  # the last group has half of the rows
    return [(None if a == 0 else int(a), v.tolist()) for a, v in zip(g, x, strict=True)]


def plain(x, var_threshold=1e-6, corr_threshold=0.95):
    kept = []
    for i in np.flatnonzero(x.var(0) > var_threshold) if len(x) else []:
        if not any(abs(np.corrcoef(x[:, i], x[:, j])[0, 1]) > corr_threshold for j in kept):
            kept.append(int(i))
    return kept


@pytest.mark.parametrize("n", [1, 5, 40, 3000])
def test_folds_equal_plain_selection(spark, n):
    data = rows(n)
    df = spark.createDataFrame(data, "subj long, feat array<double>").repartition(4)
    out = {r.subj: r for r in moments.select_for_each_fold(df, "subj", "feat").collect()}
    assert set(out) == {g for g, _ in data}
    for g, r in out.items():
        rest = np.array([v for h, v in data if h != g]).reshape(-1, 6)
        assert (r.n_test, r.n_train) == (sum(h == g for h, _ in data), len(rest)) and r.kept == plain(rest)
        if r.kept:
            np.testing.assert_allclose(r.mu, rest[:, r.kept].mean(0), rtol=1e-12)
            np.testing.assert_allclose(r.sd, rest[:, r.kept].std(0), rtol=1e-8)


def test_moments_of_groups_and_whole(spark):
    data = rows(500)
    df = spark.createDataFrame(data, "subj long, feat array<double>").repartition(3)
    own = moments.moments(df, "subj", "feat")
    for r in own.collect():
        x = np.array([v for g, v in data if g == r.subj])
        assert r.n == len(x)
        np.testing.assert_allclose(r.mean, x.mean(0), rtol=1e-13)
        np.testing.assert_allclose(np.reshape(r.m2, (6, 6)), (x - x.mean(0)).T @ (x - x.mean(0)), atol=1e-8)
    x = np.array([v for _, v in data])
    whole = moments.total(own).collect()
    assert len(whole) == 1 and whole[0].n == 500
    np.testing.assert_allclose(np.reshape(whole[0].m2, (6, 6)), (x - x.mean(0)).T @ (x - x.mean(0)), atol=1e-7)


def test_moments_are_handed_on_before_a_batch_ends():
    """A batch of few rows for each of many groups must not become all their matrices at once."""
    schema, n = moments._schema(pa.int64()), 5 * moments.GROUPS + 7
    g, x = np.repeat(np.arange(n), 2), RNG.normal(size=(2 * n, 6))
    batch = pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.ones(2 * n, np.int64)), pa.array(x.tolist(), schema.field(2).type), pa.nulls(2 * n, schema.field(3).type)], schema=schema)
    out = list(moments._merge(iter([batch])))
    assert max(b.num_rows for b in out) <= moments.GROUPS + 1 and [v for b in out for v in b.column(0).to_pylist()] == list(range(n))
    np.testing.assert_allclose([v for b in out for v in b.column(2).to_pylist()], x.reshape(n, 2, 6).mean(1))


def test_a_part_taken_away_and_put_back():
    x = RNG.normal(size=(50, 4)) * 1e-3 + 1e4
    a, b = moments.Moments.of(x[:20]), moments.Moments.of(x[20:])
    rest = (a + b) - a
    assert rest.n == b.n
    np.testing.assert_allclose(rest.mean, b.mean, rtol=1e-12)
    np.testing.assert_allclose(rest.m2, b.m2, atol=1e-8)


def test_odd_rows(spark):
    schema = "subj string, feat array<double>, n int, mean int, g int"
    data = [("a", None, 1, 2, 3), ("a", [1.0, None], 1, 2, 3), ("a", [1.0, 2.0], 1, 2, 3), ("a", [1.0, 2.0], 1, 2, 3), (None, [3.0, 1.0], 1, 2, 3), ("b", [4.0, 9.0], 1, 2, 3)]
    df = spark.createDataFrame(data, schema)
    out = {r.subj: (r.n_test, r.n_train, r.kept) for r in moments.select_for_each_fold(df, "subj", "feat").collect()}
    assert out == {"a": (2, 2, [0]), None: (1, 3, [0]), "b": (1, 3, [0])}
    none = moments.select_for_each_fold(df.filter("false"), "subj", "feat")
    assert none.collect() == [] and none.columns == ["subj", "n_test", "n_train", "kept", "mu", "sd"]
    assert moments.total(moments.moments(df.filter("false"), "subj", "feat")).collect() == []


def test_rows_are_standardised_for_the_fold_that_tests_them(spark):
    data = rows(60)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "row long, subj long, feat array<double>")
    folds = moments.select_for_each_fold(df, "subj", "feat")
    out = moments.standardize_for_each_fold(df, "subj", "feat", folds).collect()
    assert len(out) == 60
    for r in out:
        rest = np.array([v for g, v in data if g != r.subj])
        kept = plain(rest)
        assert r.kept == kept
        np.testing.assert_allclose(r.feat, (np.array(data[r.row][1])[kept] - rest[:, kept].mean(0)) / rest[:, kept].std(0), rtol=1e-4, atol=1e-5)


def direct(x):
    """Power by the sum that defines it."""
    w = x.shape[-1]
    t = np.arange(w)
    k = np.arange(1, w // 2 + 1)[:, None]
    return (x[..., None, :] * np.cos(2 * np.pi * k * t / w)).sum(-1) ** 2 + (x[..., None, :] * np.sin(2 * np.pi * k * t / w)).sum(-1) ** 2


@pytest.mark.parametrize("w", [50, 8, 7, 2])
def test_power_equals_the_direct_sum(w):
    x = RNG.normal(0, 10, (20, 6, w))
    np.testing.assert_allclose(features.power(x), direct(x), rtol=1e-9, atol=1e-9 * w)
    assert (features.power(np.full((1, 1, 50), 123.456)) == 0).all()


def test_spectra(spark):
    t = np.arange(50)
    waves = [np.sin(2 * np.pi * 3 * t / 50), np.full(50, 7.0), np.cos(2 * np.pi * 20 * t / 50) * 4, np.sin(2 * np.pi * 10 * t / 50) + 1.0001 * np.sin(2 * np.pi * 3 * t / 50)]
    df = spark.createDataFrame([(1, [w.tolist() for w in waves], "kept")], "k long, x array<array<double>>, spectra string")
    out = features.spectra(df).first()
    s = out.spectra
    assert [c.dominant for c in s] == [3, 0, 20, 3] and s[1].energy == s[1].entropy == 0 and s[1].bands == [0, 0, 0]
    assert np.allclose(s[0].bands, [1, 0, 0]) and np.allclose(s[2].bands, [0, 0, 1]) and np.allclose(s[3].bands, [0.5, 0.5, 0], atol=1e-3)
    assert abs(s[0].entropy) < 1e-9 and abs(s[3].entropy - np.log(2) / np.log(25)) < 1e-6
    assert features.spectra(df.filter("false")).collect() == []
