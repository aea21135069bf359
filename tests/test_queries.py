"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from stridewell.plans import queries

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def frame(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    return df[cols].sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = frame(queries.QUERIES[name](spark, DATA).toPandas()), frame(duck.execute(queries.ORACLE_SQL[name]).df())
    assert len(want) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9)


def test_every_query_has_sql_or_is_known():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"g_fit_predict", "g_linear_erm", "g_linear_sam"}


def test_networks_predict_every_window(spark):
    n = queries.QUERIES["c_dataset_shape"](spark, DATA).first().n
    out = queries.QUERIES["g_fit_predict"](spark, DATA).toPandas()
    assert len(out) == n and set(out.p) <= set(out.y) and out.window_id.is_unique


@pytest.mark.parametrize("mode", ["erm", "sam"])
def test_linear_models_predict_every_window(spark, mode):
    out = queries.QUERIES[f"g_linear_{mode}"](spark, DATA).toPandas()
    assert len(out) == queries.QUERIES["c_dataset_shape"](spark, DATA).first().n
    assert out.window_id.is_unique and set(out.p) <= set(out.y) and set(out.fold) == set(range(5))
