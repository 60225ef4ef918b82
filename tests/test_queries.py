"""Registered queries against a second engine on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lapwing.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(d: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(d.columns):
        if pd.api.types.is_numeric_dtype(d[c]):
            out[c] = d[c].astype("float64").round(5)
        else:
            out[c] = d[c].map(lambda x: "" if pd.isna(x) else str(x).removesuffix(" 00:00:00"))
    return pd.DataFrame(out).sort_values(list(out)).reset_index(drop=True)


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, oracle, name):
    pd.testing.assert_frame_equal(normal(QUERIES[name](spark, SF).toPandas()), normal(oracle.sql(ORACLES[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
