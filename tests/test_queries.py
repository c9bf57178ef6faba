"""Every registered core query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from lagfield.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def ordered(df):
    df = df[sorted(df.columns)]
    keys = [c for c in df.columns if df[c].dtype.kind not in "f"] or list(df.columns)
    return df.sort_values(keys + [c for c in df.columns if c not in keys]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.SQL[name]).df()
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=1e-9, atol=2e-6)
