"""Every registered query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from graphloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return str(list(x))
        if pd.isna(x):
            return ""
        return f"{x:.6f}" if isinstance(x, (float, np.floating)) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.astype(object)) == rows(want.astype(object))


def test_flagship(spark):
    df = registry.flagship(spark, SF)
    assert df.columns == ["root_id", "bucket", "shown", "hidden", "completeness"] and df.count() > 0
