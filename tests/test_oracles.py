"""Every registered query against its SQL text, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quietgrid.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert len(a) == len(b)
    keys = [c for c in columns if not pd.api.types.is_float_dtype(a[c])] + [c for c in columns if pd.api.types.is_float_dtype(a[c])]
    a, b = (x[columns].sort_values(keys).reset_index(drop=True) for x in (a, b))
    for c in columns:
        if pd.api.types.is_float_dtype(a[c]):
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=2e-5, rtol=1e-6, err_msg=c)
        else:
            assert (a[c].astype(str).to_numpy() == b[c].astype(str).to_numpy()).all(), c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        same(got, duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
