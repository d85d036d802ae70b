"""Every reference query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessaryn.plans import general, reference

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(df):
    def one(x):
        if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
            return "NULL"
        if isinstance(x, float) or "float" in str(type(x)):
            return f"{float(x):.9g}"
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = reference.QUERIES[name](spark, DIR).toPandas()
    if name in reference.SQL:
        want = duck.sql(reference.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert shown(got) == shown(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_general_queries_run(spark, name):
    assert general.QUERIES[name](spark, DIR).count() >= 0
