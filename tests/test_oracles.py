"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from veridate.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    own, sql = registry.QUERIES[name](spark, DATA).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows(own) == rows(sql)
