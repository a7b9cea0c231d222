"""Spark queries against their DuckDB oracles on the smallest data set."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from tidemark.sources.driver_tables import DRIVER_TABLES

from .conftest import SF0001


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF0001)
    cols = sdf.columns
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=str)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    orows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=str)
    assert srows == orows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["risk_tier", "customer_count", "pct_of_portfolio", "arr_at_risk_usd"]
    assert df.count() >= 0


_CAT = {"bigint": "int", "double": "float", "string": "str", "date": "date", "timestamp": "ts",
        "timestamp_ntz": "ts", "boolean": "bool"}
_DCAT = {"BIGINT": "int", "DOUBLE": "float", "VARCHAR": "str", "DATE": "date", "TIMESTAMP": "ts", "BOOLEAN": "bool"}


@pytest.mark.parametrize("name", NAMES)
def test_query_types_match_oracle(spark, con, name):
    """Both sides use the boundary types only (BIGINT, DOUBLE, VARCHAR, DATE, TIMESTAMP, BOOLEAN)."""
    sdf = E.queries()[name](spark, SF0001)
    st = {f.name: _CAT.get(f.dataType.simpleString()) for f in sdf.schema.fields}
    rel = con.sql(E.oracle_sql()[name])
    dt = {c: _DCAT.get(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert st == dt and None not in st.values()
