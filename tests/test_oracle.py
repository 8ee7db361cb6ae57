"""Every registered query against its DuckDB SQL on the sf0.001 tables (rows, columns, values)."""

import decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as se

from conftest import SF_SMALL
from mercato.plans.registry import QUERIES as OWN

TABLES = "region nation customer supplier part orders lineitem events".split()
# the library's own queries, each with SQL; those of mercato.llm are tested in tests/llm
QUERIES = {name: fn for name, fn in se.queries().items() if name in OWN}
SQL = {name: sql for name, sql in se.oracle_sql().items() if name in OWN}


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (decimal.Decimal, float)):
        f = round(float(v), 6)
        return str(int(f)) if f == int(f) else repr(f)
    if isinstance(v, pd.Timestamp):
        return v.date().isoformat() if v == v.normalize() else v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def canon(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) == set(OWN)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    rows = sdf.collect()
    s_pd = pd.DataFrame([r.asDict() for r in rows], columns=sdf.columns)
    d_pd = duck.execute(SQL[name]).fetch_df()
    assert sorted(s_pd.columns) == sorted(d_pd.columns)
    assert canon(s_pd) == canon(d_pd)


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["Categoria", "Producto", "Monto_Total_Ventas_Netas", "Ranking_en_Categoria", "ID_Producto"]
    assert df.count() > 0
