"""The registered training-data queries against their DuckDB SQL on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as se
import corpus_pipeline
from mercato.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(se.queries())
    assert {*QUERIES, "pipeline"} <= names and [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()  # every column, and no other
    assert columns == sorted(c[0] for c in con.execute(f"SELECT * FROM ({ORACLE_SQL[name]}) LIMIT 0").description)
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, want))
