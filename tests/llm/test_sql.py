"""The queries that have SQL, against it."""

import duckdb
import pytest
from rangeloom.llm import queries


def same(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    same(spark, name, "/root/testdata/sf0.01")
