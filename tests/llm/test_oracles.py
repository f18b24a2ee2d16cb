"""Corpus queries that SQL can state, against DuckDB."""

import duckdb
import pytest

from almanac.llm.queries import ORACLE, QUERIES
from conftest import SMALL
from test_queries import multiset


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert multiset(df.columns, [tuple(r) for r in df.collect()]) == multiset(columns, result.fetchall())


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, len(QUERIES) + 1)]
