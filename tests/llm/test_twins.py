"""Operators with an SQL twin, at sf0.01 against DuckDB."""

import duckdb
import pytest

from weirflow.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_equals_its_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    rows, result = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(rows.columns)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
