"""Every catalogue query at sf0.01 against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from weirflow.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for name in ("nation", "events", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_its_twin(spark, sf_dir, database, name):
    rows = QUERIES[name](spark, sf_dir)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    result = database.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
