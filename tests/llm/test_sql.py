"""Every corpus query with SQL gives the rows that DuckDB gives on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm import queries
from tests.test_oracles import TABLES, canonical


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns) and got == canonical(cursor.fetchall(), names)
