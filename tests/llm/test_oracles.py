"""Registered queries with an oracle equal DuckDB."""

from pathlib import Path

import duckdb
import pytest

from orrery.llm.oracles import SQL
from orrery.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == want and want
