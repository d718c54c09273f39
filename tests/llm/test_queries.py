"""The training-data queries that SQL can express give the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from pressroom.llm.queries import oracle_sql, queries
from tests.test_queries import rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    df = queries()[name](spark, DATA)
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())
