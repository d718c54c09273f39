"""Every query with SQL of its own gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from pressroom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    found = rows(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert found
        return
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert found == rows(columns, result.fetchall())
