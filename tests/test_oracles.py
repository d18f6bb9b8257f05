"""Every registered query of the library against its DuckDB twin, on the tables of the correctness gate."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.operators import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if value is None or isinstance(value, (int, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(repr([plain(r[n]) for n in names]) for r in frame.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        assert got == sorted(repr([plain(dict(zip(columns, r))[n]) for n in names]) for r in found.fetchall())
