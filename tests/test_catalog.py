"""Each registered query with SQL against DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.plans import catalog


def rows(table):
    def cell(v):
        if isinstance(v, float):
            return "NULL" if math.isnan(v) else round(v, 9)
        return "NULL" if v is None else v

    names = sorted(table.column_names)
    return sorted((tuple(cell(v) for v in r) for r in zip(*(table[n].to_pylist() for n in names), strict=True)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    with duckdb.connect() as c:
        for f in Path(sf).glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        yield c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, duck, name):
    ours = catalog.queries()[name](spark, sf).toArrow()
    theirs = duck.execute(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
