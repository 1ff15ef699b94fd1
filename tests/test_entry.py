"""The registered queries against their SQL, and the driver contract."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from loomgraph.queries import ORACLE, QUERIES
from loomgraph.query_base import EXAMPLE_SQL, EXAMPLES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_and_sql_agree(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    assert got[1]
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        assert got == table([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_examples_without_tables(spark, duck, name):
    df = EXAMPLES[name](spark, SF)
    found = duck.execute(EXAMPLE_SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in found.description], found.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
