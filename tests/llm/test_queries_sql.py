"""The queries that SQL can express against their SQL."""

import pytest

from loomgraph.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    want = sorted(map(str, (tuple(r) for r in found.fetchall())))
    assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect()))) == want
