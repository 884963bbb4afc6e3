"""The queries that SQL can express against it, on the smallest tables."""

import os

import duckdb
import pytest

from parley.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel, df = con.sql(registry.ORACLE[name]), registry.QUERIES[name](spark, SF)
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want
