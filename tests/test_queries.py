"""Every query of the registry against its SQL counterpart on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from parley.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLE:
        assert rows
        return
    rel = duck.sql(registry.ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert rows == want


def test_thresholds_after_a_review_that_archives_entries_without_a_language(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.15, 12).astype("float32").tolist(), int(rng.choice([1, 2, 3, 6]))) for i in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    after = registry.QUERIES["archive_after"](spark, str(tmp_path))
    assert after.filter("lang IS NULL").count() > 0
    rel = con.sql(registry.ORACLE["recalibrate"])
    want = sorted(tuple(map(plain, r)) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in rel.columns) for r in registry.QUERIES["recalibrate"](spark, str(tmp_path)).collect())
    assert got == want and len(want) > 2
