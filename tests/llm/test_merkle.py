"""The manifest against a plain tree, its proofs against tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import common, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def build(leaves, fanout=16):
    """Top of the tree, and of each leaf the (left, right) siblings of every level."""
    level, where, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, at in enumerate(where):
            run, i = runs[at // fanout], at % fanout
            proofs[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
            where[k] = at // fanout
        level = [h(*run) for run in runs]
    return level[0], proofs


def plain(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h(*map(field, (doc_id, source, lang, n, text)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        now = h(*map(field, (doc_id, source, lang, n, lower(text)))) if bad else leaf
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, now))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in names:
        groups[s].sort()
        tops[s] = build([x[2] for x in groups[s]])
    root, above = build([tops[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, doc_id, leaf, now), own in zip(groups[s], tops[s][1], strict=True):
            folded = now
            for left, right in own + up:
                folded = h(left, folded, right)
            out.append((doc_id, leaf, tops[s][0], root, h(*[left + right for left, right in own + up]), folded, folded == root))
    return sorted(out, key=str)


def got(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    df = merkle.op12_merkle_manifest(spark, str(tmp_path))
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def corpus(sizes):
    r = random.Random(2)
    rows = []
    for k, n in sizes.items():
        rows += [(len(rows) * 7 % 100_003, r.choice(["Text A", "ü ẞ", "", "lower", "X" * 50_000]) if i % 9 else None, r.choice(["en", None]), k, r.choice([1, None])) for i in range(n)]
    return rows


def test_trees_of_all_shapes(spark, tmp_path):
    """Sources of one document, of a full run, of one more, of three levels; none; and ids and rows that are null or repeat."""
    rows = corpus({None: 5, "a": 1, "b": 16, "c": 17, "d": 300, "": 2, "é": 33})
    rows += [(None, "A", None, "d", 1), (None, "A", None, "d", 1), rows[40], (rows[40][0], "Other", "en", rows[40][3], 2)]
    found = got(spark, tmp_path, rows)
    assert found == plain(rows)
    assert 0 < sum(not x[-1] for x in found) < len(found) / 2


@pytest.mark.parametrize("sizes", [{"only": 40}, {"only": 1}, {f"s{i}": 1 for i in range(20)}])
def test_few_and_many_sources(spark, tmp_path, sizes):
    rows = corpus(sizes)
    assert got(spark, tmp_path, rows) == plain(rows)


def test_no_documents(spark, tmp_path):
    assert got(spark, tmp_path, []) == []


def test_manifest_proves_a_leaf(spark):
    leaves = spark.range(50).select(F.col("id").alias("key"), (F.col("id") % 3).alias("shelf"), merkle.leaf_hash(F.col("id")).alias("leaf"), F.lit("kept").alias("note"))
    m = merkle.manifest(leaves, group="shelf", order="key", carry=("note",), fanout=4)
    row = m.leaves.filter("key = 17").first()
    now = row["leaf"]
    for x in row["siblings"]:
        now = h(x["left"], now, x["right"])
    assert now == row["root"] and row["note"] == "kept" and m.leaves.count() == 50 and m.subroots.select("root").distinct().count() == 1
    assert {r["shelf"] for r in m.subroots.collect()} == {0, 1, 2}


def test_places_and_totals(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), r.choice([None, 1, 2, 3]), "long text " * 9 + r.choice("xyz")) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, a int, b string").repartition(5)
    got = common.numbered(df, ["k"], [F.col("a"), F.col("b")], "t").collect()
    for k in (None, "a", "b"):
        mine = sorted((x for x in got if x["k"] == k), key=lambda x: x["place"])
        assert [x["place"] for x in mine] == list(range(len(mine))) and {x["total"] for x in mine} == {len(mine)}
        assert [(x["a"], x["b"]) for x in mine] == sorted(((a, b) for x, a, b in rows if x == k), key=lambda y: (y[0] is not None, y[0] or 0, y[1]))
    every = common.numbered(df, [], [F.col("b")], "t").collect()
    assert sorted(x["place"] for x in every) == list(range(400))


def test_running_total_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN", 7)
    rows = [(k, i * 3, i % 5) for k in ("a", None) for i in range(60)]
    got = {(r["k"], r["at"]): r["before"] for r in common.running_total(spark.createDataFrame(rows, "k string, at int, v int"), ["k"], "at", "v", "before").collect()}
    assert got == {(k, i * 3): sum(j % 5 for j in range(i)) for k in ("a", None) for i in range(60)}
