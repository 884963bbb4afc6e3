"""The stages of the pipeline on a small corpus, each against its brute-force counterpart."""

import random

import corpus_pipeline as p
import pytest

from parley.llm import bpe, simhash


def test_stages(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["th", "er", "an", "in", "ou", "le"]) for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(160):
        text = " ".join(word() for _ in range(r.randrange(40, 80)))
        if i % 4 == 1:
            text += " grob mist zzork"
        if i % 10 == 2:
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(500, rows[0][1], "en", "s1", 1), (501, None, None, None, None), (502, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(0, 160) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs.collect())
    clean = {x["doc_id"] for x in seen[0]}
    assert len([i for i in range(160) if i % 4 == 1 and i in clean]) <= 2 and len([i for i in range(160) if i % 4 != 1 and i in clean]) >= 115
    texts = {x["doc_id"]: x["text"] for x in seen[0]}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    kept = {x["doc_id"] for x in seen[1]}
    for i in texts:  # every document that went has a smaller one near it
        if i not in kept:
            assert any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for j in texts)
    assert 500 not in kept or 0 not in kept
    assert sum(passage in (x["text"] or "") for x in seen[2]) == 1
    assert all("text" in x for x in seen[3])
    tool = bpe.load(bpe.default_path())
    mixed = sorted((x["doc_id"], tool.encode(x["text"])) for x in seen[3])
    assert sorted((x["doc_id"], list(x["ids"])) for x in seen[4]) == mixed
    assert p.run(spark, str(tmp_path)).count() == len(mixed)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def labelled(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 0, 1)]])
def test_stages_on_no_documents(spark, labelled, labels):
    at = labelled(labels)
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        assert stage(spark, docs, at).count() == 0


def test_nothing_is_rejected_without_labels(spark, labelled):
    at = labelled([])
    docs = spark.createDataFrame([(1, "ein text", "de", "a", 1), (2, None, None, None, None)], SCHEMA)
    assert p.toxicity_stage(spark, docs, at).count() == 2


def test_stages_on_nulls_repeats_and_clashing_columns(spark, labelled):
    """Every stage on rows that repeat, null ids, null and empty texts, and columns that are called like the operators' own."""
    long = " ".join(f"wort{i}" for i in range(40))
    at = labelled([(1, 1, 0), (2, 1, 0), (3, 1, 1)])
    rows = [(1, long, "de", "s", 1, 7, "k"), (1, long, "de", "s", 1, 7, "k"), (None, long, "de", "s", 1, 8, "l"), (None, None, None, None, None, None, None), (4, "", "de", "t", 0, 9, "m"), (5, long + " mehr", "de", "t", 1, 1, "n"), (6, "kurz", "de", None, 1, 2, "o")]
    docs = spark.createDataFrame(rows, SCHEMA + ", component_id int, __gone_id string").withColumnRenamed("__gone_id", "spans")
    got = {name: stage(spark, docs, at) for name, stage in p.STAGES}
    assert all(got[name].columns == docs.columns for name, _ in p.STAGES[:-1])
    near = sorted((r["doc_id"], r["component_id"]) for r in got["near_duplicates"].collect() if r["doc_id"] is not None)
    assert near == [(1, 7), (1, 7), (4, 9), (6, 2)] and got["near_duplicates"].count() == 6
    texts = {(r["doc_id"], r["text"]) for r in got["substrings"].collect()}
    assert texts == {(1, long), (None, long), (None, None), (5, "mehr"), (6, "kurz")}
    mixed = got["mixing"].collect()
    assert {r["component_id"] for r in mixed} <= {7, 8, 1, 2} and sum(len(r["text"].split()) for r in mixed) == 162
    encoded = got["encoding"].collect()
    assert len(encoded) == 7 and sorted(r["n_tokens"] for r in encoded)[:2] == [0, 0]
