"""Every registered query on one small set of tables: columns, types, null ids and the splits that the contract names."""

import zlib

import pytest

from parley.llm import registry

COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_quality": "doc_id bigint, score double, predicted int",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_conversation_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"wort{i % 7} der die das {'ja ' * (i % 30)}", ("de", "en", None)[i % 3], f"s{i % 3}" if i % 4 else None, i, "x") for i in range(120)]
    rows += [(None, "ohne id", "de", None, 1, "x"), (500, None, None, "s1", None, "x"), (501, "", "en", "s1", 0, "x"), (502, "lang " * 20000, "en", "s2", 1, "x"), (5, rows[5][1], "en", "s1", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, held_out string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 7 == 3)) for i in range(100)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [(i, [float(i % 11), 1.0, float(i % 3)], 0) for i in range(120)] + [(None, [1.0, 2.0, 3.0], 1), (200, None, 1), (250, [0.0, 0.0, 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(1, "http://com/en/", "h"), (None, None, None), (2, "", "h")], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(c, t, "user", f"t{t}") for c in (0, 3, 7) for t in range(4)] + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_columns_and_rows(spark, tables, name):
    got = registry.QUERIES[name](spark, tables)
    types = dict(got.dtypes)
    for column, kind in (x.split(" ") for x in COLUMNS[name].split(", ")):
        assert types[column] == kind
    rows = got.collect()
    if name not in ("op7_nearest", "op11_conversation_trie"):
        assert len(rows) == {"op4_embedding_near_dedup": 123, "op6_url_filter": 3}.get(name, 125)
    if "held_out" in types:
        n, out = (4, 2) if name == "op1_language_id" else (5, 0)
        for r in rows:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % n == out)
    if "score" in types and name != "op7_nearest":
        assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, tables, tmp_path, name):
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert set(x.split(" ")[0] for x in COLUMNS[name].split(", ")) <= set(got.columns) and got.count() == 0
