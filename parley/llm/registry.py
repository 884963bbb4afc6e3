"""The queries of this subpackage and their SQL counterparts, as far as SQL can express them."""

from __future__ import annotations

from parley.llm import bpe, embeddings, langid, merkle, mixing, quality, secrets, simhash, substring, toxicity, trie, url_filter


QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_bpe": bpe.op3_bpe,
    "op4_embedding_near_dedup": embeddings.op4_embedding_near_dedup,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_nearest": embeddings.op7_nearest,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_trie": trie.op11_conversation_trie,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_secret_scan": secrets.op13_secret_scan,
}

ORACLE = {
    "op4_embedding_near_dedup": embeddings.NEAR_SQL,
    "op5_substring_dedup": substring.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op11_conversation_trie": trie.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "op13_secret_scan": secrets.ORACLE_SQL,
}
