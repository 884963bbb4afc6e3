"""The automaton against the tokenizers library and exact round trips."""

import hashlib
from functools import lru_cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parley.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def loaded():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture
def library():
    return loaded()


def same(library, text):
    mine, ids = bpe.load(PATH), library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(loaded(), text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabeehinnorst'éßΣ \x1c\t.,!0", max_size=80))
def test_dense_text(text):
    same(loaded(), text)


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "<|endoftext|>x<|startoftext|> <|END", "don't WE'LL", "ΑΣ ΑΣΑ İ", "e\u0301 \u0301x", "\u2000\u3000\x85", "½ Ⅷ ² 12", "日本語🙂\u200d"])
def test_cases(library, text):
    same(library, text)


def test_gadgets_of_a_small_automaton():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "aa", "ab", "bc", "aab"])}
    auto = bpe.Automaton(vocab, [("a", "a"), ("a", "b"), ("b", "c"), ("aa", "b")])
    read = lambda s: [auto.labels[i] for i in auto.encode(s)]
    assert read("aaa") == ["aa", "a"]
    assert read("abc") == ["ab", "c"]
    assert read("aab") == ["aab"]
    assert read("aaab") == ["aa", "ab"]
    assert not auto.follows(vocab["a"], vocab["aa"]) and auto.follows(vocab["aa"], vocab["a"])


def test_documents(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (5, "x" * 50000), (None, "<|endoftext|>")]
    docs = spark.createDataFrame([(a, b, "n") for a, b in rows], "doc_id long, text string, n_tokens string")
    for digests in (False, True):
        got = sorted(bpe.encode_documents(docs, PATH, digests).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
        assert len(got) == len(rows)
        for r, (_, text) in zip(got, rows, strict=True):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            if digests:
                assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            else:
                assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
