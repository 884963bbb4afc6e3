"""Fingerprints against the definition, groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from parley.llm import simhash as h


def plain_fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))


def plain_groups(ids, fps, distance=4):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint(monkeypatch):
    for chunk in (h.CHUNK, 7):  # long texts are hashed in chunks
        monkeypatch.setattr(h, "CHUNK", chunk)
        for text in [None, "", " \t", "One", "a B c D", "a b c d e", "É x " * 50, "the same four words " * 9, "one TWO three " * 700, " ".join(f"w{i * i % 997}" for i in range(3000))]:
            assert h.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("subspaces", [6, 7, 8, 10])
def test_manhattan_is_a_lower_bound_and_cells_lose_nothing(subspaces):
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 2000, np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << r.integers(0, 64, 2000).astype(np.uint64)
    assert (h.cells_of(x, subspaces) == h.cells_of(y, subspaces)).any(axis=1).all()
    assert h.near(x, y, 4).all()
    assert not h.near(x, ~x, 4).any()
    plain = [sum(abs((a >> 2 * k & 3).bit_count() - (b >> 2 * k & 3).bit_count()) for k in range(32)) for a, b in zip(x.tolist(), y[::-1].tolist(), strict=True)]
    assert h.manhattan(x, y[::-1]).tolist() == plain


def test_cells_get_finer_with_the_fingerprints():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 100000, np.uint64)
    fullest = [np.unique(h.cells_of(x, s), return_counts=True)[1].max() for s in (6, 7, 8)]
    assert fullest[0] > 2 * fullest[1] > 4 * fullest[2]
    assert [h.subspaces_for(n) for n in (0, 1 << 22, 1 << 24, 1 << 27)] == [6, 6, 7, 8]


def documents(n=150, seed=5):
    r = random.Random(seed)
    rows, base = [], [" ".join(r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(r.randrange(1, 300))) for _ in range(25)]
    for i in range(n):
        ws = r.choice(base).split(" ")
        for _ in range(r.randrange(0, 3)):
            ws[r.randrange(len(ws))] = f"z{r.randrange(9)}"
        rows.append((i * 11 % 1009, " ".join(ws)))
    return rows + [(2000, None), (2001, ""), (2002, " "), (2003, rows[0][1].upper())]


def test_groups_against_all_pairs(spark):
    rows = documents()
    ids, fps = [i for i, _ in rows], [h.fingerprint(t) for _, t in rows]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in h.near_duplicates(docs).collect()}
    want = plain_groups(ids, fps)
    assert got == {i: (f, want[i]) for i, f in zip(ids, fps, strict=True)}
    kept = {r["doc_id"] for r in h.keep_first(docs).collect()}
    assert kept == set(want.values())


def test_crowded_cells_in_blocks(spark):
    r = random.Random(2)
    fps = list({(0x0F0F << 20) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(400)} | {r.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from parley.llm.common import components

    got = {r["node"]: r["component"] for r in components(h.near_links(df, block=16)).collect()}
    want = plain_groups(signed, [f & (1 << 64) - 1 for f in signed])
    assert {i: got.get(i, i) for i in signed} == want


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (1, "A B")], "doc_id long, text string")
    assert {r["component_id"] for r in h.near_duplicates(docs).collect()} == {1}
    assert h.near_duplicates(docs.limit(0)).count() == 0


def test_the_callers_columns_may_have_any_name(spark):
    names = "doc_id long, text string, __gone_id int, gone_id int, doc_0 int, component_id int, fp int"
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4, 5), (2, "a b c d e f", 6, 7, 8, 9, 10), (3, "other words than those are here", 1, 1, 1, 1, 1)], names)
    for similarity in (None, 0.8):
        got = h.keep_first(df, width=5, similarity=similarity)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a b c d e f", 1, 2, 3, 4, 5), (3, "other words than those are here", 1, 1, 1, 1, 1)]
