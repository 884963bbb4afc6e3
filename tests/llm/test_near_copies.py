"""Near copies against all pairs of whole shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from parley.llm import near_copies as c
from parley.llm import simhash


def plain_set(text):
    ws = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "").encode().split()
    return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain_groups(rows):
    sets, parent = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited(r, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[r.randrange(len(ws))] = f"z{r.randrange(10**6)}"
    return ws


def corpus(seed=3):
    """Texts with 0 to 9 edited words of 150, one crowd of near copies, chains of edits, short, null and empty texts."""
    r, rows = random.Random(seed), []
    word = lambda: f"w{r.randrange(4000)}"
    for _ in range(25):
        base = [word() for _ in range(150)]
        rows += [" ".join(edited(r, base, r.randrange(0, 10))) for _ in range(4)]
    base = [word() for _ in range(200)]
    rows += [" ".join(edited(r, base, r.randrange(0, 7))) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for _ in range(15):
        chain = edited(r, chain, 1)
        rows.append(" ".join(chain))
    rows += ["a b c", "A b  C", "a b d", None, "", " ", rows[0].upper()]
    ids = r.sample(range(5000), len(rows))
    return list(zip(ids, rows, strict=True))


def test_sets_are_those_of_the_definition():
    for text in [None, "", " \t", "One", "a B c D", "a b c d e", "a b c d e f", "É x " * 50, "w " * 9000]:
        assert len(c.shingle_set(text)) == len(plain_set(text))
    x, y = c.shingle_set("a b c d e f g h i"), c.shingle_set("A B c d e f g h z")
    assert len(np.intersect1d(x, y)) == 4 and not c.similar(x, y) and c.similar(x, x)


@pytest.mark.parametrize("size", [512, 7])
def test_groups_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(c, "STAR", size)
    monkeypatch.setattr(c, "BLOCK", size)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    want = plain_groups(rows)
    assert {x["doc_id"]: x["component_id"] for x in c.near_copies(docs).collect()} == want
    assert {x["doc_id"] for x in simhash.keep_first(docs, width=5, similarity=0.8).collect()} == set(want.values())


def test_the_stage_takes_copies_beyond_four_bits(spark):
    """One pair of 0.8 and more that four bits of 4-word shingles do not link; before, the stage kept both."""
    r = random.Random(8)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    copies = [" ".join(edited(r, base, 2)) for _ in range(40)]
    near = [t for t in copies if 5 * len(plain_set(t) & plain_set(" ".join(base))) >= 4 * len(plain_set(t) | plain_set(" ".join(base)))]
    far = next(t for t in near if (simhash.fingerprint(t) ^ simhash.fingerprint(" ".join(base))).bit_count() > 4)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, far), (3, "quite another text of some words")], "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()} == {1, 3}


def test_repeats_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (1, "A B")], "doc_id long, text string")
    assert {x["component_id"] for x in c.near_copies(docs).collect()} == {1}
    assert c.near_copies(docs.limit(0)).count() == 0


def test_fingerprints_are_majorities_of_bits():
    for n in (0, 1, 2, 3, 50, 9000):
        shingles = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        hashes = [int(x) for x in c._mix(shingles[:, None] * c._FACTORS).ravel()]
        want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes[w :: c.WORDS]) > n) for w in range(c.WORDS)] if n else []
        assert c.fingerprints_of(shingles).view(np.uint64).tolist() == want


def test_candidates_share_a_cell_of_segment_counts_and_are_near():
    """Pairs of sets at a similarity of 0.8, the least there is: of their SimHashes nearly all share a cell in which they are near."""
    r, found, total = np.random.default_rng(4), 0, 600
    for _ in range(total):
        both, own, other = np.split(r.integers(0, 1 << 63, 200 + 50).astype(np.uint64), [200, 225])
        sets = [np.sort(np.concatenate([both, x])) for x in (own, other)]
        columns = [pa.array([1, 2]), c._lists([c.fingerprints_of(x) for x in sets]), c._lists([c.prefix_of(x) for x in sets])]
        dealt, firsts = c._spread(c.cell_masks(1000))([pa.RecordBatch.from_arrays(columns, ["class", "fps", "prefix"])])
        assert not firsts.num_rows
        table = sorted(zip(*[x.to_pylist() for x in dealt.columns], strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*table, strict=True)], dealt.schema.names)
        found += any(b.num_rows for b in c._grouped([batch.slice(0, 31), batch.slice(31)]))
    assert found >= 0.99 * total


@pytest.mark.parametrize("slab", [256, 3])
def test_near_in_a_cell_against_all_pairs(monkeypatch, slab):
    monkeypatch.setattr(c, "SLAB", slab)
    r = np.random.default_rng(6)
    fps = r.integers(0, 1 << 63, (30, 2)).astype(np.uint64)
    chain = [fps[0]]
    for _ in range(12):  # each within the distance of the one before
        chain.append(chain[-1] ^ np.array([sum(1 << int(b) for b in r.choice(64, 17, replace=False)) for _ in range(2)], np.uint64))
    fps = np.concatenate([fps, chain])[r.permutation(43)]
    want = np.arange(43)
    for _ in range(43):
        for i in range(43):
            for j in range(43):
                if sum(int(x).bit_count() for x in fps[i] ^ fps[j]) <= c.DISTANCE:
                    want[i] = want[j] = min(want[i], want[j])
    assert c.near_in_cell(fps).tolist() == want.tolist()


def test_few_shingles_share_one_of_the_first():
    r = np.random.default_rng(7)
    for n in range(1, c.FEW + 1):
        for lost in range(n // 5 + 1):
            for added in range(n):
                if 5 * (n - lost) >= 4 * (n + added):
                    for _ in range(30):
                        x = r.integers(0, 1 << 63, n + added).astype(np.uint64)
                        assert np.intersect1d(c.prefix_of(np.sort(x[:n])), c.prefix_of(np.sort(x[lost:]))).size
    assert not len(c.prefix_of(np.arange(21, dtype=np.uint64))) and not len(c.prefix_of(np.zeros(0, np.uint64)))


def test_documents_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    """Fingerprints are near where a passage makes up most of a text; before, all of these met in each of their cells, thousands of rows."""
    r, written, cut = random.Random(5), {}, c.cut

    def counted(df, tag):
        out = cut(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(c, "cut", counted)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(120)]
    texts = [[word() for _ in range(15)] + passage + [word() for _ in range(15)] for _ in range(120)]
    texts += [edited(r, t, k) for t in texts[:10] for k in (1, 2)]
    rows = list(zip(r.sample(range(5000), len(texts)), [" ".join(t) for t in texts], strict=True))
    want = plain_groups(rows)
    assert {x["doc_id"]: x["component_id"] for x in c.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert len(set(want.values())) < len(rows) - 10  # some are near copies
    assert written["rest"] <= 2 * len(rows) and written["stars"] <= 2 * len(rows)


def test_parts_hold_all_pairs_of_components_and_a_large_one_does_not_meet_itself(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 7)
    counts = []
    for m in (60, 120):
        rows = [(i, 0 if i < m else i, (2, 9), 3) for i in range(m + 10)] + [(i, 0, (2, 5), 1) for i in range(m)] + [(i, 0 if i < m else i, (2, 10), 4) for i in range(m + 10)]
        rows = spark.createDataFrame(rows, "class long, component long, key struct<held:long,shingle:long>, place long")
        got = c._parted(rows).collect()
        assert {x["shingle"] for x in got} == {9}  # one component holds the 5, and the 10 has the classes of the 9
        parts = {}
        for x in got:
            parts.setdefault(x["part"], []).append(x)
        met = [tuple(sorted((x["class"], y["class"]))) for p in parts.values() for x in p for y in p if x["class"] < y["class"] and (x["block"] != y["block"] or len({z["block"] for z in p}) == 1)]
        apart = [p for p in met if p[1] >= m]
        assert len(apart) == len(set(apart)) == 10 * m + 45 and not [p for p in met if p[1] < m]
        counts.append(len(got))
    assert counts[1] <= 2 * counts[0]
