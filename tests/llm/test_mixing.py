"""The mix against a brute-force water fill and the queue's own rules."""

import re
from collections import defaultdict

from parley.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), stop=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > stop * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: stop * sizes[s] for s in above}


def rows_of(spark, rows, schema="doc_id long, source string, text string"):
    return spark.createDataFrame(rows, schema)


def check(spark, rows):
    sent = mixing.mix_sources(rows_of(spark, rows), keep_idle=True).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, taken = brute_targets(sizes), defaultdict(int)
    by_doc = defaultdict(int)
    for r in sent:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["take"]
        by_doc[r["doc_id"], r["row_key"]] += r["take"]
        assert by_doc[r["doc_id"], r["row_key"]] <= 3 * r["size"]
    for s in sizes:  # to a packet of a document of the source, and the words of one document that the budget cuts
        most = max(len(WORD.findall(t or "")) for _, x, t in rows if x == s)
        assert abs(taken[s] - targets[s]) <= 1 + max(mixing.PACKET, -(-most // mixing.PACKETS))
    assert sum(taken.values()) == sum(sizes.values())
    return sent


def test_the_order_decides_what_is_taken(spark):
    """Another shuffle merges the queues otherwise, and other documents are cut or left out."""
    rows = [(i, f"s{i % 3}", "w " * (i % 19 + 1)) for i in range(200)]
    mixes = []
    for seed in (7, 8):
        sent = mixing.mix_sources(rows_of(spark, rows), seed=seed).collect()
        assert [x["finish"] for x in sent] == sorted(x["finish"] for x in sent)
        total = sum(len(t.split()) for _, _, t in rows)
        running = 0
        for x in sent[:-3]:  # all but the documents in service at the end are whole
            running += x["take"]
            assert x["take"] == x["size"] and running <= total
        mixes.append({(x["doc_id"], x["epoch"]): x["take"] for x in sent})
        assert sum(mixes[-1].values()) == total
    assert mixes[0] != mixes[1]


def test_targets_and_taken(spark):
    rows = [(i, f"s{i % 7}", "w " * (i % 50 + 1)) for i in range(300)]
    sent = check(spark, rows)
    finish = [r["finish"] for r in sent if r["take"]]
    assert all(0 < x for x in finish)


def test_hot_source_nulls_repeats_and_small_sources(spark):
    rows = [(i, "hot", "a b c") for i in range(200)] + [(i, None, "x y") for i in range(5)] + [(7, "tiny", "one two\u00a0three")] * 3 + [(9, "void", None), (10, "void", ""), (None, "z", "long " * 5000)]
    check(spark, rows)


def test_reruns_agree_and_order(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 9 + 1)) for i in range(100)]
    first, second = (sorted(map(tuple, mixing.mix_sources(rows_of(spark, rows)).drop("row_key").collect())) for _ in range(2))
    assert first == second


def test_empty_and_extra_columns(spark):
    assert mixing.mix_sources(rows_of(spark, [])).count() == 0
    docs = rows_of(spark, [(1, "a", "u v", 1, 2.0)], "doc_id long, source string, text string, size int, target double")
    assert [r["take"] for r in mixing.mix_sources(docs).collect()] == [2]


def test_mixed_documents_have_the_words_of_the_mix(spark):
    rows = [(i, f"s{i % 4}", " ".join(f"w{j}" for j in range(i % 40 + 1))) for i in range(80)]
    out = mixing.mixed_documents(rows_of(spark, rows)).collect()
    sizes, got = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    for r in out:
        got[r["source"]] += len(r["text"].split())
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= 1 + mixing.PACKET


def test_rows_that_share_an_id_are_sent_as_often_as_the_mix_says(spark):
    """Null and shared ids in several sources, equal rows, and the document cut at the budget."""
    rows = [(None, f"s{i % 3}", f"n{i} " * (i % 12 + 1)) for i in range(60)] + [(7, f"s{i % 4}", f"k{i} " * 5) for i in range(20)]
    rows += [(8, "s1", "one two three ")] * 7 + [(9, None, "x y z")] * 2 + [(i, "s2", f"w{i} v") for i in range(100, 130)]
    docs = rows_of(spark, rows)
    taken, sizes, got = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        taken[r["doc_id"], r["source"], r["text_hash"]] += r["take"]
    hashed = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    words = {t.split()[0]: t for _, _, t in rows}
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"], r["source"], hashed[words[r["text"].split()[0]]]] += len(r["text"].split())
    assert dict(got) == dict(taken)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    for s, t in brute_targets(sizes).items():
        assert abs(sum(n for k, n in got.items() if k[1] == s) - t) <= 1 + mixing.PACKET


def test_ten_thousand_sources_and_no_window_over_all_rows(spark):
    rows = [(i, f"s{i % 10_000}", "w " * (1 + i % 5)) for i in range(20_000)]
    sent = mixing.mix_sources(rows_of(spark, rows), keep_idle=True)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in sent.collect():
        taken[r["source"]] += r["take"]
    assert sum(taken.values()) == sum(sizes.values())
    assert max(abs(taken[s] - targets[s]) for s in sizes) <= 1 + mixing.PACKET


def test_what_is_in_service_at_the_end_is_spread(spark):
    """Long documents of many sources queue in packets beyond time 1, each in a range of its own time."""
    rows = [(i, f"s{i % 40}", "w " * 700) for i in range(80)]
    sent = mixing.mix_sources(rows_of(spark, rows), keep_idle=True).collect()
    by_source = defaultdict(int)
    for r in sent:
        by_source[r["source"]] += r["take"]
    targets = {r["source"]: r["target"] for r in sent}
    assert sum(by_source.values()) == 56_000 and all(abs(by_source[s] - targets[s]) <= 1 + mixing.PACKET for s in targets)
