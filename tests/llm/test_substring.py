"""Window removal against a plain loop, crowded and uncrowded buckets alike."""

import hashlib
import random

import numpy as np
import pytest

from parley.llm import substring as s


def plain(rows, window=13):
    first = {}
    texts = {i: (t or "").encode().split() for i, t in rows}
    for i, ws in texts.items():
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, ws in texts.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out[i] = (len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed=3, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "the", "é x"]) if r.random() < 0.5 else f"w{r.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        ws = [word() for _ in range(r.randrange(0, 120))]
        if r.random() < 0.5:
            a = r.randrange(50)
            ws[len(ws) // 2 : len(ws) // 2] = passage[a : a + r.randrange(5, 60)]
        if r.random() < 0.2:
            ws += ["na"] * r.randrange(30)
        rows.append((i * 7 % 1000, r.choice([" ", "\n", " \t"]).join(ws)))
    return rows + [(5000, None), (5001, ""), (5002, "  "), (5003, rows[3][1]), (5004, rows[3][1].replace(" ", "\r\n")), (5005, "w1 " * 20000), (5006, "w1 " * 13)]


@pytest.mark.parametrize("crowded_most", [1 << 20, 3])
@pytest.mark.parametrize("step", [s.STEP, 4000])
def test_against_plain_loop(spark, monkeypatch, crowded_most, step):
    monkeypatch.setattr(s, "STEP", step)  # the small one parts the long text into pieces
    monkeypatch.setattr(s, "PIECE_WORDS", 1000)
    if crowded_most == 3:
        monkeypatch.setattr(s, "CROWDED_PART", 0.0)
        real = max
        monkeypatch.setattr(s, "max", lambda *a: 3 if a[0] == 256 else real(*a), raising=False)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, n_words int").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in s.remove_repeats(docs, digests=True).collect()}
    assert got == plain(rows)


def test_crowded_part_does_not_rise_with_the_input(spark):
    """Slots and bins grow with the windows, so a slot of ordinary text stays under the bound at any size."""
    from parley.llm.substring import BIN_WINDOWS, CROWDED_MOST, SLOT_BYTES

    assert SLOT_BYTES * 16 < CROWDED_MOST  # windows a slot has on average, were every byte's text 16 times as long
    assert BIN_WINDOWS < CROWDED_MOST


def test_one_id_with_two_texts(spark):
    t, u = " ".join(f"x{i}" for i in range(20)), " ".join(f"y{i}" for i in range(32))
    docs = spark.createDataFrame([(1, t), (3, t), (3, u), (3, u)], "doc_id int, text string")
    got = sorted(map(tuple, s.remove_repeats(docs).collect()))
    assert got == sorted([(1, t), (3, ""), (3, u), (3, u)])
    docs = spark.createDataFrame([(1, t), (3, t), (3, None)], "doc_id int, text string")
    assert sorted(map(tuple, s.remove_repeats(docs).collect()), key=str) == sorted([(1, t), (3, ""), (3, None)], key=str)


def test_ids_that_are_no_numbers(spark):
    with pytest.raises(ValueError, match="whole number"):
        s.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_clashing_column_names(spark):
    t = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(1, t, 7, 8, "s", "c"), (2, t + " z", 9, 10, "t", "d")], "doc_id long, text string, span_id int, key int, spans string, c0 string")
    assert sorted(map(tuple, s.remove_repeats(docs).collect())) == [(1, t, 7, 8, "s", "c"), (2, "z", 9, 10, "t", "d")]


def test_codes_tell_words_apart():
    words = ["a", "b", "abcdefg", "abcdefgh", "abcdefgi", "a\0", "\0", "abcdefghijklmnop", "abcdefghijklmnoq", "x" * 5000, "x" * 4999 + "y"]
    w = s.Words(" \t ".join(words * 2).encode())
    assert [w.string(i, i + 1).decode() for i in range(len(w.starts))] == words * 2
    codes = w.codes().tolist()
    assert codes[: len(words)] == codes[len(words) :] and len(set(codes)) == len(words)
    assert not w.clash(w.codes())
    long = s.Words(b"abcdefgh abcdefgi")
    assert long.clash(np.array([5, 5], np.uint64))


def test_texts_null_ids_repeats_and_empty(spark):
    t = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(None, t), (None, t), (1, t), (1, t), (2, "a  b"), (3, t + " y")], "doc_id long, text string")
    got = sorted(map(tuple, s.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(None, t), (None, t), (1, t), (1, t), (2, "a  b"), (3, "y")], key=str)
    assert s.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["a", "very_long_words_"])
def test_colliding_hashes_are_told_apart(monkeypatch, kind):
    a, b = [f"{kind}{i}" for i in range(13)], [f"b{kind}{i}" for i in range(13)]
    words = s.Words(" ".join(a + b + a).encode())
    monkeypatch.setattr(s, "_mix", lambda x: x * np.uint64(0))
    if kind == "a":  # short words are never told apart by a hash alone
        monkeypatch.setattr(s.Words, "codes", s.Words.numbers)
    got = s.repeats(words, np.array([1, 1, 1]), np.array([1, 2, 3]), np.array([0, 5, 9]), 13)
    assert [x.tolist() for x in got] == [[2], [9], [22]]
