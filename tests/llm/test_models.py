"""Language ID, toxicity and quality: definitions, edge cases and held-out accuracy on made-up texts."""

import random
import zlib

import numpy as np

from parley.llm import langid, quality, toxicity

SYLLABLES = {"aa": ["ba", "no", "ti", "ru"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["ción", "os", "ñ", "la"]}


def texts(n=150, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), lang))
    return out


def test_language_id_held_out(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, score string")
    profiles = langid.learn(docs.filter("doc_id % 4 <> 2"))
    assert set(profiles) == set(SYLLABLES)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, profiles).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in rows if i % 4 == 2]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? ½"), (4, "nono " * 30000), (4, "nono " * 30000), (None, "ein")], "doc_id long, text string")
    got = langid.identify(docs, {"aa": ["n", "o", "no"], "bb": ["e", "in"]}).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:3]] == [("und", 0.0)] * 3
    assert [r["lang_pred"] for r in got[3:]] == ["aa", "aa", "bb"]
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), {"aa": ["n"]}).count() == 0
    assert langid.learn(docs.limit(0).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")) == {}


def test_out_of_place_distance_by_hand():
    judge = langid.Judge({"x": ["a", "b"], "y": ["b", "c"]}, most=2, longest=1)
    # the text's ranking is a, b: x is 0 out of place; y: a is missing (2), b is one off (1)
    assert judge.judge("aab") == ("x", 1 / (1 + 0.25))


def toxic_texts(n=400, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ws = ["".join(r.choice(["th", "er", "an", "in", "ou", "le"]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 120))]
        label = int(r.random() < 0.4)
        for _ in range(label * 2):
            ws.insert(r.randrange(len(ws) + 1), r.choice(["grob", "mist", "zzork" + r.choice(["a", "on", "er", "le", "ti", "ri"])]))
        out.append((i, " ".join(ws), label))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_texts()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 5], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, scorer).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i % 5 == 0]) > 0.9
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, scorer).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    long = "then " * 9000 + "grob mist zzorkon " + "then " * 9000
    assert scorer.texts([None, "", long, "then " * 18000]).tolist()[2] > 0.5 > scorer.texts(["then " * 18000])[0]
    assert np.isfinite(scorer.texts([None, "", " | "])).all()


def test_long_words_are_read_to_their_end():
    r = random.Random(6)
    for n in (1, 64, 65, 120, 121, 1000):
        word = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n))
        pieces = toxicity.split(f"so {word} (it)")[1:-1]
        assert all(len(x) <= toxicity.PIECE for x in pieces)
        assert {word[a : a + 5] for a in range(max(1, n - 4))} <= {x[a : a + 5] for x in pieces for a in range(len(x))}
    scorer = toxicity.Scorer(toxicity.Network(1))
    same, other = scorer.texts(["a" * 64 + "then" * 50, "a" * 64 + "then" * 40 + "mist" * 10])
    assert same != other


def test_toxicity_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    assert toxicity.score(docs.limit(0), toxicity.train([], [])).count() == 0


def test_gradients_against_differences():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = r.standard_normal((6, 2 * toxicity.DIMS))
    at = np.array([[0, 1, 2, 3], [4, 5, 0, -1], [2, -1, -1, -1]])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    _, g, d_x = net.gradients(x, at, y, w)
    for name in ("wf", "uf", "ub", "cb", "att", "out"):
        flat = net.p[name].reshape(-1)
        for i in r.integers(0, len(flat), 3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = net.gradients(x, at, y, w)[0]
            flat[i] = old - 1e-3
            down = net.gradients(x, at, y, w)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[i]) < 2e-3
    x[4, 3] += 1e-3
    up = net.gradients(x, at, y, w)[0]
    x[4, 3] -= 2e-3
    assert abs((up - net.gradients(x, at, y, w)[0]) / 2e-3 - d_x[4, 3]) < 2e-3


def test_all_windows_cover_every_word():
    for n in range(0, 200):
        rows = toxicity.window_rows(list(range(n)))
        assert set(range(n)) <= set(rows.ravel().tolist())
        assert len(rows) == 1 or set(np.diff(rows[:, 0])) == {toxicity.STRIDE}


def quality_texts(n=300, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ws = ["".join(r.choice(["tha", "er", "an", "ing"]) for _ in range(2)) for _ in range(r.randrange(40, 90))]
        bad = r.random() < 0.3
        ws = [w.upper() + "!!" if bad and i % 2 else "|" if bad and r.random() < 0.5 else w + "." * (r.random() < 0.1) for w in ws]
        out.append((i, " ".join(ws), int(not bad)))
    return out


def test_quality_without_true_labels(spark):
    rows = quality_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model, scorer = quality.fit(docs)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, scorer).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows]) > 0.9
    assert 0.5 < model.share < 0.9
    assert quality.score(docs.limit(0), scorer).count() == 0
    assert scorer.one(*quality.Hashed().text(None)) == scorer.one(*quality.Hashed().text(" "))


def test_label_model_finds_accuracies():
    r = np.random.default_rng(5)
    good = r.random(20000) < 0.8
    right = [0.9, 0.7, 0.95, 0.6, 0.8, 0.85, 0.75, 0.9, 0.65]
    votes = np.stack([np.where(r.random(20000) < a, good, ~good) * 2 for a in right], axis=1)
    ids, n = np.unique(votes @ 3 ** np.arange(9), return_counts=True)
    model = quality.LabelModel(dict(zip(ids.tolist(), n.tolist(), strict=True)))
    assert abs(model.share - 0.8) < 0.02
    assert all(abs(model.chance[1, k, 2] - a) < 0.03 for k, a in enumerate(right))
    assert quality.LabelModel({}).share == 0.5


def test_crc_split_matches_the_query(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(50).select(F.crc32(F.col("id").cast("string")) % 4).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]


def test_packed_grams_against_plain_counting():
    from collections import Counter

    import regex

    r = random.Random(8)
    for k in range(300):
        text = "".join(r.choice("ab é_-1\ńñß日\U00010400Σ") for _ in range(k % 60))
        want = Counter()
        for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
            padded = f"_{w}_".encode("utf-16-le")  # n-grams are of UTF-16 units
            for n in range(1, 5):
                grams = [padded[2 * i : 2 * (i + n)].decode("utf-16-le", "surrogatepass") for i in range(len(padded) // 2 - n + 1)]
                want.update(langid.pack(g) for g in grams if g != "_")
        keys, counts = langid.count_grams(text, 4)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == (dict(want) if any(c.isalpha() for c in text) else {})


def test_letters_beyond_16_bits_are_their_own():
    """Two letters that differ only above 16 bits, and one of 16 bits with the same low bits, are three n-grams."""
    keys = [set(langid.count_grams(c, 4)[0].tolist()) for c in ("\U00010400", "\U00020400", "Ѐ")]
    assert len(keys[0] & keys[1]) == 0 and len(keys[0] & keys[2]) == 0
    got = dict(zip(*langid.count_grams("a\U00020400", 2), strict=True))
    assert got[langid.pack("a")] == 1 and got[langid.pack("a\ud841")] == 1 and got[langid.pack("_a")] == 1


def test_all_languages_and_null_ids_teach(spark):
    rows = [(None if i % 2 else i, f"{chr(97 + i % 20)}xy " * 3, f"l{i:04d}") for i in range(1100)]
    profiles = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(profiles) == 1100


def test_quality_against_a_plain_model(spark):
    """Patterns, chances and scores of the operator against the same rules in plain loops, with nulls, repeats, a very long text and clashing columns."""
    rows = [(i, t, 0) for i, t, _ in texts(60)] + [(100, None, 1), (101, "", 1), (102, "word " * 20000, 1), (102, "word " * 20000, 1), (None, "!!! ??? ###", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pattern int")
    model, scorer = quality.fit(docs)
    counts = {}
    for _, t, _ in rows:
        p = sum(v * 3**i for i, v in enumerate(quality.votes(t)))
        counts[p] = counts.get(p, 0) + 1
    plain = quality.LabelModel(counts)
    assert all(abs(plain.of_pattern(p) - model.of_pattern(p)) < 1e-12 for p in counts)
    one = quality.Hashed()
    want = sorted((str(i), round(scorer.one(*one.text(t)), 12)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), round(r["score"], 12)) for r in quality.score(docs, scorer).collect()) == want
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0))[1]).count() == 0


def test_shapes_are_of_whole_words():
    assert quality.shape("a" * 30 + "1") == "a0" and quality.shape("Ab1!" * 9) == "Aa0!" * 9


def plain_grams(text):
    """Counts of n-grams of UTF-16 units by the definition, in the order of frequency and then of units."""
    from collections import Counter

    import regex

    found = Counter()
    for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
        units = np.frombuffer(f"_{w}_".encode("utf-16-le"), np.uint16).tolist()
        for n in range(1, 5):
            found.update(g for g in (tuple(units[i : i + n]) for i in range(len(units) - n + 1)) if g != (ord("_"),))
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0] + (0,) * (4 - len(x[0]))))]


def test_language_id_against_plain_loops(spark):
    """Profiles, out-of-place distances, winners and scores of the query's operator against lists and loops, over whole texts."""
    rows = texts(90, seed=4) + [(200, "ba " * 30000, "aa"), (201, None, "aa"), (202, "", "bb"), (203, "12 !?", "bb"), (0, "ein wort mehr", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    learned = {lang: plain_grams(" ".join(t for _, t, x in rows if x == lang and t))[:300] for lang in SYLLABLES}
    for lang, grams in learned.items():
        assert profiles[lang] == [sum(u << 48 - 16 * i for i, u in enumerate(g)) for g in grams]
    place = {lang: {g: i for i, g in enumerate(grams)} for lang, grams in learned.items()}
    want = {}
    for i, t, _ in rows:
        top = plain_grams(t or "")[:300]
        if not top:
            want[i, t] = ("und", 0.0)
            continue
        far = {lang: sum(min(abs(at[g] - k), 300) if g in at else 300 for k, g in enumerate(top)) for lang, at in place.items()}
        close = {lang: 1 - d / (300 * len(top)) for lang, d in far.items()}
        best = min(sorted(far), key=far.get)
        want[i, t] = (best, close[best] / sum(close.values()) if sum(close.values()) else 0.0)
    got = langid.identify(docs, profiles).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted((i, *want[i, t][:1], round(want[i, t][1], 9)) for i, t, _ in rows)


def test_toxicity_against_plain_loops():
    """Scores of whole texts against a window, word and gate at a time, by the network's definition."""
    import math

    rows = toxic_texts(120, seed=5)
    scorer = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=2)
    net, h = scorer.net, toxicity.HIDDEN
    logistic = lambda x: 1 / (1 + math.exp(-x))

    def states(xs, way):
        w, u, c = (net.p[k + way].astype(float) for k in "wuc")
        out, state = [None] * len(xs), np.zeros(h)
        for t in range(len(xs)) if way == "f" else range(len(xs) - 1, -1, -1):
            x = xs[t] @ w + c
            zr = [logistic(v) for v in x[: 2 * h] + state @ u[:, : 2 * h]]
            z, r = np.array(zr[:h]), np.array(zr[h:])
            new = np.tanh(x[2 * h :] + (r * state) @ u[:, 2 * h :])
            state = state + z * (new - state)
            out[t] = state
        return out

    def plain(text):
        words = toxicity.split(text)
        best = -math.inf
        for a in toxicity.windows(len(words)):
            part = words[a : a + toxicity.WINDOW]
            if not part:
                best = max(best, float(net.p["bias"][0]))
                continue
            xs = net.inputs(toxicity.features(part)).astype(float)
            both = [np.r_[f, b] for f, b in zip(states(xs, "f"), states(xs, "b"), strict=True)]
            weight = np.array([s @ net.p["att"] for s in both])
            weight = np.exp(weight - weight.max())
            pooled = sum(w * s for w, s in zip(weight / weight.sum(), both, strict=True))
            best = max(best, float(pooled @ net.p["out"] + net.p["bias"][0]))
        return logistic(max(-30, min(30, (best - scorer.shift) * scorer.scale)))

    some = [t for _, t, _ in rows[:25]] + ["x" * 400, "wort " * 400, "ein", "aß ẞ"]
    assert np.allclose(scorer.texts(some), [plain(t) for t in some], atol=2e-4)
    empty = scorer.texts([None, "", "  "])
    assert len(set(empty.tolist())) == 1 and 0 <= empty[0] <= 1
