"""Forms that hold at scale against plain loops: doubled pointers, blocked scores, bracketed quantiles, carried scans, bounds of similarity."""

import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import steps
from parley.functions import scalars as s
from parley.operators import archive, carried, closure, scores, sequences, voice


def walked(merges):
    """(final, hops, ring) of each (key, id) by walking."""
    found = {}
    for k, i in merges:
        path, now = [i], merges[k, i]
        while (k, now) in merges and now not in path:
            path.append(now)
            now = merges[k, now]
        found[k, i] = (now, len(path), now in path)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_closure_against_walks(spark, seed):
    r = random.Random(seed)
    merges = {(k, i): r.randrange(40) for k in range(12) for i in range(30) if r.random() < (0.9 if k % 2 else 0.5)}
    rows = [(k, i, t) for (k, i), t in merges.items()] + [(0, None, 3), (None, 1, 2), (1, 5, None)]
    got = {(x["decision"], x["id"]): (x["final"], x["hops"], x["ring"]) for x in closure.merge_closure(spark.createDataFrame(rows, "decision int, id int, target int")).collect()}
    assert got == walked(merges)


def test_closure_of_many_merges_and_a_long_chain(spark):
    many = spark.range(400_000).selectExpr("1 AS decision", "id + 1000000 AS id", "-1L AS target")
    chain = spark.range(3000).selectExpr("1 AS decision", "id", "id + 1 AS target")
    got = closure.merge_closure(many.unionByName(chain)).groupBy("final", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("hops").alias("hops")).collect()
    assert sorted(map(tuple, got)) == [(-1, False, 400_000, 1), (3000, False, 3000, 3000)]


def test_closure_of_nothing(spark):
    assert closure.merge_closure(spark.createDataFrame([], "decision int, id string, target string")).count() == 0


def vectors(spark, n, dims=6, people=5, langs=("zh", "en", None), seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, f"P{i % people}", langs[(i // people) % len(langs)], [float(x) for x in r.normal(size=dims)], f"r{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq long, person string, lang string, vec array<double>, ref_path string")


def cos(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("block", [7, 8192])
def test_blocked_scores_and_thresholds_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(scores, "BLOCK", block)
    rows, table = vectors(spark, 45)
    speakers = spark.createDataFrame([("v", f"s{i}", "zh", r[3]) for i, r in enumerate(rows[:9])], "video_id string, spk string, lang string, vec array<double>")
    got = {(x["spk"], x["person"], x["group_lang"]): (x["score"], x["entries"], x["top_ref"]) for x in voice.group_scores(speakers, table).collect()}
    for (spk, person, lang), (score, n, top) in got.items():
        mine = [(cos(rows[int(spk[1:])][3], r[3]), r[4]) for r in rows if r[1] == person and r[2] == lang]
        assert n == len(mine) and score == pytest.approx(sum(x for x, _ in mine) / n) and top == max(mine)[1]
    assert len(got) == 9 * 15

    imp = [(lang, a[2] != b[2], cos(a[3], b[3])) for a in rows for b in rows if a[1] < b[1] for lang in ({a[2], b[2]})]
    gen = [(a[2], np.mean([cos(a[3], b[3]) for b in rows if b[1] == a[1] and b[0] != a[0]])) for a in rows]
    flat = spark.createDataFrame([(x, False, float(v)) for x, _, v in imp] + [(x, True, float(v)) for x, v in gen], "lang string, genuine boolean, score double")
    eer = {x["lang"]: x["eer"] for x in voice.error_rate(flat, ["lang"]).collect()}
    tiers = {x["lang"]: x for x in voice.calibrate(table).collect()}
    assert set(tiers) == {"zh", "en", None}
    for lang, t in tiers.items():
        mine, cross = [v for x, _, v in imp if x == lang], [v for x, c, v in imp if x == lang and c]
        assert (t["impostor_n"], t["cross_impostor_n"], t["genuine_n"]) == (len(mine), len(cross), 15)
        assert t["thr"] == pytest.approx(np.quantile(mine, 0.99)) and t["thr_cross"] == pytest.approx(np.quantile(cross, 0.99))
        assert t["genuine_p5"] == pytest.approx(np.quantile([v for x, v in gen if x == lang], 0.05)) and t["eer"] == pytest.approx(eer[lang])
    loo = {x["seq"]: x["score"] for x in voice.leave_one_out(table).collect()}
    assert loo == {a[0]: pytest.approx(v) for a, (_, v) in zip(rows, gen, strict=True)}


def test_scores_of_odd_vectors(spark):
    table = spark.createDataFrame([(1, "A", "zh", [3.0, 4.0], "a"), (2, "A", "zh", [0.0, 0.0], "b"), (3, "B", "zh", [], "c"), (4, None, "zh", [1.0, 0.0], "d")], "seq long, person string, lang string, vec array<double>, ref_path string")
    speakers = spark.createDataFrame([("v", "s", "zh", [3.0]), ("v", "t", "zh", [])], "video_id string, spk string, lang string, vec array<double>")
    got = {x["person"]: (x["score"], x["entries"]) for x in voice.group_scores(speakers, table).collect()}
    assert got == {"A": (pytest.approx(0.3), 2), None: (pytest.approx(1.0), 1)}
    none = table.limit(0)
    assert voice.group_scores(speakers, none).count() == 0 and voice.calibrate(none).count() == 0


def loop(spark, spoken, held, tiers=(), refs=()):
    speakers = spark.createDataFrame([("v", f"s{i}", i, None, "clone", None, p, lang, sample, vec) for i, (p, lang, sample, vec) in enumerate(spoken)], "video_id string, spk string, ord long, merge_into string, voice string, host_person string, person string, lang string, sample string, vec array<double>")
    people = spark.createDataFrame([("A", None), ("B", "zh")], "person string, main_lang string")
    old = spark.createDataFrame([(i, p, lang, vec, f"r{i}") for i, (p, lang, vec) in enumerate(held)], "seq long, person string, lang string, vec array<double>, ref_path string")
    told = archive.archive_loop(speakers, people, old, spark.createDataFrame(list(tiers), "lang string, genuine_p5 double"), spark.createDataFrame(list(refs), "person string, audio string"))
    return [(r["status"], r["why"], r["total_after"]) for r in told.orderBy("spk").collect()], archive.archive_after(told, speakers, old)


def test_samples_of_one_person_are_archived_once(spark):
    told, after = loop(spark, [("B", "zh", "x", [1.0, 0.0]), ("B", "en", "x", [0.0, 1.0]), ("A", "zh", "x", [1.0, 0.0])], [])
    assert told == [("archived", None, 1), ("skipped", "archived before", None), ("archived", None, 1)]
    assert sorted((r["person"], r["lang"], r["ref_path"]) for r in after.collect()) == [("A", "zh", "x"), ("B", "zh", "x")]


def test_a_blocked_sample_may_come_again(spark):
    held = [("B", "zh", [1.0, 0.0])] * 2
    told, _ = loop(spark, [("B", "zh", "x", [0.0, 1.0]), ("B", "zh", "x", [1.0, 0.1])], held, [("zh", 0.5)])
    assert told == [("blocked", "unlike its person", None), ("archived", None, 3)]


def test_without_a_language_all_entries_of_the_person_count(spark):
    told, after = loop(spark, [("A", None, "x", [1.0, 0.0]), ("A", None, "y", [0.0, 1.0])], [("A", "zh", [1.0, 0.0])] * 3, [("zh", 0.9), (None, 0.9)])
    assert told == [("archived", None, 4), ("archived", None, 5)]
    assert after.groupBy("lang").count().orderBy("lang").collect()[0]["count"] == 2


def test_groups_keep_their_latest(spark):
    told, after = loop(spark, [("B", "zh", f"n{i}", [1.0, 0.0]) for i in range(4)], [("B", "zh", [1.0, 0.0])] * 9)
    assert [t[2] for t in told] == [10, 10, 10, 10]
    assert [r["ref_path"] for r in after.orderBy("seq").collect()] == [f"r{i}" for i in range(3, 9)] + [f"n{i}" for i in range(4)]


def test_sped_up_lines_are_counted_once_and_the_steep_ones_again(spark):
    rows = [(1, 0, 1000, 900), (2, 2000, 3000, 1200), (3, 4000, 5000, 1650), (4, 6000, 7000, 1800), (5, 8000, 9000, 5000), (6, 9050, 9500, None)]
    plan = sequences.dub_plan(spark.createDataFrame([("v", *r) for r in rows], "video_id string, idx long, t0 long, t1 long, wav_dur long"))
    got = {r["idx"]: (r["mode"], r["tempo"], r["over"]) for r in plan.collect()}
    assert got == {1: ("fit", 1.0, False), 2: ("borrow", 1.0, False), 3: ("atempo", 1.1, False), 4: ("atempo", 1.8, True), 5: ("atempo", 2.0, True)}
    assert {r["mode"]: r["n"] for r in sequences.mode_counts(plan).collect()} == {"fit": 1, "borrow": 1, "atempo": 3, "atempo_over": 2}


def test_tempos_halfway_between_places_are_rounded_as_in_sql(spark):
    lines = [(1600 * i, 1600 * (i + 1), 1600 + i) for i in range(700)]  # no silence to borrow; 1658 / 1600 is 1.03625, a bit under in binary
    df = spark.createDataFrame([("v", i, *r) for i, r in enumerate(lines)], "video_id string, idx long, t0 long, t1 long, wav_dur long")
    want = duckdb.sql("SELECT i, round(least(2.0, (1600 + i) / 1600::DOUBLE), 4) FROM range(699) r(i)").fetchall()
    plan = {r["idx"]: r["tempo"] for r in sequences.dub_plan(df).collect()}
    assert [(i, plan[i]) for i in range(699)] == want
    heard = {r["idx"]: r["heard"] for r in sequences.render_track(df).collect()}
    assert heard[58] == int(1658 / 1.0362 + 0.5) == 1600 and plan[58] == 1.0362


def test_a_fold_carries_its_state_over_batches(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("id % 3 AS k", "id AS ord").unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k long, ord long"))

    def step(state, x):
        state.append(x["ord"])
        if len(state) == 1000:
            yield len(state), sum(state)
            state.clear()

    got = carried.fold(rows, ["k"], ["ord"], "k long, n int, total long", list, step, lambda state: [(len(state), sum(state))])
    assert {r["k"]: tuple(r)[1:] for r in got.groupBy("k").agg(F.sum("n"), F.sum("total")).collect()} == {**{k: (n // 3, sum(range(k, n, 3))) for k in range(3)}, None: (2, 3)}
    assert carried.fold(rows.limit(0), ["k"], ["ord"], "k long, n int, total long", list, step).count() == 0


def test_dense_window_counts_whole_lines_only(spark):
    r = random.Random(5)
    lines = [(f"v{i % 4}", a := r.randrange(0, 280_000, 500), a + r.choice([500, 4000, 20_000, 59_000, 60_000, 61_000, 90_000])) for i in range(200)]
    totals = {f"v{i}": 300_000 - 1000 * i for i in range(4)}
    got = {x["video_id"]: x["w0"] for x in sequences.dense_window(spark.createDataFrame(lines, "video_id string, t0 long, t1 long"), spark.createDataFrame(list(totals.items()), "video_id string, total long")).collect()}
    for v, total in totals.items():
        inside = lambda w: sum(k == v and a >= w and b <= w + 60_000 for k, a, b in lines)  # noqa: B023, E731
        best = max((range(90_000, total - 120_000 + 2500, 5000)), key=lambda w: (inside(w), -w))
        assert got[v] == best and inside(best)


def test_similarity_equals_difflib_and_bounds_spare_most_pairs(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefg 中文字") for _ in range(n))
    pairs = [(word(r.randrange(0, 30)), word(r.randrange(0, 30))) for _ in range(150)]
    for n in (5, 60, 250, 400):
        for _ in range(15):
            a = word(n)
            pairs.append((a, "".join(c if r.random() < 0.85 else r.choice("abc") for c in a)))
    want = []
    for a, b in pairs:
        x, y = "".join(a.split()), "".join(b.split())
        want.append(0.0 if not x or not y else SequenceMatcher(None, x, y).ratio())
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", s.similarity(F.col("a"), F.col("b")).alias("all"), s.similarity(F.col("a"), F.col("b"), 0.75).alias("some"), s.most_similar(s.squeeze(F.col("a")), s.squeeze(F.col("b"))).alias("most")).orderBy("i").collect()
    assert [x["all"] for x in df] == pytest.approx(want)
    assert all(x["some"] == pytest.approx(w) if w >= 0.75 else x["some"] < 0.75 for x, w in zip(df, want, strict=True))
    assert all(x["most"] >= w - 1e-12 for x, w in zip(df, want, strict=True))


def test_runs_delete_their_own_steps_only(spark):
    with steps.run() as one:
        a = steps.cut(spark.range(3), "a")
        with steps.run() as two:
            b = steps.cut(spark.range(4), "b")
        kept = steps.cut(spark.range(5), "kept")
        one.release(spark, kept)
    assert b.count() == 4 and kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        a.count()
    two.release(spark)
    one.release(spark)
    steps.drop(a)
