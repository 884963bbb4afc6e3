"""Known answers of the dialogue operators, and window forms against the loops they replace."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import scalars as s
from parley.operators import intervals, sequences, voice, workflow

SEG = "video_id string, seg_ord long, t0 long, t1 long, spk string"
SUB = "video_id string, idx long, t0 long, t1 long, text string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def segs(spark, rows):
    return spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], SEG)


def subs(spark, rows):
    return spark.createDataFrame([("v", i + 1, a, b, t) for i, (a, b, t) in enumerate(rows)], SUB)


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, s.overlap(*map(lit, x))) for x in ((0, 10, 5, 20), (0, 5, 10, 20), (3, 7, 3, 7))] == [5, 0, 4]
    assert one(spark, s.srt_time(lit(3723004))) == "01:02:03,004" and one(spark, s.srt_time(lit(-5))) == "00:00:00,000"
    assert [one(spark, s.parse_length(lit(x))) for x in ("2:05", "1:00:01", "x:1", "7", "")] == [125, 3601, None, None, None]
    assert [one(spark, s.norm_part(lit(x))) for x in ("1", "P1", " p12 ", "x", None)] == [1, 1, 12, None, None]
    assert [one(spark, s.clean_badge(lit(x))) for x in ("HD4中文a9", "abc", "abcdef", "123456中文", "", "9.9%99")] == ["中文", "", "abcdef", "123456中文", "", "9.9%99"]
    assert one(spark, s.speaker_tag(lit("[SPK_03] x"))) == "SPK_03" and one(spark, s.speaker_tag(lit(" [SPK_03]"))) == "SPK_00"
    assert one(spark, s.sanitize_title(lit('a/b:c*"\n'))) == "a_b_c___"
    assert [one(spark, s.similarity(lit(a), lit(b))) for a, b in (("a b", "ab"), ("", "x"), ("abcd", "bcde"))] == [1.0, 0.0, 0.75]
    assert one(spark, s.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))) == 0.0
    assert one(spark, s.cosine(F.array(lit(3.0), lit(4.0)), F.array(lit(3.0)))) == pytest.approx(0.6)
    assert one(spark, s.content_hash(lit("{}"))) == "44136fa355b3"
    assert one(spark, s.epoch_date(lit(0))).isoformat() == "1970-01-01"
    assert one(spark, s.score_bin(lit(0.999))) == "0.98"
    with pytest.raises(Exception, match="unknown use"):
        one(spark, s.norm_use(lit("bad")))


def test_merge_fragments(spark):
    got = sorted(map(tuple, intervals.merge_segments(segs(spark, [(0, 5000, "a"), (5100, 8000, "a"), (9000, 12000, "b"), (12200, 15000, "a")])).select("t0", "t1", "spk").collect()))
    assert got == [(0, 8000, "a"), (9000, 12000, "b"), (12200, 15000, "a")]


def attributed(spark, lines, rows):
    return intervals.attribute(subs(spark, [(*x, "") for x in lines]), segs(spark, rows)).orderBy("idx").collect()


def test_attribution_known_answers(spark):
    both = [(0, 10000, "SPK_00"), (10000, 20000, "SPK_01")]
    full, half = attributed(spark, [(2000, 8000), (6000, 14000)], both)
    assert (full["spk"], full["conf"], full["runner"], full["runner_conf"]) == ("SPK_00", 1.0, "SPK_01", 0.0)
    assert (half["spk"], half["conf"], half["runner_conf"], half["review"]) == ("SPK_00", 0.5, 0.5, True)
    (gap,) = attributed(spark, [(100000, 102000)], [(0, 90000, "SPK_00"), (95000, 99000, "SPK_01")])
    assert (gap["spk"], gap["conf"], gap["review"]) == ("SPK_00", 0.0, True)
    (none,) = intervals.attribute(subs(spark, [(0, 1, "")]), segs(spark, []).limit(0)).collect()
    assert (none["spk"], none["conf"], none["runner"]) == ("SPK_00", 0.0, None)


def test_merge_relabel(spark):
    rows = segs(spark, [(0, 4200, "SPK_00"), (4300, 9200, "SPK_01"), (9800, 13800, "SPK_03"), (13900, 18500, "SPK_00")])
    line = subs(spark, [(12500, 14500, "")])
    assert intervals.attribute(line, rows).first()["spk"] == "SPK_03"
    merges = spark.createDataFrame([("v", "SPK_03", "SPK_00")], "video_id string, id string, target string")
    assert intervals.attribute(line, intervals.relabel(rows, merges)).first()["spk"] == "SPK_00"


@pytest.mark.parametrize(("noise", "least"), [(0.0, 1.0), (0.2, 0.95)])
def test_two_speaker_timeline(spark, noise, least):
    r = random.Random(42)
    t, lines, rows, truth = 0, [], [], []
    for _ in range(200):
        d, who = int(r.uniform(4, 10) * 1000), r.choice(["SPK_00", "SPK_01"])
        a, b = t, t + d
        shift = int(r.uniform(-noise, noise) * d)
        rows.append((max(0, a + shift), b + shift, who))
        lines.append((a, b))
        truth.append(who)
        t = b + int(r.uniform(0.2, 1.0) * 1000)
    got = attributed(spark, lines, rows)
    assert sum(g["spk"] == w for g, w in zip(got, truth, strict=True)) / 200 >= least


def random_segs(seed, n=60):
    r = random.Random(seed)
    return [(a := r.randrange(0, 60000), a + r.randrange(0, 9000), r.choice(["a", "b", "c"])) for _ in range(n)]


def test_bucketed_overlap_equals_plain(spark):
    a, b = subs(spark, [(x, y, z) for x, y, z in random_segs(1)]), segs(spark, random_segs(2))
    cols = ["idx", "seg_ord", "ov"]
    assert sorted(map(tuple, intervals.bucketed_overlap(a, b, 3000).select(cols).collect())) == sorted(map(tuple, intervals.overlaps(a, b).select(cols).collect()))


def test_union_and_stitch_against_loops(spark):
    rows = [(a, b, "x") for a, b, _ in random_segs(3, 12)]
    merged = []
    for a, b, _ in sorted(rows):
        if merged and a <= merged[-1][1] + 50:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    merged = [tuple(x) for x in merged if x[1] > x[0]]
    spans = intervals.union_spans(segs(spark, rows).select("video_id", "t0", "t1"))
    assert sorted((r["t0"], r["t1"]) for r in spans.collect()) == merged
    want, cursor = [], 0
    for a, b in merged:
        want += [("dub", cursor, a)] * (a > cursor) + [("orig", a, b)]
        cursor = b
    want += [("dub", cursor, 90000)]
    got = intervals.stitch_plan(spans, spark.createDataFrame([("v", 90000)], "video_id string, total long"))
    assert sorted(tuple(r)[1:] for r in got.select("video_id", "src", "a", "b").collect()) == sorted(want)


def test_monotone_and_place_against_loops(spark):
    r = random.Random(5)
    lines, t = [], 0
    for i in range(80):
        t += r.choice([0, 0, 100, 500, 3000])
        lines.append(("v", i, t, t + r.choice([0, 100, 2500])))
    want, prev = [], 0
    for _, i, a, b in lines:
        t0 = max(max(0, a - 250), prev + 10)
        prev = max(b + 250, t0 + 300)
        want.append((i, t0, prev))
    df = spark.createDataFrame(lines, "video_id string, line long, first_ts long, last_ts long")
    assert sorted((x["line"], x["t0"], x["t1"]) for x in sequences.monotone_lines(df).collect()) == want
    rows = [("v", i, i * 900, i * 900 + 800, r.choice([None, 200, 1500])) for i in range(60)]
    want, end = [], 0
    for _, i, t0, _, d in rows:
        if d is not None:
            place = max(t0, end + 50)
            end = place + d
            want.append((i, place))
    df = spark.createDataFrame(rows, "video_id string, idx long, t0 long, t1 long, wav_dur long")
    got = sequences.place_track(df).collect()
    first = min(i for i, _ in want)
    assert sorted((x["idx"], x["place_t"]) for x in got if x["idx"] > first) == [x for x in want if x[0] > first]


def test_ocr_lines(spark):
    rows = [("v", i, i * 500, t) for i, t in enumerate(["你好", "你好吗", "你好吗", "再见", "再见", "", ""])]
    df = spark.createDataFrame(rows, "video_id string, pos long, ts long, text string")
    exact = [(x["text"], x["first_ts"], x["last_ts"]) for x in sequences.ocr_lines(df, exact=True).orderBy("line").collect()]
    assert exact == [("你好", 0, 0), ("你好吗", 500, 1000), ("再见", 1500, 2000), ("", 2500, 2500), ("", 3000, 3000)]
    like = [x["text"] for x in sequences.ocr_lines(df).orderBy("line").collect()]
    assert like == ["你好吗", "再见", "", ""]


def test_merge_units(spark):
    rows = [(0, 1000, "[SPK_01] 你好。"), (1200, 2000, "[SPK_01] 再见"), (2300, 3000, "[SPK_01] x" * 1), (3100, 3300, "[SPK_02] y"), (9000, 9100, "  "), (9200, 9300, "z " * 30), (9310, 9400, "w")]
    got = [(r["idx"], r["t0"], r["t1"], r["spk"], r["text"]) for r in sequences.merge_units(subs(spark, rows)).orderBy("idx").collect()]
    assert got[:2] == [(1, 0, 3000, "SPK_01", "你好。再见,x"), (4, 3100, 3300, "SPK_02", "y")]
    assert [g[0] for g in got[2:]] == [6, 7]


def test_dense_window_known_answers(spark):
    dense = [(t * 1000, t * 1000 + 2000, "") for t in [10, 18, 26, 34, 42, *range(150, 210, 3), 290]]
    cases = [(dense, 300), ([], 50), ([(100_000, 110_000, "")], 120), ([], 100), ([(x * 1000, x * 1000 + 500, "") for x in range(8)], 300)]
    want = [(150_000, 210_000), (0, 50_000), (50_000, 110_000), (20_000, 80_000), (0, 60_000)]
    for (rows, total), answer in zip(cases, want, strict=True):
        lines = subs(spark, rows) if rows else subs(spark, [(0, 1, "")]).limit(0)
        r = sequences.dense_window(lines, spark.createDataFrame([("v", total * 1000)], "video_id string, total long")).first()
        assert (r["w0"], r["w1"]) == answer


def test_spaced_samples_known_answer(spark):
    rows = [(200_000, 204_000), (65_000, 73_000), (0, 4000), (1000, 5000), (300_000, 309_000), (62_000, 64_000), (130_000, 133_000)]
    got = sequences.spaced_samples(segs(spark, [(*r, "a") for r in rows])).orderBy("place").collect()
    assert [(r["t0"], r["t1"]) for r in got] == [(0, 4000), (65_000, 73_000), (200_000, 204_000)]
    got = sequences.spaced_samples(segs(spark, [(i * 100_000, i * 100_000 + 8000, "a") for i in range(4)])).orderBy("place").collect()
    assert [r["t0"] for r in got] == [0, 100_000, 200_000]


def archive(spark, rows):
    return spark.createDataFrame([(i, p, lang, [float(x) for x in v], f"r{i}") for i, (p, lang, v) in enumerate(rows)], "seq long, person string, lang string, vec array<double>, ref_path string")


def test_calibration_known_answers(spark):
    x, y = [1, 0], [0, 1]
    (small,) = voice.calibrate(archive(spark, [("A", "zh", x)] * 2 + [("B", "zh", y)] * 2)).collect()
    assert (small["genuine_n"], small["impostor_n"], small["calibrated"], small["eer"]) == (4, 4, False, 0.0)
    assert [small[c] for c in ("thr", "margin_min", "thr_host", "thr_cross")] == pytest.approx([0.02, 1, 1, 0.07])
    (edge,) = voice.calibrate(archive(spark, [("A", "zh", x)] * 2 + [("B", "zh", y)] * 10)).collect()
    assert (edge["impostor_n"], edge["genuine_n"], edge["thr"], edge["calibrated"]) == (20, 12, 0.0, True)
    cross = {r["lang"]: r for r in voice.calibrate(archive(spark, [("A", "zh", x)] * 2 + [("B", "en", y)] * 3 + [("B", "en", x)] * 2)).collect()}
    assert (cross["zh"]["cross_impostor_n"], cross["zh"]["thr_cross"], cross["zh"]["thr"]) == (10, 1.0, pytest.approx(1.02))


def test_error_rate_known_answers(spark):
    def rate(genuine, impostor):
        rows = [("k", True, float(g)) for g in genuine] + [("k", False, float(i)) for i in impostor]
        return voice.error_rate(spark.createDataFrame(rows, "k string, genuine boolean, score double"), ["k"]).first()["eer"]

    assert rate([1, 1], [0, 0]) == 0 and rate([1], [0, 1]) == 0.25 and rate([1], [1]) == 0.5
    assert rate([1], []) is None and rate([], [1]) is None


def test_percentile_known_answers(spark):
    for values, p, want in (([1, 2], 0.5, 1.5), ([1, 2, 3, 4], 0.25, 1.75), ([0, 0.5], 0.99, 0.495), ([7], 0.99, 7.0)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        assert df.select(F.expr(f"percentile(x, {p})")).first()[0] == pytest.approx(want)


def test_identify_mutex_and_unknown_language(spark):
    import math

    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    speakers = spark.createDataFrame([("v", "S0", "zh", turn(0)), ("v", "S1", "zh", turn(6)), ("v", "S2", "zh", turn(41.4)), ("v", "S3", None, turn(0))], "video_id string, spk string, lang string, vec array<double>")
    tiers = spark.createDataFrame([("zh", 0.8, 0.1, 0.85, 0.9, True)], "lang string, thr double, margin_min double, thr_cross double, thr_host double, calibrated boolean")
    a = archive(spark, [("A", "zh", [1, 0]), ("A", "zh", [2, 0]), ("B", "en", [0, 1])])
    got = {r["spk"]: r for r in voice.identify(speakers, a, tiers, host="A").collect()}
    assert [got[k]["verdict"] for k in ("S0", "S1", "S2", "S3")] == ["suggest", "compete", "unknown", "unknown"]
    assert got["S3"]["person"] == "A" and not got["S3"]["calibrated"] and got["S0"]["host_candidate"] and got["S0"]["top_ref"] == "r0"


def test_fifo_cap(spark):
    got = voice.fifo_cap(archive(spark, [("A", "zh", [1, 0])] * 12)).collect()
    assert sorted(r["seq"] for r in got) == list(range(2, 12))


def replay(spark, names, verdicts=None):
    rows = [(1, 1, i, e, (verdicts or {}).get(i, "dub")) for i, e in enumerate(names)]
    return workflow.replay(spark.createDataFrame(rows, "bvid long, part int, ord long, event string, verdict string")).first()


def test_every_edge_and_every_illegal_pair(spark):
    way = {
        "pending_download": [], "pending_analysis": ["download_done"], "pending_review": ["download_done", "analysis_done"], "reviewed": ["download_done", "analysis_done", "review_submit"],
        "preview": ["download_done", "analysis_done", "review_submit", "preview_ready"], "synthesizing": ["download_done", "analysis_done", "review_submit", "preview_ready", "preview_pass"],
        "delivered": ["download_done", "analysis_done", "review_submit", "preview_ready", "preview_pass", "full_done"], "excluded": ["download_done", "analysis_done", "confirm_skip"], "failed": ["fail"],
    }
    events = ["download_done", "analysis_done", "review_submit", "confirm_skip", "rediarize", "preview_ready", "preview_pass", "preview_reject", "full_done", "fail", "retry"]
    rows, want, n = [], {}, 0
    for state, path in way.items():
        for e in events:
            n += 1
            for i, x in enumerate([*path, e]):
                rows.append((n, 1, i, x, "skip" if x == "confirm_skip" else "dub"))
            to = workflow.EDGES.get((state, e))
            want[n] = ("pending_download" if to == "*" else to or state, 0 if to else 1)
    got = workflow.replay(spark.createDataFrame(rows, "bvid long, part int, ord long, event string, verdict string")).collect()
    assert {r["bvid"]: (r["state"], r["rejected"]) for r in got} == want


def test_replay_side_effects(spark):
    r = replay(spark, ["download_done", "analysis_done", "review_submit", "preview_ready", "preview_reject"])
    assert (r["state"], r["stale"], r["busy"]) == ("pending_review", True, False)
    r = replay(spark, ["download_done", "fail", "retry", "analysis_done", "review_submit"], {4: "skip"})
    assert (r["state"], r["failed_from"], r["rejected"]) == ("pending_review", None, 1)
    assert replay(spark, ["download_done", "analysis_done", "rediarize"])["busy"]


def test_merge_closure(spark):
    rows = [(1, "a", "b"), (1, "b", "c"), (1, "x", "y"), (1, "y", "x"), (2, "a", "z")]
    got = {(r["decision"], r["id"]): (r["final"], r["ring"]) for r in workflow.merge_closure(spark.createDataFrame(rows, "decision long, id string, target string")).collect()}
    assert got[1, "a"] == ("c", False) and got[1, "b"] == ("c", False) and got[2, "a"] == ("z", False) and got[1, "x"][1] and got[1, "y"][1]


def test_long_merge_chains_settle(spark):
    """A chain of 150 hops, which no fixed bound of the recursion would let through."""
    n = 150
    rows = [(1, f"s{i:03d}", f"s{i + 1:03d}") for i in range(n)] + [(2, "a", "b"), (2, "b", "a")]
    got = {(r["decision"], r["id"]): (r["final"], r["ring"]) for r in workflow.merge_closure(spark.createDataFrame(rows, "decision int, id string, target string")).collect()}
    assert got[1, "s000"] == (f"s{n:03d}", False) and got[1, "s149"] == (f"s{n:03d}", False)
    assert got[2, "a"][1] and got[2, "b"][1]


def test_a_null_language_has_a_tier(spark):
    rows = [(0, "A", None, [1.0, 0.0], "r0"), (1, "A", None, [1.0, 0.1], "r1"), (2, "B", None, [0.0, 1.0], "r2"), (3, "B", "zh", [0.1, 1.0], "r3")]
    tiers = {r["lang"]: r for r in voice.calibrate(spark.createDataFrame(rows, "seq long, person string, lang string, vec array<double>, ref_path string")).collect()}
    assert tiers[None]["genuine_n"] == 3 and tiers[None]["thr"] is not None and tiers["zh"]["genuine_n"] == 1


def test_the_next_line_counts_whether_or_not_it_has_audio(spark):
    """Three lines, the middle one without audio: the first may borrow up to the second's start less the gap."""
    rows = [("v", 1, 0, 1000, 1400), ("v", 2, 1500, 2000, None), ("v", 3, 9000, 9500, 100)]
    got = {r["idx"]: (r["win_end"], r["mode"]) for r in sequences.dub_plan(spark.createDataFrame(rows, "video_id string, idx int, t0 long, t1 long, wav_dur long")).collect()}
    assert got == {1: (1450.0, "borrow"), 3: (9500.0, "fit")}


def test_confidence_is_unrounded(spark):
    """conf is unrounded in the operator; the query rounds it to four places and then the mean to three."""
    lines = spark.createDataFrame([("v", 1, 0, 3000), ("v", 2, 3000, 6000)], "video_id string, idx int, t0 long, t1 long")
    segs = spark.createDataFrame([("v", 0, 0, 1000, "A"), ("v", 1, 3000, 5000, "A")], "video_id string, seg_ord long, t0 long, t1 long, spk string")
    conf = sorted(r["conf"] for r in intervals.attribute(lines, segs).collect())
    assert [round(c, 4) for c in conf] == [0.3333, 0.6667]


def test_cleaned_lines_keep_holes(spark):
    """The group that a badge alone made goes, and its number is a hole; the clamp does not see it. The first line starts after the gap, too."""
    hits = [("v", 0, 0, "你好"), ("v", 1, 500, "HD4"), ("v", 2, 1000, "HD4再见x9")]
    got = [tuple(r) for r in sequences.clean_lines(spark.createDataFrame(hits, "video_id string, pos int, ts long, text string"), exact=True).orderBy("idx").collect()]
    assert got == [("v", 1, 10, 310, "你好"), ("v", 3, 750, 1250, "再见")]


def test_archive_loop_by_hand(spark):
    """In one group: the first two pass for want of entries, the third is unlike them, a fourth like them joins; merged ones go to their target's person."""
    from parley.operators import archive

    rows = [(1, "a", None, "clone", "", "P", "zh", "s1", [1.0, 0.0]), (2, "b", "a", "skip", "", "Q", None, "s2", [1.0, 0.1]), (3, "c", "b", "clone", "", None, "zh", "s3", [0.0, 1.0]), (4, "d", None, "clone", "P", "Q", "zh", "s4", [1.0, 0.05])]
    rows += [(5, "e", None, "skip", "", "P", "zh", "s5", [1.0, 0.0]), (6, "f", None, "clone", "", "X", "zh", "s6", [1.0, 0.0]), (7, "g", None, "clone", "", "P", "zh", "s1", [1.0, 0.0]), (8, "h", None, "clone", "", "P", "zh", "", [1.0, 0.0])]
    speakers = spark.createDataFrame([("v", s, o, m, vo, h, p, lang, w, x) for o, s, m, vo, h, p, lang, w, x in rows], "video_id string, spk string, ord long, merge_into string, voice string, host_person string, person string, lang string, sample string, vec array<double>")
    people = spark.createDataFrame([("P", "zh"), ("Q", None)], "person string, main_lang string")
    none = spark.createDataFrame([], "seq long, person string, lang string, vec array<double>, ref_path string")
    tiers = spark.createDataFrame([("zh", 0.9)], "lang string, genuine_p5 double")
    refs = spark.createDataFrame([("P", "s1x")], "person string, audio string")
    got = {r["spk"]: (r["status"], r["why"], r["total_after"]) for r in archive.archive_loop(speakers, people, none, tiers, refs).collect()}
    assert got["a"] == ("archived", None, 1) and got["b"] == ("archived", None, 2) and got["c"] == ("blocked", "unlike its person", None) and got["d"] == ("archived", None, 3)
    assert got["e"][1] == "no person" and got["f"][1] == "unknown person" and got["h"][1] == "no sample"
