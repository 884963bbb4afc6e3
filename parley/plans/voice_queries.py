"""Queries of voice identification, on the archive capped at ten entries of a person and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import archive, voice
from parley.plans.registry import query
from parley.sources.views import with_views

_SCORES = """
gs AS (SELECT s.video_id, s.spk, s.lang, s.truth, a.person, a.lang AS group_lang, avg(list_cosine_similarity(s.vec, a.vec)) AS score, count(*) AS entries,
       arg_max(a.ref_path, (list_cosine_similarity(s.vec, a.vec), -a.seq)) AS top_ref FROM v_speakers s, v_capped a GROUP BY ALL)"""
_ROUTED = """
ro AS (SELECT *, NOT coalesce(lang = group_lang, false) AS crossed FROM gs
       QUALIFY row_number() OVER (PARTITION BY video_id, spk, person ORDER BY coalesce(lang = group_lang, false) DESC, score DESC, coalesce(group_lang, 'None')) = 1)"""
_TOP = """
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, spk ORDER BY score DESC, person) AS n FROM ro),
tt AS (SELECT video_id, spk, lang, max(CASE WHEN n = 1 THEN person END) AS person, max(CASE WHEN n = 1 THEN score END) AS score, bool_or(n = 1 AND crossed) AS crossed, max(CASE WHEN n = 1 THEN top_ref END) AS top_ref,
       max(CASE WHEN n = 2 THEN person END) AS second, max(CASE WHEN n = 1 THEN score END) - max(CASE WHEN n = 2 THEN score END) AS margin FROM rk WHERE n <= 2 GROUP BY ALL)"""
_PAIRS = """
pr AS (SELECT a.seq AS a, b.seq AS b, a.person AS pa, b.person AS pb, a.lang AS la, b.lang AS lb, list_cosine_similarity(a.vec, b.vec) AS cos FROM v_capped a JOIN v_capped b ON a.seq <> b.seq)"""
_CALIBRATED = """
ge AS (SELECT a, la AS lang, avg(cos) AS score FROM pr WHERE pa = pb GROUP BY ALL),
ot AS (SELECT a, la, pb, lb, avg(cos) AS score FROM pr WHERE pa <> pb GROUP BY ALL),
rv AS (SELECT a, max(score) AS rival FROM (SELECT * FROM ot QUALIFY row_number() OVER (PARTITION BY a, pb ORDER BY (la = lb) DESC, score DESC, lb) = 1) GROUP BY ALL),
ma AS (SELECT ge.lang, ge.score - rv.rival AS margin FROM ge JOIN rv ON ge.a = rv.a),
im AS (SELECT la AS lang, la <> lb AS crossed, cos FROM pr WHERE pa < pb UNION ALL SELECT lb, true, cos FROM pr WHERE pa < pb AND la <> lb),
g1 AS (SELECT lang, count(*) AS genuine_n, quantile_cont(score, 0.05) AS genuine_p5, quantile_cont(score, 0.25) AS genuine_p25 FROM ge GROUP BY ALL),
m1 AS (SELECT lang, count(*) AS margin_n, quantile_cont(margin, 0.05) AS m5 FROM ma GROUP BY ALL),
i1 AS (SELECT lang, count(*) AS impostor_n, count_if(crossed) AS cross_impostor_n, quantile_cont(cos, 0.99) AS p99, max(cos) AS most, quantile_cont(cos, 0.99) FILTER (crossed) AS cross99 FROM im GROUP BY ALL),
al AS (SELECT lang, true AS genuine, score FROM ge UNION ALL SELECT lang, false, cos FROM im),
di AS (SELECT lang, score, count_if(genuine) AS g, count_if(NOT genuine) AS i FROM al GROUP BY ALL),
cu AS (SELECT *, coalesce(sum(g) OVER w, 0) AS gb, coalesce(sum(i) OVER w, 0) AS ib, sum(g) OVER (PARTITION BY lang) AS gn, sum(i) OVER (PARTITION BY lang) AS im, lead(score) OVER (PARTITION BY lang ORDER BY score) AS nx FROM di
       WINDOW w AS (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ca AS (SELECT lang, score AS t, gb / gn AS frr, (im - ib) / im AS far FROM cu UNION ALL SELECT lang, (score + nx) / 2, (gb + g) / gn, (im - ib - i) / im FROM cu WHERE nx IS NOT NULL),
e1 AS (SELECT lang, arg_min((far + frr) / 2, (abs(far - frr), t)) AS eer FROM ca GROUP BY ALL),
ti AS (SELECT g1.lang, genuine_n, impostor_n, cross_impostor_n, margin_n, CASE WHEN impostor_n < 20 THEN greatest(p99, most + 0.02) ELSE p99 END AS thr, greatest(coalesce(m5, 0.03), 0.03) AS margin_min, genuine_p5, genuine_p25, cross99, eer,
       genuine_n >= 5 AND impostor_n >= 10 AS calibrated FROM g1 JOIN m1 ON g1.lang = m1.lang JOIN i1 ON g1.lang = i1.lang JOIN e1 ON g1.lang = e1.lang),
tiers AS (SELECT lang, genuine_n, impostor_n, cross_impostor_n, margin_n, thr, margin_min, greatest(thr + 0.05, genuine_p25) AS thr_host, CASE WHEN cross_impostor_n >= 10 THEN cross99 ELSE thr + 0.05 END AS thr_cross, genuine_p5, genuine_p25, eer, calibrated FROM ti)"""
_IDENTIFIED = """
ga AS (SELECT tt.*, t.thr_cross, t.thr_host, t.calibrated, coalesce(tt.score >= CASE WHEN tt.crossed THEN t.thr_cross ELSE t.thr END AND (tt.margin IS NULL OR tt.margin >= t.margin_min), false) AS passed FROM tt LEFT JOIN tiers t ON tt.lang = t.lang),
wo AS (SELECT *, passed AND row_number() OVER (PARTITION BY video_id, person, passed ORDER BY score DESC, spk) = 1 AS won FROM ga),
idn AS (SELECT video_id, spk, person, score, margin, CASE WHEN NOT passed THEN 'unknown' WHEN NOT won THEN 'compete' WHEN calibrated THEN 'suggest' ELSE 'uncalibrated' END AS verdict, coalesce(calibrated, false) AS calibrated, top_ref,
        coalesce(won AND person = 'P3' AND score >= CASE WHEN crossed THEN thr_cross + 0.05 ELSE thr_host END, false) AS host_candidate FROM wo)"""
_ALL = "WITH " + ",".join((_SCORES, _ROUTED, _TOP, _PAIRS, _CALIBRATED, _IDENTIFIED))
_R6 = "round({0}, 6) AS {0}"


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _cap(v):
    return voice.fifo_cap(v.archive)


def _identified(v):
    a = _cap(v)
    return voice.identify(v.speakers, a, voice.calibrate(a), host="P3")


@query(with_views("v_capped", "SELECT seq, person, lang, ref_path FROM v_capped"))
def fifo_cap(v):
    return _cap(v).select("seq", "person", "lang", "ref_path")


@query(with_views("v_speakers v_capped", "WITH " + _SCORES + " SELECT video_id, spk, person, group_lang, round(score, 6) AS score, entries, top_ref FROM gs"))
def archive_scores(v):
    return _rounded(voice.group_scores(v.speakers, _cap(v)), "score").select("video_id", "spk", "person", "group_lang", "score", "entries", "top_ref")


@query(with_views("v_speakers v_capped", "WITH " + _SCORES + "," + _ROUTED + " SELECT video_id, spk, person, group_lang, crossed AS \"cross\", round(score, 6) AS score FROM ro"))
def route_groups(v):
    return _rounded(voice.route(voice.group_scores(v.speakers, _cap(v))), "score").select("video_id", "spk", "person", "group_lang", "cross", "score")


@query(with_views("v_speakers v_capped", "WITH " + _SCORES + " SELECT video_id, spk, person, round(max(score), 6) AS score FROM gs GROUP BY ALL"))
def score_matrix(v):
    return _rounded(voice.route(voice.group_scores(v.speakers, _cap(v)), unknown=True), "score").select("video_id", "spk", "person", "score")


@query(with_views("v_speakers v_capped", "WITH " + ",".join((_SCORES, _ROUTED, _TOP)) + " SELECT video_id, spk, person, second, round(score, 6) AS score, round(margin, 6) AS margin FROM tt"))
def top2_margin(v):
    return _rounded(voice.top_two(voice.route(voice.group_scores(v.speakers, _cap(v)))), "score", "margin").select("video_id", "spk", "person", "second", "score", "margin")


@query(with_views("v_capped", "WITH " + _PAIRS + " SELECT a AS seq, pa AS person, la AS lang, round(avg(cos), 6) AS score FROM pr WHERE pa = pb GROUP BY ALL"))
def loo_scores(v):
    return _rounded(voice.leave_one_out(_cap(v)), "score")


_TIER_COLS = "lang, genuine_n, impostor_n, cross_impostor_n, margin_n, calibrated, " + ", ".join(_R6.format(c) for c in ("thr", "margin_min", "thr_host", "thr_cross", "genuine_p5", "genuine_p25", "eer"))


@query(with_views("v_capped", "WITH " + _PAIRS + "," + _CALIBRATED + f" SELECT {_TIER_COLS} FROM tiers"))
def calibrate(v):
    return _rounded(voice.calibrate(_cap(v)), "thr", "margin_min", "thr_host", "thr_cross", "genuine_p5", "genuine_p25", "eer")


@query(with_views("v_capped", "WITH " + _PAIRS + "," + _CALIBRATED + " SELECT lang, round(eer, 6) AS eer FROM e1"))
def eer(v):
    return _rounded(voice.calibrate(_cap(v)), "eer").select("lang", "eer")


@query("SELECT user_id, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY ALL")
def percentiles(v):
    return v.table("events").groupBy("user_id").agg(*[F.expr(f"percentile(value, {p / 100})").alias(f"p{p}") for p in (5, 25, 99)])


_ID_COLS = "video_id, spk, person, verdict, calibrated, top_ref, host_candidate, round(score, 6) AS score, round(margin, 6) AS margin"


@query(with_views("v_speakers v_capped", _ALL + f" SELECT {_ID_COLS} FROM idn"))
def identify(v):
    return _rounded(_identified(v), "score", "margin")


@query(with_views("v_speakers v_capped", _ALL + " SELECT video_id, spk, round(score, 6) AS score FROM idn WHERE host_candidate"))
def host_candidates(v):
    return _rounded(_identified(v).filter("host_candidate"), "score").select("video_id", "spk", "score")


@query(
    with_views(
        "v_speakers v_capped",
        _ALL + """ SELECT a.video_id, a.spk, a.person, a.verdict, array_to_string(list(b.spk ORDER BY b.spk) FILTER (b.spk IS NOT NULL), ',') AS rivals FROM idn a
        LEFT JOIN idn b ON a.video_id = b.video_id AND a.person = b.person AND a.spk <> b.spk AND b.verdict IN ('suggest', 'uncalibrated') WHERE a.verdict = 'compete' GROUP BY ALL""",
    )
)
def compete_with(v):
    found = _identified(v)
    other = found.filter("verdict IN ('suggest', 'uncalibrated')").select(F.col("video_id").alias("_v"), F.col("person").alias("_p"), F.col("spk").alias("rival"))
    met = found.filter("verdict = 'compete'").join(other, (F.col("video_id") == F.col("_v")) & (F.col("person") == F.col("_p")) & (F.col("spk") != F.col("rival")), "left")
    return met.groupBy("video_id", "spk", "person", "verdict").agg(F.array_join(F.sort_array(F.collect_list("rival")), ",").alias("rivals"))


@query(
    with_views(
        "v_speakers v_capped",
        "WITH " + ",".join((_SCORES, _PAIRS, _CALIBRATED)) + """, co AS (SELECT video_id, spk, lang, person, sum(score * entries) / sum(entries) AS score, sum(entries) AS n FROM gs WHERE person = truth GROUP BY ALL)
        SELECT co.video_id, co.spk, co.person, round(score, 6) AS score, coalesce(n < 2 OR t.genuine_p5 IS NULL OR score >= t.genuine_p5, true) AS ok FROM co LEFT JOIN tiers t ON co.lang = t.lang""",
    )
)
def consistency_check(v):
    a = _cap(v)
    return _rounded(voice.consistency(v.speakers.withColumnRenamed("truth", "claimed"), a, voice.calibrate(a)), "score")


def _truth(v):
    routed = voice.route(voice.group_scores(v.speakers, _cap(v)), unknown=True)
    truth = v.speakers.select(F.col("video_id").alias("_v"), F.col("spk").alias("_s"), "truth")
    return routed.join(truth, (F.col("video_id") == F.col("_v")) & (F.col("spk") == F.col("_s"))).withColumn("genuine", F.col("person") == F.col("truth"))


_SPLIT = "ts AS (SELECT video_id, spk, person, truth, person = truth AS genuine, max(score) AS score FROM gs GROUP BY ALL)"


@query(with_views("v_speakers v_capped", "WITH " + _SCORES + "," + _SPLIT + " SELECT video_id, spk, person, genuine, round(score, 6) AS score FROM ts"))
def truth_split(v):
    return _rounded(_truth(v), "score").select("video_id", "spk", "person", "genuine", "score")


@query(with_views("v_speakers v_capped", "WITH " + _SCORES + "," + _SPLIT + " SELECT genuine, count(*) AS n, round(avg(score), 6) AS mean FROM ts GROUP BY ALL"))
def truth_summary(v):
    return _truth(v).groupBy("genuine").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(with_views("v_archive", "SELECT seq, person FROM v_archive ORDER BY md5(concat(CAST(seq AS VARCHAR), ':42')), seq LIMIT 20"))
def audit_sample(v):
    """A fixed sample of archive entries for recomputation; the limit is the feature."""
    return archive.sample_of(v.archive, 20, 42).select("seq", "person")


_PATHS = "CASE WHEN seq % 11 = 0 THEN '' WHEN seq % 3 = 0 THEN concat('/audio/', ref_path) ELSE ref_path END"


@query(with_views("v_archive", "SELECT person, lang, count(*) AS entries, count_if(valid) AS valid, count_if(NOT valid) AS invalid FROM (SELECT *, seq % 11 <> 0 AND (seq % 3 <> 0 OR seq % 9 = 0) AS valid FROM v_archive) GROUP BY GROUPING SETS ((person, lang), (person), ())"))
def archive_group_view(v):
    """Entries by person and language with how many of their references are there: absolute paths must exist, relative ones count, empty ones do not."""
    entries = v.archive.withColumn("ref_path", F.expr(_PATHS))
    present = entries.filter("seq % 9 = 0 AND ref_path <> ''").select(F.col("ref_path").alias("file"))
    return archive.valid_refs(entries, present).rollup("person", "lang").agg(F.count(F.lit(1)).alias("entries"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


@query(with_views("v_archive", "SELECT person, count(*) AS added, arg_max(lang, seq) AS last_lang, max(seq) AS last_seq FROM v_archive GROUP BY ALL"))
def archive_summaries(v):
    return v.archive.groupBy("person").agg(F.count(F.lit(1)).alias("added"), F.max_by("lang", "seq").alias("last_lang"), F.max("seq").alias("last_seq"))


@query(
    with_views(
        "v_segs v_speakers v_capped",
        _ALL.replace("WITH ", "WITH card AS (SELECT video_id, spk, sum(t1 - t0) AS talk_ms FROM v_segs GROUP BY ALL),", 1)
        + """ SELECT c.video_id, c.spk, c.talk_ms, l.lang, i.person, i.verdict FROM (SELECT video_id, spk, talk_ms FROM card UNION ALL SELECT video_id, spk, 0 FROM v_speakers) c
        LEFT JOIN v_speakers l ON c.video_id = l.video_id AND c.spk = l.spk LEFT JOIN idn i ON c.video_id = i.video_id AND c.spk = i.spk""",
    )
)
def speaker_cards(v):
    talk = v.segs.groupBy("video_id", "spk").agg(F.sum(F.col("t1") - F.col("t0")).alias("talk_ms")).unionByName(v.speakers.select("video_id", "spk", F.lit(0).cast("long").alias("talk_ms")))
    return talk.join(v.speakers.select("video_id", "spk", "lang"), ["video_id", "spk"], "left").join(_identified(v).select("video_id", "spk", "person", "verdict"), ["video_id", "spk"], "left")
