"""Queries of interval and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import scalars as s
from parley.operators import intervals, sequences
from parley.plans.registry import query
from parley.sources.views import with_views

_MERGED = """
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> spk THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t0, t1, seg_ord) AS run
      FROM (SELECT *, lag(spk) OVER (PARTITION BY video_id ORDER BY t0, t1, seg_ord) AS prev FROM {src})),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR t0 - m > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, run ORDER BY t0, t1, seg_ord) AS island
      FROM (SELECT *, max(t1) OVER (PARTITION BY video_id, run ORDER BY t0, t1, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)),
merged AS (SELECT video_id, arg_min(seg_ord, (t0, t1, seg_ord)) AS seg_ord, min(t0) AS t0, max(t1) AS t1, any_value(spk) AS spk FROM i GROUP BY video_id, run, island)"""
_ATTRIBUTED = """
seen AS (SELECT video_id, spk, min(n) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t0, t1, seg_ord) AS n FROM merged) GROUP BY ALL),
shared AS (SELECT a.video_id, a.idx, b.spk, sum(least(a.t1, b.t1) - greatest(a.t0, b.t0)) AS ov FROM v_subs a JOIN merged b ON a.video_id = b.video_id AND a.t0 < b.t1 AND b.t0 < a.t1 GROUP BY ALL),
ranked AS (SELECT a.video_id, a.idx, a.t0, a.t1, s.spk, coalesce(x.ov, 0) AS ov, row_number() OVER (PARTITION BY a.video_id, a.idx ORDER BY coalesce(x.ov, 0) DESC, s.seen) AS n
           FROM v_subs a LEFT JOIN seen s ON a.video_id = s.video_id LEFT JOIN shared x ON x.video_id = a.video_id AND x.idx = a.idx AND x.spk = s.spk),
att AS (SELECT video_id, idx, t0, t1, coalesce(max(CASE WHEN n = 1 THEN spk END), 'SPK_00') AS spk, max(CASE WHEN n = 1 THEN CAST(ov AS DOUBLE) END) / greatest(t1 - t0, 1) AS conf,
        max(CASE WHEN n = 2 THEN spk END) AS runner, max(CASE WHEN n = 2 THEN CAST(ov AS DOUBLE) END) / greatest(t1 - t0, 1) AS runner_conf FROM ranked GROUP BY video_id, idx, t0, t1)"""


@query(with_views("v_segs", "WITH " + _MERGED.format(src="v_segs") + " SELECT * FROM merged"))
def merge_segments(v):
    return intervals.merge_segments(v.segs)


@query(with_views("v_subs v_segs", "WITH " + _MERGED.format(src="v_segs") + "," + _ATTRIBUTED + " SELECT *, conf < 0.6 AS review FROM att"))
def interval_attribution(v):
    return intervals.attribute(v.subs, v.segs)


_RELABELED = "relabeled AS (SELECT video_id, seg_ord, t0, t1, CASE spk WHEN 'SPK_02' THEN 'SPK_00' ELSE spk END AS spk FROM v_segs)"


def _merges(v):
    return v.segs.select("video_id").distinct().select("video_id", F.lit("SPK_02").alias("id"), F.lit("SPK_00").alias("target"))


@query(with_views("v_segs", "WITH " + _RELABELED + " SELECT * FROM relabeled"))
def merge_relabel(v):
    return intervals.relabel(v.segs, _merges(v)).select("video_id", "seg_ord", "t0", "t1", "spk")


@query(with_views("v_subs v_segs", "WITH " + _RELABELED + "," + _MERGED.format(src="relabeled") + "," + _ATTRIBUTED + " SELECT video_id, idx, spk, conf FROM att"))
def reattribute_after_merge(v):
    return intervals.attribute(v.subs, intervals.relabel(v.segs, _merges(v))).select("video_id", "idx", "spk", "conf")


@query(
    with_views(
        "v_subs v_segs",
        "WITH " + _MERGED.format(src="v_segs") + "," + _ATTRIBUTED + """ SELECT video_id, count(*) AS lines, count_if(conf < 0.6) AS review, floor(sum(CAST(floor(conf * 10000 + 0.5) AS BIGINT)) / (10.0::DOUBLE * count(*)) + 0.5) / 1000 AS conf_mean, floor(count_if(conf < 0.6) * 1000.0::DOUBLE / count(*) + 0.5) / 1000 AS review_ratio,
        array_to_string(list_sort(list(DISTINCT spk)), ',') AS speakers FROM att GROUP BY video_id""",
    )
)
def attribution_stats(v):
    """Lines, how many want review, and two means: that of conf rounded to four places, and the share to review, both to three."""
    a = intervals.attribute(v.subs, v.segs)
    n = F.count(F.lit(1))
    conf = F.floor(F.sum(F.floor(F.col("conf") * 10000 + 0.5)) / (n * 10.0) + 0.5) / 1000
    return a.groupBy("video_id").agg(n.alias("lines"), F.count_if("review").alias("review"), conf.alias("conf_mean"), (F.floor(F.count_if("review") * 1000.0 / n + 0.5) / 1000).alias("review_ratio"), F.array_join(F.sort_array(F.collect_set("spk")), ",").alias("speakers"))


@query(
    with_views(
        "v_segs",
        """SELECT video_id, spk, t0, t1, place FROM (SELECT *, row_number() OVER (PARTITION BY video_id, spk ORDER BY t0 - t1, t0, seg_ord) AS place FROM v_segs a
        WHERE t1 - t0 >= 4000 AND NOT EXISTS (SELECT 1 FROM v_segs b WHERE b.video_id = a.video_id AND b.spk <> a.spk AND least(a.t1, b.t1) - greatest(a.t0, b.t0) > 200)) WHERE place <= 3""",
    )
)
def clean_segments(v):
    return intervals.clean_segments(v.segs).select("video_id", "spk", "t0", "t1", "place")


@query(with_views("v_segs", "SELECT video_id, spk, sum(t1 - t0) AS talk_ms, count(*) AS segs FROM v_segs GROUP BY ALL"))
def talk_time(v):
    return v.segs.groupBy("video_id", "spk").agg(F.sum(F.col("t1") - F.col("t0")).alias("talk_ms"), F.count(F.lit(1)).alias("segs"))


_LINES = """
h AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY ts, pos) AS prev FROM v_hits),
g AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND regexp_replace(prev, '\\s+', '', 'g') = regexp_replace(text, '\\s+', '', 'g') AND regexp_replace(text, '\\s+', '', 'g') <> '' THEN 0 ELSE 1 END)
      OVER (PARTITION BY video_id ORDER BY ts, pos) AS line FROM h),
l AS (SELECT video_id, line, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(text, (length(text), -pos)) AS text, count(*) AS hits FROM g GROUP BY ALL)"""


@query(with_views("v_hits", "WITH " + _LINES + " SELECT * FROM l"))
def ocr_lines_exact(v):
    return sequences.ocr_lines(v.hits, exact=True)


@query()
def ocr_lines(v):
    return sequences.ocr_lines(v.hits)


_MONOTONE = """
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY line) AS i FROM l),
e AS (SELECT *, 310 * i + greatest(0, max(greatest(last_ts + 250, greatest(0, first_ts - 250) + 300) - 310 * i) OVER (PARTITION BY video_id ORDER BY line)) AS t1 FROM n),
mono AS (SELECT video_id, line, greatest(0, first_ts - 250, coalesce(lag(t1) OVER (PARTITION BY video_id ORDER BY line), 0) + 10) AS t0, t1 FROM e)"""


@query(with_views("v_hits", "WITH " + _LINES + "," + _MONOTONE + " SELECT * FROM mono"))
def monotone_lines(v):
    return sequences.monotone_lines(sequences.ocr_lines(v.hits, exact=True)).select("video_id", "line", "t0", "t1")


@query(with_views("v_hits", "WITH " + _LINES + "," + _MONOTONE + " SELECT video_id, count(*) AS lines, round(avg(t1 - t0), 3) AS mean_ms FROM mono GROUP BY ALL"))
def ocr_stats(v):
    lines = sequences.monotone_lines(sequences.ocr_lines(v.hits, exact=True))
    return lines.groupBy("video_id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg(F.col("t1") - F.col("t0")), 3).alias("mean_ms"))


@query(
    with_views(
        "v_tagged",
        r"""WITH c AS (SELECT video_id, idx, t0, t1, coalesce(nullif(regexp_extract(text, '^\[(SPK_\d+)\]', 1), ''), 'SPK_00') AS spk, regexp_replace(regexp_replace(trim(text), '^\[SPK_\d+\]\s*', ''), '\s+', ' ', 'g') AS clean FROM v_tagged),
        w AS (SELECT video_id, idx, idx AS unit, t0, t1, spk, clean AS text FROM c WHERE idx = 1
          UNION ALL
          SELECT c.video_id, c.idx, CASE WHEN w.spk = c.spk AND c.t0 - w.t1 <= 600 AND length(w.text) + length(c.clean) <= 45 THEN w.unit ELSE c.idx END,
            CASE WHEN w.spk = c.spk AND c.t0 - w.t1 <= 600 AND length(w.text) + length(c.clean) <= 45 THEN w.t0 ELSE c.t0 END, c.t1, c.spk,
            CASE WHEN w.spk = c.spk AND c.t0 - w.t1 <= 600 AND length(w.text) + length(c.clean) <= 45 THEN w.text || ',' || c.clean ELSE c.clean END
          FROM w JOIN c ON c.video_id = w.video_id AND c.idx = w.idx + 1)
        SELECT video_id, unit AS idx, arg_max(t0, w.idx) AS t0, arg_max(t1, w.idx) AS t1, arg_max(spk, w.idx) AS spk, arg_max(text, w.idx) AS text FROM w GROUP BY video_id, unit""",
        recursive=True,
    )
)
def merge_units(v):
    return sequences.merge_units(v.tagged)


_PLAN = """
p AS (SELECT *, t1 - t0 AS win, least(CAST(greatest(0, CASE WHEN coalesce(nx, 0) = 0 THEN 1000000000000 ELSE nx - 50 - t1 END) AS DOUBLE), (t1 - t0) * 0.5) AS lent
      FROM (SELECT *, lead(t0) OVER (PARTITION BY video_id ORDER BY idx) AS nx FROM v_manifest) WHERE wav_dur IS NOT NULL),
pl AS (SELECT video_id, idx, CASE WHEN wav_dur <= win THEN CAST(t1 AS DOUBLE) WHEN wav_dur <= win + lent OR wav_dur / (win + lent) <= 1.15 THEN t1 + lent ELSE CAST(t1 AS DOUBLE) END AS win_end,
      round(CASE WHEN wav_dur <= win + lent THEN 1.0::DOUBLE WHEN wav_dur / (win + lent) <= 1.15 THEN wav_dur / (win + lent) ELSE least(2.0::DOUBLE, wav_dur / win) END, 4) AS tempo,
      CASE WHEN wav_dur <= win THEN 'fit' WHEN wav_dur <= win + lent THEN 'borrow' ELSE 'atempo' END AS mode FROM p),
plan AS (SELECT *, mode = 'atempo' AND tempo > 1.15 AS over FROM pl)"""


@query(with_views("v_manifest", "WITH " + _PLAN + " SELECT * FROM plan"))
def dub_plan(v):
    return sequences.dub_plan(v.manifest)


@query(with_views("v_manifest", "WITH " + _PLAN + " SELECT m.mode, (SELECT count(*) FROM plan WHERE plan.mode = m.mode OR (over AND m.mode = 'atempo_over')) AS n FROM (VALUES ('fit'), ('borrow'), ('atempo'), ('atempo_over')) m(mode)"))
def mix_mode_counts(v):
    return sequences.mode_counts(sequences.dub_plan(v.manifest))


@query(
    with_views(
        "v_manifest",
        """WITH d AS (SELECT *, sum(wav_dur + 50) OVER (PARTITION BY video_id ORDER BY idx) AS d FROM v_manifest WHERE wav_dur IS NOT NULL),
        e AS (SELECT *, d + greatest(0, max(t0 + wav_dur - d) OVER (PARTITION BY video_id ORDER BY idx)) AS end_t FROM d)
        SELECT video_id, idx, CAST(end_t - wav_dur AS BIGINT) AS place_t, CAST(end_t AS BIGINT) AS end_t FROM e""",
    )
)
def place_track(v):
    return sequences.place_track(v.manifest).select("video_id", "idx", "place_t", "end_t")


_SPANS = """
o AS (SELECT video_id, t0, t1, max(t1) OVER (PARTITION BY video_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_segs WHERE spk = 'SPK_01'),
q AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 > reach + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
spans AS (SELECT video_id, min(t0) AS t0, max(t1) AS t1 FROM q GROUP BY video_id, island HAVING max(t1) > min(t0))"""


@query(with_views("v_segs", "WITH " + _SPANS + " SELECT * FROM spans"))
def union_spans(v):
    return intervals.union_spans(v.segs.filter("spk = 'SPK_01'").select("video_id", "t0", "t1"))


@query(
    with_views(
        "v_segs v_subs",
        "WITH " + _SPANS + """, k AS (SELECT *, coalesce(max(t1) OVER (PARTITION BY video_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM spans),
        t AS (SELECT video_id, max(t1) AS total FROM v_subs GROUP BY ALL), z AS (SELECT video_id, max(t1) AS last FROM spans GROUP BY ALL)
        SELECT * FROM (SELECT video_id, 'dub' AS src, cursor AS a, greatest(t0, cursor) AS b FROM k WHERE t1 > cursor UNION ALL SELECT video_id, 'orig', greatest(t0, cursor), t1 FROM k WHERE t1 > cursor
          UNION ALL SELECT t.video_id, 'dub', coalesce(z.last, 0), t.total FROM t LEFT JOIN z ON t.video_id = z.video_id) WHERE b > a""",
    )
)
def stitch_plan(v):
    spans = intervals.union_spans(v.segs.filter("spk = 'SPK_01'").select("video_id", "t0", "t1"))
    return intervals.stitch_plan(spans, v.subs.groupBy("video_id").agg(F.max("t1").alias("total")))


_DENSE = """
tot AS (SELECT video_id, max(t1) AS total FROM v_subs GROUP BY ALL),
w AS (SELECT video_id, 1 AS tier, 90000 + 5000 * unnest(generate_series(0, CAST(round_even((total - 210000) / 5000, 0) AS BIGINT))) AS ws FROM tot WHERE total - 120000 >= 90000
      UNION ALL SELECT video_id, 2, 5000 * unnest(generate_series(0, CAST(round_even((total - 60000) / 5000, 0) AS BIGINT))) FROM tot WHERE total >= 60000),
n AS (SELECT w.video_id, w.tier, w.ws, count(*) AS n FROM w JOIN v_subs s ON s.video_id = w.video_id AND s.t0 >= w.ws AND s.t1 <= w.ws + 60000 GROUP BY ALL),
b AS (SELECT video_id, arg_min(ws, (tier, -n, ws)) AS ws FROM n GROUP BY ALL),
dense AS (SELECT t.video_id, t.total, coalesce(CAST(b.ws AS DOUBLE), greatest(0.0, t.total / 2 - 30000)) AS w0, coalesce(CAST(b.ws + 60000 AS DOUBLE), least(CAST(t.total AS DOUBLE), t.total / 2 + 30000)) AS w1 FROM tot t LEFT JOIN b ON t.video_id = b.video_id)"""


def _dense(v):
    return sequences.dense_window(v.subs, v.subs.groupBy("video_id").agg(F.max("t1").alias("total")))


@query(with_views("v_subs", "WITH " + _DENSE + " SELECT * FROM dense"))
def dense_window(v):
    return _dense(v)


@query(
    with_views(
        "v_tagged",
        "WITH " + _DENSE + r""", u AS (SELECT t.video_id, coalesce(nullif(regexp_extract(t.text, '^\[(SPK_\d+)\]', 1), ''), 'SPK_00') = 'SPK_01' AS skip FROM v_tagged t JOIN dense d ON d.video_id = t.video_id
          WHERE (t.t0 >= 0 AND t.t1 <= 60000) OR (t.t0 >= d.w0 AND t.t1 <= d.w1))
        SELECT video_id, count_if(NOT skip) AS dubbed, count_if(skip) AS skipped FROM u GROUP BY ALL""",
    )
)
def preview_units(v):
    d = _dense(v).select(F.col("video_id").alias("_v"), "w0", "w1")
    inside = ((F.col("t0") >= 0) & (F.col("t1") <= 60000)) | ((F.col("t0") >= F.col("w0")) & (F.col("t1") <= F.col("w1")))
    units = v.tagged.join(d, F.col("video_id") == F.col("_v")).filter(inside).withColumn("skip", s.speaker_tag(F.col("text")) == "SPK_01")
    return units.groupBy("video_id").agg(F.count_if(~F.col("skip")).alias("dubbed"), F.count_if("skip").alias("skipped"))


@query(
    with_views(
        "v_segs",
        """WITH e AS (SELECT *, row_number() OVER (PARTITION BY video_id, spk ORDER BY t0, t1) AS n FROM v_segs WHERE t1 - t0 BETWEEN 3500 AND 8000),
        f AS (SELECT video_id, spk, n, [t0] AS starts, [t1] AS ends, t1 - t0 AS total FROM e WHERE n = 1
          UNION ALL
          SELECT e.video_id, e.spk, e.n, CASE WHEN ok THEN list_append(f.starts, e.t0) ELSE f.starts END, CASE WHEN ok THEN list_append(f.ends, e.t1) ELSE f.ends END, CASE WHEN ok THEN f.total + e.t1 - e.t0 ELSE f.total END
          FROM f JOIN e ON e.video_id = f.video_id AND e.spk = f.spk AND e.n = f.n + 1, LATERAL (SELECT len(f.starts) < 3 AND abs(e.t0 - f.starts[-1]) > 60000 AND f.total + e.t1 - e.t0 <= 30000 AS ok) x),
        z AS (SELECT video_id, spk, arg_max(starts, n) AS starts, arg_max(ends, n) AS ends FROM f GROUP BY ALL)
        SELECT video_id, spk, CAST(unnest(generate_series(0, len(starts) - 1)) AS INT) AS place, unnest(starts) AS t0, unnest(ends) AS t1 FROM z""",
        recursive=True,
    )
)
def spaced_samples(v):
    return sequences.spaced_samples(v.segs)


_RUNS = """
m AS (SELECT *, CASE WHEN db > -40 THEN 1 ELSE 0 END AS m FROM v_frames),
r AS (SELECT *, sum(CASE WHEN pm IS NULL OR pm <> m THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY frame_no) AS r FROM (SELECT *, lag(m) OVER (PARTITION BY file ORDER BY frame_no) AS pm FROM m)),
f AS (SELECT *, CASE WHEN m = 0 AND count(*) OVER (PARTITION BY file, r) * 1000 > 2000 THEN 0 ELSE 1 END AS m2 FROM r),
r2 AS (SELECT *, sum(CASE WHEN pm2 IS NULL OR pm2 <> m2 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY frame_no) AS r2 FROM (SELECT *, lag(m2) OVER (PARTITION BY file ORDER BY frame_no) AS pm2 FROM f)),
z AS (SELECT file, max(frame_no) + 1 AS n FROM v_frames GROUP BY ALL),
q AS (SELECT file, min(frame_no) * 1000 AS a, (max(frame_no) + 1) * 1000 AS b, stddev_pop(db) AS flat FROM r2 WHERE m2 = 1 GROUP BY file, r2 HAVING count(*) * 1000 >= 6000),
runs AS (SELECT q.file, greatest(CAST(a AS DOUBLE), n * 1000 * 0.15::DOUBLE) AS t0, least(CAST(b AS DOUBLE), n * 1000 * 0.85::DOUBLE) AS t1, flat FROM q JOIN z ON q.file = z.file
         WHERE least(CAST(b AS DOUBLE), n * 1000 * 0.85::DOUBLE) - greatest(CAST(a AS DOUBLE), n * 1000 * 0.15::DOUBLE) >= 6000)"""


def _runs(v):
    return sequences.speech_runs(v.frames, frame_ms=1000, gap_ms=2000, least_ms=6000)


@query(with_views("v_frames", "WITH " + _RUNS + " SELECT file, t0, t1, round(flat, 6) AS flat FROM runs"))
def speech_runs(v):
    return _runs(v).withColumn("flat", F.round("flat", 6))


_WINDOWS = """
w AS (SELECT file, least(8000.0::DOUBLE, t1 - t0) AS span, CASE WHEN t1 - t0 < 8000 THEN t0 ELSE t0 + 2000 * i END AS w0
      FROM (SELECT *, unnest(generate_series(0, CASE WHEN t1 - t0 < 8000 THEN 0 ELSE CAST(floor((t1 - t0 - 8000 + 10) / 2000) AS BIGINT) END)) AS i FROM runs)),
x AS (SELECT w.file, w.w0, w.span, v.db, v.db_h FROM w JOIN v_frames v ON v.file = w.file AND v.frame_no >= floor(w.w0 / 1000) AND v.frame_no < floor((w.w0 + w.span) / 1000)),
y AS (SELECT file, w0, span, median(db_h) AS med, stddev_pop(db) AS flat, list(db_h) AS high FROM x GROUP BY ALL HAVING count(*) >= 5),
windows AS (SELECT file, w0, w0 + span AS w1, round(len(list_filter(high, lambda h: h < med - 5)) / len(high), 3) AS quiet, round(flat, 2) AS flat FROM y)"""


def _windows(v):
    return sequences.quiet_windows(v.frames, _runs(v), width_ms=8000, frame_ms=1000, dip=5.0)


@query(with_views("v_frames", "WITH " + _RUNS + "," + _WINDOWS + " SELECT * FROM windows"))
def quiet_windows(v):
    return _windows(v)


@query(
    with_views(
        "v_frames",
        "WITH " + _RUNS + "," + _WINDOWS + """,
        o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY quiet DESC, flat, w0) AS n FROM windows WHERE quiet >= 0.08),
        g AS (SELECT file, n, [{'w0': w0, 'w1': w1}] AS p FROM o WHERE n = 1
          UNION ALL
          SELECT o.file, o.n, CASE WHEN len(g.p) < 3 AND len(list_filter(g.p, lambda k: NOT (o.w1 <= k.w0 - 5000 OR o.w0 >= k.w1 + 5000))) = 0 THEN list_append(g.p, {'w0': o.w0, 'w1': o.w1}) ELSE g.p END
          FROM g JOIN o ON o.file = g.file AND o.n = g.n + 1)
        SELECT file, k.w0 AS w0, k.w1 AS w1 FROM (SELECT file, unnest(p) AS k FROM (SELECT file, arg_max(p, n) AS p FROM g GROUP BY ALL))""",
        recursive=True,
    )
)
def pick_windows(v):
    return sequences.pick_windows(_windows(v))


@query(with_views("v_frames", "SELECT file, round(quantile_cont(db, 0.95), 6) AS peak, round(quantile_cont(db, 0.10), 6) AS floor, quantile_cont(db, 0.10) > -45 AS bgm FROM v_frames GROUP BY ALL"))
def noise_floor(v):
    return v.frames.groupBy("file").agg(F.round(F.expr("percentile(db, 0.95)"), 6).alias("peak"), F.round(F.expr("percentile(db, 0.10)"), 6).alias("floor"), (F.expr("percentile(db, 0.10)") > -45).alias("bgm"))


_VOTES = "SELECT video_id, spk, CASE WHEN video_id LIKE '%0' AND seg_ord % 16 <> 7 THEN 'zh' ELSE ['zh', 'ja', 'en', 'ko'][CAST(seg_ord % 4 AS INT) + 1] END AS lang, sum(t1 - t0) AS ms, min(seg_ord) AS first_ord FROM v_segs GROUP BY ALL"
_VERDICT = f"votes AS ({_VOTES}), sp AS (SELECT video_id, spk, sum(CASE WHEN lang = 'zh' THEN ms ELSE 0 END) / sum(ms) AS zh_ratio, arg_min(lang, (-ms, first_ord)) AS lang FROM votes GROUP BY ALL)"


def _votes(v):
    lang = F.expr("CASE WHEN video_id LIKE '%0' AND seg_ord % 16 <> 7 THEN 'zh' ELSE element_at(array('zh', 'ja', 'en', 'ko'), cast(seg_ord % 4 AS int) + 1) END")
    each = v.segs.groupBy("video_id", "spk", lang.alias("lang")).agg(F.sum(F.col("t1") - F.col("t0")).alias("ms"), F.min("seg_ord").alias("first_ord"))
    return each.groupBy("video_id", "spk").agg((F.sum(F.when(F.col("lang") == "zh", F.col("ms")).otherwise(0)) / F.sum("ms")).alias("zh_ratio"), F.min_by("lang", F.struct((-F.col("ms")).alias("less"), "first_ord")).alias("lang"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "ms")))).alias("votes"))


@query(with_views("v_segs", "WITH " + _VERDICT + " SELECT * FROM sp"))
def language_vote(v):
    return _votes(v).drop("votes")


@query(with_views("v_segs", "WITH " + _VERDICT + " SELECT video_id, CASE WHEN bool_and(zh_ratio >= 0.6) THEN 'skip_all' ELSE 'dub' END AS verdict FROM sp GROUP BY ALL"))
def language_verdict(v):
    return _votes(v).groupBy("video_id").agg(F.when(F.bool_and(F.col("zh_ratio") >= 0.6), "skip_all").otherwise("dub").alias("verdict"))


@query(with_views("v_segs", "SELECT video_id, array_to_string(list(spk ORDER BY first_ord), ',') AS labels, array_to_string(list(spk ORDER BY spk), ',') = array_to_string(list(spk ORDER BY first_ord), ',') AS aligned FROM (SELECT video_id, spk, min(seg_ord) AS first_ord FROM v_segs GROUP BY ALL) GROUP BY ALL"))
def alignment_check(v):
    first = v.segs.groupBy("video_id", "spk").agg(F.min("seg_ord").alias("first_ord"))
    both = first.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_ord", "spk"))), lambda x: x["spk"]), ",").alias("labels"), F.array_join(F.sort_array(F.collect_list("spk")), ",").alias("sorted"))
    return both.select("video_id", "labels", (F.col("labels") == F.col("sorted")).alias("aligned"))
