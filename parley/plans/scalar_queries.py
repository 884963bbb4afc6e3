"""Queries of scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import scalars as s
from parley.operators import intervals
from parley.plans.registry import query
from parley.sources.views import with_views


@query(with_views("v_subs v_segs", "SELECT a.video_id, a.idx, b.seg_ord, greatest(0, least(a.t1, b.t1) - greatest(a.t0, b.t0)) AS ov FROM v_subs a JOIN v_segs b ON a.video_id = b.video_id AND a.t0 < b.t1 AND b.t0 < a.t1"))
def interval_overlap(v):
    return intervals.overlaps(v.subs, v.segs).select("video_id", "idx", "seg_ord", "ov")


@query(with_views("v_subs", "SELECT video_id, idx, printf('%02d:%02d:%02d,%03d', t0 // 3600000, t0 // 60000 % 60, t0 // 1000 % 60, t0 % 1000) AS stamp, printf('%02d:%02d', t0 // 60000, t0 // 1000 % 60) AS short FROM v_subs"))
def fmt_timestamp(v):
    return v.subs.select("video_id", "idx", s.srt_time(F.col("t0")).alias("stamp"), s.minutes_seconds(F.col("t0") / 1000).alias("short"))


@query(
    with_views(
        "v_catalog",
        """SELECT bvid, CASE len(p) WHEN 2 THEN TRY_CAST(p[1] AS INT) * 60 + TRY_CAST(p[2] AS INT) WHEN 3 THEN TRY_CAST(p[1] AS INT) * 3600 + TRY_CAST(p[2] AS INT) * 60 + TRY_CAST(p[3] AS INT) END AS seconds,
        CASE WHEN length <> 'n/a' THEN CASE len(p) WHEN 2 THEN CAST(p[1] AS BIGINT) * 60 + CAST(p[2] AS BIGINT) ELSE (CAST(p[1] AS BIGINT) * 60 + CAST(p[2] AS BIGINT)) * 60 + CAST(p[3] AS BIGINT) END END AS any_arity
        FROM (SELECT *, string_split(length, ':') AS p FROM v_catalog)""",
    )
)
def parse_length(v):
    return v.catalog.select("bvid", s.parse_length(F.col("length")).alias("seconds"), s.parse_length_any(F.col("length")).alias("any_arity"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id % 97 END AS part FROM events""")
def norm_part(v):
    n = F.col("event_id") % 97
    raw = F.when(F.col("event_id") % 4 == 0, n.cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("P"), n.cast("string"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit(" p"), n.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("x"), n.cast("string")))
    return v.table("events").select("event_id", s.norm_part(raw).cast("long").alias("part"))


@query(with_views("v_catalog", "SELECT bvid, strftime(make_timestamp(created * 1000000), '%Y-%m-%d') AS day FROM v_catalog"))
def epoch_date(v):
    return v.catalog.select("bvid", s.epoch_date(F.col("created")).cast("string").alias("day"))


_BADGE = "CASE pos % 4 WHEN 0 THEN concat('HD4', '中', text, '文', 'x9.') WHEN 1 THEN concat('12345678%', text) WHEN 2 THEN concat('字', text, '字OK') ELSE text END"


@query(
    with_views(
        "v_hits",
        rf"""WITH t AS (SELECT video_id, pos, {_BADGE} AS t FROM v_hits)
        SELECT video_id, pos, CASE WHEN regexp_matches(t, '[一-鿿]') THEN trim(regexp_replace(regexp_replace(t, '^[0-9A-Za-z.]{{1,5}}([一-鿿])', '\1'), '([一-鿿])[0-9A-Za-z.]{{1,5}}$', '\1'))
          WHEN regexp_full_match(t, '[0-9A-Za-z.%]{{6,}}') THEN t ELSE '' END AS clean FROM t""",
    )
)
def clean_badge(v):
    return v.hits.select("video_id", "pos", s.clean_badge(F.expr(_BADGE)).alias("clean"))


@query(with_views("v_tagged", r"SELECT video_id, idx, coalesce(nullif(regexp_extract(text, '^\[(SPK_\d+)\]', 1), ''), 'SPK_00') AS spk, regexp_replace(regexp_replace(trim(text), '^\[SPK_\d+\]\s*', ''), '\s+', ' ', 'g') AS clean FROM v_tagged"))
def speaker_tag(v):
    return v.tagged.select("video_id", "idx", s.speaker_tag(F.col("text")).alias("spk"), s.dub_text(F.col("text")).alias("clean"))


@query(r"""SELECT page_id, substr(trim(regexp_replace(url, '[\\/:*?"<>|\r\n\t]', '_', 'g')), 1, 60) AS file FROM pages""")
def sanitize_title(v):
    return v.table("pages").select("page_id", s.sanitize_title(F.col("url")).alias("file"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
m AS (SELECT label, list(m ORDER BY i) AS y FROM (SELECT label, i, avg(x[i]) AS m FROM (SELECT label, x, unnest(generate_series(1, len(x))) AS i FROM e) GROUP BY ALL) GROUP BY label)
SELECT vec_id, e.label, round(list_cosine_similarity(x, y), 6) AS cos FROM e JOIN m ON e.label = m.label""")
def cosine_pairs(v):
    """Cosine of each vector with the mean of its label."""
    e = v.table("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "m")).groupBy("label", "i").agg(F.avg("m").alias("m"))
    middle = means.groupBy(F.col("label").alias("l")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("y"))
    return e.join(middle, F.col("label") == F.col("l")).select("vec_id", "label", F.round(s.cosine(F.col("x"), F.col("y")), 6).alias("cos"))


@query("""SELECT conv_id, turn, substr(sha256(CAST(to_json({'by': {'role': role, 'turn': turn}, 'text': text}) AS VARCHAR)), 1, 12) AS hash FROM conversations""")
def content_hash(v):
    said = v.table("conversations").select("conv_id", "turn", F.struct("text", F.struct("turn", "role").alias("by")).alias("said"))
    return said.select("conv_id", "turn", s.content_hash(s.canonical_json(F.col("said"), said.schema["said"].dataType)).alias("hash"))


@query(with_views("v_refs", "SELECT name, pos, coalesce(nullif(use, ''), 'clone') AS use FROM v_refs"))
def norm_use(v):
    return v.refs.select("name", F.inline("refs")).select("name", "pos", s.norm_use(F.col("use")).alias("use"))


@query("""SELECT printf('%.2f', floor(value / 100 / 0.02) * 0.02) AS bin, count(*) AS n FROM events GROUP BY ALL""")
def score_histogram(v):
    return v.table("events").groupBy(s.score_bin(F.col("value") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("v_hits", "SELECT video_id, pos, ts, conf FROM v_hits WHERE length(text) >= 2 AND conf >= 0.5"))
def ocr_hit_filter(v):
    return v.hits.filter((F.length("text") >= 2) & (F.col("conf") >= 0.5)).select("video_id", "pos", "ts", "conf")


@query(with_views("v_ledger", "SELECT bvid, part, status, busy FROM v_ledger WHERE status = 'reviewed' AND busy ORDER BY bvid, part"))
def ledger_query(v):
    return v.ledger.filter("status = 'reviewed' AND busy").select("bvid", "part", "status", "busy").orderBy("bvid", "part")


@query(with_views("v_refs", "SELECT name, coalesce(nullif(use, ''), 'clone') AS use, count(*) AS n, min(pos) AS first_pos FROM v_refs GROUP BY ALL"))
def refs_by_use(v):
    flat = v.refs.select("name", F.inline("refs")).withColumn("use", s.norm_use(F.col("use")))
    return flat.groupBy("name", "use").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query(with_views("v_tagged", r"SELECT video_id, idx FROM v_tagged WHERE coalesce(nullif(regexp_extract(text, '^\[(SPK_\d+)\]', 1), ''), 'SPK_00') NOT IN ('SPK_01')"))
def drop_skipped_speakers(v):
    skipped = v.spark.createDataFrame([("SPK_01",)], "skip string")
    return v.tagged.withColumn("spk", s.speaker_tag(F.col("text"))).join(skipped, F.col("spk") == F.col("skip"), "left_anti").select("video_id", "idx")


@query(with_views("v_catalog", "SELECT bvid, title FROM v_catalog WHERE contains(lower(title), 'red')"))
def catalog_search(v):
    return v.catalog.filter(s.title_contains(F.col("title"), "Red")).select("bvid", "title")


@query(with_views("v_subs", "SELECT video_id, idx, printf('SPK_%02d', (idx - 1) % 3) AS spk FROM v_subs"))
def mock_round_robin(v):
    return v.subs.select("video_id", "idx", F.format_string("SPK_%02d", (F.col("idx") - 1) % 3).alias("spk"))


@query("""SELECT page_id, rule FROM (SELECT p.page_id, r.rule, row_number() OVER (PARTITION BY p.page_id ORDER BY r.ord) AS n
FROM pages p JOIN (VALUES (1, 'blog.'), (2, '.example.net'), (3, '/en/'), (4, 'http')) r(ord, rule) ON contains(p.url, r.rule)) WHERE n = 1""")
def substring_route(v):
    # rules are configuration, a fixed few: the theta join broadcasts them
    rules = v.spark.createDataFrame([(1, "blog."), (2, ".example.net"), (3, "/en/"), (4, "http")], "ord int, rule string")
    return v.table("pages").select("page_id", "url").join(F.broadcast(rules), F.contains("url", "rule")).groupBy("page_id").agg(F.min_by("rule", "ord").alias("rule"))


@query(with_views("v_manifest", "SELECT video_id, idx, CAST(round_even(t0 * 24.0, 0) AS BIGINT) AS sample, t0 - 1000 AS shifted, CASE WHEN idx % 2 = 0 THEN 'skip' ELSE 'dub' END AS suggestion FROM v_manifest"))
def placement_samples(v):
    verdict = F.when(F.col("idx") % 2 == 0, F.lit("skip_all")).otherwise(F.lit("mixed"))
    return v.manifest.select("video_id", "idx", s.sample_index(F.col("t0") / 1000, 24000).alias("sample"), s.shift_into(F.col("t0"), F.lit(1000)).alias("shifted"), s.suggestion(verdict).alias("suggestion"))
