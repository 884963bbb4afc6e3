"""Queries of the archive's upkeep and of records: fallbacks, reuse, payloads, copies that must agree, rendered tracks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from parley.functions import scalars as s
from parley.operators import archive, intervals, records, sequences, voice, workflow
from parley.plans.registry import query
from parley.plans.scalar_queries import _BADGE
from parley.plans.sequence_queries import _LINES, _MONOTONE, _PLAN
from parley.plans.voice_queries import _CALIBRATED, _PAIRS
from parley.sources.views import with_views

_PEOPLE = "people AS (SELECT DISTINCT concat('P', CAST(label AS VARCHAR)) AS person, ['zh', 'en', NULL, 'ja'][CAST(label % 4 AS INT) + 1] AS main_lang FROM embeddings)"


def _people(v):
    return v.table("embeddings").select("label").distinct().selectExpr("concat('P', cast(label AS string)) AS person", "element_at(array('zh', 'en', NULL, 'ja'), cast(label % 4 AS int) + 1) AS main_lang")


@query(with_views("v_speakers", f"WITH {_PEOPLE} SELECT video_id, spk, coalesce(nullif(lang, ''), main_lang) AS archive_lang FROM v_speakers s LEFT JOIN people p ON s.truth = p.person"))
def lang_fallback(v):
    return archive.with_language(v.speakers.withColumnRenamed("truth", "person"), _people(v)).select("video_id", "spk", "archive_lang")


@query(with_views("v_archive", "SELECT seq, ref_path FROM v_archive WHERE person = 'P1' AND lang = 'zh'"))
def archive_entries(v):
    return archive.entries(v.archive, "P1", "zh").select("seq", "ref_path")


_REVIEWED = """
rw AS (SELECT vec_id, s.*, vec_id AS ord, CASE WHEN vec_id % 2 = 1 AND vec_id % 120 >= 80 THEN vec_id - 80 WHEN vec_id % 2 = 1 AND vec_id % 120 >= 40 THEN vec_id - 40 ELSE vec_id END AS final,
       CASE WHEN vec_id % 7 = 1 THEN 'skip' ELSE 'clone' END AS voice, CASE WHEN vec_id % 35 = 0 THEN 'P3' WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN 'P99' ELSE truth END AS owner,
       CASE WHEN vec_id % 17 = 0 THEN '' WHEN vec_id % 3 = 0 THEN concat('t', CAST(vec_id // 100 AS VARCHAR)) ELSE concat('s', CAST(vec_id AS VARCHAR)) END AS sample FROM (SELECT *, CAST(substr(spk, 5) AS BIGINT) AS vec_id FROM v_speakers) s),
fi AS (SELECT r.vec_id, r.video_id, r.spk, r.ord, r.vec, r.sample, t.owner AS person, t.voice AS owner_voice, coalesce(nullif(r.lang, ''), p.main_lang) AS lang, p.person AS known,
       EXISTS (SELECT 1 FROM v_speakers h WHERE CAST(substr(h.spk, 5) AS BIGINT) % 19 = 0 AND h.truth = t.owner AND concat('s', substr(h.spk, 5)) = r.sample) AS had
       FROM rw r JOIN rw t ON r.final = t.vec_id LEFT JOIN people p ON p.person = t.owner),
wh AS (SELECT *, CASE WHEN person IS NULL OR owner_voice = 'skip' THEN 'no person' WHEN known IS NULL THEN 'unknown person' WHEN sample = '' THEN 'no sample' WHEN had THEN 'archived before' END AS why FROM fi),
ak AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ord) AS n FROM wh WHERE why IS NULL),
he AS (SELECT person, list({'l': lang, 'v': vec} ORDER BY seq) AS held FROM v_capped GROUP BY ALL),
fo AS (SELECT a.person, CAST(0 AS BIGINT) AS n, coalesce(h.held, []) AS held, []::VARCHAR[] AS samples, NULL::VARCHAR AS status, CAST(NULL AS DOUBLE) AS score, NULL::VARCHAR AS spk, NULL::VARCHAR AS video_id, NULL::VARCHAR AS lang, 0::BIGINT AS many FROM (SELECT DISTINCT person FROM ak) a LEFT JOIN he h ON h.person = a.person
  UNION ALL
  SELECT person, n, held, CASE WHEN status = 'archived' THEN list_append(samples, sample) ELSE samples END, status, CASE WHEN status <> 'again' THEN score END, spk, video_id, lang, len(list_filter(held, lambda x: lang IS NULL OR x.l = lang)) FROM (
    SELECT * REPLACE (CASE WHEN status <> 'archived' THEN held WHEN len(list_filter(held, lambda x: x.l IS NOT DISTINCT FROM lang)) < 10 THEN list_append(held, {'l': lang, 'v': vec})
      ELSE list_append(list_concat(held[1:first - 1], held[first + 1:]), {'l': lang, 'v': vec}) END AS held) FROM (
    SELECT *, CASE WHEN list_contains(samples, sample) THEN 'again' WHEN coalesce(score < p5, false) THEN 'blocked' ELSE 'archived' END AS status, list_position(list_transform(held, lambda x: x.l IS NOT DISTINCT FROM lang), true) AS first FROM (
    SELECT *, CASE WHEN len(list_filter(held, lambda x: lang IS NULL OR x.l = lang)) > 1 THEN list_avg(list_transform(list_filter(held, lambda x: lang IS NULL OR x.l = lang), lambda x: list_cosine_similarity(vec, x.v))) END AS score FROM (
      SELECT k.person, k.n, f.held, f.samples, k.sample, k.vec, k.spk, k.video_id, k.lang, t.genuine_p5 AS p5 FROM fo f JOIN ak k ON k.person = f.person AND k.n = f.n + 1 LEFT JOIN tiers t ON t.lang = k.lang))))),
told AS (SELECT video_id, spk, person, lang, 'skipped' AS status, why, CAST(NULL AS DOUBLE) AS score, NULL::INT AS total_after FROM wh WHERE why IS NOT NULL
  UNION ALL SELECT video_id, spk, person, lang, CASE WHEN status = 'again' THEN 'skipped' ELSE status END, CASE status WHEN 'again' THEN 'archived before' WHEN 'blocked' THEN 'unlike its person' END, round(score, 6), CASE WHEN status = 'archived' THEN CAST(many AS INT) END FROM fo WHERE n > 0)"""
_LOOP = "WITH " + ",".join((_PAIRS, _CALIBRATED, _PEOPLE, _REVIEWED))


def _reviewed(v):
    n = F.substring("spk", 5, 12).cast("long")
    return v.speakers.withColumn("ord", n).selectExpr(
        "*",
        "CASE WHEN ord % 2 = 1 AND ord % 120 >= 40 THEN concat('SPK_', cast(ord - 40 AS string)) END AS merge_into",
        "CASE WHEN ord % 7 = 1 THEN 'skip' ELSE 'clone' END AS voice",
        "CASE WHEN ord % 35 = 0 THEN 'P3' ELSE '' END AS host_person",
        "CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 13 = 0 THEN 'P99' ELSE truth END AS person",
        "CASE WHEN ord % 17 = 0 THEN '' WHEN ord % 3 = 0 THEN concat('t', cast(ord div 100 AS string)) ELSE concat('s', cast(ord AS string)) END AS sample",
    )


def _told(v):
    n = F.substring("spk", 5, 12).cast("long")
    refs = v.speakers.filter(n % 19 == 0).select(F.col("truth").alias("person"), F.concat(F.lit("s"), n.cast("string")).alias("audio"))
    capped = voice.fifo_cap(v.archive)
    return archive.archive_loop(_reviewed(v), _people(v), capped, voice.calibrate(capped), refs)


@query(with_views("v_speakers v_capped", _LOOP + " SELECT * FROM told", recursive=True))
def archive_loop(v):
    return _told(v).withColumn("score", F.round("score", 6))


@query(with_views("v_speakers v_capped", _LOOP + " SELECT person, lang, count(*) AS archived, max(total_after) AS total FROM told WHERE status = 'archived' GROUP BY ALL", recursive=True))
def archive_loop_summary(v):
    return archive.archive_summary(_told(v))


_AFTER = """, nw AS (SELECT seq, person, lang, vec, ref_path FROM v_capped UNION ALL
  SELECT (SELECT max(seq) FROM v_capped) + 1 + r.ord - (SELECT min(ord) FROM rw), t.person, t.lang, r.vec, r.sample FROM told t JOIN rw r ON r.video_id = t.video_id AND r.spk = t.spk WHERE t.status = 'archived'),
v_now AS (SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY person, lang ORDER BY seq DESC) <= 10)"""


def _after(v):
    return archive.archive_after(_told(v), _reviewed(v), voice.fifo_cap(v.archive))


@query(with_views("v_speakers v_capped", _LOOP + _AFTER + " SELECT seq, person, lang, ref_path FROM v_now", recursive=True))
def archive_after(v):
    """The archive as a review leaves it: old entries and archived samples, the latest of each group."""
    return _after(v).select("seq", "person", "lang", "ref_path")


_TIERS = ("thr", "margin_min", "thr_host", "thr_cross", "genuine_p5", "genuine_p25", "eer")
_TWICE = ",".join((_PAIRS, _CALIBRATED)).replace("v_capped", "v_now")
for _n in ("pr", "ge", "ot", "rv", "ma", "im", "g1", "m1", "i1", "al", "di", "cu", "ca", "e1", "ti", "tiers"):
    _TWICE = re.sub(rf"\b{_n}\b(?= AS \()|(?<=FROM ){_n}\b|(?<=JOIN ){_n}\b", f"{_n}_now", _TWICE)


@query(with_views("v_speakers v_capped", _LOOP + _AFTER + "," + re.sub(r"\b(ge|rv|ma|g1|m1|i1|e1)\.(?=\w)", r"\1_now.", _TWICE) + " SELECT lang, genuine_n, impostor_n, cross_impostor_n, margin_n, calibrated, " + ", ".join(f"round({c}, 6) AS {c}" for c in _TIERS) + " FROM tiers_now WHERE lang IS NOT NULL", recursive=True))
def recalibrate(v):
    """The thresholds of each language after a review; null languages compare as in its SQL."""
    return voice.calibrate(_after(v), null_is_language=False).filter("lang IS NOT NULL").withColumns({c: F.round(c, 6) for c in _TIERS})


_RESULTS = """results AS (SELECT video_id, max(t1) AS written_at, count(*) % 7 <> 0 AS available, count(*) % 5 <> 0 AS has_vectors, list_sort(list(DISTINCT spk) FILTER (seg_ord % 9 <> 1)) AS have FROM v_segs GROUP BY ALL HAVING count(*) % 11 <> 0)"""


def _results(v):
    n = F.count(F.lit(1))
    found = v.segs.groupBy("video_id").agg(F.max("t1").alias("written_at"), (n % 7 != 0).alias("available"), (n % 5 != 0).alias("has_vectors"), F.collect_set(F.when(F.col("seg_ord") % 9 != 1, F.col("spk"))).alias("have"), n.alias("n"))
    return found.filter("n % 11 <> 0").drop("n")


@query(
    with_views(
        "v_segs",
        f"""WITH {_RESULTS}, o AS (SELECT video_id, list(DISTINCT spk) AS ord FROM v_segs GROUP BY ALL),
        w AS (SELECT o.video_id, CASE WHEN r.video_id IS NULL THEN 'no result' WHEN NOT has_vectors THEN CASE WHEN available THEN 'no vectors' END WHEN NOT available THEN 'vectors since' WHEN written_at < 239000 THEN 'older than archive or thresholds'
          WHEN NOT list_has_all(coalesce(have, []), ord) THEN 'other speakers' END AS why FROM o LEFT JOIN results r ON o.video_id = r.video_id)
        SELECT video_id, why IS NULL AS fresh, why FROM w""",
    )
)
def freshness(v):
    return archive.freshness(_results(v), v.segs.select("video_id", "spk"), 238000, 239000)


@query(
    with_views(
        "v_segs",
        f"""WITH {_RESULTS}, a AS (SELECT video_id, spk FROM v_segs GROUP BY ALL), b AS (SELECT video_id, unnest(have) AS spk FROM results)
        SELECT coalesce(a.video_id, b.video_id) AS video_id, array_to_string(list_sort(list(coalesce(a.spk, b.spk))), ',') AS every, coalesce(array_to_string(list_sort(list(a.spk) FILTER (b.spk IS NULL)), ','), '') AS left_only,
          coalesce(array_to_string(list_sort(list(b.spk) FILTER (a.spk IS NULL)), ','), '') AS right_only FROM a FULL JOIN b ON a.video_id = b.video_id AND a.spk = b.spk GROUP BY 1""",
    )
)
def label_difference(v):
    return archive.label_sets(v.segs.select("video_id", "spk"), _results(v).select("video_id", F.explode("have").alias("spk")))


@query(
    with_views(
        "v_archive",
        """SELECT seq, ref_path, person, lang, round(list_cosine_similarity(vec, nv), 6) AS cos, list_cosine_similarity(vec, nv) >= 0.999 AS ok
        FROM (SELECT *, CASE WHEN seq % 4 = 1 THEN list_reverse(vec) ELSE list_transform(vec, lambda x: x * 2) END AS nv FROM v_archive ORDER BY md5(concat(CAST(seq AS VARCHAR), ':0')), seq LIMIT 50)""",
    )
)
def recompute_check(v):
    """Fifty sampled entries; the sample is the feature."""
    extracted = v.archive.selectExpr("ref_path", "CASE WHEN seq % 4 = 1 THEN reverse(vec) ELSE transform(vec, x -> x * 2) END AS new_vec")
    return archive.recompute_check(v.archive, extracted, 50).withColumn("cos", F.round("cos", 6))


_NAMES = ("download_done", "analysis_done", "review_submit", "confirm_skip", "rediarize", "preview_ready", "preview_pass", "preview_reject", "full_done", "fail", "retry")
_PAYLOAD = {
    "review": "CASE WHEN event_id % 11 IN (2, 3) AND event_id % 3 > 0 THEN CASE WHEN event_id % 4 < 2 THEN 'dub' ELSE 'skip' END END",
    "media_path": "CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 8 = 0 THEN '' ELSE 'm.mp4' END WHEN event_id % 50 = 7 THEN 'x' END",
    "preview_path": "CASE WHEN event_id % 11 = 5 AND event_id % 3 = 0 THEN 'p.mp4' WHEN event_id % 31 = 4 THEN 'y' END",
    "output_path": "CASE WHEN event_id % 11 = 8 THEN 'o.mp4' END",
    "stage": "CASE WHEN event_id % 11 = 9 THEN CASE WHEN event_id % 6 = 0 THEN '' ELSE 'ocr' END END",
    "error": "CASE WHEN event_id % 11 = 9 AND event_id % 5 > 0 THEN 'broken' END",
}
_ALLOWED = " ".join(f"WHEN '{e}' THEN [{', '.join(repr(f) for f in fields)}]::VARCHAR[]" for e, fields in records.EVENT_FIELDS.items())


@query(
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'bogus' ELSE {list(_NAMES)}[CAST(event_id % 11 AS INT) + 1] END AS event, CASE WHEN event_id % 2 = 0 THEN 'dub' END AS on_record, {", ".join(f"{v} AS {k}" for k, v in _PAYLOAD.items())} FROM events),
    g AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in _PAYLOAD)}], lambda k: k IS NOT NULL) AS given, CASE event {_ALLOWED} END AS takes FROM e),
    r AS (SELECT *, list_sort(list_filter(given, lambda k: NOT list_contains(takes, k))) AS unknown, list_sort(list_filter([{", ".join(f"CASE WHEN {k} = '' THEN '{k}' END" for k in _PAYLOAD if k not in ("stage", "error"))}], lambda k: k IS NOT NULL)) AS blank FROM g)
    SELECT event_id, event, CASE WHEN takes IS NULL THEN 'unknown event' WHEN len(unknown) > 0 THEN 'takes no ' || array_to_string(unknown, ',') WHEN len(blank) > 0 THEN 'empty ' || array_to_string(blank, ',')
      WHEN event = 'fail' AND (coalesce(stage, '') = '' OR coalesce(error, '') = '') THEN 'fail without stage and error' WHEN event = 'review_submit' AND coalesce(review, on_record, '') <> 'dub' THEN 'review is not dub'
      WHEN event = 'confirm_skip' AND coalesce(review, on_record, '') <> 'skip' THEN 'review is not skip' END AS reason FROM r"""
)
def payload_check(v):
    name = "CASE WHEN event_id % 97 = 0 THEN 'bogus' ELSE element_at(array({}), cast(event_id % 11 AS int) + 1) END AS event".format(", ".join(f"'{n}'" for n in _NAMES))
    payload = "map_filter(map({}), (k, x) -> x IS NOT NULL) AS payload".format(", ".join(f"'{k}', {x}" for k, x in _PAYLOAD.items()))
    events = v.table("events").selectExpr("event_id", name, payload, "CASE WHEN event_id % 2 = 0 THEN 'dub' END AS review_on_record")
    return records.payload_check(events).select("event_id", "event", "reason")


@query(
    with_views(
        "v_ledger",
        """SELECT * FROM (SELECT bvid, part, concat_ws(',', CASE WHEN o_orderkey % 37 = 0 THEN 'detail' END, CASE WHEN o_orderkey % 53 = 0 THEN 'disk' END) AS lacking,
        concat_ws(',', CASE WHEN o_orderkey % 43 = 0 AND o_orderkey % 53 <> 0 THEN 'status' END, CASE WHEN o_orderkey % 41 = 0 AND o_orderkey % 37 <> 0 THEN 'title' END) AS differs FROM v_ledger) WHERE lacking <> '' OR differs <> ''""",
    )
)
def three_way_check(v):
    api = v.ledger.select("bvid", "part", "title", "status", "o_orderkey")
    detail = api.filter("o_orderkey % 37 <> 0").withColumn("title", F.expr("CASE WHEN o_orderkey % 41 = 0 THEN 'other' ELSE title END"))
    disk = api.filter("o_orderkey % 53 <> 0").withColumn("status", F.expr("CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE status END"))
    return records.reconcile({"api": api, "detail": detail, "disk": disk}, ("bvid", "part"), ("title", "status"))


_TITLED = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(title, '-', CAST(part AS {})) END AS title"


@query(with_views("v_ledger", f"SELECT bvid, coalesce(arg_min(title, part) FILTER (title <> ''), CAST(bvid AS VARCHAR)) AS title FROM (SELECT bvid, part, {_TITLED.format('VARCHAR')} FROM v_ledger) GROUP BY bvid"))
def item_titles(v):
    return records.item_titles(v.ledger.selectExpr("bvid", "part", _TITLED.format("string")))


@query(
    with_views(
        "v_decisions",
        """WITH d AS (SELECT decision, substr(sha256(CAST(to_json(list({'id': id, 'merge_into': merge_into, 'voice': voice} ORDER BY pos)) AS VARCHAR)), 1, 12) AS hash, decision % 9 = 4 AS rediarize FROM v_decisions GROUP BY decision),
        p AS (SELECT hash, name FROM d, (VALUES ('voices'), ('tagged')) n(name) WHERE decision % 3 <> 0 AND (name = 'voices' OR decision % 4 <> 0)),
        h AS (SELECT hash, list(DISTINCT name) AS have FROM p GROUP BY ALL),
        m AS (SELECT decision, d.hash, rediarize, list_filter(['tagged', 'voices'], lambda x: NOT list_contains(coalesce(have, []), x)) AS missing FROM d LEFT JOIN h ON h.hash = d.hash)
        SELECT decision, hash, CASE WHEN rediarize THEN 'voided' WHEN len(missing) = 0 THEN 'reused' ELSE 'applied' END AS status, CASE WHEN rediarize THEN '' ELSE array_to_string(missing, ',') END AS to_write FROM m""",
    )
)
def decision_reuse(v):
    packed = v.decisions.groupBy("decision").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("voice", "merge_into", "id").alias("x")))).alias("all"))
    packed = packed.select("decision", F.transform("all", lambda y: y["x"]).alias("speakers"))
    made = packed.select("decision", s.content_hash(s.canonical_json(F.col("speakers"), packed.schema["speakers"].dataType)).alias("hash"), (F.col("decision") % 9 == 4).alias("rediarize"))
    products = made.select("decision", "hash", F.explode(F.array(F.lit("voices"), F.lit("tagged"))).alias("name")).select("hash", "name", (F.col("decision") % 3 != 0).alias("written"), ((F.col("name") == "voices") | (F.col("decision") % 4 != 0)).alias("done"))
    return records.decision_state(made, products, ("voices", "tagged"))


@query(with_views("v_refs", "SELECT name, arg_min(audio, i) AS audio, CAST(min(i) - 1 AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS i FROM v_refs) WHERE coalesce(use, '') <> 'voiceid' AND audio <> '' AND transcript <> '' AND NOT (kind = 'episode' AND part = 'P1') GROUP BY name"))
def first_host_ref(v):
    return records.first_host_ref(v.refs, 1)


@query(with_views("v_decisions", "SELECT decision, pos, CASE WHEN voice = 'clone' THEN 'cosyvoice3' ELSE 'edge' END AS engine, CASE WHEN voice = 'clone' THEN 'cosyvoice3' ELSE 'silence' END AS clone_only FROM v_decisions"))
def engine_choice(v):
    return v.decisions.select("decision", "pos", s.engine_of(F.col("voice"), "auto").alias("engine"), s.engine_of(F.col("voice"), "cosyvoice3").alias("clone_only"))


@query(
    with_views(
        "v_subs",
        """SELECT video_id, CASE WHEN n % 5 = 0 THEN 500.0::DOUBLE WHEN n % 3 = 0 THEN 700.5::DOUBLE WHEN n % 2 = 0 THEN CAST(n * 10 AS DOUBLE) ELSE CAST(last AS DOUBLE) END AS total FROM (SELECT video_id, count(*) AS n, max(t1) AS last FROM v_subs GROUP BY ALL)""",
    )
)
def total_duration(v):
    per = v.subs.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.max("t1").alias("last"))
    given, probed = F.expr("CASE WHEN n % 5 = 0 THEN 500 WHEN n % 7 = 0 THEN -1 END"), F.expr("CASE WHEN n % 3 = 0 THEN 700.5 ELSE 0 END")
    record = F.expr("CASE WHEN n % 2 = 0 THEN cast(n * 10 AS string) WHEN n % 11 = 0 THEN 'n/a' END")
    return per.select("video_id", s.total_duration(given, probed, record, F.col("last")).alias("total"))


_URLS = "CASE vec_id % 6 WHEN 0 THEN concat('/audio/a', CAST(vec_id AS {0}), '.wav') WHEN 1 THEN concat(' \\refs\\r', CAST(vec_id AS {0}), '.wav ') WHEN 2 THEN concat('/work/w', CAST(vec_id AS {0})) WHEN 3 THEN 'else/x.wav' WHEN 4 THEN ' ' END AS url"
_PATHS = "CASE vec_id % 5 WHEN 0 THEN concat('/root/web/i', CAST(vec_id AS {0}), '.html') WHEN 1 THEN concat('/root/refs/a/', CAST(vec_id AS {0}), '.wav') WHEN 2 THEN concat('/else/v', CAST(vec_id AS {0}), '.MP4') WHEN 3 THEN '/else/x.wav' WHEN 4 THEN '' END AS path"


@query(
    f"""SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN concat('work/web/audio/a', CAST(vec_id AS VARCHAR), '.wav') WHEN 1 THEN concat('refs/r', CAST(vec_id AS VARCHAR), '.wav') WHEN 2 THEN concat('work/w', CAST(vec_id AS VARCHAR)) WHEN 3 THEN 'else/x.wav' END AS file,
    CASE vec_id % 5 WHEN 0 THEN concat('/i', CAST(vec_id AS VARCHAR), '.html') WHEN 1 THEN concat('/refs/a/', CAST(vec_id AS VARCHAR), '.wav') WHEN 2 THEN concat('/media/v', CAST(vec_id AS VARCHAR), '.MP4') END AS address FROM embeddings"""
)
def file_addresses(v):
    rows = v.table("embeddings").selectExpr("vec_id", _URLS.format("string").replace("\\", "\\\\"), _PATHS.format("string"))
    return rows.select("vec_id", s.file_of_url(F.col("url")).alias("file"), s.url_of_file(F.col("path"), (("/root/web/", "/"), ("/root/refs/", "/refs/"))).alias("address"))


@query(with_views("v_segs", "SELECT video_id, seg_ord, spk FROM v_segs"))
def speaker_labels(v):
    raw = v.segs.withColumn("label", F.replace("spk", F.lit("SPK_"), F.lit("SPEAKER_")))
    return raw.select("video_id", "seg_ord", s.speaker_label(F.col("label")).alias("spk"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 97 AS VARCHAR) WHEN 1 THEN CAST(event_id % 97 AS VARCHAR) WHEN 2 THEN concat('extra ', CAST(event_id % 97 AS VARCHAR)) END AS part FROM events""")
def part_or_text(v):
    n = "cast(event_id % 97 AS string)"
    raw = F.expr(f"CASE event_id % 4 WHEN 0 THEN {n} WHEN 1 THEN concat(' P', {n}, ' ') WHEN 2 THEN concat('Extra ', {n}) ELSE '  ' END")
    return v.table("events").select("event_id", s.norm_part_or_text(raw).alias("part"))


@query(with_views("v_catalog v_ledger", "SELECT bvid FROM v_catalog EXCEPT SELECT bvid FROM v_ledger WHERE status <> 'pending_download'"))
def pending_downloads(v):
    """Catalogue items less those that some part of is on disk, as a set difference."""
    return v.catalog.select("bvid").exceptAll(v.ledger.filter("status <> 'pending_download'").select("bvid").distinct()).distinct()


@query(with_views("v_ledger", "SELECT bvid, part, status, busy FROM v_ledger WHERE bvid = 7 AND NOT busy"))
def ledger_filters(v):
    return records.ledger_query(v.ledger, bvid=7, busy=False).select("bvid", "part", "status", "busy")


_CLEANED = _LINES.replace("FROM v_hits", f"FROM (SELECT * REPLACE ({_BADGE} AS text) FROM v_hits)") + r""",
cl AS (SELECT * REPLACE (CASE WHEN regexp_matches(text, '[一-鿿]') THEN trim(regexp_replace(regexp_replace(text, '^[0-9A-Za-z.]{1,5}([一-鿿])', '\1'), '([一-鿿])[0-9A-Za-z.]{1,5}$', '\1')) WHEN regexp_full_match(text, '[0-9A-Za-z.%]{6,}') THEN text ELSE '' END AS text) FROM l)"""


@query(with_views("v_hits", "WITH " + _CLEANED + "," + _MONOTONE.replace("FROM l)", "FROM cl WHERE text <> '')") + " SELECT m.video_id, m.line AS idx, m.t0, m.t1, cl.text FROM mono m JOIN cl ON cl.video_id = m.video_id AND cl.line = m.line"))
def ocr_lines_clean(v):
    return sequences.clean_lines(v.hits.withColumn("text", F.expr(_BADGE)), exact=True)


@query(
    with_views(
        "v_manifest",
        "WITH " + _PLAN + """, h AS (SELECT m.video_id, m.idx, m.t0, p.tempo, p.mode, CAST(CASE WHEN p.tempo > 1.001 THEN floor(m.wav_dur / p.tempo + 0.5) ELSE m.wav_dur END AS BIGINT) AS heard FROM v_manifest m JOIN plan p ON p.video_id = m.video_id AND p.idx = m.idx),
        d AS (SELECT *, sum(heard + 50) OVER (PARTITION BY video_id ORDER BY idx) AS d FROM h), e AS (SELECT *, d + greatest(0, max(t0 + heard - d) OVER (PARTITION BY video_id ORDER BY idx)) AS end_t FROM d)
        SELECT video_id, idx, tempo, mode, heard, CAST(end_t - heard AS BIGINT) AS place_t, CAST(end_t AS BIGINT) AS end_t FROM e""",
    )
)
def rendered_track(v):
    return sequences.render_track(v.manifest)


_QUIET = "CASE WHEN i < event_id % 40 THEN 3 WHEN i >= n - event_id % 30 THEN -5 ELSE 400 + (event_id + i) % 9 END"
_HEARD = f"""
sa AS (SELECT *, list_transform(generate_series(0, n - 1), lambda i: {_QUIET}) AS samples FROM (SELECT *, wav_dur // 10 AS n FROM v_manifest)),
lo AS (SELECT *, list_filter(generate_series(1, len(samples)), lambda i: abs(samples[i]) >= 300) AS loud FROM sa),
v_heard AS (SELECT * REPLACE (CASE WHEN len(samples) > 0 THEN (CASE WHEN len(loud) > 0 AND loud[-1] - loud[1] + 1 >= 80 THEN loud[-1] - loud[1] + 1 ELSE len(samples) END) * 10 END AS wav_dur) FROM lo)"""


@query(
    with_views(
        "v_manifest",
        "WITH " + _HEARD + ", " + _PLAN.replace("v_manifest", "v_heard") + """, h AS (SELECT m.video_id, m.idx, m.t0, p.tempo, p.mode, CAST(CASE WHEN p.tempo > 1.001 THEN floor(m.wav_dur / p.tempo + 0.5) ELSE m.wav_dur END AS BIGINT) AS heard FROM v_heard m JOIN plan p ON p.video_id = m.video_id AND p.idx = m.idx),
        d AS (SELECT *, sum(heard + 50) OVER (PARTITION BY video_id ORDER BY idx) AS d FROM h), e AS (SELECT *, d + greatest(0, max(t0 + heard - d) OVER (PARTITION BY video_id ORDER BY idx)) AS end_t FROM d)
        SELECT video_id, idx, tempo, mode, heard, CAST(end_t - heard AS BIGINT) AS place_t, CAST(end_t AS BIGINT) AS end_t FROM e""",
    )
)
def trimmed_track(v):
    """The track of lines whose audio is cut to what is loud before it is planned and placed; a hundred samples a second."""
    samples = F.expr(f"transform(CASE WHEN n > 0 THEN sequence(0L, n - 1) ELSE cast(array() AS array<bigint>) END, i -> {_QUIET})")
    return sequences.render_track(sequences.trimmed(v.manifest.withColumn("n", F.expr("wav_dur div 10")).withColumn("samples", samples), 100, 300, 80))


@query(
    """WITH s AS (SELECT user_id, list(CAST(round(value * 10) AS INT) - 400 ORDER BY ts, event_id) AS x FROM events GROUP BY ALL),
    p AS (SELECT *, list_filter(generate_series(1, len(x)), lambda i: abs(x[i]) >= 300) AS loud FROM s)
    SELECT user_id, CAST(CASE WHEN len(loud) > 0 AND loud[-1] - loud[1] + 1 >= 5 THEN loud[-1] - loud[1] + 1 ELSE len(x) END AS INT) AS n, CASE WHEN len(loud) > 0 AND loud[-1] - loud[1] + 1 >= 5 THEN x[loud[1]] ELSE x[1] END AS first FROM p"""
)
def trim_silence(v):
    x = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.round(F.col("value") * 10).cast("int") - 400).alias("x")))), lambda r: r["x"])
    cut = v.table("events").groupBy("user_id").agg(x.alias("x")).withColumn("y", sequences.trim_silence(F.col("x"), 300, 5))
    return cut.select("user_id", F.size("y").alias("n"), F.get("y", F.lit(0)).alias("first"))


@query(with_views("v_subs v_segs", "SELECT a.video_id, a.idx, b.seg_ord, least(a.t1, b.t1) - greatest(a.t0, b.t0) AS ov FROM v_subs a JOIN v_segs b ON a.video_id = b.video_id AND a.t0 < b.t1 AND b.t0 < a.t1"))
def bucketed_overlap(v):
    """The overlap join with time buckets as a second key, which is how very long videos are joined."""
    return intervals.bucketed_overlap(v.subs, v.segs).select("video_id", "idx", "seg_ord", "ov")


@query(with_views("v_catalog", "SELECT bvid, title FROM v_catalog WHERE bvid % 3 = 0"))
def insert_absent(v):
    """Two of each catalogue item come in; those the ledger does not hold stay, the first of each."""
    batch = v.catalog.select("bvid", "title", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"))
    return workflow.insert_absent(batch.withColumn("title", F.when(F.col("pos") == 1, F.col("title")).otherwise("late")), v.catalog.filter("bvid % 3 <> 0"), keys=("bvid",)).select("bvid", "title")


@query(
    with_views(
        "v_ledger",
        """WITH l AS (SELECT bvid, part, status, busy, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 < 3 THEN concat(title, '-', CAST(part AS VARCHAR)) END AS title, o_orderkey FROM v_ledger),
        c AS (SELECT l_orderkey, list({'spk': concat('SPK_0', CAST(l_linenumber AS VARCHAR)), 'talk': CAST(l_quantity AS BIGINT)} ORDER BY l_linenumber, l_quantity) AS speakers FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
        p AS (SELECT bvid, part, title, {'part': part, 'status': status, 'busy': busy, 'title': title, 'speakers': coalesce(speakers, [])} AS doc FROM l LEFT JOIN c ON l_orderkey = o_orderkey)
        SELECT bvid, coalesce(arg_min(title, part) FILTER (title <> ''), CAST(bvid AS VARCHAR)) AS title, CAST(to_json(list(doc ORDER BY part)) AS VARCHAR) AS parts FROM p GROUP BY bvid""",
    )
)
def episode_documents(v):
    """Every item as one nested document of its parts and their speakers."""
    ledger = v.ledger.selectExpr("bvid", "part", "status", "busy", "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 < 3 THEN concat(title, '-', cast(part AS string)) END AS title", "o_orderkey")
    lines = v.table("lineitem").filter("l_quantity > 10").selectExpr("l_orderkey", "concat('SPK_0', cast(l_linenumber AS string)) AS spk", "cast(l_quantity AS bigint) AS talk")
    cards = lines.join(ledger.select("bvid", "part", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("bvid", "part", "spk", "talk")
    return records.episode_documents(ledger.drop("o_orderkey"), cards).withColumn("parts", F.to_json("parts", {"ignoreNullFields": "false"}))


@query(
    with_views(
        "v_archive",
        """WITH e AS (SELECT person, CASE WHEN seq % 13 <> 0 THEN lang END AS lang, seq, ref_path, seq % 7 <> 0 AS valid FROM v_archive),
        g AS (SELECT person, lang, count(*) FILTER (valid) AS "count", count(*) FILTER (NOT valid) AS invalid, list({'seq': seq, 'ref_path': ref_path, 'valid': valid, 'audio': CASE WHEN valid THEN ref_path END} ORDER BY seq) AS entries FROM e GROUP BY ALL)
        SELECT person, CAST(to_json(list({'lang': lang, 'count': "count", 'invalid': invalid, 'entries': entries} ORDER BY lang NULLS LAST)) AS VARCHAR) AS groups, CAST(sum("count") AS BIGINT) AS total, CAST(sum(invalid) AS BIGINT) AS invalid_total FROM g GROUP BY person""",
    )
)
def archive_documents(v):
    """Every person's archive as one nested document, by language."""
    entries = v.archive.selectExpr("person", "CASE WHEN seq % 13 <> 0 THEN lang END AS lang", "seq", "ref_path", "seq % 7 <> 0 AS valid")
    return records.archive_documents(entries).withColumn("groups", F.to_json("groups", {"ignoreNullFields": "false"}))


@query()
def ocr_lines_similar(v):
    """Subtitle lines of recognised texts that are alike, and not only equal: badges off, grouped, cleaned, clamped."""
    return sequences.clean_lines(v.hits.withColumn("text", F.expr(_BADGE)))
