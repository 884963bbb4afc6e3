"""Queries of catalogue, decisions and ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import scalars as s
from parley.operators import closure, workflow
from parley.plans.registry import query
from parley.sources.views import with_views


@query(with_views("v_catalog v_ledger", "SELECT bvid, title FROM v_catalog c WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.bvid = c.bvid)"))
def catalog_not_imported(v):
    return v.catalog.join(v.ledger.select("bvid").distinct(), "bvid", "left_anti").select("bvid", "title")


@query(with_views("v_ledger", "SELECT c_custkey // 2 * 4 AS bvid, 1 AS part, min(c_custkey) AS pos FROM customer WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.bvid = c_custkey // 2 * 4 AND l.part = 1) GROUP BY ALL"))
def ingest_dedupe(v):
    batch = v.table("customer").select(F.expr("c_custkey div 2 * 4").alias("bvid"), F.lit(1).alias("part"), F.col("c_custkey").alias("pos"))
    return workflow.insert_absent(batch, v.ledger)


@query(with_views("v_ledger", "SELECT status, count(*) AS n, count(DISTINCT bvid) AS items FROM v_ledger GROUP BY ALL"))
def status_counts(v):
    return v.ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bvid").alias("items"))


@query(with_views("v_ledger", "SELECT bvid, part, status FROM v_ledger WHERE status IN ('pending_review', 'preview') AND NOT busy"))
def todo_list(v):
    return v.ledger.filter("status IN ('pending_review', 'preview') AND NOT busy").select("bvid", "part", "status")


@query(
    with_views(
        "v_ledger v_catalog",
        "SELECT bvid, part, status, title, NULL AS length FROM v_ledger UNION ALL SELECT bvid, NULL, 'not_imported', title, length FROM v_catalog c WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.bvid = c.bvid)",
    )
)
def library_table(v):
    missing = v.catalog.join(v.ledger.select("bvid").distinct(), "bvid", "left_anti").select("bvid", F.lit("not_imported").alias("status"), "title", "length")
    return v.ledger.select("bvid", "part", "status", "title").unionByName(missing, allowMissingColumns=True)


@query(with_views("v_catalog", "SELECT bvid, length FROM v_catalog ORDER BY CASE WHEN length = 'n/a' THEN NULL WHEN len(string_split(length, ':')) = 2 THEN CAST(string_split(length, ':')[1] AS INT) * 60 + CAST(string_split(length, ':')[2] AS INT) ELSE CAST(string_split(length, ':')[1] AS INT) * 3600 + CAST(string_split(length, ':')[2] AS INT) * 60 + CAST(string_split(length, ':')[3] AS INT) END ASC NULLS LAST, bvid LIMIT 10"))
def shortest_n(v):
    """The ten shortest catalogue items, unparseable lengths last; the limit is the feature."""
    return v.catalog.orderBy(s.parse_length(F.col("length")).asc_nulls_last(), "bvid").limit(10).select("bvid", "length")


@query("""SELECT o.o_orderkey AS item, count(*) AS parts, CASE WHEN bool_or(l.l_linenumber = 7) THEN NULL ELSE sum(CAST(l.l_quantity AS BIGINT)) END AS actual, 150 AS expected,
coalesce(CASE WHEN bool_or(l.l_linenumber = 7) THEN NULL ELSE sum(CAST(l.l_quantity AS BIGINT)) END >= 0.9 * 150, false) AS valid FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def duration_audit(v):
    """Whether the parts of an item last at least nine tenths of what is expected; a part that cannot be probed makes the sum null."""
    files = v.table("lineitem").select(F.col("l_orderkey").alias("item"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("long")).alias("dur"))
    sums = files.groupBy("item").agg(F.count(F.lit(1)).alias("parts"), F.when(~F.bool_or(F.col("dur").isNull()), F.sum("dur")).alias("actual"))
    expected = v.table("orders").select(F.col("o_orderkey").alias("item"), F.lit(150).alias("expected"))
    return expected.join(sums, "item").withColumn("valid", F.coalesce(F.col("actual") >= 0.9 * F.col("expected"), F.lit(False)))


_REF_PROBLEM = """CASE WHEN trim(audio) = '' THEN 'no audio: refs[' || (i - 1) || ']' WHEN trim(transcript) = '' THEN 'no transcript: ' || audio WHEN kind = 'episode' AND part = 'P1' THEN 'own part: ' || audio END"""


@query(
    with_views(
        "v_refs",
        f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS i, coalesce(nullif(use, ''), 'clone') <> 'voiceid' AS counts FROM v_refs),
        p AS (SELECT name, counts, {_REF_PROBLEM} AS problem FROM r)
        SELECT name, bool_or(counts AND problem IS NULL) AS ok, CASE WHEN bool_or(counts AND problem IS NULL) THEN '' WHEN NOT bool_or(counts) THEN 'no clone reference' ELSE array_to_string(list_sort(list(DISTINCT problem) FILTER (counts AND problem IS NOT NULL)), ';') END AS problems FROM p GROUP BY name""",
    )
)
def host_attach_check(v):
    return workflow.host_attach(v.refs, 1).withColumn("problems", F.array_join("problems", ";"))


_CLOSURE = """
me AS (SELECT decision, id, merge_into AS target FROM v_decisions WHERE merge_into IS NOT NULL AND id <> '' AND target <> id GROUP BY ALL),
wk AS (SELECT decision, id, target, [id, target] AS path, id = target AS ring FROM me
  UNION ALL SELECT w.decision, w.id, e.target, list_append(w.path, e.target), list_contains(w.path, e.target) FROM wk w JOIN me e ON w.decision = e.decision AND w.target = e.id WHERE NOT w.ring),
cl AS (SELECT decision, id, arg_max(target, len(path)) AS final, max(len(path)) - 1 AS hops, bool_or(ring) AS ring FROM wk GROUP BY ALL)"""


@query(with_views("v_decisions", "WITH " + _CLOSURE.replace("WHERE merge_into IS NOT NULL AND id <> '' AND target <> id GROUP BY ALL", "WHERE merge_into IS NOT NULL AND id <> '' AND merge_into <> id GROUP BY ALL") + " SELECT * FROM cl", recursive=True))
def merge_closure(v):
    edges = v.decisions.filter("merge_into IS NOT NULL AND id <> '' AND merge_into <> id").select("decision", "id", F.col("merge_into").alias("target")).distinct()
    return closure.merge_closure(edges)


@query(
    with_views(
        "v_chains",
        """WITH wk AS (SELECT decision, id, target, [id, target] AS path, id = target AS ring FROM v_chains
          UNION ALL SELECT w.decision, w.id, e.target, list_append(w.path, e.target), list_contains(w.path, e.target) FROM wk w JOIN v_chains e ON w.decision = e.decision AND w.target = e.id WHERE NOT w.ring)
        SELECT decision, id, arg_max(target, len(path)) AS final, max(len(path)) - 1 AS hops, bool_or(ring) AS ring FROM wk GROUP BY ALL""",
        recursive=True,
    )
)
def merge_rings(v):
    """Chains of up to some dozens of hops, and rings with what runs into them."""
    return closure.merge_closure(v.chains)


@query(
    with_views(
        "v_decisions",
        "WITH " + _CLOSURE.replace("target <> id GROUP BY ALL", "merge_into <> id GROUP BY ALL") + """,
        rg AS (SELECT decision, min(id) AS ring_id FROM cl WHERE ring GROUP BY ALL),
        b AS (SELECT d.*, row_number() OVER (PARTITION BY d.decision, d.id ORDER BY d.pos) AS nth, k.id AS known, rg.ring_id FROM v_decisions d
          LEFT JOIN (SELECT DISTINCT decision, id FROM v_decisions WHERE id <> '') k ON k.decision = d.decision AND k.id = d.merge_into LEFT JOIN rg ON rg.decision = d.decision),
        v AS (SELECT *, CASE WHEN host THEN CASE WHEN host_person = '' THEN 'host without person' END WHEN voice = 'clone' THEN CASE WHEN clone_ref = '' THEN 'clone without reference' END
          WHEN voice = 'preset' THEN CASE WHEN preset_voice IS NULL THEN 'preset without voice' END ELSE 'no valid voice' END AS vm FROM b),
        m AS (SELECT decision, CASE WHEN verdict <> 'dub' THEN {'o': 0, 'p': 0, 'm': 'verdict is not dub'} WHEN id = '' THEN {'o': 1, 'p': pos, 'm': 'missing id'} WHEN nth > 1 THEN {'o': 1, 'p': pos, 'm': 'repeated id ' || id}
          WHEN merge_into IS NOT NULL AND known IS NULL THEN {'o': 2, 'p': pos, 'm': 'unknown merge target ' || merge_into} WHEN merge_into = id THEN {'o': 2, 'p': pos, 'm': 'merged into itself ' || id}
          WHEN ring_id IS NOT NULL THEN {'o': 3, 'p': 0, 'm': 'merge ring at ' || ring_id} WHEN merge_into IS NULL AND voice <> 'skip' AND vm IS NOT NULL THEN {'o': 4, 'p': pos, 'm': vm || ' ' || id} END AS s FROM v)
        SELECT decision, min(s).m AS error FROM m GROUP BY decision""",
        recursive=True,
    )
)
def decision_errors(v):
    return workflow.decision_errors(v.decisions)


@query(
    with_views(
        "v_decisions",
        """SELECT decision, pos, id, kind, CASE WHEN kind = 'skip' THEN 'skip' ELSE lower(id) END AS entry, CASE kind WHEN 'host' THEN host_person WHEN 'clone' THEN clone_ref WHEN 'preset' THEN preset_voice END AS source
        FROM (SELECT *, CASE WHEN voice = 'skip' THEN 'skip' WHEN host THEN 'host' WHEN voice = 'clone' THEN 'clone' ELSE 'preset' END AS kind FROM v_decisions WHERE merge_into IS NULL AND id <> '')""",
    )
)
def voice_resolution(v):
    return workflow.voices(v.decisions)


@query(
    with_views(
        "v_refs v_archive",
        """WITH g AS (SELECT name AS person, audio AS ref_path FROM v_refs WHERE pos % 6 IN (1, 2) AND audio <> '' UNION ALL SELECT person, ref_path FROM v_archive WHERE seq % 10 = 3),
        h AS (SELECT r.name AS person, r.audio AS ref_path, coalesce(nullif(r.use, ''), 'clone') AS use FROM v_refs r WHERE r.audio <> '' AND EXISTS (SELECT 1 FROM g WHERE g.person = r.name AND g.ref_path = r.audio))
        SELECT 'ref' AS kind, person, ref_path FROM h UNION ALL SELECT 'file', person, ref_path FROM h WHERE use = 'voiceid' UNION ALL SELECT 'vector', person, ref_path FROM v_archive a WHERE EXISTS (SELECT 1 FROM g WHERE g.ref_path = a.ref_path)""",
    )
)
def cascade_delete(v):
    flat = v.refs.select(F.col("name").alias("person"), F.inline("refs"))
    gone = flat.filter("pos % 6 IN (1, 2) AND audio <> ''").select("person", F.col("audio").alias("ref_path")).unionByName(v.archive.filter("seq % 10 = 3").select("person", "ref_path"))
    return workflow.cascade_delete(v.refs, v.archive, gone)


_NEXT = " ".join(f"WHEN l.state = '{a}' AND e.event = '{e}'" + ({"review_submit": " AND e.verdict = 'dub'", "confirm_skip": " AND e.verdict = 'skip'"}.get(e, "")) + " THEN " + ("l.failed_from" if b == "*" else f"'{b}'") for (a, e), b in workflow.EDGES.items())


@query(
    with_views(
        "v_ledger_events",
        f"""WITH l AS (SELECT bvid, part, 0 AS ord, '{workflow.START}' AS state, NULL::VARCHAR AS failed_from, false AS busy, false AS has_preview, false AS stale, NULL::VARCHAR AS review, 0 AS applied, 0 AS rejected FROM (SELECT DISTINCT bvid, part FROM v_ledger_events)
          UNION ALL
          SELECT bvid, part, ord, coalesce(nx, state), CASE WHEN nx IS NULL THEN failed_from WHEN event = 'fail' THEN state END,
            CASE WHEN nx IS NULL THEN busy ELSE event IN ('review_submit', 'preview_pass', 'rediarize') END, has_preview OR (nx IS NOT NULL AND event = 'preview_ready'),
            CASE WHEN nx IS NULL THEN stale WHEN event = 'preview_ready' THEN false WHEN event IN ('preview_reject', 'rediarize') AND has_preview THEN true ELSE stale END,
            CASE WHEN nx IS NULL THEN review WHEN event IN ('review_submit', 'confirm_skip') THEN verdict WHEN event = 'rediarize' THEN NULL ELSE review END,
            applied + CASE WHEN nx IS NULL THEN 0 ELSE 1 END, rejected + CASE WHEN nx IS NULL THEN 1 ELSE 0 END
          FROM (SELECT l.bvid, l.part, e.ord, l.state, l.failed_from, l.busy, l.has_preview, l.stale, l.review, l.applied, l.rejected, e.event, e.verdict, CASE {_NEXT} END AS nx
                FROM l JOIN v_ledger_events e ON e.bvid = l.bvid AND e.part = l.part AND e.ord = l.ord + 1))
        SELECT bvid, part, arg_max(state, ord) AS state, max_by(failed_from, CASE WHEN true THEN ord END) AS failed_from, arg_max(busy, ord) AS busy, arg_max(has_preview, ord) AS has_preview, arg_max(stale, ord) AS stale, max(applied) AS applied, max(rejected) AS rejected
        FROM l GROUP BY bvid, part""".replace("max_by(failed_from, CASE WHEN true THEN ord END)", "list(failed_from ORDER BY ord DESC)[1]"),
        recursive=True,
    )
)
def ledger_replay(v):
    return workflow.replay(v.ledger_events).drop("review")
