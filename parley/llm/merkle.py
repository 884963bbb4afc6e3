"""Operator 12: a Merkle manifest of a dataset, with a proof for each document.

Documents are leaves. Those of a source form a tree, and the trees' tops form another, whose top is the root. Each level
is a table: nodes are numbered within their source, the number divided by the fan-out names the run, and a run's hashes in
order are its parent's input. Going down again, each level is joined with the one above and appends a node's siblings.
Hashes are SHA-256 as lowercase hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, drop, numbered, same_keys, table

#: Children of a node at most.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIBLINGS = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: id, group, leaf, what the caller carries, subroot, root, and the siblings of each level from the leaf up, those to the left
    and to the right joined. ``subroots``: group, subroot, root, siblings."""

    leaves: DataFrame
    subroots: DataFrame


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values in order, each as its length in UTF-8 bytes, a colon and itself; a dash for null."""
    text = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _levels(nodes: DataFrame, keys: list[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, bottom up, and the tops of all trees.

    ``nodes``: keys, i (number within the tree), m (nodes of the tree), h, carried. A run is its keys, number, how many runs
    the level has, and its children (h, carried) in order; a tree with one node has no runs. Tops: keys, h, carried.
    """
    most = nodes.agg(F.max("m")).first()[0] or 0
    runs, tops = [], nodes.filter("m = 1").select(*keys, "h")
    while most > 1:
        child = F.struct("i", "h", *(["carried"] if not runs else []))
        run = F.floor(F.col("i") / fanout)
        grouped = nodes.filter("m > 1").groupBy(*keys, run.alias("run"), F.ceil(F.col("m") / fanout).alias("m")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        runs.append(cut(grouped, "merkle"))
        nodes = runs[-1].select(*keys, F.col("run").alias("i"), "m", digest(F.array_join("children.h", "")).alias("h"))
        tops = tops.unionByName(nodes.filter("m = 1").select(*keys, "h"))
        most = -(-most // fanout)
    return runs, tops


def _descend(runs: list[DataFrame], tops: DataFrame, keys: list[str], passed: list[str]) -> DataFrame:
    """Children of the lowest runs with their siblings of every level up to the root: keys, h, carried, siblings and what is passed down.

    ``tops``: keys, siblings (those above the tree's top) and the passed columns.
    """
    named = lambda df: df.select(*[F.col(k).alias(f"_{k}") for k in keys], "_i", "_above", *passed)
    at_top = named(tops.select(*keys, F.lit(0).cast("long").alias("_i"), F.col("siblings").alias("_above"), *passed))
    above = out = None
    for level in range(len(runs) - 1, -1, -1):
        # a tree's last run hangs from its top, the others from the level above
        under = same_keys(keys, "_") & (F.col("run") == F.col("_i"))
        met = runs[level].filter("m = 1").join(at_top, under)
        if above is not None:
            met = met.unionByName(runs[level].filter("m > 1").join(above, under))
        hashes = F.col("hashes")
        one = met.withColumn("hashes", F.col("children.h")).select(*keys, "hashes", "_above", *passed, F.posexplode("children").alias("pos", "child"))
        beside = F.struct(F.array_join(F.slice(hashes, F.lit(1), F.col("pos")), "").alias("left"), F.array_join(F.slice(hashes, F.col("pos") + 2, F.greatest(F.size(hashes) - F.col("pos") - 1, F.lit(0))), "").alias("right"))
        out = one.select(*keys, "child.*", F.concat(F.array(beside), F.col("_above")).cast(_SIBLINGS).alias("siblings"), *passed)
        if level:
            above = named(out.select(*keys, F.col("i").alias("_i"), F.col("siblings").alias("_above"), *passed))
    return out


def fold(start: Column, siblings: Column) -> Column:
    """The root that ``start`` gives with its siblings."""
    return F.aggregate(siblings, start, lambda h, x: digest(x["left"], h, x["right"]))


def proof_hash(siblings: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf", carry: tuple[str, ...] = (), fanout: int = FANOUT) -> Manifest:
    """Tree of each group's leaves in ascending ``order`` (nulls first; ties by leaf), and the tree of the groups' tops, ordered by group (null first, UTF-8 bytewise).

    ``leaves`` has ``group``, ``order``, ``leaf`` and the columns to ``carry``; others are left behind, whatever their names.
    Each ``fanout`` consecutive nodes become their parent, the last ones being fewer or even one, until one is left: a group
    of one leaf has it as its top, one group's top is the root. Null is a group of its own. Repeated rows are a leaf each.
    No rows give no rows. No task holds a group: numbers come from ranges of group and order, a run has ``fanout`` nodes,
    and the number of levels is the logarithm of the largest group. Levels are written to the shared folder.
    """
    names = [order, *carry]
    taken = leaves.select(F.col(group).alias("g"), F.col(leaf).alias("h"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("carried"))
    laid = numbered(taken, ["g"], [F.col("carried")["c0"], F.col("h")], "merkle-leaves")
    laid = laid.select("g", "h", "carried", F.col("place").alias("i"), F.col("total").alias("m"))
    runs, tops = _levels(laid, ["g"], fanout)
    tops = cut(tops, "merkle-tops")

    placed = numbered(tops, [], [F.col("g")], "merkle-groups")
    over, root = _levels(placed.select("h", F.struct("g").alias("carried"), F.col("place").alias("i"), F.col("total").alias("m")), [], fanout)
    start = root.select(F.array().cast(_SIBLINGS).alias("siblings"), F.col("h").alias("root"))
    if over:
        groups = _descend(over, start, [], ["root"]).select("carried.g", F.col("h").alias("subroot"), "root", "siblings")
    else:
        groups = tops.select("g", F.col("h").alias("subroot"), F.col("h").alias("root"), F.array().cast(_SIBLINGS).alias("siblings"))
    groups = cut(groups, "merkle-subroots")
    drop(tops, *over)

    alone = laid.filter("m = 1").join(groups.withColumnRenamed("g", "_g"), same_keys(["g"], "_")).select("g", "h", "carried", "siblings", "subroot", "root")
    found = _descend(runs, groups, ["g"], ["subroot", "root"]).drop("i").unionByName(alone) if runs else alone
    put = found.select(F.col("g").alias(group), F.col("h").alias("leaf"), *[F.col("carried")[f"c{i}"].alias(c) for i, c in enumerate(names)], "subroot", "root", "siblings")
    return Manifest(put, groups.withColumnRenamed("g", group))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    Null fields count as a dash; a null doc_id is a leaf like any other and is never tampered with; repeated rows are a leaf
    each; no documents give no rows. Texts are hashed where they are read and never shuffled.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_hash(*[F.translate(c, _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]))
    leaves = docs.select("doc_id", "source", leaf_hash(*map(F.col, FIELDS)).alias("leaf"), tampered.alias("tampered"))
    found = manifest(leaves, carry=("tampered",)).leaves
    out = found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("siblings")).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("siblings")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a decimal number's digits (reflected polynomial 0xEDB88320), bit by bit, for engines without the function.
def crc32_sql(number: str) -> str:
    step = "c"
    for _ in range(8):
        step = f"list_transform([{step}], lambda z: xor(z >> 1, (z & 1) * 3988292384))[1]"
    step = step.replace("[c]", "[xor(c, d)]")
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda e: CAST(ascii(e) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, d: {step}), 4294967295::BIGINT)"


def _oracle(levels: int = 6) -> str:
    """Levels of a fixed number, enough for ``FANOUT`` to their power documents and sources."""
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    body = f"""a0 AS (SELECT doc_id, source, {hashed("text")} AS leaf, CASE WHEN {crc32_sql("doc_id")} % 5 = 0 THEN {hashed(low)} ELSE {hashed("text")} END AS now FROM documents),
    d0 AS (SELECT *, leaf AS h, now AS f, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM a0)"""
    for where, first in (("source", 0), ("1", levels)):
        for k in range(first, first + levels):
            # a node per run; a tree of one node stays as it is
            body += f""",
    n{k} AS (SELECT DISTINCT source AS s, {where} AS w, i, h, m FROM d{k}),
    {"u%d AS (SELECT min(s) AS s, w, i, h, m FROM n%d GROUP BY w, i, h, m)," % (k, k) if first else "u%d AS (SELECT * FROM n%d)," % (k, k)}
    r{k} AS (SELECT w, i // {FANOUT} AS run, list(h ORDER BY i) AS hs FROM u{k} WHERE m > 1 GROUP BY ALL),
    d{k + 1} AS (SELECT d.doc_id, d.source, d.leaf, d.now, {"d.subroot," if first else ""}
      CASE WHEN d.m > 1 THEN sha256(array_to_string(r.hs, '')) ELSE d.h END AS h,
      CASE WHEN d.m > 1 THEN sha256(coalesce(array_to_string(r.hs[1:(d.i % {FANOUT})], ''), '') || d.f || coalesce(array_to_string(r.hs[(d.i % {FANOUT}) + 2:], ''), '')) ELSE d.f END AS f,
      d.proof || CASE WHEN d.m > 1 THEN coalesce(array_to_string(r.hs[1:(d.i % {FANOUT})], ''), '') || coalesce(array_to_string(r.hs[(d.i % {FANOUT}) + 2:], ''), '') ELSE '' END AS proof,
      d.i // {FANOUT} AS i, (d.m + {FANOUT - 1}) // {FANOUT} AS m
      FROM d{k} d LEFT JOIN r{k} r ON r.w IS NOT DISTINCT FROM d.{where if not first else "w"} AND r.run = d.i // {FANOUT} AND d.m > 1)"""
            if first:
                body = body.replace(f"FROM d{k} d LEFT", f"FROM (SELECT *, 1 AS w FROM d{k}) d LEFT")
        if not first:
            # the tops of the sources, in their order, are the next tree's leaves
            body += f""",
    t AS (SELECT source AS s, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS many FROM (SELECT DISTINCT source FROM d{levels}))"""
            body = body.replace(f"d{levels} AS (SELECT", f"e{levels} AS (SELECT").replace(f"FROM d{levels})", f"FROM e{levels})")
            body += f""",
    d{levels} AS (SELECT e.doc_id, e.source, e.leaf, e.now, e.h AS subroot, e.h, e.f, e.proof, t.place AS i, t.many AS m FROM e{levels} e JOIN t ON t.s IS NOT DISTINCT FROM e.source)"""
    return f"WITH {body} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM d{2 * levels}"


ORACLE_SQL = _oracle()
