"""Operator 13: secret scans by corpus-wide ownership frequency.

Patterns find spans of three kinds in each text, and runs of letters and digits besides. The hash of every value found is
counted over the corpus: in how many repositories, of how many owners it occurs. What many owners have is a widely copied
example; what few have is theirs. A run is added as a span if it belongs to few owners and either looks like a live
credential or is the value of a span elsewhere. All of it is built-in functions: two aggregations and one join of hashes;
texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, table

#: Kinds in their order, and each one's pattern.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Whole runs of at least 12 characters with a digit; the look-ahead is tried once a run.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{12,}"
#: Least length of an assigned value; owners that a value of theirs has at most; least length, digits and different characters of a live-looking run.
VALUE, OWNERS, LONG, DIGITS, VARIED = 6, 2, 20, 3, 10
#: Words of examples.
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|redacted|your|test|xxxx|0123|1234|abcd"
#: Matches that one fold numbers.
BLOCK = 512

_SPAN = "struct<start:int,kind:int,end:int,value:string,looks:boolean>"


def _positions(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches in code points: what lies between them, and they themselves, add up.

    Sums run in blocks of ``BLOCK`` matches, so that a text of many costs no square of them.
    """
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("match")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    found = "array<struct<start:int,end:int,match:string>>"

    def one(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))))).cast(f"struct<at:int,found:{found}>")

    def block(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(found).alias("found")).cast(f"struct<at:int,found:{found}>"), one)
        # in an array of one element, so that the fold runs once
        return F.element_at(F.transform(F.array(inner), lambda y: F.struct(y["at"].alias("at"), F.concat(acc["found"], F.array(y["found"])).alias("found"))), 1).cast(f"struct<at:int,found:array<{found}>>")

    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(f"struct<at:int,found:array<{found}>>"), block)
    return F.when(F.size(matches) > 0, F.flatten(whole["found"])).otherwise(F.array().cast(found))


def looks_live(value: Column) -> Column:
    """Whether a run looks like a live credential: long, varied, of both cases and digits, without an example's words."""
    return (
        (F.char_length(value) >= LONG)
        & (F.char_length(F.regexp_replace(value, "[^0-9]", "")) >= DIGITS)
        & value.rlike("[A-Z]")
        & value.rlike("[a-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= VARIED)
        & ~value.rlike(PLACEHOLDER)
    )


def spans_of(text: Column) -> dict[str, Column]:
    """``assign``, ``access``, ``hex`` and ``run``: matches of a text's patterns, to be kept as columns before ``_positions`` uses them twice."""
    return {k: F.regexp_extract_all(text, F.lit(p), 0) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN))}


def scan(docs: DataFrame, repo: str, owner: str, text: str = "text") -> DataFrame:
    """One row for each of ``docs``: row, repo, owner, base and runs, arrays of (start, kind, end, value, looks) in order; a run that meets a base span is none."""
    df = docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.select("repo", "owner", "text", *[c.alias(k) for k, c in spans_of(F.col("text")).items()])
    at = {k: _positions(F.col("text"), F.col(k), p).alias(k) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN))}
    df = df.select("repo", "owner", *at.values())
    span = lambda x, kind, value, looks: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), value.alias("value"), looks.alias("looks")).cast(_SPAN)
    given = F.filter(F.transform("assign", lambda x: span(x, 0, F.regexp_extract(x["match"], ASSIGN, 2), F.lit(True))), lambda x: F.char_length(x["value"]) >= VALUE)
    plain = lambda name, kind: F.transform(name, lambda x: span(x, kind, x["match"], F.lit(True)))
    df = df.select("repo", "owner", "run", given.alias("assign"), F.array_sort(F.concat(given, plain("access", 1), plain("hex", 2))).alias("base"))
    # access and hex spans lie within runs
    free = F.filter("run", lambda x: ~x["match"].rlike(ACCESS) & ~x["match"].rlike(HEX) & ~F.exists("assign", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return df.select(F.monotonically_increasing_id().alias("row"), "repo", "owner", "base", F.transform(free, lambda x: span(x, 3, x["match"], looks_live(x["match"]))).alias("runs"))


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, repos (distinct pairs of repository and owner), owners (distinct) and named (is a base span's value somewhere) of every value; nulls are a repository and an owner of their own."""
    value = lambda x, named: F.struct(F.sha2(x["value"], 256).alias("hash"), F.lit(named).alias("named"))
    values = F.array_distinct(F.concat(F.transform("base", lambda x: value(x, True)), F.transform("runs", lambda x: value(x, False))))
    once = scanned.select("repo", "owner", F.inline(values)).groupBy("hash", "owner", "repo").agg(F.max("named").alias("named"))
    of_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("named").alias("named"))
    return of_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.max("named").alias("named"))


def find_secrets(docs: DataFrame, repo: str, owner: str, text: str = "text", owners: int = OWNERS) -> tuple[DataFrame, DataFrame]:
    """What a scan found, and every span with its counts.

    The first has one row for each of ``docs``: row, repo, owner, base (array of spans), runs. The second has the rows' base
    spans and added runs: row, kind (number), start, end (code points, exclusive), value, repos, owners, verdict: ``live``
    (of at most ``owners`` owners, and assigned or live-looking), else ``copied``. Null texts are empty; repeated rows are
    scanned each, and are one repository; other columns are ignored, whatever their names; no rows give none. A hash that a
    third of all rows have is counted by partial sums, and its join is split by adaptive execution.
    """
    found = cut(scan(docs, repo, owner, text), "secrets")
    spans = found.filter("size(base) + size(runs) > 0").select("row", F.inline(F.concat("base", "runs"))).withColumn("hash", F.sha2("value", 256))
    counts = ownership(found).select(F.col("hash").alias("_h"), "repos", "owners", "named")
    met = spans.join(counts, F.col("hash") == F.col("_h"))
    few = F.col("owners") <= owners
    told = met.withColumn("verdict", F.when(few & (F.col("looks") | F.col("named")) & ~F.col("value").rlike(PLACEHOLDER), "live").otherwise("copied"))
    kept = (F.col("kind") < 3) | (F.col("verdict") == "live")
    return found, told.filter(kept).select("row", "kind", "start", "end", "value", "repos", "owners", "verdict")


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of documents, and how many spans are live and how many are widely copied.

    A document is a repository, its source the owner. Null and empty texts have no spans; no documents give no rows.
    """
    found, spans = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "source")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    base = found.select("row", F.col("repo").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), (F.size("base") + F.size("runs")).alias("_n"))
    of_row = spans.groupBy(F.col("row").alias("_r")).agg(spans_text(F.array_sort(F.collect_list(F.struct("start", "kind", "end")))).alias("spans"), F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "copied").alias("n_copied"))
    none = base.filter("_n = 0").withColumns({"spans": F.lit(""), "n_live": F.lit(0).cast("long"), "n_copied": F.lit(0).cast("long")})
    some = base.filter("_n > 0").join(of_row, F.col("row") == F.col("_r"), "left").withColumns({"spans": F.coalesce("spans", F.lit("")), "n_live": F.coalesce("n_live", F.lit(0).cast("long")), "n_copied": F.coalesce("n_copied", F.lit(0).cast("long"))})
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied"]
    return none.select(*columns).unionByName(some.select(*columns))


def _oracle() -> str:
    q = lambda p: p.replace("'", "''")
    run = "[A-Za-z0-9+/_=-]{12,}"
    at = lambda name, p: f"list_transform(range(1, len({name}) + 1), lambda i: {{'s': list_sum(list_transform(string_split_regex(text, '{q(p)}')[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform({name}[1:i-1], lambda z: length(z))), 0), 'm': {name}[i]}})"
    text = "list_transform({0}, lambda z: concat_ws(':', ['assign', 'access', 'hex', 'owned'][z.k + 1], z.s, z.e))"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, regexp_extract_all(text, '{q(ASSIGN)}') AS a, regexp_extract_all(text, '{q(ASSIGN)}', 2) AS g, regexp_extract_all(text, '{ACCESS}') AS k, regexp_extract_all(text, '{HEX}') AS h, regexp_extract_all(text, '{run}') AS u FROM t),
f AS (SELECT r, doc_id, source, list_filter(list_transform({at('a', ASSIGN)}, lambda z, i: {{'s': z.s, 'k': 0, 'e': z.s + length(z.m), 'v': g[i]}}), lambda z: length(z.v) >= {VALUE}) AS a,
  list_transform({at('k', ACCESS)}, lambda z: {{'s': z.s, 'k': 1, 'e': z.s + length(z.m), 'v': z.m}}) AS k, list_transform({at('h', HEX)}, lambda z: {{'s': z.s, 'k': 2, 'e': z.s + length(z.m), 'v': z.m}}) AS h,
  list_filter(list_transform({at('u', run)}, lambda z: {{'s': z.s, 'k': 3, 'e': z.s + length(z.m), 'v': z.m}}), lambda z: regexp_matches(z.v, '[0-9]')) AS u FROM m),
b AS (SELECT r, doc_id, source, len(a) AS n_assign, len(k) AS n_access, len(h) AS n_hex, list_sort(list_concat(list_concat(a, k), h)) AS base, u FROM f),
o AS (SELECT r, doc_id, source, unnest(list_concat(base, list_filter(u, lambda z: len(list_filter(base, lambda y: y.s < z.e AND z.s < y.e)) = 0))) AS x FROM b),
c AS (SELECT x.v AS v, count(DISTINCT coalesce(source, '-null')) AS owners, bool_or(x.k < 3) AS named FROM o GROUP BY ALL),
j AS (SELECT o.r, o.x, owners <= {OWNERS} AND NOT regexp_matches(c.v, '{PLACEHOLDER}') AND (x.k < 3 OR named OR (length(c.v) >= {LONG} AND length(regexp_replace(c.v, '[^0-9]', '', 'g')) >= {DIGITS} AND regexp_matches(c.v, '[A-Z]') AND regexp_matches(c.v, '[a-z]')
  AND len(list_distinct(string_split(c.v, ''))) >= {VARIED})) AS live FROM o JOIN c ON c.v = o.x.v),
s AS (SELECT r, list_sort(list(x)) AS every, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j WHERE live OR x.k < 3 GROUP BY r)
SELECT doc_id, n_assign, n_access, n_hex, sha256(coalesce(array_to_string({text.format('base')}, ','), '')) AS base_sha256, coalesce(array_to_string({text.format('every')}, ','), '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM b LEFT JOIN s ON s.r = b.r"""


ORACLE_SQL = _oracle()
