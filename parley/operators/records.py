"""Records of items: optional filters, titles, payloads of events, decisions that are reused, copies that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.workflow import host_attach

#: The fields that each event may carry.
EVENT_FIELDS = {
    "download_done": ("media_path",),
    "analysis_done": (),
    "review_submit": ("review",),
    "confirm_skip": ("review",),
    "rediarize": (),
    "preview_ready": ("preview_path",),
    "preview_pass": (),
    "preview_reject": (),
    "full_done": ("output_path",),
    "fail": ("error", "stage"),
    "retry": (),
}


def ledger_query(ledger: DataFrame, bvid=None, status: str | None = None, busy: bool | None = None) -> DataFrame:
    """Records that meet every condition given, by item and part."""
    out = ledger
    for column, value in (("bvid", bvid), ("status", status), ("busy", busy)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.orderBy("bvid", "part")


def item_titles(ledger: DataFrame) -> DataFrame:
    """The first title of an item's parts that is not empty, else the item itself."""
    named = F.nullif("title", F.lit(""))
    return ledger.groupBy("bvid").agg(F.coalesce(F.min_by(named, F.when(named.isNotNull(), F.col("part"))), F.col("bvid").cast("string")).alias("title"))


def payload_check(events: DataFrame) -> DataFrame:
    """Events (…, event, payload map, review_on_record) with ``reason``: why the payload is refused, null if it is taken.

    In this order: an unknown event; fields the event does not take, named in order; an empty text in one it takes; a failure
    without stage and error; a review whose verdict does not fit. ``payload['review']`` is the review's verdict; without one
    the record's counts.
    """
    allowed = F.create_map(*[x for event, fields in EVENT_FIELDS.items() for x in (F.lit(event), F.array(*map(F.lit, fields)).cast("array<string>"))])
    given = F.coalesce(F.map_keys("payload"), F.array().cast("array<string>"))
    takes = F.try_element_at(allowed, F.col("event"))
    unknown = F.array_sort(F.array_except(given, takes))
    value = lambda k: F.try_element_at("payload", F.lit(k))
    empty = F.array_sort(F.filter(given, lambda k: (k != "stage") & (k != "error") & (F.element_at("payload", k) == "")))
    verdict = F.coalesce(value("review"), F.col("review_on_record"))
    wrong = lambda event, want: (F.col("event") == event) & ~F.coalesce(verdict == want, F.lit(False))
    lacks = lambda k: F.coalesce(value(k), F.lit("")) == ""
    reason = (
        F.when(takes.isNull(), "unknown event")
        .when(F.size(unknown) > 0, F.concat(F.lit("takes no "), F.array_join(unknown, ",")))
        .when(F.size(empty) > 0, F.concat(F.lit("empty "), F.array_join(empty, ",")))
        .when((F.col("event") == "fail") & (lacks("stage") | lacks("error")), "fail without stage and error")
        .when(wrong("review_submit", "dub"), "review is not dub")
        .when(wrong("confirm_skip", "skip"), "review is not skip")
    )
    return events.withColumn("reason", reason)


def decision_state(decisions: DataFrame, products: DataFrame, names: tuple[str, ...], force: bool = False) -> DataFrame:
    """Whether each decision (decision, hash, rediarize) is voided, reused or applied, and which products are to be written.

    A product (hash, name, written, done) counts if it and its sentinel are there; a decision whose products all count is reused.
    """
    whole = products.filter("written AND done").filter(F.col("name").isin(*names)).groupBy(F.col("hash").alias("_h")).agg(F.collect_set("name").alias("have"))
    df = decisions.join(whole, F.col("hash") == F.col("_h"), "left")
    every = F.array(*map(F.lit, sorted(names)))
    missing = every if force else F.array_except(every, F.coalesce("have", F.array().cast("array<string>")))
    missing = F.when(F.coalesce("rediarize", F.lit(False)), F.array().cast("array<string>")).otherwise(missing)
    status = F.when(F.coalesce("rediarize", F.lit(False)), "voided").when(F.size(missing) == 0, "reused").otherwise("applied")
    return df.select("decision", "hash", status.alias("status"), F.array_join(F.array_sort(missing), ",").alias("to_write"))


def first_host_ref(people: DataFrame, part: int) -> DataFrame:
    """Each person's first reference (name, refs) that could be attached as host of ``part`` alone; persons without one have no row."""
    one = people.select("name", F.posexplode("refs").alias("pos", "ref")).withColumn("own", F.concat_ws("/", "name", F.col("pos").cast("string")))
    fit = host_attach(one.select(F.col("own").alias("name"), F.array("ref").alias("refs")), part).filter("ok").select(F.col("name").alias("_n"))
    met = one.join(fit, F.col("own") == F.col("_n"), "left_semi")
    return met.groupBy("name").agg(F.min_by("ref.audio", "pos").alias("audio"), F.min("pos").alias("pos"))


def reconcile(copies: dict[str, DataFrame], keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Keys on which named copies of one table disagree: the copies that lack the key, and the fields that differ among those that have it."""
    names = sorted(copies)
    rows = [copies[n].select(*keys, *fields, F.lit(n).alias("copy")) for n in names]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    differs = lambda f: F.when(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\u0000"))) > 1, F.lit(f))
    met = every.groupBy(*keys).agg(F.collect_set("copy").alias("has"), *[differs(f).alias(f"_{f}") for f in fields])
    lacking = F.array_join(F.array_except(F.array(*map(F.lit, names)), "has"), ",")
    wrong = F.array_join(F.array_compact(F.array(*[F.col(f"_{f}") for f in sorted(fields)])), ",")
    return met.select(*keys, lacking.alias("lacking"), wrong.alias("differs")).filter("lacking <> '' OR differs <> ''")


def part_documents(ledger: DataFrame, cards: DataFrame) -> DataFrame:
    """One document of each part (bvid, part, doc): its record's fields and, in order, its speakers' cards.

    ``ledger``: (bvid, part, title, …); all other columns are fields of the document. ``cards``: (bvid, part, spk, …). A part
    without cards has an empty list.
    """
    fields = [c for c in ledger.columns if c != "bvid"]
    card = F.struct("spk", *[c for c in cards.columns if c not in ("bvid", "part", "spk")])
    own = cards.groupBy(F.col("bvid").alias("_b"), F.col("part").alias("_p")).agg(F.array_sort(F.collect_list(card)).alias("speakers"))
    met = ledger.join(own, (F.col("bvid") == F.col("_b")) & (F.col("part") == F.col("_p")), "left")
    none = F.array().cast(own.schema["speakers"].dataType)
    return met.select("bvid", "part", F.struct(*fields, F.coalesce("speakers", none).alias("speakers")).alias("doc"))


def episode_documents(ledger: DataFrame, cards: DataFrame) -> DataFrame:
    """One document of each item (bvid, title, parts): parts in order, the title the first that is not empty, else the id. Built bottom up: cards, parts, items."""
    parts = part_documents(ledger, cards)
    titled = F.min(F.when(F.coalesce(F.col("doc.title"), F.lit("")) != "", F.struct("part", F.col("doc.title").alias("t"))))
    found = parts.groupBy("bvid").agg(titled.alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("part", "doc"))), lambda x: x["doc"]).alias("parts"))
    return found.select("bvid", F.coalesce("first.t", F.col("bvid").cast("string")).alias("title"), "parts")


def archive_documents(entries: DataFrame) -> DataFrame:
    """One document of each person (person, groups, total, invalid_total): entries (person, lang, seq, ref_path, valid) by language in order, none last.

    A group counts its valid entries and, apart, the invalid ones; only valid ones have an ``audio`` address. Vectors stay inside.
    """
    row = F.struct("seq", "ref_path", "valid", F.when(F.col("valid"), F.col("ref_path")).alias("audio"))
    groups = entries.groupBy("person", "lang").agg(F.count_if("valid").alias("count"), F.count_if(~F.col("valid")).alias("invalid"), F.array_sort(F.collect_list(row)).alias("entries"))
    placed = F.struct(F.col("lang").isNull().alias("none"), F.coalesce("lang", F.lit("")).alias("name"), F.struct("lang", "count", "invalid", "entries").alias("g"))
    return groups.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["g"]).alias("groups"), F.sum("count").alias("total"), F.sum("invalid").alias("invalid_total"))
