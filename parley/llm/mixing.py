"""Operator 2: mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, sent over and over (at most ``max_repeats`` times). A document's
virtual finish time is the words its source has sent up to and with it, divided by the source's target. All queues are
merged by a global range sort on that time; running totals over its ranges cut the merged queue where the total budget is
spent. As targets sum to the budget, that is about virtual time 1. The documents in service then, one of a source, queue
in packets of few words, so sources meet their targets to a packet.

Running sums never meet in one task: a source's documents fall into blocks by a hash, virtual time falls into ranges that
hold about the same number of words, sums of both are pre-aggregated, and only sums within a block or a range and over the
tables of blocks and ranges are windows, and those run in two levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import WORD, compact, cut, running_total, table, word_count

#: Documents of a block and of a range of virtual time on average; words of a packet at least, and packets of a document at most.
BLOCK_ROWS, RANGE_ROWS, PACKET, PACKETS = 1024, 2048, 16, 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Targets of sources, from rows ``(source, source_size)``: all sizes shared by weight, none above ``max_repeats`` times its size.

    Sources take the weights in turn by code point, null last. Sharing the excess again until no target is above its
    stop has one fixed point: target = min(stop, rate x weight), with one rate for all. Sources are put in the order of
    stop / weight; the stopped ones are a prefix, found where the rate of the rest no longer reaches the next stop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(pattern, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * float(max_repeats))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before, after, every = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing), by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rated = ranked.withColumn("rate", rate).withColumn("holds", F.col("rate") <= F.col("stop") / F.col("weight"))
    final = F.max(F.when(F.col("holds"), F.col("rate"))).over(Window.partitionBy())  # of those that hold, the first has the largest rate
    return rated.withColumn("final", final).select("source", "source_size", F.least("stop", F.coalesce(F.col("final") * F.col("weight"), F.col("stop"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 7, keep_idle: bool = False) -> DataFrame:
    """The mix of ``docs`` (doc_id, source, text): one row for each time a document is sent, range-sorted by virtual finish time.

    Columns: doc_id, source, size, text_hash, source_size, target, row_key (tells repeated rows of a source apart), epoch (from 0),
    finish (virtual time) and take (words sent: the size, or less for a document in service when the budget is spent).
    With ``keep_idle`` documents that are never sent have one row with take 0. Documents without words take nothing. Rows that
    repeat count each for itself. The order depends only on the rows and ``seed``, so reruns agree. Empty in, empty out.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    total = sized.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    blocks, budget = max(1, total["rows"] // BLOCK_ROWS), total["words"]
    shuffled = sized.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).withColumn("block", F.pmod("shuffle", F.lit(blocks)))
    sums = shuffled.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, max_repeats)
    offsets = (
        running_total(sums, ["source"], "block", "block_size", "offset")
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "offset")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select("s", "b", "offset", "source_size", "target")
    )
    inside = Window.partitionBy("source", "block").orderBy("shuffle", "doc_id", "size", "text_hash")
    placed = (
        shuffled.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("start", F.col("offset") + F.col("within") - F.col("size"))
    )
    # a document queues as often as it can begin before virtual time 1
    times = F.ceil(F.try_divide(F.col("target") + 1 - F.col("start"), F.col("source_size"))).cast("int")
    times = F.greatest(F.lit(1), F.least(F.lit(max_repeats), F.coalesce(times, F.lit(1))))
    queued = (
        placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
        .withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("start"))
        .withColumn("end", F.col("begin") + F.col("size"))
        .withColumn("queues", (F.col("size") > 0) & (F.col("begin") < F.col("target") + 1))
        .withColumn("step", F.when(F.col("queues") & (F.col("end") > F.col("target")), F.greatest(F.lit(PACKET), F.ceil(F.col("size") / PACKETS))).otherwise(F.greatest("size", F.lit(1))))
        .withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("size") / F.col("step")) - 1))))
        .withColumn("words", F.least("step", F.col("size") - F.col("packet") * F.col("step")))
        .withColumn("due", F.coalesce((F.col("begin") + F.col("packet") * F.col("step") + F.col("words")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0)))
        .select("doc_id", "source", "size", "text_hash", "source_size", "target", F.struct("block", "place").alias("row_key"), "epoch", "begin", "packet", "words", "due", "queues")
    )
    queued = cut(queued, "queued")
    # ranges are as many as the queue's rows ask for; words flow evenly until time 1, and what is in service then queues on beyond it
    ranges = max(1, queued.count() // RANGE_ROWS)
    queued = queued.withColumn("range", F.when(F.col("queues"), F.floor(F.col("due") * ranges)))
    sent_before = queued.filter(F.col("range").isNotNull()).groupBy(F.col("range").alias("r")).agg(F.sum("words").alias("range_words"))
    sent_before = running_total(sent_before, [], "r", "range_words", "ahead").select("r", "ahead")
    merged = Window.partitionBy("range").orderBy("due", F.col("source").isNull(), "source", "row_key", "epoch", "packet").rowsBetween(Window.unboundedPreceding, 0)
    running = queued.filter(F.col("range").isNotNull()).withColumn("running", F.sum("words").over(merged)).join(sent_before, F.col("range") == F.col("r"))
    sent = running.withColumn("take", F.greatest(F.lit(0).cast("long"), F.least("words", F.lit(budget) - F.col("ahead") - F.col("running") + F.col("words"))))
    idle = queued.filter(F.col("range").isNull()).withColumn("take", F.lit(0).cast("long"))
    keep = ["doc_id", "source", "size", "text_hash", "source_size", "target", "row_key", "epoch"]
    finish = F.coalesce((F.col("begin") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0)).alias("finish")
    every = sent.select(*keep, "begin", "words", "take").union(idle.select(*keep, "begin", "words", "take"))
    # packets of one sending become one row again
    whole = every.filter("words = size").select(*keep, finish, "take")
    parts = every.filter("words <> size").groupBy(*keep, "begin").agg(F.sum("take").alias("take")).select(*keep, finish, "take")
    out = whole.union(parts)
    if not keep_idle:
        out = out.filter("take > 0")
    return out.repartitionByRange("finish", "source", "row_key", "epoch").sortWithinPartitions("finish", "source", "row_key", "epoch")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: every column of ``docs``, a row for each time it is sent; the one cut at the budget has its first words only.

    Only sent counts travel to the texts, joined on the row itself: doc_id, source and the text's hash. Of rows that are equal
    in these, each goes as often as the mix sends the one in its place. Documents without words were never sent and go.
    """
    own = ["doc_id", "source", "text_hash"]
    sent = mix_sources(docs, keep_idle=True, **options).groupBy(*own).agg(
        F.sum(F.expr("CAST(take > 0 AND take = size AS INT)")).alias("whole"),
        F.collect_list(F.expr("CASE WHEN take > 0 AND take < size THEN take END")).alias("part"),  # of a source only what is in service at the end
        F.sum(F.expr("CAST(epoch = 0 AS INT)")).alias("rows"),
    )
    sent = sent.filter("whole > 0 OR size(part) > 0").select(*[F.col(c).alias(f"sent_{c}") for c in own], "whole", "part", "rows")
    sent = cut(sent, "sent")
    plain = [F.col(c).alias(f"doc_{i}") for i, c in enumerate(docs.columns)]
    met = docs.select(*plain, F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), F.xxhash64("text").alias("own_hash")).join(
        sent, F.col("own_id").eqNullSafe(F.col("sent_doc_id")) & F.col("own_source").eqNullSafe(F.col("sent_source")) & (F.col("own_hash") == F.col("sent_text_hash"))
    )
    # equal rows stand together in the mix, so the first of them are sent once more, and the next one may be cut
    place = F.row_number().over(Window.partitionBy("own_id", "own_source", "own_hash").orderBy("own_hash"))
    met = met.filter("rows = 1").withColumn("place", F.lit(1)).union(met.filter("rows > 1").withColumn("place", place))
    each, left = F.floor(F.col("whole") / F.col("rows")).cast("int"), (F.col("whole") % F.col("rows")).cast("int")
    times = each + F.when(F.col("place") <= left, 1).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), times), F.when(F.col("place") == F.least(left + 1, F.col("rows")), F.col("part")).otherwise(F.array().cast("array<bigint>")))
    met = met.withColumn("cut_at", F.explode(copies))
    text = F.col(f"doc_{docs.columns.index('text')}")
    cut_text = F.when(F.col("cut_at").isNull(), text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("cut_at").cast("int")), " "))
    return met.select(*[cut_text.alias("text") if c == "text" else F.col(f"doc_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sent = mix_sources(table(spark, sf_dir, "documents"), keep_idle=True)
    return compact(sent.groupBy("doc_id", "source", "size", "source_size", "target", "row_key").agg(F.sum("take").alias("taken")).select("doc_id", "size", "source_size", "target", "taken", "source"))
