"""Interval operators: overlap joins with arg-max attribution, merges of adjacent segments, unions and anti-joins.

Joins are equi-joins on the video and a bucket of time with the overlap as a residual condition, so a long video is many keys;
``overlaps`` is the form without buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import scalars as s

#: Milliseconds of a time bucket.
WIDTH = 15_000


def merge_segments(segs: DataFrame, gap: int = 300, key: str = "video_id") -> DataFrame:
    """Fuse segments of one speaker that follow each other within ``gap``; another speaker in between breaks the run.

    Rows (key, seg_ord, t0, t1, spk). Gaps and islands in two windows over one shuffle: runs of a speaker first, then islands
    where a start lies more than ``gap`` after all ends so far. ``seg_ord`` of an island is its first.
    """
    order = Window.partitionBy(key).orderBy("t0", "t1", "seg_ord")
    runs = segs.withColumn("run", F.sum(F.coalesce((F.col("spk") != F.lag("spk").over(order)).cast("int"), F.lit(1))).over(order))
    inside = Window.partitionBy(key, "run").orderBy("t0", "t1", "seg_ord")
    before = F.max("t1").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("new", (before.isNull() | (F.col("t0") - before > gap)).cast("int")).withColumn("island", F.sum("new").over(inside))
    return islands.groupBy(key, "run", "island").agg(F.first("spk").alias("spk"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min(F.struct("t0", "t1", "seg_ord")).alias("at")).select(key, F.col("at.seg_ord").alias("seg_ord"), "t0", "t1", "spk")


def overlaps(lines: DataFrame, segs: DataFrame, key: str = "video_id") -> DataFrame:
    """Pairs of a line and a segment of one video that meet, with the length they share as ``ov``."""
    right = segs.select(F.col(key).alias("_k"), F.col("t0").alias("s0"), F.col("t1").alias("s1"), "spk", "seg_ord")
    met = lines.join(right, (F.col(key) == F.col("_k")) & (F.col("t0") < F.col("s1")) & (F.col("s0") < F.col("t1")))
    return met.withColumn("ov", s.overlap(F.col("t0"), F.col("t1"), F.col("s0"), F.col("s1"))).filter("ov > 0").drop("_k")


def bucketed_overlap(lines: DataFrame, segs: DataFrame, width: int = WIDTH, key: str = "video_id") -> DataFrame:
    """``overlaps`` with time buckets as a second key, so that a video's rows meet only those of their time; each pair comes once, from the first bucket both are in."""
    cut = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    right = cut(segs).select(F.col(key).alias("_k"), F.col("bucket").alias("_b"), F.col("t0").alias("s0"), F.col("t1").alias("s1"), "spk", "seg_ord")
    met = cut(lines).join(right, (F.col(key) == F.col("_k")) & (F.col("bucket") == F.col("_b")) & (F.col("t0") < F.col("s1")) & (F.col("s0") < F.col("t1")))
    once = met.filter(F.col("bucket") == F.greatest(F.floor(F.col("t0") / width), F.floor(F.col("s0") / width)))
    return once.withColumn("ov", s.overlap(F.col("t0"), F.col("t1"), F.col("s0"), F.col("s1"))).filter("ov > 0").drop("_k", "_b", "bucket")


def attribute(lines: DataFrame, segs: DataFrame, key: str = "video_id", merged: bool = False, gap: int = 300) -> DataFrame:
    """Speaker of each line (key, idx, t0, t1): most overlap, ties to the speaker seen first; runner-up likewise.

    Every speaker of the video competes, with overlap 0 if need be (of those only the first two seen can place), so a line in a gap goes to the first-seen speaker with
    conf 0; without any segment it is SPK_00. conf = overlap / duration, unrounded; review: conf < 0.6.
    """
    joined = segs if merged else merge_segments(segs, gap, key)
    seen = joined.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("t0", "t1", "seg_ord"))).groupBy(F.col(key).alias("_v"), F.col("spk").alias("_s")).agg(F.min("place").alias("seen"))
    line = [key, "idx", "t0", "t1"]
    # who shares nothing with a line can only be one of the first two seen
    early = seen.withColumn("nth", F.row_number().over(Window.partitionBy("_v").orderBy("seen"))).filter("nth <= 2")
    idle = lines.select(*line).join(early, F.col(key) == F.col("_v"), "left").select(*line, F.when(F.col("_s").isNotNull(), F.struct(F.lit(0).cast("long").alias("less"), "seen", F.col("_s").alias("spk"))).alias("offer"))
    shared = bucketed_overlap(lines.select(*line), joined, key=key).groupBy(*line, "spk").agg((-F.sum("ov")).cast("long").alias("less"))
    heard = shared.join(seen, (F.col(key) == F.col("_v")) & (F.col("spk") == F.col("_s"))).select(*line, F.struct("less", "seen", "spk").alias("offer"))
    # most overlap first, then first seen; a speaker's idle offer comes after its own
    best = idle.unionByName(heard).groupBy(*line).agg(F.array_sort(F.collect_list("offer")).alias("offers"))
    length = F.greatest(F.col("t1") - F.col("t0"), F.lit(1)).cast("double")
    first = F.get("offers", F.lit(0))
    second = F.get(F.filter("offers", lambda x: x["spk"] != first["spk"]), F.lit(0))
    out = best.select(*line, F.coalesce(first["spk"], F.lit("SPK_00")).alias("spk"), F.coalesce(-first["less"] / length, F.lit(0.0)).alias("conf"), second["spk"].alias("runner"), (-second["less"] / length).alias("runner_conf"))
    return out.withColumn("review", F.col("conf") < 0.6)


def clean_segments(segs: DataFrame, least: int = 4000, tolerance: int = 200, most: int = 3, key: str = "video_id") -> DataFrame:
    """The ``most`` longest segments of each speaker that no other speaker overlaps by more than ``tolerance``; seg_ord tells a video's segments apart."""
    long = segs.filter(F.col("t1") - F.col("t0") >= least)
    other = segs.select(key, "t0", "t1", F.col("spk"), "seg_ord")
    met = bucketed_overlap(long.select(key, "t0", "t1", F.col("spk").alias("own"), F.col("seg_ord").alias("own_ord")), other, key=key)
    crossed = met.filter((F.col("own") != F.col("spk")) & (F.col("ov") > tolerance)).select(F.col(key).alias("_k"), F.col("own_ord").alias("_o")).distinct()
    alone = long.join(crossed, (F.col(key) == F.col("_k")) & (F.col("seg_ord") == F.col("_o")), "left_anti")
    place = F.row_number().over(Window.partitionBy(key, "spk").orderBy((F.col("t0") - F.col("t1")), "t0", "seg_ord"))
    return alone.withColumn("place", place).filter(F.col("place") <= most)


def union_spans(spans: DataFrame, gap: int = 50, key: str = "video_id") -> DataFrame:
    """Unions of the spans (key, t0, t1) of each key; spans within ``gap`` join."""
    order = Window.partitionBy(key).orderBy("t0", "t1")
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("t0") > reach + gap)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).filter("t1 > t0").drop("island")


def stitch_plan(spans: DataFrame, totals: DataFrame, key: str = "video_id") -> DataFrame:
    """Pieces (key, src, a, b) of a track: original inside the spans, dub before, between and after them up to ``total``."""
    order = Window.partitionBy(key).orderBy("t0", "t1")
    cursor = F.coalesce(F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = spans.withColumn("cursor", cursor).filter(F.col("t1") > F.greatest("t0", "cursor")).withColumn("a", F.greatest("t0", "cursor"))
    pieces = F.array(F.struct(F.lit("dub").alias("src"), F.col("cursor").alias("a"), F.col("a").alias("b")), F.struct(F.lit("orig").alias("src"), F.col("a").alias("a"), F.col("t1").alias("b")))
    inner = cut.select(key, F.inline(pieces))
    last = spans.groupBy(F.col(key).alias("_k")).agg(F.max("t1").alias("last"))
    tail = totals.join(last, F.col(key) == F.col("_k"), "left").select(key, F.lit("dub").alias("src"), F.coalesce("last", F.lit(0)).alias("a"), F.col("total").alias("b"))
    return inner.unionByName(tail).filter("b > a")


def relabel(segs: DataFrame, merges: DataFrame, key: str = "video_id") -> DataFrame:
    """Segments with merged speakers renamed; merges are rows (key, id, target)."""
    names = merges.select(F.col(key).alias("_k"), "id", "target")
    return segs.join(names, (F.col(key) == F.col("_k")) & (F.col("spk") == F.col("id")), "left").withColumn("spk", F.coalesce("target", "spk")).drop("_k", "id", "target")
