"""Closure of merges by pointer doubling: in each round a pointer takes over its target's, so a chain of n hops takes log n rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.steps import cut, drop


def _at(table: DataFrame, *columns: str) -> DataFrame:
    """``table`` under names that join with a pointer."""
    return table.select(F.col("k").alias("_k"), F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])


def _meet() -> Column:
    return (F.col("k") == F.col("_k")) & (F.col("to") == F.col("_id"))


def _doubled(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Pointers (k, id, to, hops, far) of edges (k, id, to): those at the end of their chain, and those in rings or on their way into one.

    ``far`` tells that ``to`` has an edge itself. After r rounds such a pointer is 2^r hops long; when that is as many as its
    key has edges, it can only run in a ring.
    """
    ids = _at(edges).distinct()
    now = cut(edges.join(ids, _meet(), "left").select("k", "id", "to", F.lit(1).cast("long").alias("hops"), F.col("_id").isNotNull().alias("far")), "closure")
    settled, active, reach = [now.filter("NOT far")], now.filter("far"), 1
    most = edges.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    while active.limit(1).count():
        if reach >= most:
            return settled, active
        target = _at(_union([*settled, active]), "to", "hops", "far")
        step = cut(active.join(target, _meet()).select("k", "id", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_far").alias("far")), "closure")
        settled.append(step.filter("NOT far"))
        active, reach = step.filter("far"), 2 * reach
    return settled, None


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def merge_closure(merges: DataFrame, key: str = "decision") -> DataFrame:
    """Final target of each merged id (key, id, target): ``final``, ``hops`` and ``ring``.

    An id that runs into a ring ends where it would repeat: at the ring's node that it meets first, after the way there and
    once around. Null keys, ids and targets merge nothing; of several targets of an id the smallest counts; an id that is its
    own target is a ring of one. Rounds are equi-joins of pointers, log2 of the longest chain of them; each is written to the
    shared folder. The nodes of rings are what pointers as long as their key has edges point at.
    """
    edges = merges.select(F.col(key).alias("k"), "id", F.col("target").alias("to")).dropna().groupBy("k", "id").agg(F.min("to").alias("to"))
    edges = cut(edges, "merges")
    settled, running = _doubled(edges)
    found = _union(settled).select("k", "id", F.col("to").alias("final"), "hops", F.lit(False).alias("ring"))
    if running is not None:
        found = found.unionByName(_rings(edges, running))
    return found.withColumnRenamed("k", key)


def _rings(edges: DataFrame, running: DataFrame) -> DataFrame:
    """Finals of the pointers (k, id, to) that run in rings."""
    on = cut(running.select(F.col("k").alias("_k"), F.col("to").alias("_id")).distinct(), "ring-nodes")
    mine = (F.col("k") == F.col("_k")) & (F.col("id") == F.col("_id"))
    going = edges.join(running.select(F.col("k").alias("_k"), F.col("id").alias("_id")), mine, "left_semi")
    # around: the smallest id of a ring names it
    most = on.groupBy("_k").count().agg(F.max("count")).first()[0]
    now, reach = cut(going.join(on, mine, "left_semi").select("k", "id", "to", F.col("id").alias("least")), "rings"), 1
    while reach < most:
        step = cut(now.join(_at(now, "to", "least"), _meet()).select("k", "id", F.col("_to").alias("to"), F.least("least", "_least").alias("least")), "rings")
        drop(now)
        now, reach = step, 2 * reach
    size = now.groupBy(F.col("k").alias("_k"), F.col("least").alias("_least")).agg(F.count(F.lit(1)).alias("size"))
    around = cut(now.join(size, (F.col("k") == F.col("_k")) & (F.col("least") == F.col("_least"))).select("k", "id", "size"), "around")
    ring = around.select("k", "id", F.col("id").alias("final"), F.col("size").alias("hops"), F.lit(True).alias("ring"))
    # the way there: without the rings' own edges it ends where a ring is met
    tails, _ = _doubled(going.join(on, mine, "left_anti"))
    way = _union(tails).join(_at(around, "size"), _meet()).select("k", "id", F.col("to").alias("final"), (F.col("hops") + F.col("_size")).alias("hops"), F.lit(True).alias("ring"))
    return ring.unionByName(way)
