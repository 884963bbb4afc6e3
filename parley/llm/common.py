"""Shared pieces of the training-data operators: words, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley import steps
from parley.steps import FILE_BYTES, compact, drop, planned_bytes, run, shared_dir

__all__ = ["FILE_BYTES", "compact", "cut", "drop", "planned_bytes", "run", "shared_dir"]

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a column batch that the Parquet reader fills, and of an Arrow batch.
TEXT_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Links of a file between two rounds of components.
FILE_LINKS = 250_000


def tune(spark: SparkSession) -> None:
    """Batches for rows that hold whole texts, where the session has no values of its own: Spark's are made for short rows, and an executor holds several at once."""
    own = spark._jsparkSession.sessionState().conf()
    for key, value in TEXT_BATCHES.items():
        if not own.contains(key):
            spark.conf.set(key, value)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``steps.cut`` with batches for whole texts."""
    tune(df.sparkSession)
    return steps.cut(df, tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, most: int, rows: int = 4096, column: str | int = "text"):
    """Arrow batches in slices of at most ``most`` bytes of texts and ``rows`` rows (one row at least), without copying."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(lengths), 0
        while a < batch.num_rows:
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))
            b = max(a + 1, min(b, a + rows))
            yield batch.slice(a, b - a)
            a = b


def give_back() -> None:
    """Return a Python worker's free memory: workers are kept for later stages, and what an allocator hoards counts with the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` parts at exactly the six characters of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    met = down.join(least, F.col("a") == F.col("k"))
    found = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return found.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links ``(a, b)``: rows ``(node, component)``, the component being its smallest node.

    Alternates large-star and small-star steps until the links no longer change. Each step is two aggregations with
    partial sums and two equi-joins, which adaptive execution splits if a node holds very many links; no node's links
    meet in one task. Every round is written to the shared folder and the one before is deleted. Links of a node with
    itself and null ends are ignored; no links give no rows. Nodes without a link have no row.
    """
    now = cut(edges.select("a", "b").dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
        # as many files as the links ask for
        step = cut(_small_star(_large_star(now)).coalesce(-(-mark["n"] // FILE_LINKS)), "links")
        drop(now)
        now = step
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Rows that one task sums in order, at each of two levels, and letters of a string that ranges are drawn by.
RUN, HEAD = 1024, 32


def running_total(rows: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of equal ``keys`` that come before (exclusive), as ``name``.

    ``at`` is a whole number that orders the rows of a key, each number once. Sums run within blocks of ``RUN`` numbers and
    over the blocks, so that no task orders more than a block and one row for each other block of a key.
    """
    block = F.floor(F.col(at) / RUN)
    sums = rows.groupBy(*keys, block.alias("_b")).agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), before.alias("_o"))
    own = Window.partitionBy(*keys, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_b", block).withColumn("_i", F.coalesce(F.sum(value).over(own), F.lit(0)))
    met = inner.join(sums, same_keys(keys, "_k_") & (F.col("_b") == F.col("_kb")))
    return met.select(*rows.columns, (F.col("_i") + F.col("_o")).alias(name))


def same_keys(keys: list[str], prefix: str) -> Column:
    """Equality of ``keys`` with their prefixed copies, nulls being equal."""
    return reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(prefix + k)), keys, F.lit(True))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], tag: str, keep: list[Column] | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 0 among the rows of equal ``keys`` in ``order`` (nulls first), and ``total``, how many those are.

    Rows are dealt by ranges of keys and order, so one key's rows spread over many tasks; a row's place is its number in its
    range and what the ranges before hold of its key. Rows equal in all of keys and order are numbered as they come. Of the
    last of ``order``, if it is a string, ranges know the first ``HEAD`` letters, since a sample of it comes to the driver.
    ``keep``: what is kept of a row, computed once it is dealt (all of it by default). The dealt rows are written, since ranges
    would fall elsewhere if they were drawn again. No column may be called ``place``, ``total`` or begin with an underscore.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(planned_bytes(rows) // FILE_BYTES, 1 << 20))
    named = rows.select(*rows.columns, *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    by = [*keys, *[f"_o{i}" for i in range(len(order))]]
    ranges = [F.col(c).asc_nulls_first() for c in by]
    if dict(named.dtypes)[by[-1]] == "string":
        ranges[-1] = F.substring(by[-1], 1, HEAD).asc_nulls_first()
    dealt = named.repartitionByRange(parts, *ranges).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    kept = [*keys, *keep] if keep is not None else rows.columns
    laid = cut(dealt.select(*kept, F.monotonically_increasing_id().alias("_at")), tag)
    columns = [c for c in laid.columns if c != "_at"]
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    held = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    if keys:
        whole = held.groupBy(*keys).agg(F.sum("_n").alias("total")).select(*[F.col(k).alias(f"_w_{k}") for k in keys], "total")
        held = running_total(held, keys, "_part", "_n", "_before").join(whole, same_keys(keys, "_w_"))
    else:
        held = running_total(held, keys, "_part", "_n", "_before").withColumn("total", F.lit(laid.count()))
    starts = held.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_part").alias("_p"), (F.col("_before") - F.col("_first")).alias("_shift"), "total")
    met = laid.join(starts, same_keys(keys, "_h_") & (F.col("_part") == F.col("_p")))
    out = cut(met.select(*columns, (F.col("_at") + F.col("_shift")).alias("place"), "total"), tag)
    drop(laid)
    return out
