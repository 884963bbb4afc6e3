"""Operator 8: SimHash near-dedup by a grid range-join over per-segment bit counts.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such points is a
lower bound of the fingerprints' Hamming distance. The segments form subspaces, six or more; points within distance 4
differ in four of them at most, so they share a grid cell in at least one choice of all but four. Each fingerprint goes to
its cells; within a cell the Manhattan bound over all segments comes first, and pairs that pass it are verified bit by
bit. The more fingerprints there are, the more subspaces: cells get finer, and every choice of them is lossless.

Equal fingerprints are one row from the start (a partial aggregation), so copies never meet. Of a cell's links only
a spanning forest leaves it, not its pairs. Cells of many fingerprints are parted into blocks, and pairs of blocks go to
tasks of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import compact, components, cut, drop, sliced, table

#: Subspaces at least, and fingerprints up to which they are enough; for eight times as many there is one more.
LEAST_SUBSPACES, ENOUGH = 6, 1 << 22
#: Fingerprints of a cell beyond which it is parted into blocks of about this size.
BLOCK = 2048
#: Bytes of shingles hashed at a time.
CHUNK = 1 << 16
_UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(_UPPER, bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is 1 if over half of the shingles' XXH64 have it. Zero for no words; one shingle for fewer words than ``width``."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else ()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= width:
        return digest(joined, seed)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    begin, end = starts[: n - width + 1].tolist(), (starts[width:] - 1).tolist()
    counts, shingles = np.zeros(64, np.int64), n - width + 1
    for at in range(0, shingles, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begin[at : at + CHUNK], end[at : at + CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text of ``docs`` (doc_id, text); one Arrow batch at a time."""

    def run(batches):
        for batch in sliced(batches, CHUNK << 4):
            found = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def segment_counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in its segment's place."""
    low = np.uint64(0x5555555555555555)
    return (x & low) + ((x >> np.uint64(1)) & low)


def subspaces_for(n: int) -> int:
    """Subspaces for ``n`` different fingerprints."""
    more = 0
    while n > ENOUGH * 8**more and more < 6:
        more += 1
    return LEAST_SUBSPACES + more


def cell_masks(subspaces: int, distance: int = 4) -> np.ndarray:
    """The bits of the counts that each kind of cell looks at: all subspaces but ``distance``, in every choice."""
    edges = np.round(np.linspace(0, 32, subspaces + 1)).astype(int) * 2
    own = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.array([sum(own[i] for i in kept) for kept in combinations(range(subspaces), subspaces - distance)], np.uint64)


def cells_of(x: np.ndarray, subspaces: int = LEAST_SUBSPACES) -> np.ndarray:
    """The cells of each fingerprint, as numbers: the kind of cell and the counts that it looks at."""
    masks = cell_masks(subspaces)
    seen = segment_counts(x)[:, None] & masks
    key = (seen + np.arange(len(masks), dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    return (key * np.uint64(0xBF58476D1CE4E5B9) + np.arange(len(masks), dtype=np.uint64)).view(np.int64)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of the segments' bit counts: of two counts 0, 1 or 2, what their bits differ in says how far they are apart."""
    low = np.uint64(0x5555555555555555)
    apart = segment_counts(x) ^ segment_counts(y)
    high = (apart >> np.uint64(1)) & low
    return np.bitwise_count(high).astype(np.int16) + np.bitwise_count(high ^ (apart & low))


def near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs link: the Manhattan bound first, then the exact distance."""
    passed = manhattan(x, y) <= distance
    passed[passed] = np.bitwise_count(np.broadcast_to(x, passed.shape)[passed] ^ np.broadcast_to(y, passed.shape)[passed]) <= distance
    return passed


def forest(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, first of its group) that join what is linked within ``x``: one search from each group's first."""
    x = np.sort(x)
    left, out_a, out_b = np.arange(len(x)), [], []
    while len(left) > 1:
        root, left, queue = x[left[0]], left[1:], [left[0]]
        while queue and len(left):
            hit = near(x[queue.pop()], x[left], distance)
            if hit.any():
                found, left = left[hit], left[~hit]
                queue.extend(found.tolist())
                out_a.append(x[found])
                out_b.append(np.full(len(found), root))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (x[:0], x[:0])


#: Cells up to this size are compared many at once.
SMALL = 16


def links_within(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that share a cell; rows come sorted by cell."""
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[first, len(cells)])
    out_a, out_b = [], []
    few = np.repeat(sizes, sizes) <= SMALL
    for step in range(1, SMALL):
        at = np.flatnonzero((cells[step:] == cells[:-step]) & few[:-step]) if step < len(cells) else ()
        if not len(at):
            break
        hit = near(fps[at], fps[at + step], distance)
        out_a.append(fps[at][hit])
        out_b.append(fps[at + step][hit])
    for a, n in zip(first[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        found = forest(fps[a : a + n], distance)
        out_a.append(found[0])
        out_b.append(found[1])
    empty = np.array([], np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _linker(distance: int):
    """Partitions sorted by (cell, part) -> links. A cell that goes on in the next batch waits for its end."""

    def run(batches):
        rest = None
        for batch in batches:
            got = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            got = got if rest is None else np.concatenate([rest, got])
            if not len(got):
                continue
            last = np.flatnonzero((got[:, :2] != got[-1, :2]).any(axis=1))
            split = last[-1] + 1 if len(last) else 0
            rest = got[split:]
            if split:
                yield emit(got[:split])
        if rest is not None and len(rest):
            yield emit(rest)

    def emit(rows):
        # cell and part together tell groups apart; numbered anew, they fit one key
        key = np.cumsum(np.r_[0, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        a, b = links_within(key, np.ascontiguousarray(rows[:, 2]).view(np.uint64), distance)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

    return run


def near_links(distinct: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: as many as join all that are linked, not all pairs."""
    if not 0 <= distance <= 4:
        raise ValueError("cells are made for a distance of at most 4")
    subspaces = subspaces_for(distinct.count())

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            cells = cells_of(fps.view(np.uint64), subspaces)
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(fps, cells.shape[1]))], ["cell", "fp"])

    rows = cut(distinct.select("fp").mapInArrow(spread, "cell long, fp long"), "cells")
    crowded = cut(rows.groupBy("cell").count().filter(F.col("count") > block).select(F.col("cell").alias("crowd"), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "crowded")
    parted = rows.withColumn("part", F.lit(0).cast("long"))
    if crowded.head(1):
        # in a crowded cell a fingerprint goes to each pair of blocks that has its own block
        met = rows.join(crowded, F.col("cell") == F.col("crowd"), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.least(own, j) * F.col("blocks") + F.greatest(own, j)).cast("long"))
        parted = met.withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others))).select("cell", "fp", "part")
    return parted.select("cell", "part", "fp").repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_linker(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) of every document of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows stay and get equal results. A
    null doc_id is never a group's smallest unless all are null. No rows give none.
    """
    marked = cut(fingerprints(docs, width, seed), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = cut(near_links(classes, distance), "near")
    reach = components(links)
    # a fingerprint without links is a component of its own
    named = classes.join(reach, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "fp").alias("component"), "least")
    named = cut(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = cut(named.drop("least").join(least, "component").select("class_fp", "component_id"), "final")
    drop(classes, links, named)
    return marked.join(final, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 4, similarity: float | None = None, **options) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id, with all its columns.

    Groups are those of ``near_duplicates``, or with a ``similarity`` (0.8) those of documents whose sets of ``width``-word
    shingles are as similar: candidates by longer SimHashes, settled by whole sets, see ``near_copies``. Rows that share a doc_id are one document; rows
    with a null id stay; null and empty texts are copies of each other. No rows give none.
    """
    if similarity is None:
        found = near_duplicates(docs, width=width, **options)
    else:
        from parley.llm import near_copies

        if similarity * near_copies.SHARE[1] != near_copies.SHARE[0]:
            raise ValueError("cells are made for a similarity of 0.8")
        found = near_copies.near_copies(docs, width)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    # the caller's columns go under names of their own, so none of them can clash
    plain = docs.select(*[F.col(c).alias(f"doc_{i}") for i, c in enumerate(docs.columns)])
    stay = plain.join(gone, F.col(f"doc_{docs.columns.index('doc_id')}") == F.col("gone_id"), "left_anti")
    return stay.select(*[F.col(f"doc_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return compact(found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
