"""Operators 4 and 7 over embeddings: a random-projection tree forest and a hash-prefix forest.

Both take rows (vec_id, embedding). Vectors that are null, zero, or hold null or non-finite components take no part.
Cosines are computed in double precision from the original components. Equal vectors are one class from the start, so a
vector that a third of all rows hold is compared once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import compact, components, cut, drop, table

#: Rows of the sample that the trees are fitted on, the fewest of them in a leaf, and how many times its rows make a leaf large.
FIT_ROWS, LEAST_LEAF, LARGE = 16_384, 8, 4
#: Copies of a vector in one tree at most, by expectation, and bytes of vectors that leave a worker at once.
COPIES, SENT_BYTES = 3.0, 8 << 20


def takes_part() -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    return vectors.select("vec_id", "embedding").filter(takes_part())


def classes(vectors: DataFrame) -> DataFrame:
    """One row for each different vector: class_id (a number of its own, never null), least (smallest vec_id), copies (rows that hold it), embedding."""
    grouped = vectors.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return cut(grouped.select(F.monotonically_increasing_id().alias("class_id"), "least", "copies", "embedding"), "classes")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(distinct: DataFrame, rows: int = FIT_ROWS, dims: int | None = None) -> np.ndarray:
    """A fixed sample of the different vectors, at most ``rows``: those with the smallest hash."""
    got = distinct.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(rows).select("embedding").toArrow()
    return unit(matrix(got["embedding"].combine_chunks()))


# --- Operator 4: random-projection tree forest -------------------------------------------------------------------


class Forest:
    """Trees of random splits: at each node a direction, a middle and a margin on both sides that belongs to both.

    The margin is ``spill``, but no more than holds the ``share`` of the node's points that lie nearest to the middle.
    """

    def __init__(self, points: np.ndarray, trees: int, leaf: int, spill: float, seed: int, share: float = 1.0):
        self.rng, self.trees, self.leaf, self.spill, self.share = np.random.default_rng(seed), [], leaf, spill, share
        self.leaves = 0
        for _ in range(trees):
            self.trees.append(self._grow(points, 0))

    def _grow(self, points: np.ndarray, depth: int):
        if len(points) > self.leaf and depth < 24:
            direction = self.rng.standard_normal(points.shape[1])
            direction /= np.sqrt((direction * direction).sum())
            at = points @ direction
            middle = float(np.median(at))
            low, high = at <= middle + self.spill, at >= middle - self.spill
            if max(low.sum(), high.sum()) <= 0.8 * len(points):  # else near copies would be torn or double at every split
                margin = min(self.spill, float(np.quantile(np.abs(at - middle), self.share)))
                low, high = at <= middle + margin, at >= middle - margin
                return direction, middle, margin, self._grow(points[low], depth + 1), self._grow(points[high], depth + 1)
        self.leaves += 1
        return self.leaves - 1

    def reach(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each point falls into."""
        rows, leaves = [], []
        for tree in self.trees:
            todo = [(tree, np.arange(len(points)))]
            while todo:
                node, at = todo.pop()
                if isinstance(node, int):
                    rows.append(at)
                    leaves.append(np.full(len(at), node))
                    continue
                value = points[at] @ node[0]
                todo.append((node[3], at[value <= node[1] + node[2]]))
                todo.append((node[4], at[value >= node[1] - node[2]]))
        return np.concatenate(rows), np.concatenate(leaves)


def _compare(least: float, per_part: int):
    """One part of a leaf -> (class_id, links, root): links counted where the pair's first common leaf is this one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class_id")
        ids, copies, block = (group[c].to_numpy() for c in ("class_id", "copies", "block"))
        x = unit(np.stack(group["embedding"].to_numpy()).astype(np.float64))
        width = max(map(len, group["leaves"]))
        member = np.full((len(ids), width), -1, np.int64)
        for i, m in enumerate(group["leaves"]):
            member[i, : len(m)] = m
        here, part = int(group["leaf"].iloc[0]), int(group["part"].iloc[0])
        blocks = int(group["blocks"].iloc[0])
        first, second = divmod(part, blocks)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        step = 1024
        for a in range(0, len(ids), step):
            close = x[a : a + step] @ x.T
            i, j = np.nonzero(close >= least - 1e-9)
            i += a
            keep = (i < j) & (np.minimum(block[i], block[j]) == first) & (np.maximum(block[i], block[j]) == second)
            i, j = i[keep], j[keep]
            exact = np.empty(len(i), bool)
            for b in range(0, len(i), 1 << 16):
                exact[b : b + (1 << 16)] = np.einsum("ij,ij->i", x[i[b : b + (1 << 16)]], x[j[b : b + (1 << 16)]]) >= least
            i, j = i[exact], j[exact]
            if not len(i):
                continue
            # the smallest leaf that both are in owns the pair
            owner = np.full(len(i), np.iinfo(np.int64).max)
            for k in range(width):
                mine = member[i, k]
                shared = (member[j] == mine[:, None]).any(axis=1) & (mine >= 0)
                owner = np.where(shared, np.minimum(owner, mine), owner)
            own = owner == here
            np.add.at(links, i[own], copies[j[own]])
            np.add.at(links, j[own], copies[i[own]])
            # roots settle by taking the smaller end again and again
            while True:
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                np.minimum.at(root, before[i], low)
                np.minimum.at(root, before[j], low)
                root = root[root]
                if (root == before).all():
                    break
        told = (links > 0) | (root != np.arange(len(ids)))
        return pd.DataFrame({"class_id": ids[told], "links": links[told], "root": ids[root[told]]})

    return run


def link_spill(least: float, dims: int, spill: float) -> float:
    """The margin of a split: ``spill`` times what two unit vectors of cosine ``least`` lie apart on a random direction, as a rule."""
    return spill * float(np.sqrt(max(0.0, 2 - 2 * least) / dims))


def spill_share(rows: int, leaf: int) -> float:
    """The share of a node's points that may go both ways so that a vector has ``COPIES`` copies in a tree when it is as deep as ``rows`` ask for."""
    levels = max(1.0, np.log2(max(2.0, rows / leaf)))
    return float(min(0.5, COPIES ** (1 / levels) - 1))


def near_vectors(vectors: DataFrame, least: float = 0.95, trees: int = 6, leaf: int = 1024, spill: float = 0.32, block: int = 2048, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding): links have cosine >= ``least``.

    The trees are fitted on a sample of at most ``FIT_ROWS`` different vectors, so that a leaf holds about ``leaf`` of all;
    leaves that hold far more are split on over all rows. Every vector goes down every tree, and to both sides where it lies
    near a split: within ``spill`` of what a linked pair lies apart on a direction, which shrinks with the dimensions, and never
    more than ``COPIES`` copies a tree allow. Leaves of near copies, of more than ``block`` vectors are parted into
    blocks, and each pair of blocks is a task's group. A pair is counted in its first common leaf alone, so counts
    add up without a list of pairs; from each group a spanning forest goes on to the components.

    Vectors that take no part have no links and are their own component. Repeated rows count as vectors. A row with a
    null vec_id links like others but is no component's smallest, unless all are null. Vectors of different lengths are compared with their like only. No rows give none.
    """
    good = cut(usable(vectors), "vectors")
    found = []
    for (dims,) in good.select(F.size("embedding")).distinct().collect():
        found.append(_near_of_length(good.filter(F.size("embedding") == dims), least, trees, leaf, spill, block, seed))
    if not found:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = found[0]
    for more in found[1:]:
        named = named.unionByName(more)
    met = good.join(named, good["embedding"] == named["class_vector"]).select("vec_id", F.col("n_links"), F.col("component_id"))
    rest = vectors.filter(~takes_part())
    all_rows = met.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return all_rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _split_further(reached: DataFrame, most: int, spill: float, seed: int, share: float = 1.0) -> DataFrame:
    """Rows (leaf, class_id, copies, embedding) with the leaves of over ``most`` rows split on, a level at a time, over all rows.

    A leaf's direction is a row of signs that its number and ``seed`` give; its middle is the median of all its rows, summed
    up from sketches; rows within ``spill`` of it, and no more than the middle ``share`` of them, go to both sides. A leaf that a split would not make smaller (near copies of
    one vector) stays: its pairs are compared block by block. Only rows of large leaves are touched.
    """
    done, now, level = None, reached, 0
    while True:
        sizes = now.groupBy("leaf").count()
        large = cut(sizes.filter(F.col("count") > most).select(F.col("leaf").alias("of"), F.col("count").alias("rows")), "large")
        if not large.head(1):
            return now if done is None else done.unionByName(now)
        sign = F.transform("embedding", lambda _, i: 1.0 - 2.0 * F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "leaf", i), F.lit(2)))
        v = F.col("embedding").cast("array<double>")
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x) * F.size("embedding"))
        value = F.aggregate(F.zip_with(v, sign, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x) / norm
        at = cut(now.join(large, F.col("leaf") == F.col("of")).withColumn("at", value), "split")
        at_shares = F.percentile_approx("at", [0.5 - share / 2, 0.5, 0.5 + share / 2], 1000)
        middles = at.groupBy(F.col("leaf").alias("split")).agg(at_shares.alias("q")).select("split", F.col("q")[0].alias("least_at"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("most_at"))
        parted = at.join(middles, F.col("leaf") == F.col("split"))
        low, high = F.col("at") <= F.col("middle") + spill, F.col("at") >= F.col("middle") - spill
        worth = parted.groupBy(F.col("leaf").alias("judged"), F.col("rows")).agg(F.greatest(F.count_if(low), F.count_if(high)).alias("side"))
        worth = worth.filter(F.col("side") <= 0.8 * F.col("rows")).select("judged")
        low, high = F.col("at") <= F.least(F.col("middle") + spill, "most_at"), F.col("at") >= F.greatest(F.col("middle") - spill, "least_at")
        sides = F.array_compact(F.array(F.when(low, F.xxhash64("leaf", F.lit(level), F.lit("low"))), F.when(high, F.xxhash64("leaf", F.lit(level), F.lit("high")))))
        own = ["leaf", "class_id", "copies", "embedding"]
        split = cut(parted.join(worth, F.col("leaf") == F.col("judged"), "left_semi").select(F.explode(sides).alias("leaf"), "class_id", "copies", "embedding"), "sides")
        whole = now.join(large.join(worth, F.col("of") == F.col("judged"), "left_semi"), F.col("leaf") == F.col("of"), "left_anti")
        if not split.head(1):
            return now if done is None else done.unionByName(now)
        rest = cut(whole.select(*own), "settled")  # small leaves, and large ones that are dense
        done = rest if done is None else done.unionByName(rest)
        now, level = split, level + 1


def _near_of_length(good: DataFrame, least: float, trees: int, leaf: int, spill: float, block: int, seed: int) -> DataFrame:
    distinct = classes(good)
    points, n = sample(distinct), distinct.count()
    spill, share = link_spill(least, points.shape[1], spill), spill_share(n, leaf)
    # the more vectors there are, the fewer of the sample a leaf holds: a leaf gets about as many of all at any size
    forest = Forest(points, trees, max(LEAST_LEAF, leaf * len(points) // max(1, n)), spill, seed, share)
    sent = good.sparkSession.sparkContext.broadcast(forest)  # bounded: trees x FIT_ROWS / leaf splits
    kind = distinct.schema["embedding"].dataType.simpleString()
    width = points.shape[1]

    def down(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at = sent.value.reach(unit(matrix(batch.column("embedding"))))
            step = max(1, SENT_BYTES // (8 * width))
            for a in range(0, len(row), step):
                taken = pa.array(row[a : a + step])
                yield pa.RecordBatch.from_arrays([pa.array(at[a : a + step]), *[batch.column(c).take(taken) for c in ("class_id", "copies", "embedding")]], ["leaf", "class_id", "copies", "embedding"])

    reached = cut(distinct.mapInArrow(down, f"leaf long, class_id long, copies long, embedding {kind}"), "leaves")
    reached = _split_further(reached, LARGE * leaf, spill, seed, share)
    members = reached.groupBy(F.col("class_id").alias("member")).agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    reached = cut(reached.join(members, F.col("class_id") == F.col("member")).drop("member"), "members")
    blocks = reached.groupBy("leaf").count().select(F.col("leaf").alias("of"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    parted = reached.join(blocks, F.col("leaf") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least("block", j) * F.col("blocks") + F.greatest("block", j))
    parted = parted.withColumn("part", F.explode(pairs)).select("leaf", "part", "blocks", "block", "class_id", "copies", "embedding", "leaves")
    told = cut(parted.groupBy("leaf", "part").applyInPandas(_compare(least, block), "class_id long, links long, root long"), "told")
    reach = components(told.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    counts = told.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = distinct.select("class_id", "least").join(reach, F.col("class_id") == F.col("node"), "left").select("class_id", "least", F.coalesce("component", "class_id").alias("component"))
    joined = cut(joined, "joined")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    settled = joined.join(smallest, "component").select(F.col("class_id").alias("settled"), "component_id")
    named = (
        distinct.join(counts.withColumnRenamed("class_id", "counted"), F.col("class_id") == F.col("counted"), "left")
        .join(settled, F.col("class_id") == F.col("settled"))
        .select(F.col("embedding").alias("class_vector"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    out = cut(named, "named")
    drop(distinct, reached, told, joined)
    return out


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return compact(near_vectors(table(spark, sf_dir, "embeddings")))


NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.links, 0) AS n_links, c.least AS component_id, e.vec_id = c.least AS kept
FROM embeddings e JOIN (SELECT n, min(m) AS least FROM r GROUP BY n) c ON c.n = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


# --- Operator 7: hash-prefix forest --------------------------------------------------------------------------------

#: Bits of a hash string, rows of a shard and of a prefix's cell on average, and the chance that all trees miss a neighbour.
BITS, SHARD_ROWS, CELL_ROWS, MISS = 32, 8192, 1024, 0.05


def agreement(trees: int, miss: float = MISS) -> float:
    """How likely a prefix must be shared in one tree for all trees to miss it with the chance ``miss``."""
    return 1 - miss ** (1 / trees)


def safe_length(cosine: np.ndarray, trees: int) -> np.ndarray:
    """The longest prefix by which vectors of at least this cosine are met but for the chance ``MISS``. A bit agrees with 1 - angle / pi."""
    bit = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    with np.errstate(divide="ignore"):
        length = np.log(agreement(trees)) / np.log(np.minimum(bit, 1 - 1e-12))
    return np.minimum(np.floor(length), BITS).astype(np.int64)


def safe_cosine(length: int, trees: int) -> float:
    """The least cosine for which ``safe_length`` is ``length``."""
    return float(np.cos(np.pi * (1 - agreement(trees) ** (1 / length))))


def planes(trees: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, dims, BITS))


def strings(points: np.ndarray, of_tree: np.ndarray) -> np.ndarray:
    """Hash strings of a tree as numbers, the first bit the highest."""
    bits = (points @ of_tree >= 0).astype(np.uint64)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class PrefixForest:
    """Sorted arrays of hash strings, one for each tree, over the rows of one shard."""

    def __init__(self, points: np.ndarray, trees: int, seed: int):
        self.points, self.planes = points, planes(trees, points.shape[1], seed)
        hashed = [strings(points, p) for p in self.planes]
        self.order = [np.argsort(h, kind="stable") for h in hashed]
        self.sorted = [h[o] for h, o in zip(hashed, self.order, strict=True)]

    def search(self, queries: np.ndarray, known: np.ndarray, k: int, least: int):
        """For each query the rows it meets and their cosines.

        All trees go down to their longest matching prefix, then rise together, a bit at a time, until ``least`` matches are
        met. The k-th best cosine of these, or the one ``known`` before, says how far a nearer row can be, and all trees rise on
        to the prefix by which such a row is met but for the chance ``MISS``.
        """
        trees, n = len(self.order), len(queries)
        low, high = np.zeros((trees, BITS + 1, n), np.int32), np.zeros((trees, BITS + 1, n), np.int32)
        for t in range(trees):
            q = strings(queries, self.planes[t])
            for length in range(BITS + 1):
                free = np.uint64((1 << (BITS - length)) - 1)
                low[t, length] = np.searchsorted(self.sorted[t], q & ~free, "left")
                high[t, length] = np.searchsorted(self.sorted[t], q | free, "right")

        def met(i, length):
            seen = np.zeros(len(self.points), bool)
            for t in range(trees):
                seen[self.order[t][low[t, length, i] : high[t, length, i]]] = True
            at = np.flatnonzero(seen)
            return at, np.einsum("ij,j->i", self.points[at], queries[i])

        for i in range(n):
            totals = (high[:, :, i] - low[:, :, i]).sum(axis=0)
            length = int(np.flatnonzero(totals >= min(max(least, k), totals[0]))[-1])
            at, scores = met(i, length)
            bound = max(float(known[i]), float(np.partition(scores, -k)[-k]) if len(scores) >= k else -1.0)
            if (safe := int(safe_length(np.float64(bound), trees))) < length:
                at, scores = met(i, safe)
            yield i, at, scores


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 24, least: int = 256, seed: int = 5, effort: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of all rows by cosine for each query, the rows whose vec_id is divisible by ``every``.

    Long prefixes first: different vectors and queries meet in the cells of a tree's prefixes, of as many bits as make a cell
    about ``CELL_ROWS`` vectors. A cell is a sorted array of hash strings: a query goes down to its longest matches there and
    rises until its trees have met ``least``. The k-th best cosine of all trees says how far a nearer vector can be, so that all
    cells rise on to the prefix by which such a one is met but for the chance ``MISS``. A query for which that prefix is no
    longer than a cell's is done; the others ask cells of four bits less. Where the cells of all trees would together hold
    more than the table, what is left asks all shards of it, each of them a forest that is built once and read by all
    queries. Cells of very many vectors are parted into blocks. See the README for the recall measured.

    A class answers with its smallest vec_ids, so copies of one vector come in the order of their ids. A query is never
    its own answer but its copies are; a query row that occurs more than once asks once. Fewer candidates than ``k``: all of them. Rows that take no part are neither
    queries nor answers; a null vec_id neither. Repeated rows are answers each. No rows give none. ``effort`` adds ``met``: how many cosines the query took.
    """
    good = cut(usable(vectors).filter(F.col("vec_id").isNotNull()), "vectors")
    found = []
    for (dims,) in good.select(F.size("embedding")).distinct().collect():
        found.append(_nearest_of_length(good.filter(F.size("embedding") == dims), every, k, trees, least, seed, effort))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double" + ", met long" * effort)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: A hit of a query; ``used``: bits of the prefix whose vectors it has met there; ``met``: how many, told with the first hit.
_HIT = "query_id long, class_id long, score double, used long, met long"


class Cell:
    """The sorted array of one tree's hash strings over the vectors of a cell, which share the first ``bits``."""

    def __init__(self, points: np.ndarray, tree: int, trees: int, bits: int, seed: int):
        self.tree, self.bits, self.planes = tree, bits, planes(trees, points.shape[1], seed)[tree]
        hashed = strings(points, self.planes)
        self.order = np.argsort(hashed, kind="stable")
        self.sorted, self.points = hashed[self.order], points[self.order]

    def search(self, queries: np.ndarray, known: np.ndarray, k: int, want: int, trees: int):
        """For each query the vectors that share a prefix and their cosines: the longest prefix that ``want`` share, or, where a k-th best cosine is ``known``, the one by which a nearer vector is met."""
        q = strings(queries, self.planes)
        lengths = np.arange(self.bits, BITS + 1)
        free = np.array([(1 << (BITS - n)) - 1 for n in lengths], np.uint64)
        low, high = np.searchsorted(self.sorted, q[None, :] & ~free[:, None], "left"), np.searchsorted(self.sorted, q[None, :] | free[:, None], "right")
        enough = ((high - low) >= want).sum(axis=0) - 1  # counts fall with the length
        length = np.where(known > -1, np.maximum(self.bits, safe_length(known, trees)), self.bits + np.maximum(enough, 0))
        for i in range(len(queries)):
            a, b = low[length[i] - self.bits, i], high[length[i] - self.bits, i]
            if a < b:
                yield i, self.order[a:b], np.einsum("ij,j->i", self.points[a:b], queries[i]), int(length[i])


def _best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best classes, ties to the smaller one."""
    if len(scores) > k:
        worst = np.partition(scores, -k)[-k]
        ids, scores = ids[scores >= worst], scores[scores >= worst]
    order = np.lexsort([ids, -scores])[:k]
    return ids[order], scores[order]


def _streamed(keys: list[str], build, k: int):
    """Rows sorted by ``keys`` and ``asks``: vectors of a cell or shard first, then its queries. What ``build`` makes of the vectors is made once; queries pass in batches."""

    def run(batches):
        now, rows, index, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("embedding")))
            number, known = batch.column("id").to_numpy(zero_copy_only=False), batch.column("known").to_numpy(zero_copy_only=False)
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "asks")])
            starts = np.flatnonzero(np.append(True, (where[:, 1:] != where[:, :-1]).any(axis=0)))
            out: list[tuple] = []
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                key = tuple(where[:-1, a].tolist())
                if key != now:
                    now, rows, index = key, [], None
                if not where[-1, a]:
                    rows.append((number[a:b], x[a:b]))
                elif rows:
                    if index is None:
                        ids = np.concatenate([r[0] for r in rows])
                        order = np.argsort(ids)
                        ids, index = ids[order], build(key, np.concatenate([r[1] for r in rows])[order])
                    for i, at, scores, used in index(x[a:b], known[a:b]):
                        best, score = _best_of(ids[at], scores, k)
                        out.append((np.full(len(best), number[a + i]), best, score, np.full(len(best), used), np.append(len(at), np.zeros(len(best) - 1, np.int64))))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.float64 if n == 2 else np.int64)) for n, c in enumerate(columns)], ["query_id", "class_id", "score", "used", "met"])

    return run


def _asked(rows: DataFrame, asks: DataFrame, keys: list[str], build, k: int) -> DataFrame:
    """Hits of ``asks`` (keys, id, embedding, known) among ``rows`` (keys, id, embedding) of the same keys."""
    both = rows.withColumn("known", F.lit(-1.0)).withColumn("asks", F.lit(0)).unionByName(asks.withColumn("asks", F.lit(1)))
    return both.select(*keys, "asks", "id", "known", "embedding").repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(_streamed(keys, build, k), _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best classes of each query; what a task has beyond them stays in it."""
    once = hits.groupBy("query_id", "class_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id"))
    return once.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def _kth(best: DataFrame, k: int) -> DataFrame:
    """The k-th best cosine of the queries that have as many hits."""
    return best.groupBy(F.col("query_id").alias("_q")).agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= k).select("_q", "bound")


def _ask_prefixes(distinct: DataFrame, queries: DataFrame, bits: int, k: int, trees: int, dims: int, least: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Hits of each query among the vectors that share its first ``bits`` in some tree, and the queries (query_id, known) whose nearest may lie outside.

    First down to the longest prefixes, then, with the k-th best cosine of all trees, up to where a nearer vector is met.
    """

    def keys(name):
        def run(batches):
            of = planes(trees, dims, seed)
            for batch in batches:
                x = unit(matrix(batch.column("embedding"))) if batch.num_rows else np.zeros((0, dims))
                prefix = [(strings(x, p) >> np.uint64(BITS - bits)).astype(np.int64) for p in of]
                ids = batch.column(name).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(trees), len(x))), pa.array(np.concatenate(prefix)), pa.array(np.tile(ids, trees))], ["tree", "prefix", name])

        return run

    asked = cut(queries.select("query_id", "embedding").mapInArrow(keys("query_id"), "tree long, prefix long, query_id long"), "asked")
    wanted = asked.select("tree", "prefix").distinct()
    held = cut(distinct.select("class_id", "embedding").mapInArrow(keys("class_id"), "tree long, prefix long, class_id long").join(wanted, ["tree", "prefix"], "left_semi"), "held")
    sizes = cut(held.groupBy("tree", "prefix").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("long").alias("blocks")), "sizes")
    spot = ["tree", "prefix", "block"]
    own = held.join(sizes, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    own = own.select(*spot, F.col("class_id").alias("c")).join(distinct.select(F.col("class_id").alias("id"), "embedding"), F.col("c") == F.col("id")).drop("c")
    mine = asked.join(sizes, ["tree", "prefix"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*spot, F.col("query_id").alias("q"))
    want = max(k, least // trees)

    def build(key, points):
        cell = Cell(points, key[0], trees, bits, seed)
        return lambda x, known: cell.search(x, known, k, want, trees)

    ask = lambda who: mine.join(who.select(F.col("query_id").alias("id"), "embedding", "known"), F.col("q") == F.col("id")).drop("q")
    first = cut(_asked(own, ask(queries.withColumn("known", F.lit(-1.0))), spot, build, k), "met")
    bound = _kth(_best(first, k), k)
    reach = first.groupBy(F.col("query_id").alias("_r")).agg(F.max("used").alias("used"))
    known = queries.join(bound, F.col("query_id") == F.col("_q"), "left").join(reach, F.col("query_id") == F.col("_r"), "left").withColumn("known", F.greatest("known", F.coalesce("bound", F.lit(-1.0))))
    known = cut(known.select("query_id", "embedding", "known", F.coalesce("used", F.lit(bits)).alias("used")), "bounds")
    # a prefix of this many bits meets a nearer vector
    safe = F.lit(bits)
    for length in range(bits + 1, BITS + 1):
        safe = F.when(F.col("known") >= safe_cosine(length, trees), F.lit(length)).otherwise(safe)
    # who cannot be done here does not ask the cells again
    again = known.filter((safe < F.col("used")) & (F.col("known") >= safe_cosine(bits, trees)))
    second = cut(_asked(own, ask(again), spot, build, k), "met")
    hits = first.unionByName(second)
    best = _kth(_best(hits, k), k)
    rest = known.join(best, F.col("query_id") == F.col("_q"), "left").withColumn("known", F.greatest("known", F.coalesce("bound", F.lit(-1.0)))).filter(F.col("known") < safe_cosine(bits, trees))
    rest = cut(rest.select("query_id", "embedding", "known"), "left")
    drop(asked, held, sizes, known)
    return hits, rest


def _ask_all(distinct: DataFrame, queries: DataFrame, n: int, k: int, trees: int, least: int, seed: int) -> DataFrame:
    """Hits of each query (query_id, embedding, known) among all; every shard has a forest over its rows, built once, which all queries ask."""
    shards = max(1, -(-n // SHARD_ROWS))
    rows = distinct.select(F.pmod(F.xxhash64("class_id"), F.lit(shards)).alias("shard"), F.col("class_id").alias("id"), "embedding")
    asks = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("query_id").alias("id"), "embedding", "known")

    def build(_, points):
        forest = PrefixForest(points, trees, seed)

        def search(x, known):
            for i, at, scores in forest.search(x, known, k, least):
                if len(at):
                    yield i, at, scores, 0

        return search

    return _asked(rows, asks, ["shard"], build, k)


def _nearest_of_length(good: DataFrame, every: int, k: int, trees: int, least: int, seed: int, effort: bool = False) -> DataFrame:
    # a class's k + 1 smallest ids are enough: one may be the query itself; and so are k + 1 classes
    numbered = good.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    distinct = cut(_smallest_ids(numbered, k + 1), "classes")
    queries = good.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct().withColumn("known", F.lit(-1.0))
    n, dims = distinct.count(), good.select(F.size("embedding")).first()
    dims, found, left = dims[0] if dims else 0, [], queries
    bits = int(np.log2(max(1, n / CELL_ROWS)))
    while 2**bits > trees:
        hits, left = _ask_prefixes(distinct, left, bits, k + 1, trees, dims, least, seed)
        found.append(hits)
        bits -= 4
    if not found or left.limit(1).count():
        found.append(_ask_all(distinct, left, n, k + 1, trees, least, seed))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    best = _best(hits, k + 1).withColumnRenamed("class_id", "hit")
    each = best.join(distinct.select("class_id", "firsts"), F.col("hit") == F.col("class_id")).select("query_id", "score", F.explode("firsts").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if effort:
        out = out.join(hits.groupBy("query_id").agg(F.sum("met").alias("met")), "query_id")
    return out


def _smallest_ids(numbered: DataFrame, k: int) -> DataFrame:
    """class_id, firsts (the k smallest vec_ids of equal vectors), embedding: k at most of each salt, then k of those."""
    inside = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    few = numbered.withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= k)
    grouped = few.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k).alias("firsts"))
    return grouped.select(F.element_at("firsts", 1).alias("class_id"), "firsts", "embedding")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of each query's 5 nearest."""
    return compact(nearest(table(spark, sf_dir, "embeddings")))
