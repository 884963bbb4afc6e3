"""Operator 11: the prefix trie of conversations.

Conversations are arrays of turn digests. They are sorted globally by ranges; within a range one sweep compares each array
with the one before (their longest common prefix) and keeps the open nodes on a stack: what the next array does not share
is closed. What touches a range's ends stays open and is passed on as two paths, those of the first and the last array.
Paths of neighbouring ranges are swept again by the same code, ``STITCH`` ranges at a time, until all are one.

An array holds ``BAND`` turns at most. A longer conversation goes on in another array, sorted under a digest of all turns
before, so rows are bounded however long a conversation is; sums climb from band to band by doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, drop, numbered, running_total, table, word_count
from parley.llm.merkle import crc32_sql

#: Turns of an array, and bytes of a turn's digest.
BAND, WIDTH = 64, 16
#: Arrays of a range, ranges that are stitched in one task, and closed nodes and rows that a sweep holds.
ROWS, STITCH, HELD, SENT = 100_000, 64, 20_000, 2048
#: Ids of a row of ``ids``.
IDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()

#: Rows of a sweep: nodes; tops of later bands; rows that nodes look their parents up in; ids of members that end at an open node; paths.
SCHEMA = (
    "kind string, at long, id binary, parent binary, top binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "chunk long, ids string, first_at long, last_at long, "
    "pid long, band int, seg binary, key binary, words array<long>, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, over array<boolean>, first array<long>, last array<long>"
)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in SCHEMA.split(", "))])


_ARROW = _arrow_schema()


class _Node:
    """A node of the stack, with what its closed part holds so far: rows, their least id, children, leaves and saved words below it."""

    __slots__ = ("depth", "words", "parent", "left", "n", "least", "kids", "leaves", "saved", "over", "ids", "first", "last", "asked", "done")

    def __init__(self, depth: int, words: int, parent: _Node | None, left: bool):
        self.depth, self.words, self.parent, self.left = depth, words, parent, left
        self.n = self.kids = self.leaves = self.saved = 0
        self.least = self.first = self.last = None
        self.over = self.asked = self.done = False
        self.ids: list[int] = []

    def reach(self, least: int | None, first: int | None, last: int | None) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        if first is not None and (self.first is None or first < self.first):
            self.first = first
        if last is not None and (self.last is None or last > self.last):
            self.last = last


def _name(seg: bytes, key: bytes, depth: int) -> bytes:
    """A node's own name: a digest of the turns that lead to it."""
    return hashlib.blake2b(seg + b":" + key[: depth * WIDTH], digest_size=WIDTH).digest()


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two arrays begin with alike."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    return next(d for d in range(most) if a[d * WIDTH : (d + 1) * WIDTH] != b[d * WIDTH : (d + 1) * WIDTH])


class _Sweep:
    """The stack sweep of one range's arrays (``stitched`` false) or of the paths of ranges that follow each other.

    A node is closed when the next array does not share it, and is known then, unless it lies on the range's first array:
    such nodes, and those still open at the end, go out as paths, without what their children on the path hold. ``whole``:
    nothing lies outside. Closed nodes wait for their parents' least id, but no more than ``HELD`` of them: the others, and
    those whose parents stay open, go out with their parent's name, and the parent's own row follows.
    """

    def __init__(self, size: int, number: int, stitched: bool, whole: bool):
        self.size, self.number, self.stitched, self.whole = size, number, stitched, whole
        self.stack: list[_Node] = []
        self.left: list[_Node] = []
        self.band, self.seg, self.key, self.left_at = 0, b"", None, None
        self.held: list[tuple] = []
        self.out: list[dict] = []

    def step(self, band: int, seg: bytes, key: bytes, words: list[int]) -> list[_Node]:
        """The nodes of the next array or path, from the top of its segment down."""
        begins = self.key is None
        shared = _shared(key, self.key) if not begins and band == self.band and seg == self.seg else -1
        self._close_to(shared)
        self.band, self.seg, self.key = band, seg, key
        for d in range(len(self.stack), len(key) // WIDTH + 1):
            self.stack.append(_Node(d, words[d - 1] if d else 0, self.stack[-1] if d else None, begins and not self.whole))
        if begins and not self.whole:
            self.left, self.left_at = list(self.stack), (band, seg, key)
        return self.stack

    def _close_to(self, depth: int) -> None:
        while self.stack and self.stack[-1].depth > depth:
            self._close(self.stack.pop())

    def _close(self, node: _Node) -> None:
        node.done = True
        if node.left:
            return
        leaves, saved = node.leaves + (node.kids == 0), node.saved + (node.n - 1) * node.words
        up = node.parent
        if up is not None:
            up.reach(node.least, node.first, node.last)
            up.n, up.kids, up.leaves, up.saved = up.n + node.n, up.kids + 1, up.leaves + leaves, up.saved + saved
        self.held.append((node, leaves, saved, self.band, self.seg, self.key))
        if node.asked or self.stitched:
            self.out.append({"kind": "lookup", "id": _name(self.seg, self.key, node.depth), "conv_id": node.least, "first_at": node.first, "last_at": node.last})
        if len(self.held) >= HELD:
            self._send()

    def _send(self) -> None:
        """Rows of the nodes held; a parent that is open, or on the first array, is named."""
        for node, leaves, saved, band, seg, key in self.held:
            up = node.parent
            if up is None and band:  # its own row is the last of the band before
                self.out.append({"kind": "top", "band": band, "seg": seg, "n_children": node.kids, "n_leaves": node.leaves, "saved_tokens": node.saved})
                continue
            row = {"kind": "node", "at": node.first, "conv_id": node.least, "depth": band * self.size + node.depth, "n_convs": node.n, "n_children": node.kids, "n_leaves": leaves, "saved_tokens": saved}
            if node.over:
                row["id"] = _name(seg, key, node.depth)
            elif node.ids:
                row["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest()
            if up is not None:
                if up.depth == 0 and band:
                    row["top"] = seg
                elif up.done and not up.left:
                    row["parent_conv_id"] = up.least
                else:
                    row["parent"], up.asked = _name(seg, key, up.depth), True
            self.out.append(row)
        self.held = []

    def _path(self, pid: int, at: tuple, nodes: list[_Node], told: Callable[[_Node], bool]) -> None:
        band, seg, key = at
        for x in nodes:
            if told(x) and x.ids:
                x.over = True
                self.out += [{"kind": "ids", "id": _name(seg, key, x.depth), "at": self.number, "chunk": c, "ids": ",".join(map(str, x.ids[c : c + IDS]))} for c in range(0, len(x.ids), IDS)]
        values = {"n": ("n", 0), "least": ("least", None), "kids": ("kids", 0), "leaves": ("leaves", 0), "saved": ("saved", 0), "over": ("over", False), "first": ("first", None), "last": ("last", None)}
        self.out.append({"kind": "path", "pid": pid, "band": band, "seg": seg, "key": key, "words": [x.words for x in nodes]} | {c: [getattr(x, f) if told(x) else none for x in nodes] for c, (f, none) in values.items()})

    def end(self) -> None:
        if self.whole:
            self._close_to(-1)
        self._send()
        if self.left:
            self._path(2 * self.number, self.left_at, self.left, lambda x: True)
            # a node of both paths is told by the first
            self._path(2 * self.number + 1, (self.band, self.seg, self.key), self.stack, lambda x: not x.left)

    def sent(self, least: int = SENT) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            yield pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in self.out], f.type) for f in _ARROW}, schema=_ARROW)
            self.out = []


def sweep_arrays(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One range of sorted arrays of ``size`` turns at most: pid, band, seg, key, words, conv, goes_on, kids, leaves, saved (of what hangs below the array's last node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            for r in batch.to_pylist():
                sweep = sweep or _Sweep(size, r["pid"], False, False)
                node = sweep.step(r["band"], r["seg"], r["key"], r["words"])[-1]
                node.n += 1
                node.reach(r["conv"], r["pid"], r["pid"])
                if r["goes_on"]:  # the same for all arrays that go on here
                    node.kids, node.leaves, node.saved = r["kids"], r["leaves"], r["saved"]
                else:
                    node.ids.append(r["conv"])
                yield from sweep.sent()
        if sweep:
            for node in {*sweep.stack, *sweep.left}:  # all of this range, also those that only later arrays of a path will close
                node.reach(None, sweep.number, sweep.number)
            sweep.end()
            yield from sweep.sent(1)

    return run


def sweep_paths(size: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paths in order, those of a group together; ``whole`` if there is one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            for r in batch.to_pylist():
                if sweep is None or r["grp"] != sweep.number:
                    if sweep:
                        sweep.end()
                        yield from sweep.sent(1)
                    sweep = _Sweep(size, r["grp"], True, whole)
                for i, node in enumerate(sweep.step(r["band"], r["seg"], r["key"], r["words"][1:])):
                    node.reach(r["least"][i], r["first"][i], r["last"][i])
                    node.n, node.over = node.n + r["n"][i], node.over or r["over"][i]
                    # what hangs below a full array is told by each of its ranges
                    add = max if node.depth == size else int.__add__
                    node.kids, node.leaves, node.saved = add(node.kids, r["kids"][i]), add(node.leaves, r["leaves"][i]), add(node.saved, r["saved"][i])
                yield from sweep.sent()
        if sweep:
            sweep.end()
            yield from sweep.sent(1)

    return run


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids from its rows in order. A hash is a chain, so one task reads a node's ids, row by row; it holds one row."""
    now, digest = None, None
    for batch in batches:
        names, texts = batch.column("id").to_pylist(), batch.column("ids").to_pylist()
        found = []
        for name, ids in zip(names, texts, strict=True):
            if name == now:
                digest.update(b",")
            else:
                if now is not None:
                    found.append((now, digest.hexdigest()))
                now, digest = name, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"_id": pa.array([x[0] for x in found], pa.binary()), "_ends": pa.array([x[1] for x in found], pa.string())})
    if now is not None:
        yield pa.RecordBatch.from_pydict({"_id": pa.array([now], pa.binary()), "_ends": pa.array([digest.hexdigest()], pa.string())})


def _swept(arrays: DataFrame, count: int, size: int, rows: int, stitch: int) -> list[DataFrame]:
    """Rows of all sweeps over the arrays: the ranges', then those of each round of stitching."""
    spark = arrays.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // rows))
    by = ["band", "seg", "key", "conv"]
    dealt = arrays.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("pid", F.spark_partition_id().cast("long"))
    found = [cut(dealt.mapInArrow(sweep_arrays(size), SCHEMA), "trie-ranges")]
    while True:
        paths = found[-1].filter("kind = 'path'")
        most = paths.agg(F.max("pid")).first()[0]
        if most is None:
            return found
        whole = most // 2 < stitch
        grouped = paths.withColumn("grp", F.floor(F.col("pid") / (2 * stitch)))
        dealt = grouped.repartition(max(1, most // (2 * stitch)), "grp").sortWithinPartitions("grp", "pid")
        found.append(cut(dealt.mapInArrow(sweep_paths(size, whole), SCHEMA), "trie-paths"))
        if whole:
            return found


def _rows(found: list[DataFrame], kind: str) -> DataFrame:
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.filter(F.col("kind") == kind)


def _climbed(tops: DataFrame, links: DataFrame) -> DataFrame:
    """Leaves and saved words below each segment, those of all segments below it included, from its own (seg, n_leaves, saved_tokens) and links (seg, up).

    Doubling: in round k a segment has what lies less than 2^k links below it, and knows the one 2^k links above.
    """
    now = cut(tops.join(links.withColumnRenamed("seg", "_s"), F.col("seg") == F.col("_s"), "left").select("seg", "n_leaves", "saved_tokens", "up"), "trie-bands")
    while now.filter("up IS NOT NULL").limit(1).count():
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("_u")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_w"))
        above = now.select(F.col("seg").alias("_s"), F.col("up").alias("_up"))
        met = now.join(below, F.col("seg") == F.col("_u"), "left").join(above, F.col("up") == F.col("_s"), "left")
        step = cut(met.select("seg", (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_w", F.lit(0))).alias("saved_tokens"), F.col("_up").alias("up")), "trie-bands")
        drop(now)
        now = step
    return now.drop("up")


def trie(arrays: DataFrame, band: int = BAND, rows: int = ROWS, stitch: int = STITCH) -> DataFrame:
    """Nodes of the trie over ``arrays``: conv, band, goes_on, key (digests of ``WIDTH`` bytes of ``band`` turns at most, joined) and words (of each turn) of each band of each conversation.

    One row for each node, with the columns of the query. No task holds a node's members: their number, least id and sums
    come from ranges, and only the ids of those that end at one node pass through one task, for a hash is a chain.
    """
    arrays = _segments(arrays, band)
    size = arrays.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band") > 0).alias("later")).first()
    none = [F.lit(1).cast("long").alias("kids"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")]
    bare = arrays.select("conv", "band", "seg", "key", "words", "goes_on", *none)
    if size["later"]:
        # later bands by themselves, then all of them with what hangs below
        later = _swept(bare.filter("band > 0"), size["later"], band, rows, stitch)
        tops = cut(_rows(later, "top").select("band", "seg", "n_children", "n_leaves", "saved_tokens"), "trie-tops")
        drop(*later)
        links = arrays.filter("goes_on AND band > 0").groupBy(F.col("next").alias("seg")).agg(F.min("seg").alias("up"))
        climbed = _climbed(tops.select("seg", "n_leaves", "saved_tokens"), links).join(tops.select(F.col("seg").alias("_t"), F.col("n_children").alias("kids")), F.col("seg") == F.col("_t"))
        below = climbed.select(F.col("seg").alias("_n"), "kids", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        on = arrays.filter("goes_on").join(below, F.col("next") == F.col("_n")).select(*bare.columns)
        bare = bare.filter("NOT goes_on").unionByName(on)
    found = _swept(bare, size["n"], band, rows, stitch)
    nodes = _rows(found, "node")
    open_ = F.col("id").isNotNull() | F.col("parent").isNotNull() | F.col("top").isNotNull()
    lookup = _rows(found, "lookup").select(F.col("id").alias("_p"), F.explode(F.sequence("first_at", "last_at")).alias("_at"), F.col("conv_id").alias("_least"))
    ids = _rows(found, "ids").select("id", "at", "chunk", "ids")
    ends = ids.repartition("id").sortWithinPartitions("id", "at", "chunk").mapInArrow(hash_ids, "_id binary, _ends string")
    firsts = arrays.filter("next IS NOT NULL").groupBy(F.col("next").alias("_t")).agg(F.min("conv").alias("_first"))
    late = nodes.filter(open_).join(lookup, (F.col("parent") == F.col("_p")) & (F.col("at") == F.col("_at")), "left").join(ends, F.col("id") == F.col("_id"), "left").join(firsts, F.col("top") == F.col("_t"), "left")
    late = late.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_least", "_first")).withColumn("ends_sha256", F.coalesce("ends_sha256", "_ends"))
    return nodes.filter(~open_).select(*NODE).unionByName(late.select(*NODE)).fillna({"ends_sha256": EMPTY})


def _segments(arrays: DataFrame, size: int) -> DataFrame:
    """``arrays`` with ``seg``, a digest of all turns before the band (empty for the first), and ``next``, that of the following band (null if the array is not full).

    Sums of digests of (band, array) stand for the sequence before a band; only conversations of more than one band are summed.
    """
    x = F.sha2(F.concat(F.col("band").cast("string"), F.lit(":"), F.hex("key")), 256)
    part = lambda a, n: F.conv(F.substring(x, a, n), 16, 10)
    value = (part(1, 13).cast("decimal(16,0)") * F.lit(1 << 48).cast("decimal(15,0)") + part(14, 12).cast("decimal(15,0)")).cast("decimal(38,0)")
    name = lambda total, band: F.unhex(F.md5(F.concat(band.cast("string"), F.lit(":"), total.cast("string"))))
    full = F.octet_length("key") == size * WIDTH
    valued = arrays.withColumn("_v", value)
    after = lambda before: F.when(full, name(before + F.col("_v"), F.col("band") + 1))
    zero = F.lit(0).cast("decimal(38,0)")
    alone = valued.filter("band = 0").withColumn("seg", F.unhex(F.lit(""))).withColumn("next", after(zero))
    longer = running_total(valued.filter("band > 0 OR goes_on"), ["conv"], "band", "_v", "_sum").filter("band > 0").withColumn("_sum", F.col("_sum").cast("decimal(38,0)"))
    longer = longer.withColumn("seg", name(F.col("_sum"), F.col("band"))).withColumn("next", after(F.col("_sum"))).drop("_sum")
    return cut(alone.unionByName(longer).drop("_v"), "trie-arrays")


def arrays_of(turns: DataFrame, band: int = BAND) -> DataFrame:
    """Arrays of conversations from their turns (conv, place from 0, length, digest as hex, words): conv, band, goes_on, key, words. A conversation with a length of 0 has one row, whose place and digest are null."""
    turn = F.when(F.col("place").isNotNull(), F.struct("place", "digest", "words"))
    grouped = turns.groupBy("conv", F.coalesce(F.floor(F.col("place") / band), F.lit(0)).cast("int").alias("band")).agg(F.array_sort(F.collect_list(turn)).alias("t"), F.max("length").alias("length"))
    return grouped.select("conv", "band", ((F.col("band") + 1) * band < F.col("length")).alias("goes_on"), F.unhex(F.array_join("t.digest", "")).alias("key"), F.col("t.words").alias("words"))


def rebuilt(conversations: DataFrame, base: Callable[[Column], Column], borrowed: Callable[[Column], Column], most: int) -> DataFrame:
    """Turns of conversations that begin as another: the first ``borrowed`` (of at most ``most``) turns of conversation ``base``, then their own after as many.

    ``conversations``: conv_id, turn, role, text; others are ignored, whatever their names. Turns are in ascending order
    (null first; ties by role, then text), null roles and texts are empty, repeated rows are a turn each. Rows without a
    conv_id belong to no conversation and go. A base that is absent lends nothing, a shorter one what it has.
    """
    said = F.concat(F.coalesce("role", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit("")))
    digest = F.substring(F.sha2(F.concat(F.octet_length(F.coalesce("role", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256), 1, 2 * WIDTH)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    laid = numbered(rows, ["conv"], [F.col("turn"), said], "trie-turns", [digest.alias("digest"), word_count(F.col("text")).alias("words")])
    heads = laid.filter(F.col("place") < most).filter(F.col("conv") == base(F.col("conv"))).groupBy(F.col("conv").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("_head"))
    ids = laid.filter("place = 0").select("conv", "total", base(F.col("conv")).alias("base"), borrowed(F.col("conv")).alias("h"))
    lent = F.slice(F.coalesce("_head", F.array().cast("array<struct<place:bigint,digest:string,words:bigint>>")), F.lit(1), F.col("h").cast("int"))
    ids = ids.join(heads, F.col("base") == F.col("_b"), "left").select("conv", "h", lent.alias("lent"), F.greatest(F.col("total") - F.col("h"), F.lit(0)).alias("own"))
    ids = ids.withColumn("length", F.size("lent") + F.col("own"))
    first = ids.select("conv", "length", F.inline_outer("lent")).select("conv", "place", "length", "digest", "words").filter("place IS NOT NULL OR length = 0")
    shift = ids.filter("own > 0").select(F.col("conv").alias("_c"), "h", (F.size("lent") - F.col("h")).alias("_shift"), "length")
    own = laid.join(shift, F.col("conv") == F.col("_c")).filter("place >= h").select("conv", (F.col("place") + F.col("_shift")).alias("place"), "length", "digest", "words")
    return first.unionByName(own)


def op11_conversation_trie(spark: SparkSession, sf_dir: str, **sizes: int) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the rebuilt conversations.

    No conversations give no nodes. Texts of any length are digests from the first sort on.
    """
    turns = rebuilt(table(spark, sf_dir, "conversations"), lambda c: c - c % 20, lambda c: F.crc32(c.cast("string")) % 4, 3)
    return trie(arrays_of(turns, sizes.get("band", BAND)), **sizes)


ORACLE_SQL = rf"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 20 AS b, {crc32_sql("c")} % 4 AS h FROM o GROUP BY c),
r AS (SELECT c.c, 0 AS own, o.p, o.role, o.text FROM c JOIN o ON o.c = c.b AND o.p < c.h UNION ALL SELECT c.c, 1, o.p, o.role, o.text FROM c JOIN o ON o.c = c.c AND o.p >= c.h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, sha256(strlen(role) || ':' || role || text) AS x FROM r),
m AS (SELECT c, d, words, array_to_string(list(x) OVER (PARTITION BY c ORDER BY d), '') AS path FROM t UNION ALL SELECT c, 0, 0, '' FROM c),
n AS (SELECT d AS depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY d, path),
w AS (SELECT depth, n.path, n.conv_id, n_convs, n.words, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND left(k.path, strlen(n.path)) = n.path) AS n_children
      FROM n LEFT JOIN (SELECT depth AS pd, path AS pp, conv_id FROM n) p ON pd = depth - 1 AND pp = left(n.path, strlen(n.path) - 64)),
s AS (SELECT m.d, m.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens FROM w u JOIN m ON m.c = u.conv_id AND m.d <= u.depth GROUP BY ALL),
e AS (SELECT m.d, m.path, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids FROM m JOIN (SELECT c, max(d) AS d FROM m GROUP BY c) z ON z.c = m.c AND z.d = m.d GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s ON s.d = depth AND s.path = w.path LEFT JOIN e ON e.d = depth AND e.path = w.path"""
