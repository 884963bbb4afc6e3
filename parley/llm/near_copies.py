"""Near copies at a similarity that 4 of 64 bits cannot tell, for operator 8: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash finds the candidates as in ``simhash``: fingerprints, a grid over the bit counts of two-bit segments, the Manhattan
bound of all segments, then the exact distance. At a similarity of 0.8 two fingerprints differ in about 15 % of their bits, so there are four
of 64 bits, each cell looks at a drawn choice of one's segments, and bound and distance run over that one and the next. Cells are
no longer lossless: a pair at 0.8 shares one with a probability of about 0.999 (MinHash bands: 0.99995), a closer one with more. The more documents, the more
segments a cell looks at and the more cells there are. Sets of few shingles, whose bits are ruled by ties, are also dealt by their first
shingles in order of hash, of which a pair at 0.8 shares one for certain. Candidates are settled by their two whole sets.

Equal sets are one class from the start, so copies never meet. What is near within a cell is a group, which leaves its task as its
smallest class with each other one. The classes found are then settled by whole sets: of a set in order of how many of these classes
hold a shingle, two at 0.8 share one of the first fifth, for certain, while a passage that many documents share comes last. Classes
that share none go. A star is first: each class is compared with its groups' smallest. Of what holds such a shingle and is still of
several components, each pair is compared at the first shingle it shares, in a task's memory; only links leave a task, never pairs.
Large stars are salted, classes of one shingle parted into blocks, and a shingle's largest component never meets itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import components, cut, drop, give_back, sliced
from parley.llm.simhash import LOWER, segment_counts
from parley.llm.substring import Words, _mix, _powers

#: Words of a shingle; fingerprints of 64 bits; bits of two of them that near copies differ in at most.
WIDTH, WORDS, DISTANCE = 5, 4, 36
#: Segments that a cell looks at, and classes up to which they are enough: 8/3 as many ask for one more, as two in 8/3 have equal counts.
LEAST_SEGMENTS, ENOUGH = 7, 1 << 18
#: Share of segments with equal counts at a similarity of 0.8, and how seldom such a pair may share no cell.
EQUAL, MISS = 0.73, 0.00001
#: Shingles of a set up to which no pair at 0.8 with it is missed.
FEW = 16
#: Least similarity of near copies, as a fraction.
SHARE = (4, 5)
#: Classes of a salt of a star, and of a block of those that hold one shingle.
STAR, BLOCK = 512, 512
#: Rows of a cell that are compared with all of it at a time; shingles whose bits are counted at a time, and bytes of texts.
SLAB = 256
CHUNK, STEP = 1 << 12, 1 << 20
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of whole texts, A-Z lower-cased. Fewer words than ``width`` are one shingle; no words give none."""
    raw = [(t or b"").translate(LOWER) for t in texts]
    words = Words(b" ".join(raw))
    codes = words.codes()
    ends = np.cumsum([len(t) + 1 for t in raw])
    edge = np.searchsorted(words.starts, np.r_[0, ends]).tolist()
    grams, out = _mix(_powers(codes, width) * _FOLD), []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:  # the number of words is part of a short text's one shingle
            out.append(_mix(_powers(codes[a:b], b - a) * _FOLD + np.uint64(b - a)) if b > a else codes[:0])
    return out


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return shingle_sets([text.encode("utf-8", "surrogatepass") if text else None], width)[0]


def fingerprints_of(shingles: np.ndarray) -> np.ndarray:
    """The SimHashes of a set, ``WORDS`` of 64 bits; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    counts = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(shingles), CHUNK):
        hashes = _mix(shingles[a : a + CHUNK, None] * _FACTORS)
        counts += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)


def prefix_of(shingles: np.ndarray) -> np.ndarray:
    """The first shingles of a set, as numbers, so many that a near copy shares one; none of a set too large to be near one of ``FEW``."""
    n = len(shingles)
    return shingles[: n + 1 + -SHARE[0] * n // SHARE[1] if n and SHARE[0] * n <= SHARE[1] * FEW else 0].view(np.int64)


def cell_masks(n: int) -> np.ndarray:
    """The bits of the counts that each kind of cell looks at, for ``n`` classes; kind k is of fingerprint k modulo ``WORDS``."""
    segments = LEAST_SEGMENTS
    while n > ENOUGH * (8 / 3) ** (segments - LEAST_SEGMENTS) and segments < 32:
        segments += 1
    kinds = int(np.ceil(np.log(MISS) / np.log1p(-(EQUAL**segments))))
    draw = np.random.default_rng(17)
    return np.array([sum(3 << (2 * int(i)) for i in draw.choice(32, segments, replace=False)) for _ in range(kinds)], np.uint64)


def _spread(masks: np.ndarray):
    """Classes with their fingerprints -> a row for each kind of cell, with the cell's fingerprint and the next. A shingle's cell has none: all in it are candidates."""
    kind = np.arange(len(masks))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column("fps").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
                key = (segment_counts(fps)[:, kind % WORDS] & masks) + kind.astype(np.uint64) * _FOLD
                key = _mix(key * _FOLD).view(np.int64)
                first, second = fps[:, kind % WORDS].view(np.int64), fps[:, (kind + 1) % WORDS].view(np.int64)
                mine = np.repeat(part.column("class").to_numpy(), len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (key, first, second, mine)], ["cell", "fp", "fp2", "class"])
                listed = part.column("prefix")
                keys = listed.flatten().to_numpy()
                owner = np.repeat(part.column("class").to_numpy(), listed.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, np.zeros_like(keys), np.zeros_like(keys), owner)], ["cell", "fp", "fp2", "class"])

    return run


def near_in_cell(fps: np.ndarray) -> np.ndarray:
    """Number of its group (that of its first row) for each row of a cell's fingerprints: what links at ``DISTANCE`` or fewer bits, directly or by others."""
    low, counts = np.uint64(0x5555555555555555), segment_counts(fps)

    def links(rows, among):
        """Which rows are near which: the Manhattan bound of the segments first, then the distance."""
        apart = np.zeros((len(rows), len(among)), np.uint16)
        for w in range(fps.shape[1]):
            differ = counts[rows, w][:, None] ^ counts[among, w]
            high = (differ >> np.uint64(1)) & low
            apart += np.bitwise_count(high)
            apart += np.bitwise_count(high ^ (differ & low))
        i, j = np.nonzero(apart <= DISTANCE)
        exact = np.bitwise_count(fps[rows[i]] ^ fps[among[j]]).sum(axis=1, dtype=np.int64) <= DISTANCE
        return i[exact], j[exact]

    if (fps == fps[0]).all():
        return np.zeros(len(fps), np.int64)
    every = np.arange(len(fps))
    met = np.zeros(len(fps), bool)
    for at in range(0, len(fps), SLAB):
        i, j = links(every[at : at + SLAB], every[at:])
        met[at + i[i != j]] = met[at + j[i != j]] = True
    group, left = every.copy(), np.flatnonzero(met)
    while len(left):
        root, queue, left = left[0], left[:1], left[1:]
        while len(queue) and len(left):
            hit = np.zeros(len(left), bool)
            hit[links(queue[:SLAB], left)[1]] = True
            group[left[hit]] = root
            queue, left = np.concatenate([queue[SLAB:], left[hit]]), left[~hit]
    return group


def _grouped(batches):
    """Rows sorted by cell -> the first class of its group and class, of all that is near another of its cell; a cell that goes on in the next batch waits for its end."""
    names, rest = ("cell", "fp", "fp2", "class"), None

    def emit(rows):
        edges = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
        out_g, out_c = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                group = near_in_cell(np.ascontiguousarray(rows[a:b, 1:3]).view(np.uint64))
                size = np.bincount(group, minlength=b - a)[group]
                at = np.flatnonzero(size > 1)
                if len(at):
                    first = rows[a:b, 3].copy()
                    np.minimum.at(first, group, rows[a:b, 3])
                    out_g.append(first[group[at]])
                    out_c.append(rows[a + at, 3])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (out_g, out_c)], ["centre", "class"])

    for batch in batches:
        got = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        got = got if rest is None else np.concatenate([rest, got])
        last = np.flatnonzero(got[:, 0] != got[-1, 0]) if len(got) else ()
        split = last[-1] + 1 if len(last) else 0
        rest = got[split:]
        if split:
            yield emit(got[:split])
    if rest is not None and len(rest):
        yield emit(rest)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have the similarity of near copies; two empty ones do."""
    small, large = sorted((len(x), len(y)))
    if SHARE[1] * small < SHARE[0] * large:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return SHARE[1] * common >= SHARE[0] * (len(x) + len(y) - common)


def _sets(batch, column: str, width: int) -> list[np.ndarray]:
    return shingle_sets(batch.column(column).cast(pa.binary()).to_pylist(), width)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _mark(width: int):
    def run(batches):
        for batch in sliced(batches, STEP):
            sets = _sets(batch, "text", width)
            class_of = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            fps = [fingerprints_of(s) for s in sets]
            fps, firsts = _lists(fps), _lists([prefix_of(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(class_of), pa.array([len(s) for s in sets], pa.int64()), fps, firsts], ["doc_id", "key", "class", "size", "fps", "prefix"])
        give_back()

    return run


def _stars(width: int):
    """Rows sorted by star, its centre first -> links of the centre with what is similar."""

    def run(batches):
        now, centre = None, None
        for batch in sliced(batches, STEP):
            a, b = [], []
            rows = zip(batch.column("centre").to_pylist(), batch.column("class").to_pylist(), _sets(batch, "text", width), strict=True)
            for star, member, own in rows:
                if member == star:
                    now, centre = star, own
                elif star == now and similar(own, centre):
                    a.append(member)
                    b.append(star)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _shingled(width: int):
    """Classes with their texts -> a row for each of their shingles, with their number."""

    def run(batches):
        for batch in sliced(batches, STEP):
            sets = _sets(batch, "text", width)
            sizes = np.array([len(x) for x in sets], np.int64)
            columns = [np.repeat(batch.column("class").to_numpy(), sizes), np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["class", "size", "shingle"])

    return run


def _met(width: int):
    """Rows sorted by shingle and part -> links that join what is similar and was apart; a shingle's part is in memory.

    ``place`` is the shingle's in the order of its class, ``earlier`` the shingles before it by which the class meets others.
    """

    def run(batches):
        now, held = None, []
        for batch in sliced(batches, STEP):
            names = ("shingle", "part", "class", "component", "block", "place", "earlier")
            for shingle, part, *row, earlier, own in zip(*[batch.column(c).to_pylist() for c in names], _sets(batch, "text", width), strict=True):
                if (shingle, part) != now and held:
                    yield settle(held)
                    held = []
                now = (shingle, part)
                held.append((*row, frozenset(earlier), own))
        if held:
            yield settle(held)

    def settle(held):
        held.sort(key=lambda x: len(x[5]))
        size = np.array([len(x[5]) for x in held])
        member, component, block, place = (np.array(x) for x in list(zip(*held, strict=True))[:4])
        ahead = size - place  # what two sets can have in common from a shingle on that is their first
        a, b, across = [], [], len(set(block.tolist())) > 1
        for i, (*_, earlier, own) in enumerate(held):
            end = np.searchsorted(SHARE[0] * size, SHARE[1] * size[i], "right")  # all further ones are larger still
            j = np.arange(i + 1, end)
            j = j[(component[j] != component[i]) & (sum(SHARE) * np.minimum(ahead[i], ahead[j]) >= SHARE[0] * (size[i] + size[j]))]
            if across:
                j = j[block[j] != block[i]]  # the others are another part's pairs
            for k in j.tolist():
                if component[k] != component[i] and earlier.isdisjoint(held[k][4]) and similar(own, held[k][5]):
                    component[component == component[k]] = component[i]
                    a.append(member[i])
                    b.append(member[k])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _rarest(classes: DataFrame, width: int) -> DataFrame:
    """Classes with their texts -> class, size, key and place for the shingles by which a class can meet one like it: those of its rarest that another holds.

    Shingles are ordered by how many of the classes hold them, then by hash. A key is that pair, its place counts from 0.
    """
    shingled = cut(classes.mapInArrow(_shingled(width), "class long, size long, shingle long"), "shingles")
    often = shingled.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").withColumnRenamed("shingle", "of")
    listed = shingled.join(often, F.col("shingle") == F.col("of")).groupBy("class", "size").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("listed"))
    # those that no other class holds come first
    listed = listed.withColumn("alone", F.col("size") - F.size("listed"))
    most = F.expr(f"cast(greatest(size + 1 - ({SHARE[0]} * size + {SHARE[1] - 1}) div {SHARE[1]} - alone, 0) as int)")
    rows = listed.select("class", "size", "alone", F.posexplode(F.slice("listed", F.lit(1), most)).alias("at", "key"))
    out = cut(rows.select("class", "size", "key", (F.col("alone") + F.col("at")).alias("place")), "rarest")
    drop(shingled)
    return out


def _parted(rows: DataFrame) -> DataFrame:
    """class, component, key and place -> the rows whose key several components hold, by shingle, part and block; a row goes to each part that one of its pairs is of."""
    same = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("first"), F.bit_xor(F.xxhash64("class")).alias("mark"))
    apart = same.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.min("first").alias("first"), F.bit_xor("mark").alias("mark"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    # keys of the same classes are one, the first
    apart = apart.groupBy("n", "main", "first", "mark").agg(F.min("key").alias("apart"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    apart = apart.select("apart", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("small"), blocks(F.col("main.n")).alias("large"))
    before = Window.partitionBy("class").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rest = rows.join(apart, F.col("key") == F.col("apart")).withColumn("earlier", F.collect_list("key.shingle").over(before))
    # the largest component has blocks of its own, which meet the others' only
    large, number, every = F.col("component") == F.col("main"), F.xxhash64("class"), F.col("small") + F.col("large")
    rest = rest.withColumn("block", F.when(large, F.col("small") + F.pmod(number, F.col("large"))).otherwise(F.pmod(number, F.col("small"))).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.when(large, F.col("small")).otherwise(every) - 1), lambda j: F.least("block", j).cast("long") * every + F.greatest("block", j))
    return rest.select(F.col("key.shingle").alias("shingle"), F.explode(others).alias("part"), "class", "component", "block", "place", "earlier")


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts, F.col("class") == F.col("named")).drop("named")


def near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable by links) of every document of ``docs`` (doc_id, text).

    Null and empty texts have the empty set and are copies of each other. Repeated rows stay and get equal results. A null
    doc_id is never a group's smallest unless all are null. No rows give none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    marked = cut(keyed.mapInArrow(_mark(width), f"doc_id {kind}, key long, class long, size long, fps array<long>, prefix array<long>"), "sets")
    classes = cut(marked.groupBy("class").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.min("size").alias("size"), F.min("fps").alias("fps"), F.min("prefix").alias("prefix")), "classes")
    dealt = classes.filter("size > 0").select("class", "fps", "prefix").mapInArrow(_spread(cell_masks(classes.count())), "cell long, fp long, fp2 long, class long")
    groups = cut(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_grouped, "centre long, class long").distinct(), "groups")
    needed = groups.select("class").distinct().join(classes.select(F.col("class").alias("named"), "key"), F.col("class") == F.col("named")).select("named", F.col("key").alias("needed"))
    texts = keyed.select("key", "text").join(needed, F.col("key") == F.col("needed")).groupBy("named").agg(F.min("text").alias("text"))
    texts = cut(texts, "texts")

    rare = _rarest(texts.withColumnRenamed("named", "class"), width)
    live = rare.select("class", "size").distinct()
    stars = groups.filter("class <> centre").join(live, "class").join(live.select(F.col("class").alias("of"), F.col("size").alias("most")), F.col("centre") == F.col("of"))
    stars = cut(stars.filter(SHARE[1] * F.least("size", "most") >= SHARE[0] * F.greatest("size", "most")).select("centre", "class"), "stars")
    sizes = stars.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts")).withColumnRenamed("centre", "of")
    rays = stars.join(sizes, F.col("centre") == F.col("of")).select("centre", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int").alias("salt"), "class")
    centres = sizes.select(F.col("of").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("of").alias("class"))
    rows = _with_texts(rays.union(centres), texts).repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("class") != F.col("centre"))
    links = cut(rows.select("centre", "class", "text").mapInArrow(_stars(width), "a long, b long"), "near")
    drop(stars)
    reach = components(links)

    joined = rare.join(reach, F.col("class") == F.col("node"), "left").select("class", "key", "place", F.coalesce("component", "class").alias("component"))
    rest = cut(_parted(joined), "rest")
    if rest.head(1):
        rows = _with_texts(rest, texts).repartition("shingle", "part").sortWithinPartitions("shingle", "part")
        more = cut(rows.mapInArrow(_met(width), "a long, b long"), "near")
        reach = components(links.union(more))
    named = cut(classes.join(reach, F.col("class") == F.col("node"), "left").select(F.col("class").alias("named"), F.coalesce("component", "class").alias("component"), "least"), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = cut(named.drop("least").join(least, "component").select("named", "component_id"), "final")
    drop(classes, groups, texts, links, rare, rest, named)
    return marked.select("doc_id", "class").join(final, F.col("class") == F.col("named")).select("doc_id", "component_id")
