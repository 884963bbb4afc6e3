"""Operator 5: substring dedup by super-k-mer partitioning.

A window is 13 consecutive words. Its minimiser is the smallest hash among its four-word runs. Consecutive windows with one
minimiser travel as one packed string to the minimiser's bin, so a word is sent about three times instead of thirteen. In
a bin the windows are sorted and equal ones counted, word by word, never by hash alone. Bins are as many as the windows
ask for, so a bin holds about the same at every size.

A pass before that counts windows by slots of the minimisers' hashes; slots grow with the input too. Those few slots that
hold more than a share of a partition, or than a task can hold, have minimisers of very common passages. Their windows
travel one by one, are pre-aggregated by the window itself on the map side, and come back by an equi-join that adaptive
execution splits. So neither a passage in a third of all documents nor a line in very many contexts meets in one task.

Words are read as numbers from the bytes of many texts at once: words of up to seven bytes as themselves, longer ones as a
hash that each bin checks against the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import compact, cut, drop, give_back, planned_bytes, sliced, table

WINDOW, RUN = 13, 4
#: Bytes worked on at a time, words of a piece of a longer text, packed bytes kept before they are sent, windows a bin should have.
STEP, PIECE_WORDS, FLUSH_BYTES, BIN_WINDOWS = 1 << 20, 1 << 16, 12 << 20, 200_000
#: Bytes of the input for a slot of the count, and the fewest slots.
SLOT_BYTES, LEAST_SLOTS = 1 << 13, 1 << 16
#: A slot is crowded beyond this part of a partition's mean, or beyond this number of windows.
CROWDED_PART, CROWDED_MOST = 0.2, 1 << 20
#: Bytes of a word beyond which its hash is xxHash's.
LONG_WORD = 1 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BLANK = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of ``width`` numbers from each place on."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out *= _MULT
        out += h[k : k + n]
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` numbers from each place on, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Words:
    """The words of a string of bytes: where they start and end, and a number for each that equals where the words do."""

    def __init__(self, raw: bytes):
        self.raw = raw.translate(_BLANK)
        inside = np.frombuffer(self.raw, np.uint8) != 32
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[::2], edge[1::2]

    def _blocks(self) -> np.ndarray:
        padded = self.raw + bytes(8)
        return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))

    def codes(self) -> np.ndarray:
        starts, length = self.starts, self.ends - self.starts
        blocks = self._blocks()
        code = (blocks[starts] & _MASKS[np.minimum(length, 8)]) | (np.minimum(length, 7).astype(np.uint64) << np.uint64(56))
        code <<= np.uint64(1)
        long = np.flatnonzero(length > 7)
        if len(long):
            at, left, h = starts[long], length[long], length[long].astype(np.uint64)
            todo = np.arange(len(long))
            while len(todo):
                h[todo] = _mix((h[todo] ^ (blocks[at[todo]] & _MASKS[np.minimum(left[todo], 8)])) * _MULT)
                at[todo] += 8
                left[todo] -= 8
                todo = todo[(left[todo] > 0) & (length[long[todo]] <= LONG_WORD)]
            for i in np.flatnonzero(length[long] > LONG_WORD).tolist():
                h[i] = xxhash.xxh64_intdigest(self.raw[starts[long[i]] : self.ends[long[i]]])
            code[long] = h << np.uint64(1) | np.uint64(1)
        return _mix(code * _MULT)

    def clash(self, code: np.ndarray) -> bool:
        """Whether two different words have one number. Words of up to seven bytes never do."""
        length = self.ends - self.starts
        long = np.flatnonzero(length > 7)
        if not len(long):
            return False
        _, first, which = np.unique(code[long], return_index=True, return_inverse=True)
        alike = long[first][which]
        if (length[alike] != length[long]).any():
            return True
        blocks = self._blocks()
        a, b, left = self.starts[long], self.starts[alike], length[long]
        other = a != b
        a, b, left = a[other], b[other], left[other]
        while len(a):
            if ((blocks[a] ^ blocks[b]) & _MASKS[np.minimum(left, 8)]).any():
                return True
            more = left > 8
            a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
        return False

    def numbers(self) -> np.ndarray:
        """A number for each word by the bytes themselves, for strings of words whose codes clash."""
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(self.raw[a:b], len(known)) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)), np.uint64, len(self.starts))

    def string(self, first: int, end: int) -> bytes:
        return self.raw[self.starts[first] : self.ends[end - 1]]


class Runs:
    """Super-k-mers of some texts: owner (place of the text), first word, number of windows, and the minimiser's hash of each run."""

    def __init__(self, texts: list[bytes], window: int, run: int):
        self.words = Words(b" ".join(texts))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        doc = np.searchsorted(ends, self.words.starts, "right")
        self.begin = np.searchsorted(doc, np.arange(len(texts)))  # first word of each text
        n = len(doc) - window + 1
        if n < 1:
            self.owner, self.first, self.count, self.hash = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
            return
        least = _least(_mix(_powers(self.words.codes(), run)), window - run + 1)
        valid = doc[:n] == doc[window - 1 :]
        starts = valid.copy()
        starts[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        stops = valid & np.r_[starts[1:] | ~valid[1:], True]
        self.first = np.flatnonzero(starts)
        self.count, self.owner = np.flatnonzero(stops) - self.first + 1, doc[self.first]
        # the smallest of several hashes is itself small: mix it again to spread over bins and slots
        self.hash = _mix(least[self.first] * _MULT)


def _texts(batches, window: int):
    """(ids, keys, texts as bytes, word each starts with) of rows with an id, about ``STEP`` bytes at a time. Longer texts come in pieces that overlap by a window less a word."""
    ids, keys, texts, size = [], [], [], 0
    for batch in sliced(batches, STEP):
        for i, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if i is None or not text:
                continue
            if len(text) > 2 * STEP:
                whole = Words(text)
                for a in range(0, max(1, len(whole.starts) - window + 1), PIECE_WORDS):
                    if len(whole.starts):
                        yield [i], [key], [whole.string(a, min(a + PIECE_WORDS + window - 1, len(whole.starts)))], a
                continue
            ids.append(i)
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= STEP:
                yield ids, keys, texts, 0
                ids, keys, texts, size = [], [], [], 0
    if ids:
        yield ids, keys, texts, 0


def slot_counts(docs: DataFrame, bits: int, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(slot, windows) over all texts, slots being the first ``bits`` of the minimisers' hashes; tasks send sums, in bounded memory."""

    def count(batches):
        slots, found = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        kept, size = [], 0

        def settle():
            every, n = np.concatenate([slots, *[x for x, _ in kept]]), np.concatenate([found, *[x for _, x in kept]])
            named, where = np.unique(every, return_inverse=True)
            return named, np.bincount(where, n, len(named)).astype(np.int64)

        for _, _, texts, _ in _texts(batches, window):
            runs = Runs(texts, window, run)
            kept.append((runs.hash >> np.uint64(64 - bits), runs.count))
            size += len(runs.count)
            if size > 1 << 20:
                slots, found = settle()
                kept, size = [], 0
                if len(slots) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(found)], ["slot", "windows"])
                    slots, found = slots[:0], found[:0]
        slots, found = settle()
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.uint64).view(np.int64)), pa.array(found)], ["slot", "windows"])

    return docs.mapInArrow(count, "slot long, windows long").groupBy("slot").agg(F.sum("windows").alias("windows"))


def _is_crowded(hashes: np.ndarray, crowded: np.ndarray, bits: int) -> np.ndarray:
    if not len(crowded):
        return np.zeros(len(hashes), bool)
    slots = hashes >> np.uint64(64 - bits)
    return crowded[np.minimum(np.searchsorted(crowded, slots), len(crowded) - 1)] == slots


def _pack(crowded: np.ndarray, bits: int, bins: int, window: int, run: int):
    """Documents -> (bin, packed super-k-mers of the bin), crowded slots left out."""

    def send(batches):
        pack, kept, size = zstandard.ZstdCompressor(6), [], 0

        def flush():
            meta = np.concatenate([m for m, _ in kept])
            strings = [s for _, x in kept for s in x]
            order = np.argsort(meta[:, 0], kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(meta[order, 0]) != 0, True])
            out_bin, blobs = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                at = order[a:b]
                body = b" ".join([strings[i] for i in at.tolist()])
                blobs.append(pack.compress(np.int64(len(at)).tobytes() + np.ascontiguousarray(meta[at, 1:].T).tobytes() + body))
                out_bin.append(int(meta[at[0], 0]))
            return pa.RecordBatch.from_arrays([pa.array(out_bin, pa.int64()), pa.array(blobs, pa.binary())], ["bin", "packed"])

        for ids, keys, texts, base in _texts(batches, window):
            runs = Runs(texts, window, run)
            cold = np.flatnonzero(~_is_crowded(runs.hash, crowded, bits))
            if len(cold):
                owner, first, n = runs.owner[cold], runs.first[cold], runs.count[cold]
                into = ((runs.hash[cold] >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
                # the windows' number and the run's place in its document share a number
                meta = np.stack([into, np.array(ids, np.int64)[owner], np.array(keys, np.int64)[owner], (first - runs.begin[owner] + base) << 32 | n], axis=1)
                raw = runs.words.raw
                strings = [raw[a:b] for a, b in zip(runs.words.starts[first].tolist(), runs.words.ends[first + n + window - 2].tolist(), strict=True)]
                kept.append((meta, strings))
                size += sum(map(len, strings))
                if size >= FLUSH_BYTES:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()
        kept.clear()
        give_back()

    return send


def repeats(words: Words, windows: np.ndarray, docs: np.ndarray, places: np.ndarray, window: int):
    """Spans (run, first word, end) of windows that also start in a smaller document, from the runs of one bin, whose words come one run after another."""
    codes = words.codes()
    lengths = windows + window - 1
    run = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(lengths) - lengths, windows) + inner
    keys = _mix(_powers(codes, window))[at]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return (np.zeros(0, np.int64),) * 3
    if words.clash(codes):
        codes = words.numbers()
    left, right = at[order[same]], at[order[same + 1]]
    equal = np.ones(len(same), bool)
    for k in range(window):
        equal &= codes[left + k] == codes[right + k]
    if not equal.all():  # two windows with one hash: sort the words themselves
        order = np.lexsort([codes[at + k] for k in range(window - 1, -1, -1)])
        equal = np.ones(len(order) - 1, bool)
        for k in range(window):
            equal &= codes[at[order[1:]] + k] == codes[at[order[:-1]] + k]
        same = np.flatnonzero(equal)
    new = np.ones(len(order), bool)
    new[same + 1] = False
    group = np.flatnonzero(new)
    owner = docs[run[order]]
    least = np.repeat(np.minimum.reduceat(owner, group), np.diff(np.r_[group, len(order)]))
    later = np.zeros(len(order), bool)
    later[order[owner > least]] = True
    # runs of flagged windows become one span
    start = later & np.r_[True, ~later[:-1] | (run[1:] != run[:-1])]
    stop = later & np.r_[~later[1:] | (run[1:] != run[:-1]), True]
    a, b = np.flatnonzero(start), np.flatnonzero(stop)
    return run[a], places[run[a]] + inner[a], places[run[b]] + inner[b] + window


def _count_bins(window: int):
    """Partitions sorted by bin -> spans; one bin at a time is in memory."""

    def run(batches):
        unpack, now, blobs = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != now and blobs:
                    yield close(blobs, unpack)
                    blobs = []
                now = b
                blobs.append(blob.as_py())
        if blobs:
            yield close(blobs, unpack)
        give_back()

    def close(blobs, unpack):
        meta, text = [], []
        while blobs:
            x = unpack.decompress(blobs.pop())
            n = int(np.frombuffer(x, np.int64, 1)[0])
            meta.append(np.frombuffer(x, np.int64, 3 * n, 8).reshape(3, n))
            text.append(x[8 + 24 * n :])
        docs, key, place = np.concatenate(meta, axis=1)
        row, a, b = repeats(Words(b" ".join(text)), place & 0xFFFFFFFF, docs, place >> 32, window)
        return pa.RecordBatch.from_arrays([pa.array(docs[row]), pa.array(key[row]), pa.array(a << 32 | b)], ["span_id", "span_key", "span"])

    return run


def _crowded_windows(crowded: np.ndarray, bits: int, window: int, run: int):
    """Documents -> the windows of crowded slots, one by one, their words joined by one space."""

    def send(batches):
        for ids, keys, texts, base in _texts(batches, window):
            runs = Runs(texts, window, run)
            hot = np.flatnonzero(_is_crowded(runs.hash, crowded, bits))
            if len(hot):
                owner, first, n = runs.owner[hot], runs.first[hot], runs.count[hot]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, owner = np.repeat(first, n) + inner, np.repeat(owner, n)
                raw, a, b = runs.words.raw, runs.words.starts[at], runs.words.ends[at + window - 1]
                letters = np.r_[0, np.cumsum(runs.words.ends - runs.words.starts)]
                tidy = b - a == letters[at + window] - letters[at] + window - 1
                strings = [raw[x:y] if t else b" ".join(raw[x:y].split()) for x, y, t in zip(a.tolist(), b.tolist(), tidy.tolist(), strict=True)]
                arrays = [pa.array(strings, pa.binary()), pa.array(np.array(ids, np.int64)[owner]), pa.array(np.array(keys, np.int64)[owner]), pa.array(at - runs.begin[owner] + base)]
                yield pa.RecordBatch.from_arrays(arrays, ["words", "span_id", "span_key", "place"])

    return send


def slot_bits(docs: DataFrame) -> int:
    """Slots grow with the bytes that the planner expects of the input; a rough number is enough."""
    return max(LEAST_SLOTS.bit_length() - 1, min(40, (planned_bytes(docs) // SLOT_BYTES).bit_length()))


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(span_id, span_key, spans): per id and text the word spans, first << 32 | end, that windows of smaller documents cover. ``docs`` holds doc_id, key, text.

    The list of crowded slots that tasks get has at most ``partitions / CROWDED_PART`` entries, or one of eight bytes for each ``CROWDED_MOST`` windows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = slot_bits(docs)
    counts = cut(slot_counts(docs, bits, window, run), "slots")
    total = counts.agg(F.sum("windows")).first()[0] or 0
    most = max(256, min(CROWDED_MOST, int(CROWDED_PART * total / parts)))
    crowded = np.array(sorted(r["slot"] for r in counts.filter(F.col("windows") > most).select("slot").collect()), np.uint64)
    bins = max(1, 8 * parts, total // BIN_WINDOWS)
    packed = docs.mapInArrow(_pack(crowded, bits, bins, window, run), "bin long, packed binary")
    found = packed.repartition("bin").sortWithinPartitions("bin").mapInArrow(_count_bins(window), "span_id long, span_key long, span long")
    if len(crowded):
        rows = cut(docs.mapInArrow(_crowded_windows(crowded, bits, window, run), "words binary, span_id long, span_key long, place long"), "windows")
        # written first, so that the join has exchanges of its own, which adaptive execution may split
        firsts = cut(rows.groupBy("words").agg(F.min("span_id").alias("least"), F.max("span_id").alias("last")).filter("least < last").select(F.col("words").alias("first_words"), "least"), "firsts")
        later = rows.join(firsts, F.col("words") == F.col("first_words")).filter("span_id > least")
        found = found.union(later.select("span_id", "span_key", (F.shiftleft("place", 32) + F.col("place") + window).alias("span")))
    spans = cut(found, "spans")
    drop(counts, *(rows, firsts) if len(crowded) else ())
    # rows that repeat send the same spans
    return spans.groupBy("span_id", "span_key").agg(F.collect_set("span").alias("spans"))


def _kept(text: str | None, spans) -> tuple[list[bytes], int]:
    found = text.encode("utf-8", "surrogatepass").split() if text else []
    if spans is None or not len(found):
        return found, len(found)
    spans = np.asarray(spans, np.int64)
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, np.minimum(spans >> 32, len(found)), 1)
    np.add.at(edge, np.minimum(spans & 0xFFFFFFFF, len(found)), -1)
    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [found[i] for i in stay.tolist()], len(found)


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, digests: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) without the words that a window also starting in a document of smaller doc_id covers.

    Returns every column of ``docs`` with the new text: the kept words joined by one space, or the text as it was if
    nothing goes. With ``digests`` returns doc_id, n_words, n_removed and kept_sha256 instead. Null texts have no words
    and stay null; documents under 13 words and those with a null doc_id stay whole and cause no removal. Rows that share
    a doc_id remove nothing from each other, whether their texts are equal or not; each loses its own words only. Windows
    are judged on the input, so the order of removal does not matter. doc_id must be a whole number. Extra columns keep
    their values, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"doc_id must be a whole number, not {kind}")
    # a key for the text travels with every run only where some id has several texts
    told_apart = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).filter("doc_id IS NOT NULL AND a <> b")
    several = bool(told_apart.head(1))
    key = F.xxhash64("text") if several else F.lit(0).cast("long")
    found = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text"), window, run)
    names = ["doc_id", "text"] if digests else docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own_id, own_text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    same = F.col(own_id).cast("long") == F.col("span_id")
    if several:
        same = same & (F.xxhash64(own_text) == F.col("span_key"))
    met = own.join(found, same, "left").drop("span_id", "span_key")
    if not digests:

        def rewrite(batches):
            for batch in sliced(batches, STEP, column=own_text):
                out = []
                for text, spans in zip(batch.column(own_text).to_pylist(), batch.column("spans"), strict=True):
                    out.append(text if text is None or not spans.is_valid else b" ".join(_kept(text, spans.values.to_numpy())[0]).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(f"c{i}") for i, c in enumerate(names)], names)

        return met.mapInArrow(rewrite, docs.schema)

    def digest(batches):
        for batch in sliced(batches, STEP, column=own_text):
            rows = []
            for text, spans in zip(batch.column(own_text).to_pylist(), batch.column("spans"), strict=True):
                kept, n = _kept(text, spans.values.to_numpy() if spans.is_valid else None)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(own_id), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return met.mapInArrow(digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return compact(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS least FROM p GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM p JOIN f ON p.win = f.win AND f.least < p.doc_id),
k AS (SELECT x.doc_id, string_agg(x.ws[x.j], ' ' ORDER BY x.j) AS kept, count(*) AS n FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS j FROM w) x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j WHERE c.j IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""
