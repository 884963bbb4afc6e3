"""Operator 1: language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order of frequency. A document's most frequent n-grams are
compared to each profile: an n-gram costs the difference of its two ranks, or the full length of the profile if it is
not in there. The language of the smallest sum of these out-of-place distances wins.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import compact, cut, sliced, table

#: Longest n-gram (in UTF-16 units, packed into 64 bits), n-grams of a profile, and the bound of the learning sample: documents of each language.
LONGEST, PROFILE, FIT_DOCS = 4, 300, 400
UNKNOWN = "und"
#: Bytes of texts judged at a time.
STEP = 1 << 20
_EDGE = ord("_")


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which are letters or marks."""
    alpha = np.array([chr(i).isalpha() for i in range(0x110000)])
    marks = np.array([unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)])
    return alpha, alpha | marks


def pack(gram: str) -> int:
    """The 64 bits of an n-gram of UTF-16 units; their order is that of the units."""
    units = np.frombuffer(gram.encode("utf-16-le", "surrogatepass"), np.uint16).tolist()
    return sum(u << (48 - 16 * i) for i, u in enumerate(units))


def count_grams(text: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a whole text's words, word ends marked, and how often each comes; none if there is no letter.

    The words stand in a row with one mark between them, so an n-gram counts if it has no mark but at its ends.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha, inside = _letters()
    if not alpha[points].any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.concatenate([[_EDGE], np.where(inside[points], points, _EDGE), [_EDGE]])
    edge = row == _EDGE
    stay = np.r_[True, ~(edge[1:] & edge[:-1])]
    row, edge = row[stay].astype(np.uint64), edge[stay]
    far = row > 0xFFFF
    if far.any():  # two units for a letter beyond 16 bits, which no other letter owns
        first, second = (row - np.uint64(0x10000) >> np.uint64(10)) + np.uint64(0xD800), (row & np.uint64(0x3FF)) + np.uint64(0xDC00)
        twice = np.where(far, 2, 1)
        at = np.cumsum(twice) - twice
        row, edge = np.repeat(np.where(far, first, row), twice), np.repeat(edge, twice)
        row[at[far] + 1] = second[far]
    keys, gram, clear = [row[~edge] << np.uint64(48)], row << np.uint64(48), np.ones(len(row), bool)
    for n in range(2, longest + 1):
        gram = gram[:-1] | row[n - 1 :] << np.uint64(64 - 16 * n)
        if n > 2:
            clear = clear[: len(gram)] & ~edge[n - 2 : n - 2 + len(gram)]  # no mark within
        keys.append(gram[clear[: len(gram)]])
    return np.unique(np.concatenate(keys), return_counts=True)


def most_frequent(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams (packed), equal ones in the order of their code points."""
    if len(keys) > most:
        keep = counts >= np.partition(counts, -most)[-most]
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort([keys, -counts])][:most]


def learn(labelled: DataFrame, fit_docs: int = FIT_DOCS, most: int = PROFILE, longest: int = LONGEST) -> dict[str, list[int]]:
    """Profiles (packed n-grams in order) from rows (doc_id, text, lang). Of each language the ``fit_docs`` rows with the smallest hash of their id are counted, whole.

    Rows without a language or without text teach nothing; rows with a null id teach like others. One scan finds the rows of all languages.
    """
    named = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("key"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key"))
    picked = named.select("doc_id", "lang", "key").withColumn("place", first).filter(F.col("place") <= fit_docs)
    picked = cut(picked.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), F.col("key").alias("own")).distinct(), "learned")
    chosen = named.join(picked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")) & (F.col("key") == F.col("own")))

    def count(batches):
        for batch in sliced(batches, STEP):
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = count_grams(text.as_py(), longest)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("place", place).filter(F.col("place") <= most).orderBy("lang", "place").collect()  # at most languages x profile
    profiles: dict[str, list[int]] = {}
    for r in rows:
        profiles.setdefault(r["lang"], []).append(r["gram"] & (1 << 64) - 1)
    return profiles


class Judge:
    """Profiles as a sorted table: a row for each n-gram with its rank in each language."""

    def __init__(self, profiles: dict[str, list], most: int, longest: int):
        self.languages, self.most, self.longest = sorted(profiles), most, longest
        packed = {lang: [pack(g) if isinstance(g, str) else g for g in profiles[lang]] for lang in self.languages}
        self.keys = np.array(sorted({g for x in packed.values() for g in x}), np.uint64)
        self.ranks = np.full((len(self.keys), len(self.languages)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, np.array(packed[lang], np.uint64)), k] = np.arange(len(packed[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        keys, counts = count_grams(text, self.longest)
        if not len(keys):
            return UNKNOWN, 0.0
        top = most_frequent(keys, counts, self.most)
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        mine = np.flatnonzero(self.keys[at] == top)
        distance = np.full(len(self.languages), len(top) * self.most, np.int64)
        if len(mine):
            theirs = self.ranks[at[mine]]
            distance -= np.where(theirs >= 0, self.most - np.minimum(np.abs(theirs - mine[:, None]), self.most), 0).sum(axis=0)
        best = int(np.argmin(distance))
        near = 1.0 - distance / (len(top) * self.most)  # 0: nothing in common, 1: the profile itself
        return self.languages[best], float(near[best] / near.sum()) if near.sum() else 0.0


def identify(docs: DataFrame, profiles: dict[str, list], most: int = PROFILE, longest: int = LONGEST) -> DataFrame:
    """doc_id, lang_pred and score (the winner's part of all closeness, 0 to 1) of every whole text of ``docs`` (doc_id, text).

    Texts that are null or have no letters, and all texts if no language was learned, are ``und`` with score 0. Equal distances: the
    language first by code point. Repeated rows get equal results; no rows give none. One Arrow batch at a time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # at most languages x profile n-grams

    def run(batches):
        judge = Judge(sent.value, most, longest)
        for batch in sliced(batches, STEP):
            got = [judge.judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = learn(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return compact(identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))
