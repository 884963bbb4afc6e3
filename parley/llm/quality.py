"""Operator 9: quality classifier from weak labels.

Overlapping heuristics vote on each document: good, bad or no vote. Expectation-maximisation over the table of vote
patterns, counted over all documents, estimates how often each heuristic is right for good and for bad documents, with no
true label seen. The posteriors of a bounded sample of documents then train a hashed linear scorer, which scores every
text by its words and their shapes.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import compact, cut, sliced, table

BAD, NONE, GOOD = 0, 1, 2
#: Rows of the hashed scorer, and the bound of the sample it is trained on.
ROWS, FIT_DOCS = 1 << 16, 4000
#: Words whose rows a worker keeps, and bytes of texts worked on at a time.
CACHE, STEP = 1 << 18, 1 << 20


def _between(x: float, bad_under: float, good_from: float) -> int:
    return BAD if x < bad_under else GOOD if x >= good_from else NONE


def votes(text: str | None) -> tuple[int, ...]:
    """The heuristics' votes on a text. A text without words is bad to the first and of no interest to the others."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (BAD,) + (NONE,) * (len(HEURISTICS) - 1)
    counts = Counter(words)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    letters = sum(map(len, words))
    alphabetic = sum([len(w) for w in words if w.isalpha()])
    capital = sum([1 for w in words if len(w) > 1 and w.isupper() and w.isalpha()] + [1 for w in words if w.endswith("!!")])
    ends = sum([1 for w in words if w[-1] in ".?!"])
    odd = sum([1 for w in words if not any(c.isalpha() for c in w)])
    runs = sum([1 for w in words if w[-1] == w[-2:-1] == w[-3:-2] and not w[-1].isalnum()])
    return (
        _between(n, 5, 30),  # length
        _between(len(counts) / n, 0.2, 0.45) if n >= 20 else NONE,  # variety of words
        _between(len(set(lines)) / max(1, len(lines)), 0.7, 0.95) if len(lines) > 2 else NONE,  # lines that repeat
        _between(1 - capital / n, 0.7, 0.95),  # shouting
        _between(1 - odd / n, 0.7, 0.9),  # signs and numbers alone
        _between(ends / n, 0.01, 0.04) if n >= 20 else NONE,  # ends of sentences
        _between(alphabetic / max(1, letters), 0.4, 0.7),  # letters in plain words
        BAD if letters / n > 14 or letters / n < 2 else GOOD if 3.5 <= letters / n <= 9 else NONE,  # length of words
        _between(1 - runs / n, 0.8, 0.98),  # runs of one sign at the ends of words
    )


HEURISTICS = ("length", "variety", "lines", "shouting", "signs", "sentences", "letters", "word_length", "sign_runs")


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id and pattern (votes as a number in base 3) of every text."""

    def run(batches):
        for batch in sliced(batches, STEP):
            got = [sum(v * 3**i for i, v in enumerate(votes(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern long")


class LabelModel:
    """Class share and, for each heuristic, the chance of each vote given the class; by expectation-maximisation on pattern counts."""

    def __init__(self, counts: dict[int, int], rounds: int = 100):
        k = len(HEURISTICS)
        ids = np.array(sorted(counts), np.int64)
        self.digits = np.stack([(ids // 3**i) % 3 for i in range(k)], axis=1) if len(ids) else np.zeros((0, k), np.int64)
        n = np.array([counts[i] for i in ids.tolist()], float)
        # it starts from the documents that no heuristic calls bad, which settles which class is the good one
        margin = 2.0 - 4 * (self.digits == BAD).sum(axis=1)
        post = 1 / (1 + np.exp(-margin.astype(float)))
        self.share, self.chance = 0.5, np.full((2, k, 3), 1 / 3)
        for _ in range(rounds if len(ids) else 0):
            for c, p in ((1, post), (0, 1 - post)):
                for i in range(k):
                    mass = np.bincount(self.digits[:, i], p * n, 3) + 1.0
                    self.chance[c, i] = mass / mass.sum()
            self.share = float((post * n).sum() + 1) / (n.sum() + 2)
            new = self.posterior(self.digits)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new

    def posterior(self, digits: np.ndarray) -> np.ndarray:
        """Chance that documents with these votes are good."""
        at = np.arange(digits.shape[1])
        good = np.log(self.share) + np.log(self.chance[1, at, digits]).sum(axis=1)
        bad = np.log(1 - self.share) + np.log(self.chance[0, at, digits]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def of_pattern(self, pattern: int) -> float:
        return float(self.posterior(np.array([[pattern // 3**i % 3 for i in range(len(HEURISTICS))]]))[0])


_SHAPE = regex.compile(r"(\p{Lu}+)|(\p{L}+)|(\p{N}+)")


def shape(word: str) -> str:
    """Capitals, other letters and numbers as one sign for each run, the rest as it is, over the whole word."""
    return _SHAPE.sub(lambda m: "A" if m[1] else "a" if m[2] else "0", word)


class Hashed:
    """Hashed features of a text: shares of its words, shapes and pairs of shapes, and its length; words met are kept, up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        known, rows, shapes, last = self.known, [], [], 0
        if len(known) > CACHE:
            known.clear()
        for w in words:
            got = known.get(w)
            if got is None:
                got = known[w] = (zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % ROWS, zlib.crc32(shape(w).encode("utf-8", "surrogatepass"), 7) % ROWS)
            rows.append(got[0])
            shapes.append(got[1])
        n = max(1, len(words))
        s = np.array(shapes, np.int64)
        pairs = (s[1:] * 31 + s[:-1]) % ROWS if n > 1 else s[:0]
        kinds = len(set(rows)) / n
        extra = [zlib.crc32(f"n{min(12, n.bit_length())}".encode()) % ROWS, zlib.crc32(f"v{int(10 * kinds)}".encode()) % ROWS]
        at, counts = np.unique(np.concatenate([np.array(rows, np.int64), s, pairs]), return_counts=True)
        return np.r_[at, extra], np.r_[counts / n, 1.0, 1.0]


class Linear:
    """A logistic scorer over hashed features, trained on chances instead of labels."""

    def __init__(self):
        self.weights, self.bias = np.zeros(ROWS), 0.0

    def train(self, rows, goals, epochs: int = 6, rate: float = 0.3, seed: int = 1) -> Linear:
        r, seen = np.random.default_rng(seed), np.full(ROWS, 1e-3)
        for _ in range(epochs):
            for i in r.permutation(len(rows)).tolist():
                at, x = rows[i]
                g = self.one(at, x) - goals[i]
                seen[at] += (g * x) ** 2
                np.add.at(self.weights, at, -rate * g * x / np.sqrt(seen[at]))
                self.bias -= 0.05 * g
        return self

    def one(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.bias, -30, 30))))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = 20_000) -> tuple[LabelModel, Linear]:
    """The label model of all documents, and the scorer trained on those ``fit_docs`` of at most ``fit_chars`` letters with the smallest hash of their id."""
    marked = cut(patterns(docs), "patterns")
    counts = {r["pattern"]: r["count"] for r in marked.groupBy("pattern").count().collect()}  # at most 3 ** heuristics
    model = LabelModel(counts)
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= fit_chars).select("doc_id", "text", F.xxhash64("text").alias("key"))
    ids = cut(short.select("doc_id", "key").orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(fit_docs).select(F.col("doc_id").alias("id"), F.col("key").alias("own")).distinct(), "sampled")
    # texts of the sampled ids alone come to the driver: at most fit_docs x fit_chars letters
    few = short.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own"))).select("doc_id", "text").distinct().collect()
    few.sort(key=lambda r: (str(r["doc_id"]), r["text"] or ""))
    hashed = Hashed()
    goals = [model.of_pattern(sum(v * 3**i for i, v in enumerate(votes(r["text"])))) for r in few]
    return model, Linear().train([hashed.text(r["text"]) for r in few], goals)


def score(docs: DataFrame, scorer: Linear) -> DataFrame:
    """doc_id and score (0 to 1, the chance of being good) of every whole text of ``docs`` (doc_id, text).

    Null and empty texts score as texts of no words. Repeated rows get equal scores; no rows give none. One Arrow batch at a time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        hashed = Hashed()
        for batch in sliced(batches, STEP):
            got = [sent.value.one(*hashed.text(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score and predicted (1: good) of every document; no true label is used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compact(score(docs, fit(docs)[1]).select("doc_id", "score", F.expr("CAST(score >= 0.5 AS INT)").alias("predicted")))
