"""Operator 10: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network as two vectors: a row of a word table, and the mean of rows of a table of letter n-grams (3 to 5
letters, word ends marked), both hashed. Two gated recurrent layers read a window of words forwards and backwards,
attention pools their states, and a logistic output scores the window. Windows overlap by half, one at every 12th word of a
text; the text has the score of its worst window. So training takes, of a toxic text, the window that the network finds worst so far.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import compact, cut, drop, give_back, sliced, table

#: Words of a window and between the starts of two; vector sizes; hashed rows.
WINDOW, STRIDE = 24, 12
DIMS, HIDDEN = 8, 8
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
#: Bound of the learning sample: texts of each label, and letters of a text.
FIT_DOCS, FIT_CHARS = 900, 4000
#: Bound of the longer texts that the threshold is set on as well: of each label, and letters.
LONG_DOCS, LONG_CHARS = 150, 40_000
#: Letters of the longest word, and those that two pieces of a longer one share: more than a letter n-gram has.
PIECE, OVERLAP = 64, 8
#: Words whose inputs a worker keeps, and bytes of texts scored at a time.
CACHE, STEP = 1 << 17, 1 << 20
_EDGE = ".,;:!?\"'()[]{}|*_-"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many words: the row of each word, the rows of their letter n-grams one after another, and how many each word has."""
    marked = [f"<{w or '-'}>".encode("utf-8", "surrogatepass") for w in words]
    rows = np.fromiter((zlib.crc32(m, 1) for m in marked), np.int64, len(marked)) % WORD_ROWS
    letters = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), np.fromiter(map(len, marked), np.int64, len(marked)))
    grams, owners = [], []
    for k in (3, 4, 5):
        n = len(letters) - k + 1
        if n < 1:
            continue
        inside = np.flatnonzero(owner[:n] == owner[k - 1 :])
        hashed = np.full(len(inside), k, np.uint64)
        for j in range(k):
            hashed = hashed * np.uint64(0x100000001B3) + letters[inside + j]
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        grams.append((hashed >> np.uint64(40)).astype(np.int64) % GRAM_ROWS)
        owners.append(owner[inside])
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    return rows, np.concatenate(grams)[order] if grams else owners, np.bincount(owners, minlength=len(marked))


def pick(feats: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of some of the words."""
    rows, grams, lengths = feats
    starts, many = (np.cumsum(lengths) - lengths)[at], lengths[at]
    return rows[at], grams[np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


def split(text: str | None) -> list[str]:
    """The words of a text; a longer one than ``PIECE`` letters, as of a text without spaces, is parted into overlapping pieces."""
    found = [w.strip(_EDGE) for w in text.lower().split()] if text else []
    if all(len(w) <= PIECE for w in found):
        return found
    return [w[a : a + PIECE] for w in found for a in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, forward pass and gradients. Windows are arrays (window, word) of rows of the inputs given; -1 is no word."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d, h = 2 * DIMS, HIDDEN
        draw = lambda *s, scale=0.3: (scale * r.standard_normal(s)).astype(np.float32)
        self.words, self.grams = draw(WORD_ROWS, DIMS, scale=0.02), draw(GRAM_ROWS, DIMS, scale=0.02)
        self.p = {}
        for way in "fb":  # forwards, backwards: input, recurrent and bias of update, reset and candidate
            self.p |= {f"w{way}": draw(d, 3 * h), f"u{way}": draw(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": draw(2 * h), "out": draw(2 * h), "bias": np.full(1, -1.0, np.float32)}

    def inputs(self, feats) -> np.ndarray:
        """A row for each word: its word vector and the mean of its n-gram vectors."""
        rows, grams, lengths = feats
        if not len(rows):
            return np.zeros((0, 2 * DIMS), np.float32)
        means = np.add.reduceat(self.grams[grams], np.cumsum(lengths) - lengths) / lengths[:, None].astype(np.float32)
        return np.concatenate([self.words[rows], means], axis=1)

    def read(self, gates: np.ndarray, at: np.ndarray, way: str, keep: bool = False):
        """States after each word of one layer; ``gates`` are the inputs' parts of the gates, by word."""
        h, p = HIDDEN, self.p
        n, length = at.shape
        state = np.zeros((n, h), np.float32)
        states, trail = np.zeros((length, n, h), np.float32), []
        u = p["u" + way]
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            here = at[:, t]
            mask = (here >= 0)[:, None]
            x = gates[here]
            zr = sigmoid(x[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            new = np.where(mask, state + z * (c - state), state)
            if keep:
                trail.append((t, state, z, r, c, mask))
            state = new
            states[t] = state
        return (states, trail) if keep else states

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Output before the logistic function of each window."""
        states = np.concatenate([self.read(x @ self.p["w" + w] + self.p["c" + w], at, w) for w in "fb"], axis=2)
        return self._pool(states, at)[0]

    def _pool(self, states, at):
        weight = states @ self.p["att"]
        weight = np.where(at.T >= 0, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return pooled @ self.p["out"] + self.p["bias"], pooled, weight

    def gradients(self, x: np.ndarray, at: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """(loss, gradients by name, gradient of the inputs) of the weighted logistic loss."""
        h, p = HIDDEN, self.p
        kept = {w: self.read(x @ p["w" + w] + p["c" + w], at, w, True) for w in "fb"}
        states = np.concatenate([kept[w][0] for w in "fb"], axis=2)
        out, pooled, weight = self._pool(states, at)
        prob = sigmoid(out)
        total = weights.sum()
        loss = float(-(weights * np.log(np.where(labels > 0, prob, 1 - prob) + 1e-9)).sum() / total)
        d_out = ((prob - labels) * weights / total).astype(np.float32)
        g = {"out": pooled.T @ d_out, "bias": np.array([d_out.sum()])}
        d_pooled = d_out[:, None] * p["out"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_raw = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled + d_raw[:, :, None] * p["att"]
        g["att"] = (d_raw[:, :, None] * states).sum(axis=(0, 1))
        d_x = np.zeros_like(x)
        order = np.argsort(at, axis=None, kind="stable")[int((at < 0).sum()) :]
        slots = at.ravel()[order]
        edges = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        for k, way in enumerate("fb"):
            u, w = p["u" + way], p["w" + way]
            du, d_slots = np.zeros_like(u), np.zeros((*at.shape, 3 * h), np.float32)
            carry = np.zeros((len(at), h), np.float32)
            for t, before, z, r, c, mask in reversed(kept[way][1]):
                d = carry + d_states[t][:, k * h : (k + 1) * h]
                dm = np.where(mask, d, 0)
                dc = dm * z * (1 - c * c)
                dz = dm * (c - before) * z * (1 - z)
                d_reset = dc @ u[:, 2 * h :].T
                dr = d_reset * before * r * (1 - r)
                du[:, 2 * h :] += (r * before).T @ dc
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * h] += before.T @ dzr
                carry = np.where(mask, dm * (1 - z) + d_reset * r + dzr @ u[:, : 2 * h].T, d)
                d_slots[:, t] = np.concatenate([dzr, dc], axis=1)
            dgates = np.zeros((len(x), 3 * h), np.float32)
            dgates[slots[edges]] = np.add.reduceat(d_slots.reshape(-1, 3 * h)[order], edges)
            g["u" + way], g["w" + way], g["c" + way] = du, x.T @ dgates, dgates.sum(axis=0)
            d_x += dgates @ w.T
        return loss, g, d_x


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows over ``n`` words, the last one up to the end."""
    return [*range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def window_rows(numbers: list[int]) -> np.ndarray:
    n, starts = len(numbers), windows(len(numbers))
    padded = np.full(starts[-1] + WINDOW, -1, np.int64)
    padded[:n] = numbers
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)]


class Scorer:
    """Scores texts; the gates' inputs of words already met are kept, up to a bound."""

    def __init__(self, net: Network, shift: float = 0.0, scale: float = 1.0):
        self.net, self.shift, self.scale = net, shift, scale
        self.restart()

    def restart(self) -> None:
        self.numbers, self.filed, self.fresh = {}, 0, []
        self.gates = {w: np.zeros((1024, 3 * HIDDEN), np.float32) for w in "fb"}

    def number(self, word: str) -> int:
        found = self.numbers.get(word)
        if found is None:
            found = self.numbers[word] = len(self.numbers)
            self.fresh.append(word)
        return found

    def _settle(self) -> None:
        if not self.fresh:
            return
        x = self.net.inputs(features(self.fresh))
        end = self.filed + len(x)
        for w in "fb":
            if end > len(self.gates[w]):
                self.gates[w] = np.concatenate([self.gates[w], np.zeros((max(end, len(self.gates[w])), 3 * HIDDEN), np.float32)])
            self.gates[w][self.filed : end] = x @ self.net.p["w" + w] + self.net.p["c" + w]
        self.filed, self.fresh = end, []

    def windows(self, rows: np.ndarray) -> np.ndarray:
        self._settle()
        out = np.empty(len(rows), np.float32)
        for a in range(0, len(rows), 4096):
            at = rows[a : a + 4096]
            states = np.concatenate([self.net.read(self.gates[w], at, w) for w in "fb"], axis=2)
            out[a : a + 4096] = self.net._pool(states, at)[0]
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """A score from 0 to 1 for each text."""
        if len(self.numbers) > CACHE:
            self.restart()
        best, pending, owner, size = np.full(len(texts), -np.inf), [], [], 0

        def close():
            got = self.windows(np.concatenate(pending))
            np.maximum.at(best, np.concatenate(owner), got)

        for i, text in enumerate(texts):
            rows = window_rows([self.number(w) for w in split(text)])
            pending.append(rows)
            owner.append(np.full(len(rows), i))
            size += len(rows)
            if size >= 8192:
                close()
                pending, owner, size = [], [], 0
        if pending:
            close()
        return sigmoid(np.clip((best - self.shift) * self.scale, -30, 30)).astype(float)


def train(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 0.02, tables: float = 3.0, seed: int = 3, seeded: bool = True, long: tuple[list[str], list[int]] = ((), ())) -> Scorer:
    """A scorer fitted on labelled texts; the same texts give the same scorer. ``long`` are further texts and labels that only the threshold is set on.

    With ``seeded`` one dimension of the tables starts from how each feature is spread over the labels; without it they start from chance alone.
    """
    net = Network(seed)
    r = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    vocabulary: dict[str, int] = {}
    rows = [window_rows([vocabulary.setdefault(w, len(vocabulary)) for w in split(t)]) for t in texts]
    if not vocabulary or y.min() == y.max():
        return Scorer(net, shift=0.0 if len(y) and y.max() else 30.0)
    feats = features(list(vocabulary))
    # one dimension of the tables starts from how each feature is spread over the texts
    texts_of = {1: max(1, int(y.sum())), 0: max(1, int((1 - y).sum()))}
    count = {(k, many): np.zeros(many) for k in (0, 1) for many in (WORD_ROWS, GRAM_ROWS)}
    for window, label in zip(rows, labels, strict=True):
        of_word, of_gram, _ = pick(feats, np.unique(window[window >= 0]))
        count[label, WORD_ROWS][np.unique(of_word)] += 1
        count[label, GRAM_ROWS][np.unique(of_gram)] += 1
    for target, many in ((net.words, WORD_ROWS), (net.grams, GRAM_ROWS)) if seeded else ():
        good, bad = count[0, many], count[1, many]
        # how far a feature's number of toxic texts is above chance, in standard deviations: rare ones stay near nought
        chance = (good + bad) * texts_of[1] / (texts_of[0] + texts_of[1])
        target[:, 0] = np.clip((bad - chance) / np.sqrt(chance + 1) / 2 - 1, 0, 3)
    flat = np.concatenate(rows)
    first = np.r_[0, np.cumsum([len(x) for x in rows])][:-1]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        x = net.inputs(feats)
        got = np.concatenate([net.scores(x, flat[a : a + 8192]) for a in range(0, len(flat), 8192)])
        if epoch == 0 and seeded:  # before anything is learned, the window with the most telling word
            hint = np.where(flat >= 0, x[flat, 0] + x[flat, DIMS], -9).max(axis=1)
            got = hint
        worst = np.array([a + int(np.argmax(got[a : a + len(w)])) for a, w in zip(first, rows, strict=True)])
        chance = first + (r.random(len(rows)) * [len(w) for w in rows]).astype(np.int64)
        taken = np.r_[worst, chance[y == 0]]
        goal = np.r_[y, np.zeros(int((y == 0).sum()), np.float32)]
        order = r.permutation(len(taken))
        for a in range(0, len(order), 128):
            at = order[a : a + 128]
            used, local = np.unique(flat[taken[at]], return_inverse=True)
            local = local.reshape(-1, WINDOW)
            if used[0] < 0:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            some = pick(feats, used)
            x = net.inputs(some)
            _, g, d_x = net.gradients(x, local, goal[at], np.where(goal[at] > 0, 1.0, 0.7).astype(np.float32))
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
            d_x = np.clip(d_x, -0.1, 0.1)
            np.add.at(net.words, some[0], -rate * tables * d_x[:, :DIMS])
            np.add.at(net.grams, some[1], -rate * tables * np.repeat(d_x[:, DIMS:] / some[2][:, None], some[2], axis=0))
    x = net.inputs(feats)
    got = np.concatenate([net.scores(x, flat[a : a + 8192]) for a in range(0, len(flat), 8192)])
    best = np.maximum.reduceat(got, first)
    if long[0]:
        far = np.clip(Scorer(net).texts(list(long[0])), 1e-13, 1 - 1e-13)
        best, y = np.r_[best, np.log(far / (1 - far))], np.r_[y, np.array(long[1], np.float32)]
    # where texts of both labels part best, a clean text rejected counting double; in a gap, its middle
    edges = np.unique(best)
    cuts = np.r_[edges[0] - 1, (edges[1:] + edges[:-1]) / 2, edges[-1] + 1]
    bad, good = np.sort(best[y > 0]), np.sort(best[y == 0])
    wrong = np.searchsorted(bad, cuts) + 2.0 * (len(good) - np.searchsorted(good, cuts))
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return Scorer(net, shift=float((cuts[least[0]] + cuts[least[-1]]) / 2))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, long_docs: int = LONG_DOCS, long_chars: int = LONG_CHARS) -> Scorer:
    """Train on at most ``fit_docs`` documents of each label, of at most ``fit_chars`` letters: those with the smallest hash of their id.

    The threshold is also set on at most ``long_docs`` longer ones of each label, of at most ``long_chars`` letters: a text's score
    is its worst window's, and long texts have many. Labels without a document, or other than 0 and 1, teach nothing.
    """
    length = F.length("text")
    sized = docs.filter(length <= long_chars).select("doc_id", (length > fit_chars).alias("long"))
    known = cut(sized.join(labels.select(F.col("doc_id").alias("id"), "toxic").filter("toxic IN (0, 1)"), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "long"), "labelled")
    few = [known.filter((F.col("toxic") == k) & (F.col("long") == far)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for far, most in ((False, fit_docs), (True, long_docs)) for k in (0, 1)]
    picked = cut(few[0].union(few[1]).union(few[2]).union(few[3]).select(F.col("doc_id").alias("id"), "toxic", "long").distinct(), "picked")
    # at most 2 x fit_docs texts of fit_chars letters and 2 x long_docs of long_chars
    rows = docs.join(F.broadcast(picked), (F.col("doc_id") == F.col("id")) & ((F.length("text") > fit_chars) == F.col("long"))).select("doc_id", "text", "toxic", "long").filter(F.length("text") <= long_chars).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or "", r["toxic"]))
    drop(known, picked)
    short, long = ([r for r in rows if r["long"] == far] for far in (False, True))
    return train([r["text"] for r in short], [r["toxic"] for r in short], long=([r["text"] for r in long], [r["toxic"] for r in long]))


def _run(sent, columns: list[str], keep: float | None):
    def run(batches):
        scorer = Scorer(*sent.value)
        for batch in sliced(batches, STEP):
            scores = scorer.texts(batch.column("text").to_pylist())
            if keep is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])
            else:
                yield batch.filter(pa.array(scores < keep)).select(columns)
        del scorer
        give_back()

    return run


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text of ``docs`` (doc_id, text); null and empty texts score as one window without words.

    Repeated rows get equal scores; no rows give none. One Arrow batch at a time; the network is of fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast((scorer.net, scorer.shift, scorer.scale))
    return docs.select("doc_id", "text").mapInArrow(_run(sent, [], None), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, scorer: Scorer, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``below``, with all their columns, whatever their names.

    Null and empty texts score as one window without words, repeated rows stay or go together, no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast((scorer.net, scorer.shift, scorer.scale))
    return docs.mapInArrow(_run(sent, docs.columns, below), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels are learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scorer = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return compact(score(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", F.expr("CAST(score >= 0.5 AS INT)").alias("predicted")))
