"""Operator 3: byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled one after another. At first the automaton has one state and reads any symbol after any other.
The gadget of merge number r, of tokens a and b, works on every path that reads a and then b: it puts a fresh state
behind the arcs labelled a, a copy of the old one without the arc b, and adds an arc labelled ab beside the pair, to
where the b arc led. After the last merge the automaton accepts exactly the token sequences that merging would give.

All arcs with one label lead to one state, so a state is named by its label, and a gadget is three numbers: which arc it
cut, when, and from which state the new token's state was copied. Copies are kept by version (time) instead of being
written out; ``Automaton.follows`` looks an arc up through the versions and files it in a table of transitions.

A pre-split word is read symbol by symbol. For each prefix the table gives the one token that can end it: the longest
for which an arc leads on from the token that ends the prefix before. Decoding emits the labels of the arcs taken.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import compact, sliced, table

#: Cached words and transitions of a worker, and bytes of filed stretches; beyond it the cache starts anew.
CACHE, CACHE_BYTES = 1 << 18, 128 << 20
#: Slots of the table of transitions; symbols of a word that is encoded alone; words encoded together; letters of a stretch that is encoded with its text only.
PAIRS, ALONE, TOGETHER, LONG = 1 << 21, 64, 1 << 14, 1 << 12
#: Bytes of texts encoded before their results are sent on.
SLICE = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class Lookup:
    """A fixed table from numbers to numbers, read for whole arrays: open addressing, -1 for what is not in it."""

    def __init__(self, keys, values):
        keys, values = np.fromiter(keys, np.int64), np.fromiter(values, np.int32)
        self.mask = np.int64((1 << max(4, (3 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            _, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x2545F4914F6CDD1D)) >> np.int64(29)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Automaton:
    """The compiled merges. ``labels[i]`` is token i's string."""

    FOREVER = 1 << 30

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        self.labels = [""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        self.born = [-1] * size  # number of the merge that made the token; -1: a symbol
        self.head, self.tail = list(range(size)), list(range(size))  # the tokens merged
        self.cut_at: dict[tuple[int, int], int] = {}  # arc b out of the state behind a -> number of the merge that cut it
        self.table: dict[int, bool] = {}
        merged = set()
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab.get(a), vocab.get(b), vocab.get(a + b)
            if i is None or j is None or k is None:
                continue
            self.cut_at.setdefault((i, j), r)
            if k not in merged and self._arc(i, j, r):  # else no path reads a and then b any more: the gadget adds no arc
                self.born[k], self.head[k], self.tail[k] = r, i, j
                merged.add(k)
        pairs = {a + b for a, b in merges}
        #: Tokens that some path reads: symbols and merged tokens.
        self.ids = {t: i for t, i in vocab.items() if i in merged or t not in pairs}
        self._index()

    def _index(self) -> None:
        """Nodes for what has been read of a word, as far as some token may still go on from it, with the tokens that end there.

        A symbol that ends a word is a character of its own, ``SHIFT`` further on.
        """
        self.goto: dict[int, int] = {}  # node and symbol -> node
        self.back, self.at_end = [0], [()]  # the node of the longest shorter ending; (token, its symbols), the longest first
        depth = [0]
        for token, i in self.ids.items():
            node, word = 0, self._shifted(token)
            for c in word:
                key = node << 16 | ord(c)
                if key not in self.goto:
                    self.goto[key] = len(depth)
                    depth.append(depth[node] + 1)
                    self.back.append(0)
                    self.at_end.append(())
                node = self.goto[key]
            self.at_end[node] = ((i, len(word)),)
        for key, node in sorted(self.goto.items(), key=lambda x: depth[x[1]]):
            if depth[node] > 1:
                self.back[node] = self.read(self.back[key >> 16], key & 0xFFFF)
            self.at_end[node] += self.at_end[self.back[node]]
        self._compile(depth)

    def _compile(self, depth: list[int]) -> None:
        """The automaton as arrays: edges, ways back, the token that ends at a node and the next shorter one's node, and the cuts of the gadgets."""
        self.edges = Lookup(self.goto.keys(), self.goto.values())
        self.ways_back = np.array(self.back, np.int32)
        own = [x[0] if x and x[0][1] == d else (-1, 0) for x, d in zip(self.at_end, depth, strict=True)]
        self.token, self.width = (np.array([x[i] for x in own], np.int32) for i in (0, 1))
        shorter = np.zeros(len(depth), np.int32)  # the next node on the way back at which a token ends; 0: none
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            back = self.back[node]
            shorter[node] = back if own[back][0] >= 0 else shorter[back]
        self.shorter = shorter
        self.longest = np.where(self.token >= 0, np.arange(len(depth), dtype=np.int32), shorter)
        self.cuts = Lookup((x << 20 | y for x, y in self.cut_at), self.cut_at.values())
        self.births, self.heads, self.tails = (np.array(x, np.int32) for x in (self.born, self.head, self.tail))
        self.pairs, self.arcs = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)  # arcs looked up last, by slot

    def reads(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The nodes after one more symbol each."""
        nodes, out, left = nodes.copy(), np.zeros(len(nodes), np.int32), np.arange(len(nodes))
        while len(left):
            got = self.edges.get(nodes[left].astype(np.int64) << 16 | symbols[left])
            hit = got >= 0
            out[left[hit]] = got[hit]
            left = left[~hit & (nodes[left] > 0)]
            nodes[left] = self.ways_back[nodes[left]]
        return out

    def follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the states behind the tokens ``x`` have the arcs ``y``: from the table of transitions, or else through the versions."""
        keys = x.astype(np.int64) << 20 | y
        slots = (keys * np.int64(0x2545F4914F6CDD1D) >> np.int64(40)) & np.int64(PAIRS - 1)
        out = self.arcs[slots]
        new = np.flatnonzero(self.pairs[slots] != keys)
        if len(new):
            fresh, where = np.unique(keys[new], return_inverse=True)
            found = self._arcs((fresh >> 20).astype(np.int32), (fresh & 0xFFFFF).astype(np.int32))
            out[new] = found[where]
            at = (fresh * np.int64(0x2545F4914F6CDD1D) >> np.int64(40)) & np.int64(PAIRS - 1)
            self.pairs[at] = fresh
            self.arcs[at] = found & (self.pairs[at] == fresh)
            lost = self.pairs[at] != fresh  # another pair has the slot: its arc must stay its own
            if lost.any():
                self.pairs[at[lost]] = -1
        return out

    def _arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``_arc`` of many pairs, after all merges."""
        out, left, time = np.zeros(len(x), bool), np.arange(len(x)), np.full(len(x), self.FOREVER, np.int32)
        x, y = x.copy(), y.copy()
        while len(left):
            a, b = x[left], y[left]
            cut = self.cuts.get(a.astype(np.int64) << 20 | b)
            stays = (cut < 0) | (cut >= time[left])
            born_a, born_b = self.births[a], self.births[b]
            back_a = stays & (born_a > born_b)
            back_b = stays & ~back_a & (born_b >= 0)
            out[left[stays & ~back_a & ~back_b]] = True
            i, j = left[back_a], left[back_b]
            time[i], x[i] = born_a[back_a], self.tails[a[back_a]]
            time[j], y[j] = born_b[back_b] + 1, self.heads[b[back_b]]
            left = left[back_a | back_b]
        return out

    def encode_many(self, words: list[str]) -> list[list[int]]:
        """``encode`` of many words at once, a symbol of each at a time. Long words, and those with a symbol without a token, go alone."""
        out: list = [None] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) <= ALONE), key=lambda i: -len(words[i]))
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            for i, ids in zip(some, self._together([words[i] for i in some]), strict=True):
                out[i] = ids
        return [self.encode(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _together(self, words: list[str]) -> list[list[int] | None]:
        """Words in order of length, the longest first."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        most = int(lengths[0]) if n else 0
        symbols = np.zeros((most, n), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols[row, np.repeat(np.arange(n), lengths)] = flat
        ends, starts = np.zeros((most + 1, n), np.int32), np.zeros((most + 1, n), np.int16)
        nodes, fine = np.zeros(n, np.int32), np.ones(n, bool)
        for k in range(1, most + 1):
            active = int(np.searchsorted(-lengths, -k, "right"))
            nodes[:active] = self.reads(nodes[:active], symbols[k - 1, :active])
            left, at = np.arange(active), self.longest[nodes[:active]]
            fine[left[at == 0]] = False
            left, at = left[at > 0], at[at > 0]
            while len(left):
                token, start = self.token[at], k - self.width[at]
                ok = start == 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.follow(ends[start[ask], left[ask]], token[ask])
                ends[k, left[ok]], starts[k, left[ok]] = token[ok], start[ok]
                left, at = left[~ok], self.shorter[at[~ok]]
                fine[left[at == 0]] = False
                left, at = left[at > 0], at[at > 0]
        # backwards from the ends of the words that are fine
        place, left, taken, owners = lengths * fine, np.flatnonzero(fine & (lengths > 0)), [], []
        while len(left):
            taken.append(ends[place[left], left])
            owners.append(left)
            place[left] = starts[place[left], left]
            left = left[place[left] > 0]
        found: list = [[] if x else None for x in fine.tolist()]
        if taken:
            owner = np.concatenate(owners[::-1])
            by_word = np.argsort(owner, kind="stable")
            ids, counts = np.concatenate(taken[::-1])[by_word].tolist(), np.bincount(owner, minlength=n)
            edge = np.r_[0, np.cumsum(counts)].tolist()
            for i in np.flatnonzero(fine).tolist():
                found[i] = ids[edge[i] : edge[i + 1]]
        return found

    SHIFT, END = 0x1000, "</w>"

    def _shifted(self, token: str) -> str:
        return token[: -len(self.END) - 1] + chr(ord(token[-len(self.END) - 1]) + self.SHIFT) if token.endswith(self.END) and len(token) > len(self.END) else token

    def read(self, node: int, symbol: int) -> int:
        """The node after one more symbol; ways over shorter endings are filed."""
        key = node << 16 | symbol
        found = self.goto.get(key)
        if found is None:
            found = self.read(self.back[node], symbol) if node else 0
            if len(self.goto) < 16 * CACHE:
                self.goto[key] = found
        return found

    def _arc(self, x: int, y: int, time: int) -> bool:
        """Whether the state behind x has an arc y after the merges numbered under ``time``."""
        born, cut_at = self.born, self.cut_at
        while True:
            if cut_at.get((x, y), time) < time:
                return False
            if born[x] > born[y]:  # x's state was copied from that behind its tail, as it was then
                time, x = born[x], self.tail[x]
            elif born[y] >= 0:  # the arc y was put beside the arc of its head, its own gadget's cut made
                time, y = born[y] + 1, self.head[y]
            else:
                return True

    def follows(self, x: int, y: int) -> bool:
        key = x << 20 | y
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= 4 * CACHE:
                self.table.clear()
            found = self.table[key] = self._arc(x, y, self.FOREVER)
        return found

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, each character a symbol and the last shifted; symbols without a token are dropped."""
        goto, at_end, table = self.goto, self.at_end, self.table
        ends, starts = [0], [0]  # ends[i]: the token that ends the prefix of i symbols; starts[i]: where it starts
        node = n = 0
        for c in word:
            key = node << 16 | ord(c)
            node = goto[key] if key in goto else self.read(node, ord(c))
            n += 1
            for token, width in at_end[node]:
                start = n - width
                if start:
                    key = ends[start] << 20 | token
                    if not (table[key] if key in table else self.follows(ends[start], token)):
                        continue
                ends.append(token)
                starts.append(start)
                break
            else:
                return self.encode("".join([x for x in word if goto.get(ord(x), 0)]))
        out = []
        while n:
            out.append(ends[n])
            n = starts[n]
        return out[::-1]

    def decode(self, ids) -> str:
        """The labels of the arcs taken, joined as a decoder-less tokenizer joins them."""
        return " ".join([self.labels[i] for i in ids])


#: Letters and numbers that Unicode 17 adds; the tokenizers library splits by Unicode 16.
TOO_NEW = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 "
    "16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)


#: Capitals newer than Python's tables, with their small letters.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CAPITALS |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


class WordBpe:
    """Encoder and decoder for a vocabulary file of the kind `BPE with word ends`: NFC, lower case, white space dropped."""

    #: White space, but not the four separators that Python's ``split`` adds.
    SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
    NEW = regex.compile("[" + "".join(chr(int(a, 16)) + "-" + chr(int(b or a, 16)) for a, _, b in (x.partition("-") for x in TOO_NEW.split())) + "]")
    ODD = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        labels = self.automaton.labels
        labels += [""] * (max([*self.special.values(), -1]) + 1 - len(labels))
        for token, i in self.special.items():
            labels[i] = token
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.mark = os.path.commonprefix(list(self.special))  # a text without it holds no special token
        self.numbers = list(map(str, range(len(labels))))
        self.words: dict[str, tuple[str, str]] = {}
        self.filed: dict[str, tuple[str, str]] = {}  # stretches met, with their ids and labels
        self.held, self.silent = 0, False

    def read(self, word: str) -> str:
        """The symbols of a word, the last one shifted."""
        symbols = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        return symbols[:-1] + chr(ord(symbols[-1]) + Automaton.SHIFT) if self.end else symbols

    def _texts(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(self.numbers.__getitem__, ids)), self.automaton.decode(ids)

    def word(self, word: str) -> tuple[str, str]:
        """Ids and labels of a word, each joined by one space."""
        return self.words.get(word) or self._texts(self.automaton.encode(self.read(word)))

    def meet(self, fresh: set[str]) -> None:
        """File stretches that are new; their words that are new are encoded all at once."""
        new = [(x, self.parted(x)) for x in fresh if len(x) <= LONG]
        words = [w for w in set(chain.from_iterable([x for _, x in new])) - self.words.keys() if len(w) <= ALONE]
        for w, ids in zip(words, self.automaton.encode_many([self.read(w) for w in words]), strict=True):
            self.words[w] = self._texts(ids)
        filed, chunk = self.filed, self.chunk
        for raw, found in new:
            filed[raw] = got = chunk(found)
            self.held += 2 * len(raw) + 2 * len(got[0]) + len(got[1])
            self.silent |= not got[0]

    def many(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """(ids, labels) of whole texts, each joined by one space; null is empty."""
        if self.held + 300 * len(self.filed) > CACHE_BYTES:
            self.filed, self.held, self.silent = {}, 0, False
        if len(self.words) > CACHE:
            self.words.clear()
        get, out, fresh = self.filed.get, [], set()
        for t in texts:
            if not t:
                out.append(((), ()))
            elif self.parts and self.mark in t and self.parts.search(t):
                out.append(None)
            else:
                stretches = [x for x in self.SPACE.split(t) if x] if self.ODD.search(t) else t.split()
                found = list(map(get, stretches))
                if None in found:
                    fresh.update([x for x, got in zip(stretches, found, strict=True) if got is None])
                out.append((stretches, found))
        self.meet(fresh)
        return [self._special(t) if x is None else self._joined(*x) for t, x in zip(texts, out, strict=True)]

    def _joined(self, stretches, found) -> tuple[str, str]:
        if None in found:
            get = self.filed.get
            found = [got or get(x) or self.chunk(self.parted(x)) for x, got in zip(stretches, found, strict=True)]
        if self.silent:
            found = [x for x in found if x[0]]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def _special(self, text: str) -> tuple[str, str]:
        """The same of a text with special tokens."""
        parts = self.parts.split(text)
        plain = iter(self.many([x for x in parts if x not in self.special]))
        got = [(str(self.special[x]), x) if x in self.special else next(plain) for x in parts]
        return " ".join([x[0] for x in got if x[0]]), " ".join([x[1] for x in got if x[0]])

    def chunk(self, words: list[str]) -> tuple[str, str]:
        """Ids and labels of the words of a stretch."""
        got = [self.words.get(w) or self.word(w) for w in words]
        if len(got) == 1:
            return got[0]
        if len(got) == 2 and got[0][0] and got[1][0]:
            (ids, labels), (more, last) = got
            return f"{ids} {more}", f"{labels} {last}"
        return " ".join([x[0] for x in got if x[0]]), " ".join([x[1] for x in got if x[0]])

    def parted(self, raw: str) -> list[str]:
        """The words of a stretch without white space."""
        # letters up to U+024F, with one sign at most behind them, are in normal form already
        body, tail = (raw[:-1], raw[-1]) if raw[-1] in ".,;:!?" else (raw, "")
        if body.isalpha() and (body.isascii() or max(body) < "\u0250"):
            low = body.lower()
            if low.isalpha():
                return [low, tail] if tail else [low]
        text = unicodedata.normalize("NFC", raw)
        # Lower case letter by letter: a sigma at a word's end stays the common one.
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        text = text if text.isascii() else text.translate(NEW_CAPITALS)
        # The library takes characters that its Unicode version does not know for neither letters nor numbers.
        known = text if text.isascii() else self.NEW.sub("\uffff", text)
        return [text[m.start() : m.end()] for m in self.split.finditer(known)]

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.many([text])[0][0].split()))

    def decode(self, ids) -> str:
        return self.automaton.decode(ids)


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One compiled automaton for each Python worker."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and decode it again.

    Columns: doc_id, n_tokens and either ids (array) and decoded (string), or with ``digests`` ids_sha256 and
    decoded_sha256. Null and empty texts have no tokens and an empty decoding. Rows go one by one in Arrow batches, so
    memory is bounded by a batch, repeated rows get equal results, and nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in sliced(batches, SLICE):
            counts, first, second = [], [], []
            for ids, labels in bpe.many(batch.column(1).to_pylist()):
                counts.append(ids.count(" ") + 1 if ids else 0)
                first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else np.fromstring(ids, np.int32, sep=" "))
                second.append(hashlib.sha256(labels.encode("utf-8", "surrogatepass")).hexdigest() if digests else labels)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, {rest}")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return compact(encode_documents(table(spark, sf_dir, "documents"), default_path(), digests=True))
