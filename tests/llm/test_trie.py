"""The prefix trie against a plain one, at production sizes and with bands, ranges and groups so small that all of them are many."""

import hashlib
import random
import re
import zlib

import pytest

from parley.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth long, band int, ids string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def plain(rows):
    turns = rebuilt(rows)
    members = {}
    for c, x in turns.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[k] for k in kids.get(p, [])]
        saved = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        total[p] = (sum(x for x, _ in below) or 1, saved + sum(y for _, y in below))
    found = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(turns[c]) == len(p)))
        found.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def got(spark, tmp_path, turns, **sizes):
    spark.createDataFrame([(*r, 1, 2, "x") for r in turns], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    df = trie.op11_conversation_trie(spark, str(tmp_path), **sizes).select(*trie.NODE)
    return sorted(map(tuple, df.collect()), key=str)


def talk(seed, n=60, most=9, texts=4):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            rows.append((c, t, r.choice(["user", "assistant"]), "w " * r.randrange(texts)))
    r.shuffle(rows)
    return rows


ODD = [
    (-5, 1, "user", "a"), (-5, 2, None, "b"), (-45, None, "user", None), (-45, 1, "user", ""), (7, 3, "u", "same"), (7, 3, "u", "same"), (7, 3, "t", "same"), (7, None, None, None),
    (None, 1, "user", "nobody"), (1000003, 1, "user", "no base"), (1000005, 1, "user", "no base"), (1000005, 2, "user", "no base"), (20, 5, "user", "x " * 30000), (21, 1, "user", "ü\x0b\x1c y"), (22, 1, "", "user"), (23, 1, "user", ""),
]


@pytest.mark.parametrize("sizes", [{}, {"band": 3, "rows": 9, "stitch": 2}])
def test_random_and_odd_conversations(spark, tmp_path, sizes):
    rows = talk(1) + ODD
    assert got(spark, tmp_path, rows, **sizes) == plain(rows)


def test_long_conversations_and_many_copies(spark, tmp_path):
    """One conversation of hundreds of turns, others that leave it on the way, and a third of all alike; ranges cut through all of them."""
    long = [(0, t, "user", f"t{t}") for t in range(300)]
    rows = list(long)
    for c in range(20, 20 + 20 * 15, 20):  # ids divisible by 20 keep their own turns
        rows += [(c, t, "user", f"t{t}") for t in range(c)] + [(c, 900, "user", f"end {c % 3}")] * (c % 40 == 0)
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 4000, 20) for t in range(3)]
    want = plain(rows)
    assert got(spark, tmp_path, rows) == want
    assert got(spark, tmp_path, rows, band=7, rows=11, stitch=2) == want


def test_few_held_nodes_and_small_batches(spark, tmp_path, monkeypatch):
    """Nodes that are sent before their parents are closed find them afterwards: a sweep in this process, with next to nothing held."""
    import pyarrow as pa

    monkeypatch.setattr(trie, "HELD", 2)
    r = random.Random(3)
    keys = sorted(b"".join(r.choice([b"a", b"b", b"c"]) * trie.WIDTH for _ in range(r.randrange(5))) for _ in range(80))
    rows = [{"pid": 0, "band": 0, "seg": b"", "key": k, "words": [1] * (len(k) // trie.WIDTH), "conv": i, "goes_on": False, "kids": 1, "leaves": 0, "saved": 0} for i, k in enumerate(keys)]
    swept = [x for b in trie.sweep_arrays(64)(iter([pa.RecordBatch.from_pylist(rows[:30]), pa.RecordBatch.from_pylist(rows[30:])])) for x in b.to_pylist()]
    paths = [dict(x, grp=0) for x in sorted((x for x in swept if x["kind"] == "path"), key=lambda x: x["pid"])]
    swept += [x for b in trie.sweep_paths(64, True)(iter([pa.RecordBatch.from_pylist(paths, schema=trie._ARROW.append(pa.field("grp", pa.int64())))])) for x in b.to_pylist()]
    least = {x["id"]: x["conv_id"] for x in swept if x["kind"] == "lookup"}
    nodes = [x for x in swept if x["kind"] == "node"]
    assert len(nodes) == len({k[: d * trie.WIDTH] for k in keys for d in range(len(k) // trie.WIDTH + 1)})
    assert any(x["parent"] for x in nodes) and all(x["parent"] in least for x in nodes if x["parent"])
    by = {}
    for i, k in enumerate(keys):
        for d in range(len(k) // trie.WIDTH + 1):
            by.setdefault(k[: d * trie.WIDTH], []).append(i)
    want = sorted((len(k) // trie.WIDTH, m[0], by[k[: -trie.WIDTH]][0] if k else -1, len(m)) for k, m in by.items())
    assert sorted((x["depth"], x["conv_id"], -1 if not x["depth"] else x["parent_conv_id"] if x["parent"] is None else least[x["parent"]], x["n_convs"]) for x in nodes) == want


def test_no_conversations(spark, tmp_path):
    assert got(spark, tmp_path, []) == [] and got(spark, tmp_path, [(None, 1, "u", "t")]) == []
