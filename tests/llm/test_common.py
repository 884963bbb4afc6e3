"""Components against a plain search, and the word count."""

import random

from parley.llm.common import components, word_count


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4040)] + [(7, 7), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_count(spark):
    texts = [None, "", " \x0b\x0c", "a b c\x1cd", "x\ty\nz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count("t").alias("n")).collect()
    assert [r["n"] for r in got] == [0, 0, 0, 2, 3]
