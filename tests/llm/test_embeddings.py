"""Links and neighbours against all pairs in double precision."""

import numpy as np

from parley.llm import embeddings as e


def vectors(n=400, dims=16, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = r.standard_normal(dims)
        if i % 3 == 0:
            v = np.eye(dims)[i % 6] + 0.1 * r.standard_normal(dims)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, [2.0 * x for x in rows[5][1]]), (1, rows[1][1])]
    bad = [None, [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), []]
    return rows, [(3000 + 50 * i, v) for i, v in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, links string")


def unit(v):
    v = np.array(v, float)
    return v / np.sqrt((v * v).sum())


def test_links_against_all_pairs(spark):
    rows, bad = vectors()
    got = e.near_vectors(frame(spark, rows + bad), block=32).collect()
    assert len(got) == len(rows) + len(bad)
    x = np.stack([unit(v) for _, v in rows])
    close = x @ x.T >= 0.95
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        p, q = find(rows[a][0]), find(rows[b][0])
        parent[max(p, q)] = min(p, q)
    want = sorted((i, int(close[k].sum()) - 1, find(i), i == find(i)) for k, (i, _) in enumerate(rows))
    want += [(i, 0, i, True) for i, _ in bad]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted(want)


def test_nearest_against_all_rows(spark):
    rows, bad = vectors()
    got = e.nearest(frame(spark, rows + bad)).collect()
    hits = total = 0
    x = {}
    for i, v in rows:
        x.setdefault(i, unit(v))
    for i in sorted(x):
        if i % 50 == 0:
            scores = sorted(((-float(u @ x[i]), j) for j, u in ((j, unit(v)) for j, v in rows) if j != i))[:5]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
            assert all(abs(s - float(x[i] @ x[j])) < 1e-12 for _, j, s in mine)
            hits += len({j for _, j in scores} & {m[1] for m in mine})
            total += 5
    assert {r["query_id"] for r in got} == {i for i in x if i % 50 == 0}
    assert hits / total >= 0.9


def clustered(n=3000, dims=32, groups=150, seed=9):
    r = np.random.default_rng(seed)
    middles = e.unit(r.standard_normal((groups, dims)))
    return e.unit(middles[r.integers(0, groups, n)] + 0.06 * r.standard_normal((n, dims)))


def test_prefixes_first_and_the_rest_asks_all(spark, monkeypatch):
    """With small cells the clustered queries are done by prefixes alone, far ones ask everything; recall holds for both."""
    monkeypatch.setattr(e, "CELL_ROWS", 24)
    monkeypatch.setattr(e, "SHARD_ROWS", 600)
    r = np.random.default_rng(3)
    x = np.concatenate([clustered(2000), e.unit(r.standard_normal((200, 32)))])
    asked = []
    real = e._ask_all
    monkeypatch.setattr(e, "_ask_all", lambda d, q, *rest: asked.append(q.count()) or real(d, q, *rest))
    got = e.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), every=10).collect()
    hits = total = 0
    for i in range(0, len(x), 10):
        scores = x @ x[i]
        want = {j for j in np.lexsort([np.arange(len(x)), -scores]).tolist() if j != i}
        top = [j for j in np.lexsort([np.arange(len(x)), -scores]).tolist() if j != i][:5]
        mine = sorted((q["rank"], q["vec_id"], q["score"]) for q in got if q["query_id"] == i)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and len({m[1] for m in mine} & want) == 5
        assert all(abs(m[2] - scores[m[1]]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & set(top))
        total += 5
    assert hits / total >= 0.9
    assert asked and 0 < asked[0] < 0.5 * len(range(0, len(x), 10))


def test_few_rows_are_met_on_clustered_vectors(spark, monkeypatch):
    """Through the search itself: nine of ten neighbours at cosines with under a fifth of the rows, by cells and by one shard alike."""
    x = clustered(6000, 64, 400)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for cell in (64, 1 << 20):
        monkeypatch.setattr(e, "CELL_ROWS", cell)
        got = e.nearest(df, every=100, effort=True).collect()
        hits = sum(q["vec_id"] in set(np.argsort(-(x @ x[q["query_id"]]))[:6].tolist()) for q in got)
        met = {q["query_id"]: q["met"] for q in got}
        assert hits / 300 >= 0.9 and sum(met.values()) / 60 / len(x) < 0.2


def test_a_forest_meets_few_rows_where_neighbours_are_near():
    """On clustered vectors under a fifth of the rows are met at a recall of 0.9 and more; on scattered ones as many as it takes."""
    for x, share in ((clustered(8000, 64, 400), 0.2), (e.unit(np.random.default_rng(2).standard_normal((4000, 64))), 1.0)):
        hits, met = 0, 0
        for i, at, scores in e.PrefixForest(x, 24, 5).search(x[:60], np.full(60, -1.0), 6, 256):
            best = set(np.argsort(-(x @ x[i]))[:6].tolist())
            hits += len(best & set(at[np.argsort(-scores)[:6]].tolist()))
            met += len(at)
        assert hits / 360 >= 0.9 and met / 60 / len(x) < share


def test_copies_come_in_the_order_of_ids_and_few_rows(spark):
    v = [1.0, 2.0]
    got = e.nearest(frame(spark, [(i, v) for i in range(0, 20)] + [(100, [1.0, 0.0])])).collect()
    first = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert first == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    few = e.nearest(frame(spark, [(0, v), (1, v), (2, [3.0, 1.0])])).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few)] == [(1, 1), (2, 2)]


def test_empty_and_all_unusable(spark):
    assert e.near_vectors(frame(spark, [])).count() == 0
    assert e.nearest(frame(spark, [])).count() == 0
    assert e.near_vectors(frame(spark, [(1, None)])).collect()[0]["kept"]


def test_near_copies_do_not_double_at_every_split():
    r = np.random.default_rng(0)
    x = e.unit(np.ones((2000, 8)) + 1e-3 * r.standard_normal((2000, 8)))
    forest = e.Forest(x, 2, 64, 0.02, 1)
    assert len(forest.reach(x)[0]) <= 3 * 2 * len(x)


def test_null_ids_and_ids_that_repeat(spark):
    v = [1.0, 2.0]
    got = e.near_vectors(frame(spark, [(None, v), (4, v), (4, v), (4, None), (None, None)])).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (4, 0, 4), (None, 0, None)], key=str)


def test_null_ids_and_large_ids_keep_their_links(spark):
    """Three vectors, two without an id, all alike but not equal; and two ids that doubles do not tell apart, beside a null one."""
    rows = [(None, [1.0, 0.001]), (4, [1.0, 0.002]), (None, [1.0, 0.003])]
    got = e.near_vectors(frame(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == [(4, 2, 4, True), (None, 2, 4, False), (None, 2, 4, False)]
    big = 2**53
    got = e.near_vectors(frame(spark, [(big + 1, [1.0, 0.001]), (big + 3, [1.0, 0.002]), (None, [0.0, 1.0])])).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted([(big + 1, 1, big + 1), (big + 3, 1, big + 1), (None, 0, None)], key=str)


def test_a_query_row_that_repeats_asks_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(i, [1.0, 0.1 * i]) for i in range(1, 9)]
    got = sorted((r["rank"], r["vec_id"]) for r in e.nearest(frame(spark, rows)).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_leaves_hold_as_much_at_any_size(spark):
    """Recall of planted pairs just over the bound, with leaves far smaller than the table."""
    r = np.random.default_rng(4)
    x = e.unit(r.standard_normal((3000, 32)))
    noise = e.unit(r.standard_normal((300, 32)))
    noise = e.unit(noise - (noise * x[:300]).sum(axis=1, keepdims=True) * x[:300])
    y = 0.951 * x[:300] + np.sqrt(1 - 0.951**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {q["vec_id"]: q["n_links"] for q in e.near_vectors(frame(spark, rows), leaf=100).collect()}
    assert sum(got[3000 + i] > 0 for i in range(300)) >= 294


def test_large_leaves_are_split_over_all_rows(spark, monkeypatch):
    """Trees of a sample of 60 rows have leaves far too large: split on, they hold at most 200 rows, but for those with near copies."""
    r = np.random.default_rng(6)
    x = e.unit(r.standard_normal((1500, 16)))
    dense = e.unit(np.ones((300, 16)) + 1e-4 * r.standard_normal((300, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, dense]))]
    df = spark.createDataFrame([(0, i, 1, v) for i, v in rows], "leaf long, class_id long, copies long, embedding array<double>")
    leaves = e._split_further(df, 200, 0.02, 3).groupBy("leaf").agg({"class_id": "count"}).collect()
    sizes = sorted(x[1] for x in leaves)
    assert sizes[-1] <= 600 and len(sizes) >= 8 and sum(n > 200 for n in sizes) <= 3  # what holds the near copies
    monkeypatch.setattr(e, "FIT_ROWS", 60)
    monkeypatch.setattr(e, "LEAST_LEAF", 30)
    got = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in e.near_vectors(frame(spark, rows), leaf=40, block=64).collect()}
    close = np.concatenate([x, dense]) @ np.concatenate([x, dense]).T >= 0.95
    want = close.sum(axis=1) - 1
    assert sum(got[i][0] == int(want[i]) for i in range(len(rows))) >= 0.98 * len(rows)
    assert {got[i] for i in range(1500, 1800)} == {(int(want[1500]), got[1500][1])}


def test_copies_and_recall_at_real_dimensions():
    """Trees as deep as a million vectors ask for: under three copies in a tree, nine of ten links just over the bound in a common leaf."""
    for dims, rows in ((768, 8192), (1536, 4096)):
        r = np.random.default_rng(dims)
        x, turn = e.unit(r.standard_normal((rows, dims))), e.unit(r.standard_normal((200, dims)))
        turn = e.unit(turn - (turn * x[:200]).sum(axis=1, keepdims=True) * x[:200])
        near = 0.951 * x[:200] + np.sqrt(1 - 0.951**2) * turn
        forest = e.Forest(x, 6, 1024 * rows // 1_000_000 or 4, e.link_spill(0.95, dims, 0.32), 11, e.spill_share(1_000_000, 1024))
        row, leaf = forest.reach(np.concatenate([x[:200], near]))
        assert len(row) / 6 / 400 < 3
        own = [set() for _ in range(400)]
        for i, at in zip(row, leaf, strict=True):
            own[i].add(int(at))
        assert np.mean([bool(own[i] & own[200 + i]) for i in range(200)]) >= 0.9


def test_wide_vectors_with_small_leaves(spark):
    """Thousands of copies of wide vectors leave a worker in slices."""
    r = np.random.default_rng(2)
    x = e.unit(r.standard_normal((1000, 1024))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:20] + np.float32(1e-4)]))]
    got = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in e.near_vectors(frame(spark, rows), leaf=64).collect()}
    assert sum(got[1000 + i] == (1, i) for i in range(20)) >= 19 and sum(n for n, _ in got.values()) <= 40
