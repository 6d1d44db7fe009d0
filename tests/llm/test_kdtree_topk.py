import math
import random

import numpy as np

from tidemark.llm import kdtree_topk as t


def brute(rows, k=5, every=50):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(fine):
        if q is not None and q % every == 0:
            clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            hits = [(-clip(sum(m * n for m, n in zip(x, y))), i is None, i or 0, i) for b, (i, y) in enumerate(fine) if a != b and len(x) == len(y)]
            out += [(q, n + 1, h[3], -h[0]) for n, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k])]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row int, dim int")
    return sorted((tuple(r) for r in t.top_k(df, **more).collect()), key=str)


def test_matches_brute_force_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [round(rng.random()) / 4 for _ in range(8)]) for i in range(300)]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (None, rows[3][1]), (2000, [1.0, 2.0]), (2001, [1.0, 1.0])]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, shard_rows=90, block_rows=7, lane=3) == want


def test_edges(spark):
    rows = [(0, None), (50, []), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, [1.0, 1.0]), (3, [2.0, -1.0]), (4, [1e300, 1.0]), (300, [1e200, -1e300])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(50, [1.0])]) == []


def test_search_is_best_first_and_prunes():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 400, (30, 6))
    points = np.floor(np.concatenate([c + rng.normal(0, 8, (300, 6)) for c in centres]))
    ids = rng.permutation(len(points)).astype(np.int64)
    tree = t.Tree.build(points, ids, ids)
    again = t.Tree.load(6, *tree.packed().values())
    assert (again.points == tree.points).all() and (again.low == tree.low).all() and (again.nodes == tree.nodes).all()
    for first, end, left, right in tree.nodes.tolist():  # boxes are tight at every node, children share out their parent
        node = tree.nodes.tolist().index([first, end, left, right])
        assert (tree.low[node] == tree.points[first:end].min(0)).all() and (tree.high[node] == tree.points[first:end].max(0)).all()
        if left >= 0:
            assert (tree.nodes[left][0], tree.nodes[right][1], tree.nodes[left][1]) == (first, end, tree.nodes[right][0])
    queries = np.floor(centres[:10])
    none = np.empty(0, np.int64)
    best = [(none, none, none)] * 10
    leaves = int((tree.nodes[:, 2] < 0).sum())
    opened = t.search(again, queries, np.full(10, -1), best, np.full(10, -np.inf), 5)
    for q, (scores, hits, _) in zip(queries, best):
        every = sorted(((-int(p @ q), int(i)) for p, i in zip(tree.points, tree.ids)))[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, hits)] == every
    assert opened < 0.2 * leaves * 10, (opened, leaves)
    floors = np.array([b[0][-1] for b in best], float)
    assert t.search(again, queries, np.full(10, -1), [(none, none, none)] * 10, floors, 5) <= opened  # a known k-th score helps
