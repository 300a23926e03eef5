"""Operators in rounds over tables against their sequential rules."""

import math
import random

import pytest

from mensura.operators import graph, keypoints, match


def places(rng, items=4, n=120):
    rows = []
    for i in range(items):
        for k in range(n if i else 1):
            x, y = (rng.gauss(0, 3), rng.gauss(0, 3)) if i % 2 else (float(rng.randrange(12)), float(rng.randrange(12)))
            rows.append((i, k, x, y, rng.choice([0.1, 0.5, 0.5, rng.random()]), rng.choice(["endpoint", "corner", "junction", "basal_transition"])))
    return rows


SCHEMA = "item int, k int, x double, y double, score double, kind string"


@pytest.mark.parametrize("radius", [0.7, 2.0])
def test_suppression_equals_the_sequential_rule(spark, radius):
    rows = places(random.Random(1))
    rows += [(9, k, k * 0.5, 0.0, k / 100, "corner") for k in range(60)]  # ever better along a line
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for i in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[4], r[3], r[2])):
            if all(math.hypot(r[2] - q[2], r[3] - q[3]) >= radius for q in kept):
                kept.append(r)
        want += [(i, r[2], r[3], r[4], k + 1) for k, r in enumerate(kept)]
    got = match.suppressed(df, "item", radius).collect()
    assert sorted((r["item"], r["x"], r["y"], r["score"], r["rank"]) for r in got) == sorted(want)
    few = match.suppressed(df, "item", radius, most=3).collect()
    assert sorted((r["item"], r["rank"]) for r in few) == sorted((w[0], w[4]) for w in want if w[4] <= 3)
    assert match.suppressed(df.limit(0), "item", radius).count() == 0


def test_coverage_equals_the_sequential_rule(spark):
    rows, radius = places(random.Random(2)), 1.0
    want = []
    for i in {r[0] for r in rows}:
        kept = []
        first = {"basal_transition": 0, "endpoint": 1}
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (first.get(r[5], 2), -r[4], r[5], r[3], r[2])):
            near = [q for q in kept if (q[0][2] - r[2]) ** 2 + (q[0][3] - r[3]) ** 2 <= radius**2]
            if near:
                near[0][1].add(r[5])
            else:
                kept.append((r, {r[5]}))
        want += [(i, r[2], r[3], r[5], r[4], sorted(roles)) for r, roles in kept]
    got = keypoints.cover(spark.createDataFrame(rows, SCHEMA), "item", radius).collect()
    assert sorted((r["item"], r["x"], r["y"], r["kind"], r["score"], r["roles"]) for r in got) == sorted(want)


def test_greedy_matching_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    a, b = places(rng, n=40), places(rng, n=50) + [(7, 0, 1.0, 1.0, 1.0, "corner")]
    got = {r["item"]: r for r in match.match_sets(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "item", 1.5, "greedy").collect()}
    assert set(got) == {0, 1, 2, 3, 7}
    for i, r in got.items():
        x, y = (sorted((p[2], p[3]) for p in side if p[0] == i) for side in (a, b))
        pairs, used_a, used_b = [], set(), set()
        for d, p, q in sorted((math.hypot(u[0] - v[0], u[1] - v[1]), p, q) for p, u in enumerate(x) for q, v in enumerate(y)):
            if d <= 1.5 and p not in used_a and q not in used_b:
                used_a.add(p)
                used_b.add(q)
                pairs.append(d)
        n = len(pairs)
        assert (r["n_a"], r["n_b"], r["matches"]) == (len(x), len(y), n)
        assert r["f1"] == pytest.approx(2 * n / (len(x) + len(y))) and (r["error"] is None if not n else r["error"] == pytest.approx(sorted(pairs)[n // 2] if n % 2 else sum(sorted(pairs)[n // 2 - 1 : n // 2 + 1]) / 2))


def random_edges(seed, nodes=60, edges=240, items=3):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(nodes), rng.randrange(nodes), float(rng.choice([1, 1, 2, 3, rng.random()]))) for i in range(items) for _ in range(edges if i else 8)]
    return rows + [(0, None, 3, 1.0), (0, 4, 5, None), (1, 7, 7, 0.0)]


def test_spanning_trees_equal_the_sequential_rule(spark):
    rows = random_edges(4)
    want = []
    for i in {r[0] for r in rows}:
        root = {}

        def find(v, root=root):
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        for w, u, v in sorted({(r[3], r[1], r[2]) for r in rows if r[0] == i and None not in r}):
            if find(u) != find(v):
                root[find(u)] = find(v)
                want.append((i, u, v, w))
    got = graph.spanning_trees(spark.createDataFrame(rows, "item int, a int, b int, w double"), "item", "a", "b", "w").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    path = spark.range(3000).selectExpr("1 AS item", "id AS a", "id + 1 AS b", "double(pmod(id * 7919, 3001)) AS w")
    assert graph.spanning_trees(path, "item", "a", "b", "w").count() == 3000


def test_shortest_ways_equal_the_sequential_rule(spark):
    import heapq

    rows = random_edges(5)
    df = spark.createDataFrame(rows, "item int, a int, b int, w double")
    trees = graph.shortest_trees(df, "item", "a", "b", "w")
    got = {(r["item"], r["node"]): r for r in trees.collect()}
    steps = {}
    for r in graph.path_rows(trees, "item").collect():
        steps.setdefault((r["item"], r["node"]), {})[r["step"]] = r["via"]
    for i in {r[0] for r in rows}:
        near = {}
        for _, u, v, w in (r for r in rows if r[0] == i and None not in r):
            near.setdefault(u, []).append((v, w))
            near.setdefault(v, []).append((u, w))
        best, heap = {}, [(0.0, min(near))]
        while heap:
            d, u = heapq.heappop(heap)
            if u not in best:
                best[u] = d
                for v, w in near[u]:
                    heapq.heappush(heap, (d + w, v))
        assert {n for j, n in got if j == i} == set(best)
        for n, d in best.items():
            r, way = got[i, n], steps[i, n]
            assert r["distance"] == pytest.approx(d, abs=1e-9) and sorted(way) == list(range(r["hops"] + 1)) and way[0] == min(near) and way[r["hops"]] == n
            length = sum(min(w for v, w in near[way[k]] if v == way[k + 1]) for k in range(r["hops"]))
            assert length == pytest.approx(d, abs=1e-9)


def test_simplified_paths_equal_the_sequential_rule(spark):
    import numpy as np

    from mensura.operators import curve

    rng = random.Random(6)
    rows = []
    for i, n in enumerate((1, 2, 3, 40, 400)):
        x = y = 0.0
        for k in range(n):
            x, y = x + rng.random(), y + rng.gauss(0, 1)
            rows.append((i, k, round(x, 3), round(y, 3)))
    rows += [(9, k, float(k % 2), 0.0) for k in range(9)] + [(8, 0, None, 1.0), (8, 1, 2.0, 2.0)]
    got = {}
    for r in curve.simplified_paths(spark.createDataFrame(rows, "p int, o int, x double, y double"), "p", "o", "x", "y", 0.8).collect():
        got.setdefault(r["p"], {})[r["position"]] = (r["x"], r["y"])
    for i in (0, 1, 2, 3, 4, 9):
        p = np.array([r[2:] for r in rows if r[0] == i])
        assert got[i] == {int(k): tuple(p[k]) for k in curve.simplify(p, 0.8)}
    assert got[8] == {0: (2.0, 2.0)}


def test_small_items_take_no_rounds_and_equal_them(spark):
    """Many small graphs are dealt once; rounds over all of them shuffled every edge again and again."""
    import random

    r = random.Random(4)
    rows = [(i, f"n{r.randrange(9)}", f"n{r.randrange(9)}", float(r.randrange(4))) for i in range(300) for _ in range(r.randrange(1, 14))] + [(None, "a", "b", 1.0), (7, None, "b", 1.0)]
    edges = spark.createDataFrame(rows, "item long, a string, b string, w double")
    same = lambda f: sorted(map(tuple, f(graph.LARGE).collect()), key=repr) == sorted(map(tuple, f(5).collect()), key=repr) == sorted(map(tuple, f(0).collect()), key=repr)
    assert same(lambda n: graph.spanning_trees(edges, "item", "a", "b", "w", large=n))
    assert same(lambda n: graph.shortest_trees(edges, "item", "a", "b", "w", large=n))
    assert same(lambda n: graph.path_rows(graph.shortest_trees(edges, "item", "a", "b", "w", large=n), "item", large=n))
