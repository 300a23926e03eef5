"""The reference's synthetic cases (see FIXTURES.md, A) and properties of the sequential operators."""

import itertools
import math

import numpy as np
import pytest

from mensura.operators import curve, graph, match, raster


def points(*p):
    return [{"x": a[0], "y": a[1], "score": a[2] if len(a) > 2 else 1.0} for a in p]


@pytest.fixture
def line():
    m = np.zeros((24, 24), bool)
    m[12, 3:21] = True
    return m


@pytest.fixture
def fork():
    m = np.zeros((25, 25), bool)
    for k in range(9):
        m[12 - k, 12 - k] = m[12 - k, 12 + k] = True
    m[12:22, 12] = True
    return m


@pytest.fixture
def masks():
    shoot, root = np.zeros((25, 25), bool), np.zeros((25, 25), bool)
    shoot[:14], root[11:] = True, True
    return shoot, root


def regions(g):
    for n in g["nodes"]:
        n["region"] = "seed_base_root" if n["y"] > 14 else "shoot"
    return g


def test_line_graph(line):
    g = graph.point_graph(line, points((3, 12), (20, 12)), 24, 0.05)
    assert (len(g["nodes"]), len(g["edges"]), int(g["union"].sum()), g["coverage"]) == (2, 1, 18, 1.0)


@pytest.mark.parametrize("given", [(), ((10, 12),)])
def test_no_structure_without_points(line, given):
    g = graph.point_graph(line, points(*given), 24, 0.05)
    assert not g["edges"] and not g["union"].any() and g["coverage"] == 0


def test_far_point_is_rejected(line):
    g = graph.point_graph(line, points((3, 12), (20, 3)), 24, 0.05)
    assert (len(g["nodes"]), len(g["rejected"]), len(g["edges"])) == (1, 1, 0)


def test_duplicate_projection_keeps_the_better(line):
    g = graph.point_graph(line, points((8, 11.9, 0.2), (8.1, 12.1, 0.9), (20, 12)), 24, 0.05)
    assert (len(g["nodes"]), g["merged"], g["nodes"][0]["score"]) == (2, 1, 0.9)


def test_fork_and_leave_one_out(fork):
    tips = points((4, 4), (20, 4), (12, 21))
    g = graph.point_graph(fork, tips, 25, 0.05)
    assert len(g["edges"]) == 2 and g["union"].sum() > graph.point_graph(fork, tips[::2], 25, 0.05)["union"].sum()
    drops = graph.leave_one_out(fork, tips, 25, 0.05)
    assert len(drops) == 3 and all(d["drop"] > 0 for d in drops)


def lowest(g):
    return max(g["nodes"], key=lambda n: n["y"])["node"]


def test_straight_shoot(masks):
    m = np.zeros((25, 25), bool)
    m[3:22, 12] = True
    g = regions(graph.point_graph(m, points((12, 21), (12, 3)), 25, 0.05))
    out = graph.organ_paths(g, lowest(g), masks[0], 25)
    assert [p["kind"] for p in out["paths"]] == ["main_axis"] and out["failure"] == "" and out["base"] == lowest(g)


def test_fork_paths_and_missing_tip(fork, masks):
    three = regions(graph.point_graph(fork, points((4, 4), (20, 4), (12, 21)), 25, 0.05))
    two = regions(graph.point_graph(fork, points((4, 4), (12, 21)), 25, 0.05))
    assert [p["kind"] for p in graph.organ_paths(three, lowest(three), masks[0], 25)["paths"]] == ["main_axis", "lateral_branch"]
    assert len(graph.organ_paths(two, lowest(two), masks[0], 25)["paths"]) == 1


def test_pruning_modes():
    m = np.zeros((45, 45), bool)
    m[8:42, 22] = True
    for k in range(9):
        m[22 - k, 22 + k] = True
    shoot = np.zeros_like(m)
    shoot[:34] = m[:34]
    shoot = raster.dilate(shoot, 1)
    g = graph.point_graph(m, points((22, 41, 0.9), (22, 8, 0.9), (30, 14, 0.9)), 400, 0.05)
    for n in g["nodes"]:
        n["region"] = "seed_base_root" if n["y"] > 34 else "shoot"
    assert len(graph.organ_paths(g, lowest(g), shoot, 400)["paths"]) == 1
    local = graph.organ_paths(g, lowest(g), shoot, 400, mode="local_learned_support")
    assert len(local["paths"]) == 2 and local["decisions"][0]["reason"] == "accepted"
    with pytest.raises(ValueError):
        graph.organ_paths(g, lowest(g), shoot, 400, mode="other")


def test_spur_pruning():
    m = np.zeros((40, 40), bool)
    m[5:35, 20] = True
    for k in range(12):
        m[20 - k, 20 + k] = True
    m[27, 21:24] = True
    out, info = graph.pruned(m, 4)
    assert not out[27, 22:24].any() and out[5, 20] and out[34, 20] and out[9, 31] and info["removed"] >= 2


def test_rooted_paths(fork):
    paths, failure = graph.rooted_paths(fork, (12, 21), np.zeros((0, 2)), 25)
    assert failure == "" and [p["kind"] for p in paths] == ["main_axis", "lateral_branch"]
    assert tuple(paths[0]["points"][0]) == (12, 21)
    assert graph.rooted_paths(np.zeros((5, 5), bool), (0, 0), np.zeros((0, 2)), 7) == ([], "skeleton_too_small")
    traits = {(t["x"], t["y"]): t for t in graph.end_traits(fork, raster.dilate(fork, 1))}
    assert set(traits) == {(4, 4), (20, 4), (12, 21)}
    assert traits[12, 21]["stub"] == 9 and traits[12, 21]["width"] == traits[12, 21]["width"] > 0
    assert traits[4, 4]["far"] == pytest.approx(16 * math.sqrt(2))


def test_spline_stays_in_the_box_and_near_in_length():
    p = np.array([[0, 0], [5, 1], [10, 0], [10, 10], [3, 14], [0, 20], [1, 25]], float)
    q = curve.pchip(p)
    assert (q >= p.min(0) - 1e-9).all() and (q <= p.max(0) + 1e-9).all() and len(q) == 240
    assert curve.polyline_length(q) <= 1.1 * curve.polyline_length(p)


def test_simplify_is_strict():
    assert curve.simplify(np.array([[0, 0], [5, 1.5], [10, 0]], float), 1.5).tolist() == [0, 2]
    assert curve.simplify(np.array([[0, 0], [5, 1.6], [10, 0]], float), 1.5).tolist() == [0, 1, 2]


def test_support_merges_close_indices():
    p = np.column_stack([np.arange(30.0), np.zeros(30)])
    out = curve.adaptive_support(p, np.array([[10.0, 0], [11.0, 0], [20.0, 0]]), 100)
    assert [r["index"] for r in out] == [0, 10, 20, 29] and out[1]["evidence"] == {"candidate_0", "candidate_1"}


def test_curve_measures():
    m = curve.curve_measures(np.array([[0, 0], [3, 0], [3, 4]], float))
    assert m["length"] == 7 and m["chord"] == 5 and math.isclose(m["turning"], 90)
    assert math.isnan(curve.divergence_angle(np.zeros((1, 2)), np.ones((2, 2))))


@pytest.mark.parametrize("shape", [(3, 3), (4, 6), (6, 4), (1, 5), (5, 1)])
def test_assignment_is_optimal(shape):
    r = np.random.default_rng(1)
    n, m = shape
    for _ in range(10):
        c = r.random(shape)
        a, b = match.hungarian(c)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert math.isclose(c[a, b].sum(), best) and len(set(a)) == len(set(b)) == min(shape)


def test_tolerance_acts_after_assignment():
    a, b = np.array([[0.0, 0], [0.0, 2.0]]), np.array([[0.0, 1.9], [0.0, 100.0]])
    assert len(match.assigned(a, b, 2.5)) == 1
    assert match.score(0, 0, [])["f1"] == 1 and match.score(1, 0, [])["f1"] == 0 and math.isnan(match.score(0, 2, [])["error"])


def test_raster_properties():
    m = np.zeros((40, 40), bool)
    m[5:35, 15:25] = True
    hole = m.copy()
    hole[15:20, 18:21] = False
    assert (raster.filled(hole) == m).all() and raster.distance_inside(m).max() == 5
    s = raster.skeleton(m)
    assert raster.label(s)[1] == 1 and s.sum() < 40 and (m | ~s).all()
    flip = np.array([[-1, 0, 39], [0, 1, 0]], float)
    assert raster.warp_mask(m, flip).sum() == m.sum()
    assert (raster.opened(m, 2) == m).all() and (raster.closed(hole, 3) >= hole).all()
    two = m.copy()
    two[0, 0] = True
    assert raster.largest(two).sum() == m.sum() and raster.at_least(two, 5).sum() == m.sum() and raster.linked(two, ~m).sum() == 1
    image = np.full((30, 60, 3), 7, np.uint8)
    out, mapping = raster.letterbox_pixels(image, 224)
    assert out.shape == (224, 224, 3) and mapping["pad_y"] == 56 and (out[:50] == 255).all()
    assert (raster.whiten(image, np.zeros((30, 60), bool)) == 255).all()


def test_structural_support():
    m = np.zeros((60, 60), bool)
    m[10:50, 25:33] = True
    support, skel = raster.structural_support(m)
    assert support.sum() >= m.sum() and raster.label(skel)[1] == 1


def test_mask_queries_take_every_pixel_and_point(spark, tmp_path):
    from mensura.plans import geometry

    r = np.random.default_rng(7)
    v = [[0.0] * 4 + (r.random(2) * 0.1 - 0.52).round(3).tolist() + [0.0] * 4 for _ in range(15)]  # x and y from -4 to 16
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    at = [(round(x[4] * 200 + 100, 6), round(x[5] * 200 + 100, 6)) for x in v]

    def dilated(k, by=20):
        m = np.zeros((60, 60), bool)
        for x, y in at:
            m[math.floor(y) + by - k : math.floor(y) + by + k + 1, math.floor(x) + by - k : math.floor(x) + by + k + 1] = True
        return m

    skel = raster.skeleton(dilated(3))
    want = sorted((int(x) - 20, int(y) - 20) for y, x in zip(*np.nonzero(skel)))
    assert sorted((p["x"], p["y"]) for p in geometry.mask_skeleton(spark, str(tmp_path)).collect()) == want
    got = geometry.mask_components(spark, str(tmp_path)).collect()
    assert sum(g["pixels"] for g in got) == int(dilated(2).sum())
    ys, xs = np.nonzero(skel)
    diagonal = math.hypot(xs.max() - xs.min() + 1, ys.max() - ys.min() + 1)
    given = points(*[(x + 20, y + 20) for x, y in sorted(at)])
    for g in geometry.point_conditioned_sweep(spark, str(tmp_path)).collect():
        w = graph.point_graph(skel, given, diagonal, g["ratio"])
        assert (g["nodes"], g["rejected"], g["merged"], g["edges"]) == (len(w["nodes"]), len(w["rejected"]), w["merged"], len(w["edges"]))
        assert g["coverage"] == pytest.approx(w["coverage"])
        assert g["nodes"] + g["rejected"] + g["merged"] == len(v)


def test_masks_are_not_broadcast(spark):
    """A grown mask has many times the rows that the planner expects."""
    from mensura.plans import measures

    plan = measures.point_regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_heatmap_points_are_dealt_over_tasks(spark):
    """A small file of points made one task of all cells."""
    from mensura.operators import raster

    rows = spark.range(12_000).selectExpr("id % 300 AS item", "id % 190 * 1.0D AS x", "id % 170 * 1.0D AS y", "1.0D AS confidence").coalesce(1)
    h = raster.heatmap(rows, 2.0, 200, 200)
    assert h.rdd.getNumPartitions() == 3 and h.groupBy("item", "gx", "gy").count().filter("count > 1").isEmpty()
