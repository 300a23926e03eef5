"""Masks, regions, structure, roots and bases of drawn plants on pixel tables."""

import math

import numpy as np
import pytest

from mensura.operators import graph, match, plant, raster


def drawn(turn=0, root=True, noise=None):
    """(image, shoot, root, full): a green bar with a leaf, a brown seed and a pale root."""
    image = np.full((60, 100, 3), 225, np.uint8)
    shoot, under = np.zeros((60, 100), bool), np.zeros((60, 100), bool)
    shoot[28:32, 40:90] = True
    shoot[18:28, 65:68] = True
    under[28:31, 10:40] = root
    if noise is not None:
        image[:] = noise.integers(90, 200, (60, 100, 1)) + noise.integers(-4, 5, (60, 100, 3))
    image[shoot], image[under] = (60, 150, 50), (200, 180, 140)
    image[26:33, 32:39][under[26:33, 32:39]] = (140, 80, 30)
    return tuple(np.rot90(m, turn).copy() for m in (image, shoot, under, shoot | under))


def mask_rows(item, m):
    return [(item, int(x), int(y)) for y, x in np.argwhere(m)]


def image_rows(item, image):
    return [(item, x, y, *map(int, image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]


@pytest.fixture(scope="module")
def plants(spark):
    """Turned plants 0 to 3, one without root and seed but with a hint, one with none, one with a leaf behind
    the boundary, one without a shoot."""
    lone = drawn()
    lone[1][2:7, 20:30] = lone[3][2:7, 20:30] = True
    lone[0][2:7, 20:30] = (60, 150, 50)
    many = [drawn(t) for t in range(4)] + [drawn(root=False), drawn(root=False), lone]
    table = lambda k, kind: spark.createDataFrame([r for i, p in enumerate(many) for r in mask_rows(i, p[k])], kind).cache()
    image = spark.createDataFrame([r for i, p in enumerate(many) for r in image_rows(i, p[0])], "item int, x int, y int, r int, g int, b int").cache()
    frames = spark.createDataFrame([(i, p[0].shape[1], p[0].shape[0]) for i, p in enumerate(many)] + [(9, 50, 40)], "item int, width int, height int")
    hints = spark.createDataFrame([(4, 40.0, 30.0), (5, float("nan"), 3.0), (0, 500.0, 10.0), (9, -1.0, 41.0)], "item int, hint_x double, hint_y double")
    return many, image, *[table(k, "item int, x int, y int") for k in (1, 2, 3)], frames, hints


def test_regions_keep_the_shoot_and_leave_the_root(plants):
    many, image, shoot, root, full, frames, hints = plants
    regions, measures = plant.region_of_interest(image, shoot, root, full, frames, hints)
    told = {r["item"]: r for r in measures.collect()}
    inside = {}
    for r in regions.collect():
        inside.setdefault(r["item"], {})[r["x"], r["y"]] = r["transition"]
    for turn, way in enumerate([(1, 0), (0, -1), (-1, 0), (0, 1)]):
        t = told[turn]
        assert t["source"] == plant.SOURCES[0] and t["shoot_retention"] > 0.9 and t["root_overlap"] < 0.2 and t["failure"] is None
        assert t["way_x"] * way[0] + t["way_y"] * way[1] > 0.95 and any(inside[turn].values()) and inside[turn][t["centre_x"], t["centre_y"]]
        assert len(inside[turn]) == len(inside[0])
    assert told[4]["source"] == plant.SOURCES[2] and told[4]["hint_distance"] == 0 and told[4]["shoot_retention"] == 1
    assert told[5]["failure"] == "no start" and told[9]["failure"] == "no shoot" and not {5, 9} & set(inside)
    assert told[6]["repaired"] and told[6]["green_retention"] >= 0.9 > told[6]["green_retention_before"]
    assert told[0]["hint_distance"] is None


def test_hints_are_moved_into_the_frame(plants):
    *_, frames, hints = plants
    assert sorted(tuple(r) for r in plant.hints_within(hints, frames).collect()) == [(4, 40, 30), (9, 0, 39)]


def test_masks_follow_the_background(spark):
    even, noisy = drawn(), drawn(noise=np.random.default_rng(1))
    image = spark.createDataFrame(image_rows(0, even[0]) + image_rows(1, noisy[0]), "item int, x int, y int, r int, g int, b int")
    frames = spark.createDataFrame([(0, 100, 60), (1, 100, 60)], "item int, width int, height int")
    found = {(i, u): np.zeros((60, 100), bool) for i in (0, 1) for u in (True, False)}
    for r in plant.confident(image, frames).collect():
        found[r["item"], r["uniform"]][r["y"], r["x"]] = True
    assert not found[0, False].any() and not found[1, True].any()
    (_, shoot, _, full), m, n = even, found[0, True], found[1, False]
    assert (m & shoot).sum() > 0.95 * shoot.sum() and m.sum() < 1.3 * full.sum()
    assert (n & shoot).sum() > 0.9 * shoot.sum() and (n & ~full).sum() < 0.05 * shoot.sum()


def test_morphology_equals_arrays(spark):
    r = np.random.default_rng(2)
    m = np.pad(r.random((20, 30)) < 0.7, 4)
    df = spark.createDataFrame(mask_rows(0, m), "item int, x int, y int")
    for table, array in ((plant.grown(df, 2), raster.dilate(m, 2)), (plant.shrunk(df, 1), raster.erode(m, 1)), (plant.closed(df, 1), raster.closed(m, 1)), (plant.opened(df, 1), raster.opened(m, 1))):
        assert {(r["x"], r["y"]) for r in table.collect()} == {(int(x), int(y)) for y, x in np.argwhere(array)}
    sizes = np.sort(np.bincount(raster.label(m)[0].reshape(-1))[1:]).tolist()
    assert sorted(r["size"] for r in plant.parts(df).select("component", "size").distinct().collect()) == sizes


def fork_skeleton():
    skel = np.zeros((100, 100), bool)
    skel[50:90, 50] = True
    for k in range(35):
        skel[50 - k, 50 - k] = skel[50 - k, 50 + k] = True
    return skel


def test_line_ends_and_lasting_junctions(spark):
    ends = spark.createDataFrame([(0, 10, 10), (0, 11, 14), (0, 12, 18), (0, 60, 60), (1, 3, 3)], "item int, x int, y int")
    got = plant.line_ends(ends, spark.createDataFrame([(0, 250.0), (1, 10.0)], "item int, diagonal double")).collect()
    assert sorted((r["item"], r["x"], r["y"]) for r in got) == [(0, 11, 14), (0, 60, 60), (1, 3, 3)]
    skel = fork_skeleton()
    skel[70, 51:54] = True  # a spur, no arm
    pixels = spark.createDataFrame(mask_rows(0, skel), "item int, x int, y int")
    forks = plant._degrees(pixels).filter("degree >= 3")
    got = plant.lasting_junctions(forks, pixels, spark.createDataFrame([(0, 100.0)], "item int, diagonal double")).collect()
    assert len(got) == 1 and math.hypot(got[0]["x"] - 50, got[0]["y"] - 50) <= 3


def test_structures_of_a_fork(spark):
    m = raster.dilate(fork_skeleton(), 2)
    got = plant.structures(spark.createDataFrame(mask_rows(0, m) + mask_rows(1, m[:40, :40]), "item int, x int, y int")).collect()
    by = {r["item"]: (r["endpoints"], r["junctions"], r["components"]) for r in got}
    assert by == {0: (3, 1, 1), 1: (2, 0, 1)}


def test_candidates_of_a_fork(spark):
    support = np.zeros((120, 160), bool)
    support[58:63, 10:150] = True
    support[10:60, 88:93] = True
    rows = [(0, x, y, 1.0 if (x, y) == (40, 60) else 0.0, 0.0) for _, x, y in mask_rows(0, support)]
    pixels = spark.createDataFrame(rows, "item int, x int, y int, contrast double, attention double")
    transition = spark.createDataFrame([r[:3] for r in rows if r[1] < 22], "item int, x int, y int")
    got = plant.candidates(pixels, transition=transition).orderBy("rank").collect()
    count = lambda rows: {k: sum(r["kind"] == k for r in rows) for k in {r["kind"] for r in rows}}
    assert {k: n for k, n in count(got).items() if k != "distinctive"} == {"endpoint": 3, "junction": 1, "basal_transition": 1}
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True) and all(r["score"] >= 0.57 for r in got if r["kind"] == "distinctive")
    shape = count(plant.candidates(pixels, geometry_only=True).collect())
    assert shape["corner"] >= 1 and "distinctive" not in shape and shape["endpoint"] == 3
    strong = spark.createDataFrame([(i, x, y, 1.5 if (x, y) == (40, 60) else 0.2, 0.2) for i, x, y, *_ in rows], "item int, x int, y int, contrast double, attention double")
    assert count(plant.candidates(strong).collect())["distinctive"] >= 1
    assert plant.candidates(pixels.limit(0)).count() == 0


def test_roots_weigh_the_traits_of_ends(spark):
    ends = [(0, 1, 1, 5.0, 2.0, 3.0, 9.0), (0, 2, 1, 0.0, 4.0, 3.0, 5.0), (0, 3, 1, 5.0, 2.0, 3.0, 7.0), (1, 4, 4, 0.0, 1.0, 1.0, 1.0)]
    got = {r["item"]: r for r in plant.roots(spark.createDataFrame(ends, "item int, x int, y int, colour double, stub double, width double, far double")).collect()}
    assert (got[0]["x"], got[0]["score"]) == (1, pytest.approx(0.55 + 0.05 + 0.15 + 0.25)) and got[0]["margin"] == pytest.approx(0.125)
    assert got[1]["score"] == pytest.approx(0.55 + 0.15 + 0.25) and got[1]["margin"] == 1


def test_end_colours_take_vivid_support_first(spark):
    image = [(0, x, y, *((150, 60, 40) if x < 20 else (40, 160, 40))) for x in range(40) for y in range(9)]
    support = [(0, x, y) for x in range(40) for y in range(3, 6)]
    args = spark.createDataFrame(image, "item int, x int, y int, r int, g int, b int"), spark.createDataFrame(support, "item int, x int, y int"), spark.createDataFrame([(0, 100.0)], "item int, diagonal double")
    got = {r["x"]: r["colour"] for r in plant.end_colours(spark.createDataFrame([(0, 2, 4), (0, 37, 4)], "item int, x int, y int"), *args).collect()}
    assert got[2] == pytest.approx(150 + 40 - 120 + 0.12 * (255 - 250 / 3) + 9) and got[2] > 0 > got[37]


def test_bases_of_regions_and_transitions(spark):
    shoot, root = [(0, x, y) for x in range(25) for y in range(14)], [(0, x, y) for x in range(25) for y in range(11, 25)]
    table = lambda rows: spark.createDataFrame(rows, "item int, x int, y int")
    scale = spark.createDataFrame([(0, 25.0), (1, 25.0), (2, 25.0)], "item int, diagonal double")
    nodes = spark.createDataFrame(
        [(0, 0, 12.0, 3.0, 0.9, "shoot"), (0, 1, 12.0, 21.0, 0.5, "seed_base_root"), (0, 2, 3.0, 20.0, 0.7, "seed_base_root"), (0, 3, 3.0, 20.4, 0.9, "seed_base_root"), (1, 7, 1.0, 1.0, 1.0, "shoot")],
        "item int, node int, x double, y double, score double, region string",
    )
    got = {r["item"]: (r["node"], r["failure"]) for r in plant.bases(nodes, table(shoot), table(root), scale).collect()}
    assert got == {0: (2, ""), 1: (None, graph.NO_INTERFACE), 2: (None, graph.NO_NODES)}
    roi, transition = [(i, x, y) for i in (0, 1) for x in range(10, 15) for y in range(3, 22)], [(0, x, y) for x in range(10, 15) for y in range(19, 22)] + [(1, 14, 40)]
    got = {r["item"]: (r["node"], r["failure"], r["rule"]) for r in plant.roi_bases(nodes, table(roi), table(transition), scale).collect()}
    assert got == {0: (1, "", graph.ROI_RULE), 1: (None, graph.NO_NEAR_NODE, graph.ROI_RULE), 2: (None, graph.NO_NODES, graph.ROI_RULE)}


@pytest.mark.parametrize("leaf", [1, 8])
def test_nearest_of_any_distance_equals_all_pairs(spark, leaf):
    r = np.random.default_rng(7)
    targets = [(0, k, *map(float, r.normal(size=2))) for k in range(200)] + [(1, k, float(r.choice([0, 1e6]) + r.random()), float(r.random())) for k in range(150)]
    targets += [(2, k, float(r.integers(0, 6)), float(r.integers(0, 6))) for k in range(90)] + [(3, 5, 2.0, 2.0), (3, 9, float("nan"), 0.0)]
    points = [(i, k, float(x), float(y)) for i in range(5) for k, (x, y) in enumerate([(0, 0), (1e7, -1e7), (2.5, 2.5), (1e6, 0.5), *r.normal(size=(15, 2)) * 3])] + [(0, 99, None, 1.0)]
    p, t = spark.createDataFrame(points, "item int, p int, x double, y double"), spark.createDataFrame(targets, "item int, t int, x double, y double")
    got = {(r["item"], r["p"]): (r["distance"], r["t"]) for r in match.nearest_any(p, t, "item", "p", "t", leaf=leaf).collect()}
    for i, k, x, y in points:
        every = sorted((math.hypot(x - a, y - b), n) for j, n, a, b in targets if j == i and a == a) if x is not None else []
        d, n = got.pop((i, k), (None, None))
        assert (d is None) == (not every) and (not every or d == pytest.approx(every[0][0], rel=1e-12) and n in [m for e, m in every if e <= every[0][0] * (1 + 1e-12)])
    assert not got and match.nearest(p, t.limit(0), "item", "p", "t").count() == 0


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_follow_runs(connectivity):
    """Components as a walk from pixel to pixel finds them, numbered in row order; large masks take no such walk."""
    import time

    r = np.random.default_rng(connectivity)
    steps = raster.EIGHT if connectivity == 8 else [(1, 0), (-1, 0), (0, 1), (0, -1)]
    for share in (0.0, 0.2, 0.5, 0.6, 0.9):
        m = r.random((int(r.integers(1, 30)), int(r.integers(1, 30)))) < share
        want, n = np.zeros(m.shape, int), 0
        for y, x in np.argwhere(m):
            n += not want[y, x]
            todo = [(y, x)] if not want[y, x] else []
            while todo:
                b, a = todo.pop()
                if 0 <= b < m.shape[0] and 0 <= a < m.shape[1] and m[b, a] and not want[b, a]:
                    want[b, a] = n
                    todo += [(b + dy, a + dx) for dx, dy in steps]
        got = raster.label(m, connectivity)
        assert got[1] == n and (got[0] == want).all()
    began = time.process_time()
    assert raster.label(np.ones((2000, 2000), bool), connectivity)[1] == 1
    assert time.process_time() - began < 3
