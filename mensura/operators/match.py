"""Point matching across views: nearest neighbours, optimal and greedy assignment, consensus, peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import affine_inverse, clip, distance
from mensura.staging import stage


def nearest(points: DataFrame, targets: DataFrame, item: str, point: str, target: str, radius: float | None = None) -> DataFrame:
    """points with target id and distance of the nearest target of the same item; ties to the least
    id. With a radius both sides meet in grid cells of its size (3 x 3 probed), which is exact up to
    the radius; without one by ``nearest_any``."""
    if radius is None:
        return nearest_any(points, targets, item, point, target)
    t = targets.select(F.col(item).alias("_i"), F.col(target).alias("_t"), F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    cell = lambda v: F.floor(F.col(v) / radius)
    probe = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = points.withColumn("_p", F.explode(probe)).withColumns({"_cx": cell("x") + F.col("_p.a"), "_cy": cell("y") + F.col("_p.b")})
    t = t.withColumns({"_gx": cell("_tx"), "_gy": cell("_ty")})
    both = near.join(t, (F.col(item) == F.col("_i")) & (F.col("_cx") == F.col("_gx")) & (F.col("_cy") == F.col("_gy")))
    both = both.withColumn("_d", distance("x", "y", "_tx", "_ty")).filter(F.col("_d") <= radius)
    best = both.groupBy(item, point).agg(F.min(F.struct("_d", "_t")).alias("b"))
    return best.select(item, point, F.col("b._t").alias(target), F.col("b._d").alias("distance"))


def nearest_any(points: DataFrame, targets: DataFrame, item: str, point: str, target: str, leaf: int = 8, depth: int = 20) -> DataFrame:
    """The nearest target of the same item at any distance, ties to the least id; points of items without
    targets, and places that are null or not finite, are absent.

    Targets lie in a tree of cells: a cell of more than ``leaf`` places is cut into 4 x 4, ``depth`` times
    at most. All points go down together, a level a round: of a point's cells those stay that may be
    nearer than the farthest corner of any of them, as no cell is empty. So a point meets few targets,
    however they cluster and however far it is."""
    real = lambda d: d.filter(d["x"].isNotNull() & d["y"].isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    t = real(targets.select(F.col(item).alias("i"), F.col(target).alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    t = t.groupBy("i", "x", "y").agg(F.min("t").alias("t"))
    boxes = t.groupBy("i").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"))
    boxes = stage(boxes.withColumn("wide", F.greatest(F.col("wide") * (1 + 1e-12), F.lit(1e-300))), "boxes")
    keys = ["i", "cx", "cy"]
    cells, leaves, left, level = [], None, t.join(boxes, "i"), 0
    while True:
        cell = lambda v, low, k=level: F.floor((F.col(v) - F.col(low)) / F.col("wide") * 4.0**k).cast("long")
        left = left.withColumns({"cx": cell("x", "x0"), "cy": cell("y", "y0")})
        sized = stage(left.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("leaf", (F.col("n") <= leaf) | (F.lit(level) == depth)), "cells")
        here = left.join(sized.filter("leaf"), keys, "left_semi").select("i", F.lit(level).alias("level"), "cx", "cy", "t", F.col("x").alias("tx"), F.col("y").alias("ty"))
        leaves = here if leaves is None else leaves.unionByName(here)
        cells.append(sized.select(*keys, "leaf"))
        if sized.filter("NOT leaf").isEmpty():
            break
        left = stage(left.join(sized.filter("NOT leaf"), keys, "left_semi"), "crowded")
        level += 1
    p = real(points.select(F.col(item).alias("i"), F.col(point).alias("p"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).distinct()
    met = p.join(boxes, "i").join(cells[0], "i").withColumn("level", F.lit(0))
    step = F.col("wide") / F.pow(F.lit(4.0), "level")
    low = lambda v, c, v0: F.greatest(F.col(v0) + F.col(c) * step - F.col(v), F.col(v) - F.col(v0) - (F.col(c) + 1) * step, F.lit(0.0))
    high = lambda v, c, v0: F.greatest(F.abs(F.col(v0) + F.col(c) * step - F.col(v)), F.abs(F.col(v) - F.col(v0) - (F.col(c) + 1) * step))
    for k, below in enumerate(cells[1:]):
        children = below.select("i", F.floor(F.col("cx") / 4).alias("px"), F.floor(F.col("cy") / 4).alias("py"), F.col("cx").alias("x_"), F.col("cy").alias("y_"), F.col("leaf").alias("leaf_"))
        down = met.filter("NOT leaf").withColumnsRenamed({"cx": "px", "cy": "py"}).join(children, ["i", "px", "py"])
        down = down.withColumns({"cx": F.col("x_"), "cy": F.col("y_"), "leaf": F.col("leaf_"), "level": F.lit(k + 1)}).select(*met.columns)
        met = met.filter("leaf").unionByName(down)
        bound = F.min(F.hypot(high("x", "cx", "x0"), high("y", "cy", "y0"))).over(Window.partitionBy("i", "p"))
        near = F.hypot(low("x", "cx", "x0"), low("y", "cy", "y0"))
        met = met.withColumns({"_far": bound, "_near": near}).filter(F.col("_near") <= F.col("_far") + 1e-9 * (F.col("_far") + F.col("wide")))
        met = stage(met.drop("_far", "_near"), "met")
    both = met.filter("leaf").join(leaves, ["i", "level", "cx", "cy"])
    best = both.groupBy("i", "p").agg(F.min(F.struct(distance("x", "y", "tx", "ty").alias("d"), "t")).alias("b"))
    return best.select(F.col("i").alias(item), F.col("p").alias(point), F.col("b.t").alias(target), F.col("b.d").alias("distance"))


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost full matching of the smaller side, by shortest augmenting
    paths with potentials."""
    if cost.shape[0] > cost.shape[1]:
        r, c = hungarian(cost.T)
        order = np.argsort(c)
        return c[order], r[order]
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < low[free]
            low[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    cols = np.flatnonzero(match[1:])
    rows = match[1:][cols] - 1
    order = np.argsort(rows)
    return rows[order], cols[order]


def assigned(a: np.ndarray, b: np.ndarray, radius: float) -> list[tuple[int, int, float]]:
    """Pairs of the optimal assignment that lie within the radius. The radius acts after assignment,
    so it is no matching of most pairs within it."""
    if not len(a) or not len(b):
        return []
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return [(int(i), int(j), float(d[i, j])) for i, j in zip(*hungarian(d)) if d[i, j] <= radius]


def greedy_pairs(a: DataFrame, b: DataFrame, item: str, radius: float) -> DataFrame:
    """(item, ax, ay, bx, by, distance): closest pair first, ties by the place in a, then in b, each row
    once, within the radius. Pairs within it meet on a grid; a round takes every pair that is the first of
    both its rows, which the sequential choice takes too, and drops what these rows had. Rows with a place
    that is null or not finite match nothing; repeated rows are rows of their own."""
    real = lambda d, k: d.select(F.col(item).alias("i"), *[F.col(v).cast("double").alias(f"{k}{v}") for v in "xy"]).filter(" AND ".join(f"abs({k}{v}) < double('infinity')" for v in "xy"))
    sides = [stage(real(d, k).withColumn(k, F.struct(f"{k}x", f"{k}y", F.monotonically_increasing_id().alias("n"))), "points") for d, k in ((a, "a"), (b, "b"))]
    cell = lambda v: F.floor(F.col(v) / radius)
    near = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
    left = sides[0].withColumn("s", F.explode(near)).withColumns({"cx": cell("ax") + F.col("s.p"), "cy": cell("ay") + F.col("s.q")}).drop("s")
    right = sides[1].withColumns({"cx": cell("bx"), "cy": cell("by")})
    d = distance("ax", "ay", "bx", "by")
    pairs = left.join(right, ["i", "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= radius).select("i", F.struct("d", "a", "b").alias("p"))
    found, pairs = None, stage(pairs, "pairs")
    while found is None or not pairs.isEmpty():
        firsts = [pairs.groupBy("i", F.col(f"p.{k}").alias(k)).agg(F.min("p").alias("p")).select("i", "p") for k in "ab"]
        taken = stage(firsts[0].join(firsts[1], ["i", "p"]), "taken")
        found = taken if found is None else found.unionByName(taken)
        for k in "ab":
            used = taken.select("i", F.col(f"p.{k}").alias("_u"))
            pairs = pairs.join(used, (pairs["i"] == used["i"]) & (F.col(f"p.{k}") == F.col("_u")), "left_anti")
        pairs = stage(pairs, "pairs")
    return found.select(F.col("i").alias(item), "p.a.ax", "p.a.ay", "p.b.bx", "p.b.by", F.col("p.d").alias("distance"))


def score(n_a: int, n_b: int, pairs: list[tuple[int, int, float]]) -> dict[str, float]:
    """precision, recall, f1, median error. Two empty sides agree (1, error NaN); one scores 0."""
    if not n_a and not n_b:
        return {"precision": 1.0, "recall": 1.0, "f1": 1.0, "error": float("nan")}
    k = len(pairs)
    p, r = k / n_b if n_b else 0.0, k / n_a if n_a else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if k else 0.0, "error": float(np.median([x[2] for x in pairs])) if k else float("nan")}


def match_sets(a: DataFrame, b: DataFrame, item: str, radius: float, how: str = "optimal") -> DataFrame:
    """One row an item on either side: counts, matches, precision, recall, f1, error (null if none). Greedy
    pairs come from rounds over all items; an optimal assignment takes an item's few points in one task."""
    kind = a.schema[item].dataType.simpleString()
    if how == "greedy":
        return _scored(a, b, item, greedy_pairs(a, b, item, radius))
    if how != "optimal":
        raise ValueError(f"unknown matching {how}")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = (p.sort_values(["x", "y"])[["x", "y"]].to_numpy(float) for p in (left, right))
        pairs = assigned(x, y, radius)
        key = (left if len(left) else right)[item].iloc[0]
        return pd.DataFrame([{item: key, "n_a": len(x), "n_b": len(y), "matches": len(pairs), **score(len(x), len(y), pairs)}])

    out = a.select(item, "x", "y").groupBy(item).cogroup(b.select(item, "x", "y").groupBy(item)).applyInPandas(run, f"{item} {kind}, n_a int, n_b int, matches int, precision double, recall double, f1 double, error double")
    return out.withColumn("error", F.when(~F.isnan("error"), F.col("error")))


def _scored(a: DataFrame, b: DataFrame, item: str, pairs: DataFrame) -> DataFrame:
    """``score`` over tables: an item has a row on one side at least."""
    from mensura.operators.ranking import quantiles

    size = lambda d, name: d.groupBy(item).agg(F.count("*").cast("int").alias(name))
    out = size(a, "n_a").join(size(b, "n_b"), item, "full").join(size(pairs, "matches"), item, "left").fillna(0)
    k, n_a, n_b = F.col("matches"), F.col("n_a"), F.col("n_b")
    out = out.withColumns({"precision": F.when(n_b > 0, k / n_b).otherwise(0.0), "recall": F.when(n_a > 0, k / n_a).otherwise(0.0)})
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.when(k > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return out.join(quantiles(pairs, {"error": ("distance", 0.5)}, [item]), item, "left")


def back_mapped(points: DataFrame, views: DataFrame, size: float, view: str = "view") -> DataFrame:
    """Points of views in reference coordinates, those beyond the frame dropped. views: view and m,
    an array of six affine terms; a view set has a handful of rows."""
    m = [F.col("_m")[k] for k in range(6)]
    a, b, tx, d, e, ty = affine_inverse(m)
    both = points.join(F.broadcast(views.select(F.col(view).alias("_v"), F.col("m").alias("_m"))), F.col(view) == F.col("_v"))
    both = both.withColumns({"_x": a * F.col("x") + b * F.col("y") + tx, "_y": d * F.col("x") + e * F.col("y") + ty})
    inside = (F.col("_x") >= 0) & (F.col("_x") < size) & (F.col("_y") >= 0) & (F.col("_y") < size)
    return both.filter(inside).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_v", "_m", "_x", "_y")


def consensus(observed: DataFrame, by: list[str], views: int, presence: float = 0.75, error: float = 0.025, confidence: float = 0.35, filtered: bool = True) -> DataFrame:
    """One row a reference point from its observations (distance as a share of the diagonal, score):
    presence over the views, median error, confidence, accepted. The identity view counts as one."""
    g = observed.groupBy(*by).agg((F.count_distinct("view") / float(views)).alias("presence"), F.median("distance").alias("error"), F.avg("score").alias("_s"), F.array_sort(F.collect_set("view")).alias("views"))
    g = g.withColumn("confidence", F.col("presence") * F.exp(-F.col("error") / 0.025) * clip("_s", 0.0, 1.0)).drop("_s")
    rule = (F.col("presence") >= presence) & (F.col("error") <= error) & (F.col("confidence") >= confidence)
    return g.withColumn("accepted", (rule if filtered else F.lit(True)).cast("int"))


def usable(accepted: Column, capped: Column) -> Column:
    return ((accepted >= 2) & (capped == 0)).cast("int")


def settled(df: DataFrame, item: str, order: list[Column], radius: float, touching: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, all) of greedy suppression by order: points nearer than the radius to a kept one go (with
    touching, also those just as far). all has df's columns and ``_o``, which orders an item's rows.

    Rounds: a point that is the first of all open ones in its 3 x 3 cells of the radius is kept, as the
    sequential rule would keep it; what is near it goes. Cells meet by aggregates, and kept points, of
    which a cell has few, meet the open points about them; no pairs within a cell are made."""
    every = stage(df.withColumn("_o", F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.monotonically_increasing_id().alias("n"))), "points")
    cell = lambda v: F.floor(F.col(v) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
    open_ = every.select(F.col(item).alias("i"), "x", "y", "_o", cell("x").alias("cx"), cell("y").alias("cy"))
    kept = None
    while kept is None or not open_.isEmpty():
        best = open_.groupBy("i", "cx", "cy").agg(F.min("_o").alias("b")).withColumn("s", around)
        best = best.groupBy("i", (F.col("cx") + F.col("s.p")).alias("cx"), (F.col("cy") + F.col("s.q")).alias("cy")).agg(F.min("b").alias("b"))
        now = stage(open_.join(best, ["i", "cx", "cy"]).filter(F.col("_o") == F.col("b")).drop("b"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        about = now.select(F.col("i"), F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("_o").alias("ko"), "cx", "cy").withColumn("s", around)
        about = about.select("i", "kx", "ky", "ko", (F.col("cx") + F.col("s.p")).alias("cx"), (F.col("cy") + F.col("s.q")).alias("cy"))
        d = distance("x", "y", "kx", "ky")
        gone = open_.join(about, ["i", "cx", "cy"]).filter(((d <= radius) if touching else (d < radius)) | (F.col("_o") == F.col("ko"))).select("i", "_o").distinct()
        open_ = stage(open_.join(gone, ["i", "_o"], "left_anti"), "open")
    return kept.select(F.col("i").alias(item), "x", "y", "_o"), every


def suppressed(df: DataFrame, item: str, radius: float, most: int | None = None) -> DataFrame:
    """Greedy suppression: by score descending (then y, x), points nearer than the radius to a kept one go;
    adds rank among the kept. ``most`` is the operator's cap for an item, beyond which nothing is kept."""
    kept, every = settled(df, item, [-F.col("score"), F.col("y"), F.col("x")], radius)
    out = every.join(kept.select(item, "_o"), [item, "_o"], "left_semi")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy("_o"))).drop("_o")
    return (out if most is None else out.filter(F.col("rank") <= most)).select(*df.columns, "rank")


def peaks_1d(df: DataFrame, item: str, order: str, x: str, tau: float) -> DataFrame:
    """Rows of a series that reach median + tau * 1.4826 * MAD and both their neighbours; the ends are
    no peaks."""
    from mensura.operators.robust import with_mad

    w = Window.partitionBy(item).orderBy(order)
    near = df.withColumns({"_a": F.lag(x).over(w), "_b": F.lead(x).over(w)}).filter((F.col(x) >= F.col("_a")) & (F.col(x) >= F.col("_b"))).drop("_a", "_b")
    limits = with_mad(df.select(item, x), x, [item]).select(F.col(item).alias("_i"), (F.col("centre") + tau * F.col("scale")).alias("limit"))
    return near.join(limits, F.col(item) == F.col("_i")).filter(F.col(x) >= F.col("limit")).drop("_i")


def grid_peaks(df: DataFrame, item: str, value: str, least: float, radius: int = 1, inner: bool = True) -> DataFrame:
    """Cells of a grid (x, y) that reach their neighbourhood's maximum and ``least``; with inner, not
    on the border. The maximum comes along rows, then along columns."""
    reach = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    spread = df.select(item, F.col(value).alias("_max"), "y", F.col("x").alias("_x"), F.explode(reach).alias("_s"))
    rows = spread.groupBy(item, (F.col("_x") + F.col("_s")).alias("x"), "y").agg(F.max("_max").alias("_max"))
    spread = rows.select(item, "x", F.col("y").alias("_y"), "_max", F.explode(reach).alias("_s"))
    around = spread.groupBy(item, "x", (F.col("_y") + F.col("_s")).alias("y")).agg(F.max("_max").alias("_max"))
    high = df.filter(F.col(value) >= least)
    out = high.join(around.hint("merge"), [item, "x", "y"]).filter(F.col(value) >= F.col("_max")).drop("_max")
    if inner:
        size = df.groupBy(item).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
        out = out.join(size, item).filter((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("_w")) & (F.col("y") < F.col("_h"))).drop("_w", "_h")
    return out


def quantile_peaks(df: DataFrame, item: str, value: str, share: float) -> DataFrame:
    """Inner cells of a grid that reach their 3 x 3 neighbourhood's maximum and the item's quantile."""
    levels = df.groupBy(item).agg(F.percentile(value, share).alias("_level")).withColumnRenamed(item, "_i")
    high = grid_peaks(df, item, value, float("-inf"))
    return high.join(levels, F.col(item) == F.col("_i")).filter(F.col(value) >= F.col("_level")).drop("_i", "_level")


def decoded(df: DataFrame, item: str, value: str, least: float = 0.35, most: int = 64) -> DataFrame:
    """Peaks of a heatmap in 5 x 5 neighbourhoods, the best ``most`` an item (the operator's cap)."""
    p = grid_peaks(df, item, value, least, 2, inner=False)
    return p.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(F.desc(value), "y", "x"))).filter(F.col("rank") <= most)


def grid_to_pixel(v, cells: int, size: float) -> Column:
    return (F.col(v) + 0.5) * size / cells if isinstance(v, str) else (v + 0.5) * size / cells


def recall(events: DataFrame, nodes: DataFrame, item: str, event: str, node: str, tolerance: float) -> DataFrame:
    """Share of an item's events with a node within the tolerance; items without events are absent."""
    hit = nearest(events, nodes, item, event, node, tolerance).select(item, event, F.lit(1).alias("_hit"))
    return events.join(hit, [item, event], "left").groupBy(item).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
