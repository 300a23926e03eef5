"""Polylines and curves: window expressions for their measures, numpy for the sequential parts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import angle_between
from mensura.staging import running, stage


def measures(df: DataFrame, path: list[str], order: str, x: str, y: str) -> DataFrame:
    """One row a path: points, length, chord, sinuosity, total turning (degrees), mean absolute
    curvature. Windows are partitioned by path."""
    w = Window.partitionBy(*path).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    d = df.withColumns({"_dx": dx, "_dy": dy})
    d = d.withColumns({"_px": F.lag("_dx").over(w), "_py": F.lag("_dy").over(w)})
    d = d.withColumns({"_step": F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2), "_turn": angle_between(F.col("_px"), F.col("_py"), F.col("_dx"), F.col("_dy"))})
    first, last = F.min_by(F.struct(x, y), order), F.max_by(F.struct(x, y), order)
    g = d.groupBy(*path).agg(F.count("*").alias("points"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), first.alias("_a"), last.alias("_b"), F.coalesce(F.sum("_turn"), F.lit(0.0)).alias("turning"))
    g = g.withColumn("chord", F.sqrt((F.col(f"_b.{x}") - F.col(f"_a.{x}")) ** 2 + (F.col(f"_b.{y}") - F.col(f"_a.{y}")) ** 2))
    return g.select(*path, "points", "length", "chord", (F.col("length") / F.greatest("chord", F.lit(1e-9))).alias("sinuosity"), "turning", (F.radians("turning") / F.greatest("length", F.lit(1e-9))).alias("curvature"))


def divergence(df: DataFrame, path: list[str], order: str, x: str, y: str, k: int = 12) -> DataFrame:
    """Angle between the vector over a path's first k points and that over its last k; null if one
    has no length."""
    w = Window.partitionBy(*path)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    at = lambda i, v: F.max(F.when(F.col("_i") == i, F.col(v)))
    n = F.col("_n")
    ends = {"a": F.lit(1), "b": F.least(F.lit(k), n), "c": F.greatest(n - k + 1, F.lit(1)), "d": n}
    g = d.groupBy(*path).agg(*[at(i, v).alias(f"{name}{axis}") for name, i in ends.items() for axis, v in (("x", x), ("y", y))])
    return g.select(*path, angle_between(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")).alias("divergence"))


def smoothed(df: DataFrame, path: list[str], order: str, x: str, window: int = 11, name: str = "smooth") -> DataFrame:
    """Centred moving average of an odd window (no longer than the path), places beyond an end taking
    its value; the end points stay."""
    w = Window.partitionBy(*path)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    half = F.floor((F.least(F.lit(window), F.col("_n") - (F.col("_n") + 1) % 2) - 1) / 2)
    h = window // 2
    o = w.orderBy(order)
    first, last = F.first(x).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(x).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = F.lit(0.0)
    for k in range(-h, h + 1):
        v = F.lag(x, -k).over(o) if k < 0 else F.lead(x, k).over(o) if k > 0 else F.col(x)
        inside = F.when(F.col("_i") + k < 0, first).when(F.col("_i") + k >= F.col("_n"), last).otherwise(v)
        total = total + F.when(F.lit(abs(k)) <= half, inside).otherwise(0.0)
    pinned = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)
    return d.withColumn(name, F.when(pinned, F.col(x)).otherwise(total / (2 * half + 1))).drop("_i", "_n")


def polyline_length(p: np.ndarray) -> float:
    return float(np.hypot(*np.diff(p, axis=0).T).sum()) if len(p) > 1 else 0.0


def simplify(p: np.ndarray, epsilon: float) -> np.ndarray:
    """Indices kept by Ramer-Douglas-Peucker: a point stays if it is further than epsilon (strictly)
    from the chord of its stretch."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        size = float(np.hypot(*d))
        q = p[a + 1 : b] - p[a]
        t = np.clip((q @ d) / size**2, 0, 1) if size > 0 else np.zeros(len(q))
        off = np.hypot(*(q - t[:, None] * d).T)
        k = int(np.argmax(off))
        if off[k] > epsilon:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def tolerance(diagonal: float) -> float:
    return max(1.5, 0.006 * diagonal)


def adaptive_support(p: np.ndarray, candidates: np.ndarray, diagonal: float) -> list[dict]:
    """Indices of the simplification and of the path points nearest to candidates within .025 of the
    diagonal, with their evidence; an index less than three after the one before folds into it (the
    end points stay)."""
    evidence: dict[int, set[str]] = {int(i): {"geometry"} for i in simplify(p, tolerance(diagonal))}
    for k, q in enumerate(candidates):
        d = np.hypot(*(p - q).T)
        i = int(np.argmin(d))
        if d[i] <= 0.025 * diagonal:
            evidence.setdefault(i, set()).add(f"candidate_{k}")
    out: list[dict] = []
    for i in sorted(evidence):
        ends = i in (0, len(p) - 1)
        if out and i - out[-1]["index"] < 3 and not ends:
            out[-1]["evidence"] |= evidence[i]
        else:
            out.append({"index": i, "evidence": set(evidence[i])})
    return out


def pchip(p: np.ndarray, samples: int = 240) -> np.ndarray:
    """Monotone cubic resampling by chord length (Fritsch-Carlson slopes); linear for two points."""
    p = p[np.r_[True, np.hypot(*np.diff(p, axis=0).T) > 0]] if len(p) > 1 else p
    if len(p) < 2:
        return np.repeat(p, samples, axis=0)
    t = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    s = np.linspace(0, t[-1], samples)
    if len(p) == 2:
        return np.column_stack([np.interp(s, t, p[:, k]) for k in (0, 1)])
    h = np.diff(t)
    i = np.clip(np.searchsorted(t, s, side="right") - 1, 0, len(h) - 1)
    u = (s - t[i]) / h[i]
    out = []
    for v in p.T:
        d = np.diff(v) / h
        m = np.zeros(len(v))
        a, b = d[:-1], d[1:]
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = a * b > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / a + w2 / b), 0.0)
        for end, x0, x1, h0, h1 in ((0, d[0], d[1], h[0], h[1]), (-1, d[-1], d[-2], h[-1], h[-2])):
            e = ((2 * h0 + h1) * x0 - h0 * x1) / (h0 + h1)
            m[end] = 0.0 if e * x0 <= 0 else 3 * x0 if x0 * x1 <= 0 and abs(e) > 3 * abs(x0) else e
        c0, c1, c2, c3 = (1 + 2 * u) * (1 - u) ** 2, u * (1 - u) ** 2, u**2 * (3 - 2 * u), u**2 * (u - 1)
        out.append(c0 * v[i] + c1 * h[i] * m[i] + c2 * v[i + 1] + c3 * h[i] * m[i + 1])
    return np.column_stack(out)


def curve_measures(q: np.ndarray) -> dict[str, float]:
    length, chord = polyline_length(q), float(np.hypot(*(q[-1] - q[0]))) if len(q) else 0.0
    d = np.diff(q, axis=0)
    d = d[np.hypot(*d.T) > 1e-12] if len(d) else d
    turn = 0.0
    if len(d) > 1:
        cosine = (d[1:] * d[:-1]).sum(axis=1) / (np.hypot(*d[1:].T) * np.hypot(*d[:-1].T))
        turn = float(np.arccos(np.clip(cosine, -1, 1)).sum())
    return {"length": length, "chord": chord, "sinuosity": length / max(chord, 1e-9), "turning": math.degrees(turn), "curvature": turn / max(length, 1e-9)}


def divergence_angle(trunk: np.ndarray, branch: np.ndarray, k: int = 12) -> float:
    a, b = trunk[-1] - trunk[max(0, len(trunk) - k)], branch[min(k, len(branch)) - 1] - branch[0]
    size = float(np.hypot(*a) * np.hypot(*b))
    return math.degrees(math.acos(float(np.clip(a @ b / size, -1, 1)))) if size > 1e-12 else float("nan")


def reconstruction_error(path: np.ndarray, curve: np.ndarray) -> float:
    """Median distance of path points to the curve's nearest sample."""
    return float(np.median([np.hypot(*(curve - p).T).min() for p in path])) if len(curve) and len(path) else float("nan")


def _paths(df: DataFrame, path: str, order: str, x: str, y: str, f, schema: str) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values([order, x, y])[[x, y]].to_numpy(float)
        return f(key[0], p)

    return df.select(path, order, x, y).groupBy(path).applyInPandas(run, f"{path} {df.schema[path].dataType.simpleString()}, " + schema)


def simplified_paths(df: DataFrame, path: str, order: str, x: str, y: str, epsilon: float) -> DataFrame:
    """(path, position, x, y) of what ``simplify`` keeps of each path, its rows by order, x and y (rows
    without a place are none), numbered from 0.

    All open stretches of all paths are cut in one round: of the points of a stretch the farthest from its
    chord, the first of equal ones, is found by an aggregate, and a stretch that none is further from
    than epsilon is done with. So a path may have any number of points; none lies in one task."""
    rows = df.select(F.col(path).alias("i"), F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = stage(rows.withColumns({"n": F.monotonically_increasing_id(), "one": F.lit(1)}), "points")
    p = stage(running(rows, ["i"], ["o", "x", "y", "n"], "one", "k").select("i", "k", "x", "y"), "paths")
    here = F.struct("k", "x", "y")
    ends = p.groupBy("i").agg(F.min(here).alias("a"), F.max(here).alias("b"))
    kept = ends.select("i", F.explode(F.array_distinct(F.array("a.k", "b.k"))).alias("k"))
    # Open points, each with the ends of the stretch it is in.
    open_ = p.join(ends, "i").filter((F.col("k") > F.col("a.k")) & (F.col("k") < F.col("b.k")))
    dx, dy, qx, qy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest((qx * dx + qy * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    off = F.hypot(qx - t * dx, qy - t * dy)
    while True:
        open_ = stage(open_, "open")
        far = open_.groupBy("i", F.col("a.k").alias("at")).agg(F.max(F.struct(off.alias("off"), (-F.col("k")).alias("k"), "x", "y")).alias("m")).filter(F.col("m.off") > epsilon)
        cut = stage(far.select("i", "at", F.struct((-F.col("m.k")).alias("k"), F.col("m.x").alias("x"), F.col("m.y").alias("y")).alias("m")), "cuts")
        if cut.isEmpty():
            break
        kept = kept.unionByName(cut.select("i", "m.k"))
        met = open_.join(cut.withColumnRenamed("i", "_i"), (F.col("i") == F.col("_i")) & (F.col("a.k") == F.col("at"))).filter(F.col("k") != F.col("m.k"))
        before = F.col("k") < F.col("m.k")
        open_ = met.select("i", "k", "x", "y", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b"))
    return kept.join(p, ["i", "k"]).select(F.col("i").alias(path), F.col("k").cast("int").alias("position"), "x", "y")


def resampled_paths(df: DataFrame, path: str, order: str, x: str, y: str, samples: int = 240) -> DataFrame:
    def f(key, p):
        q = pchip(p, samples)
        return pd.DataFrame({path: key, "position": range(len(q)), "x": q[:, 0], "y": q[:, 1]})

    return _paths(df, path, order, x, y, f, "position int, x double, y double")
