"""Raster operators: relational on long-form pixels (item, x, y, ...) where algebra suffices, numpy
on one item's mask where it does not. Behaviour is fixed by properties, not by another library's bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.scalar import c, clip, half_even
from mensura.staging import dealt

EIGHT = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


# --- relational --------------------------------------------------------------------------------


def excess_green(r, g, b) -> Column:
    return 2 * c(g) - c(r) - c(b)


def vegetation(pixels: DataFrame, least: float = 20.0, chroma: float = 25.0) -> DataFrame:
    """Pixels whose colour is plant-like: green in excess, with some chroma."""
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    return pixels.filter((excess_green("r", "g", "b") >= least) & (spread >= chroma))


def hsv(r, g, b) -> tuple[Column, Column, Column]:
    """Hue (0 to 179), saturation and value (0 to 255) of eight-bit channels."""
    r, g, b = c(r), c(g), c(b)
    top, spread = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    part = lambda x, y: 60.0 * (x - y) / spread
    angle = F.when(spread == 0, 0.0).when(top == r, part(g, b)).when(top == g, 120 + part(b, r)).otherwise(240 + part(r, g))
    hue = half_even(F.when(angle < 0, angle + 360).otherwise(angle) / 2) % 180
    return hue, F.when(top == 0, 0.0).otherwise(half_even(255.0 * spread / top)), top


def audit_vegetation(pixels: DataFrame) -> DataFrame:
    """Pixels of the inclusive rule for audits and crop proposals: a green hue with some colour, or
    green in excess."""
    hue, saturation, value = hsv("r", "g", "b")
    green = hue.between(18, 100) & (saturation >= 24) & (value >= 22)
    more = (excess_green("r", "g", "b") >= 10) & (F.col("g") >= 35) & (F.col("g") >= F.col("r") - 3) & (F.col("g") >= F.col("b") - 3)
    return pixels.filter(green | more)


def border(pixels: DataFrame, item: str = "item", band: int = 1) -> DataFrame:
    """Mean, median and deviation of the border's luminance; corner pixels count once."""
    lum = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    frame = pixels.groupBy(item).agg(F.max("x").alias("_w"), F.max("y").alias("_h")).withColumnRenamed(item, "_i")
    edge = pixels.join(frame, F.col(item) == F.col("_i")).filter((F.col("x") < band) | (F.col("y") < band) | (F.col("x") > F.col("_w") - band) | (F.col("y") > F.col("_h") - band))
    return edge.groupBy(item).agg(F.count("*").alias("pixels"), F.avg(lum).alias("mean"), F.median(lum).alias("median"), F.stddev_pop(lum).alias("deviation"))


def geometry(mask: DataFrame, width: int, height: int, item: str = "item") -> DataFrame:
    """Bounding box, diagonal, area share and border touch of each item's mask."""
    out = mask.groupBy(item).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"))
    diagonal = F.sqrt(F.pow(F.col("x1") - F.col("x0") + 1, 2) + F.pow(F.col("y1") - F.col("y0") + 1, 2))
    touch = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == width - 1) | (F.col("y1") == height - 1)
    return out.withColumns({"diagonal": diagonal, "area_share": F.col("area") / float(width * height), "touches_border": touch.cast("int")})


def conservative_crop(x0, y0, x1, y1, width, height, pad: float = 0.3, least: float = 0.6) -> Column:
    """struct(left, top, right, bottom): the box padded, at least a share of the frame, shifted into it."""

    def side(low, high, size):
        low, high, size = c(low), c(high), c(size)
        want = F.least(F.greatest(half_even((high - low + 1) * (1 + 2 * pad)), half_even(size * least)), size.cast("double"))
        start = clip(half_even((low + high + 1 - want) / 2), 0.0, 1e18)
        start = F.least(start, size - want)
        return start.cast("int"), (start + want).cast("int")

    left, right = side(x0, x1, width)
    top, bottom = side(y0, y1, height)
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def dilate_pixels(mask: DataFrame, radius: int, item: str = "item") -> DataFrame:
    """Every pixel within the square of the radius, once."""
    steps = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    out = mask.select(item, "y", F.explode(F.transform(steps, lambda d: F.col("x") + d)).alias("x")).distinct()
    return out.select(item, "x", F.explode(F.transform(steps, lambda d: F.col("y") + d)).alias("y")).distinct()


def interface(a: DataFrame, b: DataFrame, radius: int, item: str = "item") -> DataFrame:
    """Where two dilated masks meet."""
    return dilate_pixels(a, radius, item).join(dilate_pixels(b, radius, item), [item, "x", "y"], "left_semi")


def lookup(points: DataFrame, mask: DataFrame, width: int, height: int, item: str = "item", name: str = "hit") -> DataFrame:
    """Whether each point's pixel (half to even, clipped to the frame) is in the mask. A mask may have many
    times the rows of the table it was grown from, which the planner doesn't count, so it is not broadcast."""
    at = points.withColumns({"_px": clip(half_even("x"), 0, width - 1).cast("int"), "_py": clip(half_even("y"), 0, height - 1).cast("int")})
    there = mask.select(F.col(item).alias("_i"), F.col("x").cast("int").alias("_mx"), F.col("y").cast("int").alias("_my"), F.lit(1).alias("_there")).distinct().hint("merge")
    out = at.join(there, (F.col(item) == F.col("_i")) & (F.col("_px") == F.col("_mx")) & (F.col("_py") == F.col("_my")), "left")
    return out.withColumn(name, F.coalesce("_there", F.lit(0))).drop("_px", "_py", "_i", "_mx", "_my", "_there")


def region(shoot: Column, root: Column, plant: Column) -> Column:
    """Five labels by ordered mask membership."""
    return F.when(shoot & root, "shoot_root_overlap").when(shoot, "shoot").when(root, "seed_base_root").when(plant, "other_plant").otherwise("background")


def integrity(organ: DataFrame, full: DataFrame, items: DataFrame, width: int, height: int, item: str = "item") -> DataFrame:
    """Per item: organ pixels outside the full mask, on the border, and the area ratio."""
    size = lambda m, name: m.groupBy(item).agg(F.count("*").alias(name))
    outside = size(organ.join(full, [item, "x", "y"], "left_anti"), "outside")
    edge = size(organ.filter((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)), "on_border")
    out = items.select(item).distinct()
    for part in (size(organ, "organ"), size(full, "full"), outside, edge):
        out = out.join(part, item, "left")
    out = out.fillna(0)
    return out.withColumns({"ratio": F.col("organ") / F.greatest("full", F.lit(1)), "sound": ((F.col("organ") > 0) & (F.col("outside") == 0) & (F.col("on_border") == 0)).cast("int")})


def laplacian_variance(pixels: DataFrame, value: str, item: str = "item") -> DataFrame:
    """Sharpness: variance of the four-neighbour Laplacian over inner pixels."""
    near = pixels.select(item, value, F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(w).alias("w")) for dx, dy, w in ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))])).alias("t")).select(item, "t.*", value)
    lap = near.groupBy(item, "x", "y").agg(F.sum(F.col("w") * F.col(value)).alias("lap"), F.count("*").alias("n")).filter("n = 5")
    return lap.groupBy(item).agg(F.var_pop("lap").alias("sharpness"))


def heatmap(points: DataFrame, sigma: float, width: int, height: int, item: str = "item") -> DataFrame:
    """Gaussian target heatmap, largest value by cell within three sigma. A point makes some hundred cells, so
    points are dealt by item first, few to a task; cells of an item come together without another shuffle."""
    r = int(np.ceil(3 * sigma))
    points = dealt(points, item, 5_000)
    steps = F.array(*[F.lit(k) for k in range(-r, r + 1)])
    cells = points.withColumns({"_cx": half_even("x").cast("int"), "_cy": half_even("y").cast("int")})
    cells = cells.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    cells = cells.withColumns({"gx": F.col("_cx") + F.col("_dx"), "gy": F.col("_cy") + F.col("_dy")})
    cells = cells.filter(F.col("gx").between(0, width - 1) & F.col("gy").between(0, height - 1))
    d2 = F.pow(F.col("gx") - F.col("x"), 2) + F.pow(F.col("gy") - F.col("y"), 2)
    return cells.groupBy(item, "gx", "gy").agg(F.max(c("confidence") * F.exp(-d2 / (2 * sigma * sigma))).alias("value"))


# --- one item's mask ---------------------------------------------------------------------------------


def _shifted(m: np.ndarray, dx: int, dy: int, fill=0) -> np.ndarray:
    out = np.full_like(m, fill)
    h, w = m.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = m[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(m: np.ndarray, radius: int) -> np.ndarray:
    """Square dilation, one axis after the other."""
    out = m.astype(bool)
    for axis in ((1, 0), (0, 1)):
        out = np.logical_or.reduce([_shifted(out, k * axis[0], k * axis[1], False) for k in range(-radius, radius + 1)])
    return out


def erode(m: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~m.astype(bool), radius)


def opened(m: np.ndarray, radius: int) -> np.ndarray:
    return dilate(erode(m, radius), radius)


def closed(m: np.ndarray, radius: int) -> np.ndarray:
    wide = np.pad(m.astype(bool), radius)
    return erode(dilate(wide, radius), radius)[radius:-radius or None, radius:-radius or None]


def label(m: np.ndarray, connectivity: int = 8) -> tuple[np.ndarray, int]:
    """Component numbers from one, in row order of their first pixel."""
    h, w = m.shape
    wide = np.zeros((h, w + 1), bool)  # an empty column ends the runs of each row
    wide[:, :w] = m
    flat = wide.reshape(-1)
    step = np.diff(flat.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    reach = 1 if connectivity == 8 else 0
    # Each run meets a stretch of the runs in the row above.
    low = np.searchsorted(end, start - (w + 1) - reach, side="right")
    n = np.maximum(np.searchsorted(start, end - (w + 1) + reach) - low, 0)
    a = np.repeat(np.arange(len(start)), n)
    b = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    root = np.arange(len(start))
    while True:
        p, q = root[a], root[b]
        least = np.minimum(p, q)
        if (p == q).all():
            break
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        while (root[root] != root).any():
            root = root[root]
    first, own = np.unique(root, return_inverse=True)
    out = np.zeros(wide.shape, np.int64)
    out.reshape(-1)[flat] = np.repeat(own + 1, end - start)
    return out[:, :w].copy(), len(first)


def centroids(m: np.ndarray) -> np.ndarray:
    """(x, y) means of the components."""
    lab, n = label(m)
    y, x = np.nonzero(lab)
    k = lab[y, x] - 1
    size = np.maximum(np.bincount(k, minlength=n), 1)
    return np.column_stack([np.bincount(k, x, minlength=n) / size, np.bincount(k, y, minlength=n) / size])


def largest(m: np.ndarray) -> np.ndarray:
    lab, n = label(m)
    return lab == 1 + np.argmax(np.bincount(lab[lab > 0] - 1, minlength=n)) if n else m.astype(bool)


def at_least(m: np.ndarray, area: int, share: float = 0.0) -> np.ndarray:
    """Components of an area, and of a share of the largest one's, or more."""
    lab, n = label(m)
    size = np.bincount(lab.reshape(-1), minlength=n + 1)
    size[0] = 0
    return ((size >= area) & (size >= share * size.max(initial=0)) & (size > 0))[lab]


def linked(m: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Components that touch the seed."""
    lab, n = label(m)
    hit = np.zeros(n + 1, bool)
    hit[lab[seed.astype(bool)]] = True
    hit[0] = False
    return hit[lab]


def filled(m: np.ndarray) -> np.ndarray:
    """Holes closed: what the outside can't reach."""
    wide = np.pad(~m.astype(bool), 1, constant_values=True)
    lab, _ = label(wide, 4)
    return (~(lab == lab[0, 0]))[1:-1, 1:-1]


def distance_inside(m: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each mask pixel to the nearest pixel outside."""
    m = m.astype(bool)
    h, w = m.shape
    up = np.full(m.shape, float(h + w) ** 2)
    run = np.full(w, float(h + w))
    for y in range(h):
        run = np.where(m[y], run + 1, 0)
        up[y] = run**2
    run = np.full(w, float(h + w))
    for y in range(h - 1, -1, -1):
        run = np.where(m[y], run + 1, 0)
        up[y] = np.minimum(up[y], run**2)
    gap = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.sqrt(np.stack([(gap + row[None, :]).min(axis=1) for row in up]))


def skeleton(m: np.ndarray) -> np.ndarray:
    """A thin connected medial line by two-pass thinning; pixels leave while eight-connectivity and
    line ends stay."""
    m = np.pad(m.astype(bool), 1)
    order = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    while True:
        before = m.sum()
        for turn in (0, 1):
            ring = [_shifted(m, -dx, -dy, False) for dx, dy in order]
            around = sum(r.view(np.uint8) for r in ring)
            rises = sum((~ring[k] & ring[(k + 1) % 8]).view(np.uint8) for k in range(8))
            n, e, s, w = ring[0], ring[2], ring[4], ring[6]
            free = ~(n & e & s) & ~(e & s & w) if turn == 0 else ~(n & e & w) & ~(n & s & w)
            m = m & ~((around >= 2) & (around <= 6) & (rises == 1) & free)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def letterbox_pixels(image: np.ndarray, side: int, fill: str = "white") -> tuple[np.ndarray, dict]:
    """Nearest-neighbour fit into a square with a white or median-border margin, and its mapping."""
    h, w = image.shape[:2]
    scale = side / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    rim = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    out = np.full((side, side, *image.shape[2:]), 255, image.dtype) if fill == "white" else np.broadcast_to(np.median(rim, axis=0), (side, side, *image.shape[2:])).astype(image.dtype).copy()
    top, left = (side - nh) // 2, (side - nw) // 2
    ys, xs = np.minimum((np.arange(nh) + 0.5) / scale, h - 1).astype(int), np.minimum((np.arange(nw) + 0.5) / scale, w - 1).astype(int)
    out[top : top + nh, left : left + nw] = image[ys][:, xs]
    return out, {"scale": scale, "pad_x": float(left), "pad_y": float(top), "source_width": float(w), "source_height": float(h)}


def warp_mask(m: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The mask under an affine view, nearest pixel, empty beyond the frame."""
    inverse = np.linalg.inv(np.vstack([np.asarray(matrix, float)[:2], [0, 0, 1]]))
    y, x = np.mgrid[: m.shape[0], : m.shape[1]]
    u, v = (np.rint(inverse[k, 0] * x + inverse[k, 1] * y + inverse[k, 2]).astype(int) for k in (0, 1))
    inside = (u >= 0) & (v >= 0) & (u < m.shape[1]) & (v < m.shape[0])
    out = np.zeros(m.shape, bool)
    out[inside] = m.astype(bool)[v[inside], u[inside]]
    return out


def whiten(image: np.ndarray, mask: np.ndarray, feather: int = 2) -> np.ndarray:
    """The masked item on white with a linear alpha over the rim."""
    inside = distance_inside(dilate(mask, feather))
    alpha = np.clip(inside / (feather + 1), 0, 1)[..., None]
    return np.rint(image * alpha + 255 * (1 - alpha)).astype(np.uint8)


def structural_support(mask: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(regularised mask, its skeleton without short spurs)."""
    from mensura.operators.graph import pruned

    m = at_least(filled(closed(mask, 1)), least)
    diagonal = float(np.hypot(*m.shape))
    return m, pruned(skeleton(m), max(4.0, 0.012 * diagonal))[0]


def per_item(pixels: DataFrame, f, schema: str, item: str = "item") -> DataFrame:
    """One item's mask (as an array over its bounding box from the origin) through f, which returns a
    data frame; an item is one image, whose pixels bound the group. Pixels before the origin move it
    for f, and back in the columns x, y, cx and cy."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(int), pdf["y"].to_numpy(int)
        left, top = min(0, int(x.min())), min(0, int(y.min()))
        m = np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1), bool)
        m[y - top, x - left] = True
        out = f(key[0], m)
        return out.assign(**{c: out[c] + by for c, by in (("x", left), ("cx", left), ("y", top), ("cy", top)) if c in out})

    return pixels.groupBy(item).applyInPandas(run, schema)


def skeleton_pixels(mask: DataFrame, item: str = "item") -> DataFrame:
    def f(key, m):
        y, x = np.nonzero(skeleton(m))
        return pd.DataFrame({item: key, "x": x, "y": y})

    return per_item(mask, f, f"{item} {mask.schema[item].dataType.simpleString()}, x int, y int", item)


def component_sizes(mask: DataFrame, item: str = "item") -> DataFrame:
    def f(key, m):
        lab, n = label(m)
        xy = centroids(m)
        return pd.DataFrame({item: key, "component": range(1, n + 1), "pixels": np.bincount(lab.reshape(-1), minlength=n + 1)[1:], "cx": xy[:, 0], "cy": xy[:, 1]})

    return per_item(mask, f, f"{item} {mask.schema[item].dataType.simpleString()}, component int, pixels int, cx double, cy double", item)
