"""Plants as pixel tables: confident masks, the region of interest on the shoot's side with its basal
transition, scored structure, root and base choice.

A mask is a table of (item, x, y), each pixel once; frames is (item, width, height). Rules are filters,
joins and aggregates over pixels of all items at once; only labels of components and holes of one mask
take a grouped map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import clip, half_even
from mensura.operators import keypoints, raster
from mensura.operators.match import nearest
from mensura.operators.ranking import quantiles
from mensura.operators.robust import with_mad
from mensura.operators.stats import principal_axis
from mensura.staging import stage

# Where the boundary of a region came from.
SOURCES = ["estimated_seed", "seed_base_root_mask", "manifest_automatic_base_hint_fallback"]
XY = ["item", "x", "y"]


# --- masks -----------------------------------------------------------------------------------------


def grown(mask: DataFrame, radius: int | Column) -> DataFrame:
    """Every pixel within a square of the radius, which may be a column."""
    r = F.lit(radius) if isinstance(radius, int) else radius
    wide = mask.withColumn("_r", r.cast("int"))
    step = lambda v: F.explode(F.sequence(F.col(v) - F.col("_r"), F.col(v) + F.col("_r")))
    return wide.select("item", "y", "_r", step("x").alias("x")).distinct().select("item", "x", step("y").alias("y")).distinct()


def shrunk(mask: DataFrame, radius: int) -> DataFrame:
    """The pixels whose whole square of the radius lies in the mask."""
    out, full = mask.select(*XY), 2 * radius + 1
    for v, w in (("x", "y"), ("y", "x")):
        steps = F.explode(F.sequence(F.col(v) - radius, F.col(v) + radius)).alias(v)
        out = out.select("item", w, steps).groupBy(*XY).count().filter(F.col("count") == full).drop("count")
    return out


def closed(mask: DataFrame, radius: int) -> DataFrame:
    return shrunk(grown(mask, radius), radius)


def opened(mask: DataFrame, radius: int) -> DataFrame:
    return grown(shrunk(mask, radius), radius)


def parts(mask: DataFrame) -> DataFrame:
    """Adds component, numbered within its item, and size, its pixels."""
    import pandas as pd

    def f(key, m):
        labels, _ = raster.label(m)
        y, x = labels.nonzero()
        return pd.DataFrame({"item": [key] * len(x), "x": x, "y": y, "component": labels[y, x]})

    kind = mask.schema["item"].dataType.simpleString()
    out = raster.per_item(mask.select(*XY), f, f"item {kind}, x int, y int, component int")
    return out.withColumn("size", F.count("*").over(Window.partitionBy("item", "component")))


def largest(mask: DataFrame) -> DataFrame:
    """The largest component of each item, the first of equal ones."""
    first = Window.partitionBy("item").orderBy(F.desc("size"), "component")
    return parts(mask).withColumn("_k", F.dense_rank().over(first)).filter("_k = 1").select(*XY)


def filled(mask: DataFrame) -> DataFrame:
    import pandas as pd

    def f(key, m):
        y, x = raster.filled(m).nonzero()
        return pd.DataFrame({"item": [key] * len(x), "x": x, "y": y})

    kind = mask.schema["item"].dataType.simpleString()
    return raster.per_item(mask.select(*XY), f, f"item {kind}, x int, y int")


def _with(df: DataFrame, per_item: DataFrame) -> DataFrame:
    """df with the columns of its item's row."""
    return df.join(per_item, "item")


def _share(of: float, what: Column, least: int) -> Column:
    return F.greatest(F.lit(least), half_even(what * of))


def _area(frames: DataFrame) -> DataFrame:
    return frames.select("item", (F.col("width") * F.col("height")).alias("area"))


# --- confident masks ---------------------------------------------------------------------------------


def limits(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """One row an item, from a border of 4 % of the shorter side (two pixels at least): its median colour
    (r0, g0, b0), whether it is of one colour (median deviation of the distance from it of 3 at most), the
    distance that counts as far from it, and the saturation and excess of green that count as vivid."""
    edge = _with(pixels, frames).withColumn("_t", _share(0.04, F.least("width", "height"), 2))
    inner = F.col("x").between(F.col("_t"), F.col("width") - 1 - F.col("_t")) & F.col("y").between(F.col("_t"), F.col("height") - 1 - F.col("_t"))
    hue, saturation, value = raster.hsv("r", "g", "b")
    edge = edge.filter(~inner).select("item", "r", "g", "b", saturation.alias("s"), raster.excess_green("r", "g", "b").alias("e"))
    colour = quantiles(edge, {f"{c}0": (c, 0.5) for c in "rgb"}, ["item"])
    off = _with(edge, colour).withColumn("off", _far())
    far, vivid, green = (with_mad(off, x, ["item"]).select("item", F.col("centre").alias(f"{x}_c"), F.col("scale").alias(f"{x}_s")) for x in ("off", "s", "e"))
    out = colour.join(far, "item").join(vivid, "item").join(green, "item")
    return out.select(
        "item", "r0", "g0", "b0", (F.col("off_s") / 1.4826 <= 3.0).alias("uniform"), F.greatest(F.lit(9.0), F.col("off_c") + 6 * F.col("off_s") + 5).alias("limit"),
        clip(F.col("s_c") + 4 * F.col("s_s"), 45.0, 85.0).alias("saturation"), clip(F.col("e_c") + 3 * F.col("e_s"), 15.0, 30.0).alias("excess"),
    )


def _far() -> Column:
    return F.sqrt(sum(F.pow(F.col(c) - F.col(f"{c}0"), 2) for c in "rgb"))


def confident(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Plant pixels (item, x, y, uniform) of images (item, x, y, r, g, b). On a border of one colour: the
    largest component of what is far from it, without holes, if that is 0.0001 to 0.45 of the image; in
    all other items what is vivid, without components under 2.5 % of the largest. Items may have none."""
    rule = stage(limits(pixels, frames), "limits")
    area = _area(frames).withColumn("least", _share(0.00004, F.col("area"), 20))
    own = _with(pixels, rule)
    whole = stage(filled(largest(closed(own.filter("uniform").filter(_far() >= F.col("limit")), 1))), "uniform")
    solid = largest_share(whole, area)
    first = _with(whole, solid).select(*XY)
    hue, s, v = raster.hsv("r", "g", "b")
    lead = (F.col("g") >= 35) & (F.col("g") >= F.col("r") - 3) & (F.col("g") >= F.col("b") - 3)
    green = hue.between(18, 100) & (s >= F.col("saturation")) & (v >= 22)
    more = (raster.excess_green("r", "g", "b") >= F.col("excess")) & (s >= F.greatest(F.lit(28.0), 0.62 * F.col("saturation"))) & lead
    vivid = own.join(solid, "item", "left_anti").filter(green | more)
    kept = _with(parts(closed(opened(vivid, 1), 2)), area).withColumn("_most", F.max("size").over(Window.partitionBy("item")))
    second = kept.filter((F.col("size") >= F.col("least")) & (F.col("size") >= 0.025 * F.col("_most"))).select(*XY)
    return first.withColumn("uniform", F.lit(True)).unionByName(second.withColumn("uniform", F.lit(False)))


def largest_share(mask: DataFrame, area: DataFrame) -> DataFrame:
    """The items whose mask has the pixels and the share of the frame of a plant."""
    size = _with(mask.groupBy("item").agg(F.count("*").alias("n")), area)
    return size.filter((F.col("n") >= F.col("least")) & (F.col("n") / F.col("area")).between(0.0001, 0.45)).select("item")


# --- region of interest ------------------------------------------------------------------------------


def hints_within(hints: DataFrame, frames: DataFrame) -> DataFrame:
    """(item, x, y) of hints (item, hint_x, hint_y) that are finite and within 5 % of the frame, moved into it."""
    h = _with(hints, frames)
    fine = F.lit(True)
    for v, size in (("hint_x", "width"), ("hint_y", "height")):
        fine &= F.coalesce(~F.isnan(v) & F.col(v).between(-0.05 * F.col(size), 1.05 * F.col(size)), F.lit(False))
    into = lambda v, size: half_even(F.least(F.greatest(v, F.lit(0.0)), F.col(size) - 1.0)).cast("int")
    return h.filter(fine).select("item", into("hint_x", "width").alias("x"), into("hint_y", "height").alias("y"))


def _closest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each item the point (x, y) nearest to any target, the first in row order of equal ones, and how
    far it is."""
    named = points.select("item", F.struct("y", "x").alias("p"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    goals = targets.select("item", F.struct("y", "x").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    best = nearest(named, goals, "item", "p", "t").groupBy("item").agg(F.min(F.struct("distance", "p")).alias("b"))
    return best.select("item", F.col("b.p.x").alias("x"), F.col("b.p.y").alias("y"), F.col("b.distance").alias("distance"))


def seeds(image: DataFrame, root: DataFrame, frames: DataFrame) -> DataFrame:
    """The attached seed of each item: the largest brown component within three pixels of the root."""
    hue, s, v = raster.hsv("r", "g", "b")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    brown = (hue <= 35) & (s >= 24) & v.between(18, 245) & ((r >= 0.98 * g) | (r >= 1.08 * b))
    near = closed(image.filter(brown).select(*XY).join(grown(root, 3), XY, "left_semi"), 1)
    size = _area(frames).withColumn("least", _share(0.00001, F.col("area"), 8))
    return largest(_with(parts(near), size).filter(F.col("size") >= F.col("least")).select(*XY))


def _heading(points: DataFrame, base: DataFrame) -> DataFrame:
    """(item, way_x, way_y): from the base (item, base_x, base_y) to the mean of the farthest 18 % of the
    points; where that is the base itself along their principal axis; to the right for a single point."""
    off = _with(points, base).withColumn("off", F.hypot(F.col("x") - F.col("base_x"), F.col("y") - F.col("base_y")))
    far = _with(off, quantiles(off, {"q": ("off", 0.82)}, ["item"])).withColumn("far", F.col("off") >= F.col("q"))
    mean = lambda v, only=None: F.avg(F.col(v) if only is None else F.when(only, F.col(v)))
    one = far.groupBy("item").agg(
        F.count("*").alias("n"), (mean("x", F.col("far")) - F.first("base_x")).alias("fx"), (mean("y", F.col("far")) - F.first("base_y")).alias("fy"),
        (mean("x") - F.first("base_x")).alias("mx"), (mean("y") - F.first("base_y")).alias("my"), principal_axis("x", "y").alias("axis"),
    )
    turn = F.when(F.col("axis.dx") * F.col("mx") + F.col("axis.dy") * F.col("my") >= 0, 1.0).otherwise(-1.0)
    length = F.hypot("fx", "fy")
    pick = lambda f, a, one_: F.when(F.col("n") < 2, one_).when(length >= 1e-6, F.col(f) / length).otherwise(turn * F.col(a))
    return one.select("item", pick("fx", "axis.dx", 1.0).alias("way_x"), pick("fy", "axis.dy", 0.0).alias("way_y"))


def _placed(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with its item's row and each pixel's place along the way from the base and across it."""
    dx, dy = F.col("x") - F.col("base_x"), F.col("y") - F.col("base_y")
    return _with(df, one).withColumns({"along": dx * F.col("way_x") + dy * F.col("way_y"), "across": F.abs(dy * F.col("way_x") - dx * F.col("way_y"))})


def region_of_interest(image: DataFrame, shoot: DataFrame, root: DataFrame, full: DataFrame, frames: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(regions, measures) of the parts of plants on the shoot's side of a boundary. The boundary is the
    shoot's pixel nearest to the seed (to the root without one, to a hint without either). A region has
    the shoot beyond it and the plant in a collar about it, as far as green is linked to it; where less
    than 0.9 of the shoot's green stayed, that comes back.

    regions: item, x, y, transition (in the collar). measures: one row a frame with source, boundary and
    direction (base_x, base_y, way_x, way_y), diagonal, centre of the transition, how much of shoot, green
    and root the region has, and failure: 'no shoot' or 'no start', with all else null and no region."""
    seed = stage(seeds(image, root, frames), "seeds")
    hinted = hints_within(hints, frames) if hints is not None else frames.select("item", F.lit(0).alias("x"), F.lit(0).alias("y")).limit(0)
    ranked = seed.withColumn("k", F.lit(0)).unionByName(root.select(*XY).withColumn("k", F.lit(1))).unionByName(hinted.withColumn("k", F.lit(2)))
    first = ranked.groupBy("item").agg(F.min("k").alias("k"))
    base = _closest(shoot, ranked.join(first, ["item", "k"])).select("item", F.col("x").alias("base_x"), F.col("y").alias("base_y"))
    base = stage(base.join(first, "item").select("item", "base_x", "base_y", F.element_at(F.array(*map(F.lit, SOURCES)), F.col("k") + 1).alias("source")), "base")
    hue, s, _ = raster.hsv("r", "g", "b")
    green = image.filter(hue.between(24, 92) & (s >= 30) & (raster.excess_green("r", "g", "b") >= 7)).select(*XY)
    flag = lambda m, name: m.select(*XY, F.lit(name).alias("in"))
    masks = {"shoot": shoot, "root": root, "full": full, "green": green, "margin": grown(seed, 1), "beside": grown(shoot, 3)}
    every = None
    for name, m in masks.items():
        every = flag(m, name) if every is None else every.unionByName(flag(m, name))
    cells = every.groupBy(*XY).agg(*[F.max(F.col("in") == name).alias(name) for name in masks])
    cells = stage(cells.withColumn("core", F.col("green") & F.col("full")).filter("shoot OR root OR full"), "cells")
    few = Window.partitionBy("item")
    heads = cells.filter("shoot").withColumn("_n", F.count_if(F.col("core")).over(few)).filter((F.col("_n") < 20) | F.col("core"))
    box = cells.filter("full").groupBy("item").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("d"))
    one = base.join(_heading(heads, base), "item").join(frames, "item").join(box, "item", "left")
    one = one.withColumn("diagonal", F.greatest(F.lit(1.0), F.coalesce("d", F.hypot("width", "height")))).drop("d")
    share = lambda of, least: F.greatest(F.lit(float(least)), of * F.col("diagonal"))
    one = stage(one.withColumns({"collar": share(0.035, 8), "behind": -share(0.004, 2), "reach": share(0.035, 7), "onward": share(0.012, 3), "inward": share(0.012, 4)}), "items")
    at = stage(_placed(cells, one), "placed")
    stray, side = F.col("root") & ~F.col("beside"), F.col("along") >= F.col("behind")
    collar = (F.col("along") <= F.col("collar")) & (F.col("across") <= F.col("reach"))
    start = ((F.col("shoot") & side) | (F.col("full") & side & collar & ~stray)) & ~F.col("margin")
    whole = stage(closed(at.filter(start), 1), "start")
    linked = whole.join(at.filter(F.col("core") & (F.col("along") >= F.col("onward"))), XY, "left_semi")
    small = _area(frames).withColumn("least", _share(0.000005, F.col("area"), 6))
    bridged = _with(parts(grown(whole, 2)), small).filter(F.col("size") >= F.col("least"))
    held = bridged.join(linked, XY, "left_semi").select("item", "component").distinct()
    kept = whole.join(bridged.join(held, ["item", "component"], "left_semi"), XY, "left_semi")
    kept = kept.unionByName(largest(whole.join(linked.select("item").distinct(), "item", "left_anti")))
    kept = stage(kept.unionByName(largest(at.filter(F.col("shoot") & side).join(kept.select("item").distinct(), "item", "left_anti"))), "kept")
    vivid = at.filter("core AND shoot")
    before = vivid.join(kept.withColumn("_in", F.lit(1)), XY, "left").groupBy("item").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("green_retention_before"))
    lost = _with(vivid.select(*XY), before.filter("green_retention_before < 0.9")).select(*XY)
    back = grown(lost, 2).join(at.filter("shoot AND NOT margin"), XY, "left_semi")
    roi = kept.unionByName(back).distinct().join(at.filter(stray), XY, "left_anti")
    roi = stage(_placed(roi, one).select(*XY, "along", "across", ((F.col("along") >= 0) & collar).alias("transition")), "regions")
    inside = roi.withColumn("_any", F.max("transition").over(few)).filter(F.col("transition") | ~F.col("_any"))
    off = F.hypot(F.col("along") - F.col("inward"), F.col("across"))
    centre = _with(inside, one.select("item", "inward")).groupBy("item").agg(F.min(F.struct(off.alias("o"), "y", "x")).alias("c"))
    told = at.join(roi.select(*XY, F.lit(1).alias("_in")), XY, "left").groupBy("item").agg(
        *[(F.count_if(F.col(m) & F.col("_in").isNotNull()) / F.greatest(F.count_if(F.col(m)), F.lit(1))).alias(name) for m, name in (("shoot", "shoot_retention"), ("root", "root_overlap"))],
        (F.count_if(F.col("core") & F.col("shoot") & F.col("_in").isNotNull()) / F.greatest(F.count_if(F.col("core") & F.col("shoot")), F.lit(1))).alias("green_retention"),
    )
    to_hint = _closest(shoot, hinted).select("item", F.col("x").alias("_hx"), F.col("y").alias("_hy"))
    out = frames.select("item").join(one.select("item", "source", "base_x", "base_y", "way_x", "way_y", "diagonal"), "item", "left").join(told, "item", "left").join(before, "item", "left")
    out = out.join(centre.select("item", F.col("c.x").alias("centre_x"), F.col("c.y").alias("centre_y")), "item", "left").join(to_hint, "item", "left")
    out = out.join(shoot.select("item").distinct().withColumn("_s", F.lit(1)), "item", "left")
    failure = F.when(F.col("_s").isNull(), "no shoot").when(F.col("source").isNull(), "no start")
    out = out.withColumns({"hint_distance": F.hypot(F.col("base_x") - F.col("_hx"), F.col("base_y") - F.col("_hy")), "repaired": F.col("green_retention_before") < 0.9, "failure": failure})
    return roi.select(*XY, "transition"), out.drop("_hx", "_hy", "_s")


# --- structure -----------------------------------------------------------------------------------------


def _rounded(share: float, least: int) -> Column:
    """A share of the item's diagonal in whole pixels."""
    return F.greatest(F.lit(least), half_even(share * F.col("diagonal")).cast("int"))


def _clusters(points: DataFrame, scale: DataFrame) -> DataFrame:
    """(item, component, cx, cy): middles of what points (item, x, y) make when they grow by 1.2 % of
    their item's diagonal (two pixels at least)."""
    wide = grown(_with(points.select(*XY), scale).withColumn("_w", _rounded(0.012, 2)), F.col("_w"))
    return parts(wide).groupBy("item", "component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def _at_middle(clusters: DataFrame, pixels: DataFrame) -> DataFrame:
    """Of each cluster the pixel nearest to its middle."""
    middle = clusters.select("item", "component", F.col("cx").alias("x"), F.col("cy").alias("y"))
    got = nearest(middle, pixels.select("item", F.struct("y", "x").alias("at"), "x", "y"), "item", "component", "at")
    return got.select("item", "component", F.col("at.x").alias("x"), F.col("at.y").alias("y"))


def line_ends(ends: DataFrame, scale: DataFrame) -> DataFrame:
    """One of the ends (item, x, y) for each cluster of them; scale is (item, diagonal)."""
    return _at_middle(_clusters(ends, scale), ends).select(*XY)


def lasting_junctions(forks: DataFrame, skeleton: DataFrame, scale: DataFrame) -> DataFrame:
    """Of each cluster of forks the skeleton's pixel at its middle, if three or more arms of 3.5 % of the
    diagonal leave a disc of 1.4 % about it."""
    centre = stage(_with(_at_middle(_clusters(forks, scale), skeleton), scale), "centres")
    about = centre.select("item", "component", F.col("x").alias("jx"), F.col("y").alias("jy"), _rounded(0.014, 3).alias("cut"), _rounded(0.035, 8).alias("arm"))
    off = F.hypot(F.col("x") - F.col("jx"), F.col("y") - F.col("jy"))
    beyond = _with(skeleton.select(*XY), about).withColumn("off", off).filter(F.col("off") > F.col("cut"))
    beyond = beyond.withColumn("key", F.concat_ws("/", F.col("item").cast("string"), F.col("component").cast("string")))
    arms = parts(beyond.select(F.col("key").alias("item"), "x", "y")).withColumnRenamed("item", "key").drop("size")
    arms = beyond.join(arms.withColumnRenamed("component", "part"), ["key", "x", "y"]).groupBy("item", "key", "jx", "jy", "part")
    arms = arms.agg(((F.count("*") >= F.first("arm")) & (F.min("off") <= F.first("cut") + 3)).alias("leads"))
    return arms.groupBy("item", "key", "jx", "jy").agg(F.count_if("leads").alias("n")).filter("n >= 3").select("item", F.col("jx").alias("x"), F.col("jy").alias("y")).distinct()


def _degrees(skeleton: DataFrame) -> DataFrame:
    from mensura.operators.graph import degrees, pixel_edges

    return degrees(pixel_edges(skeleton))


def structures(mask: DataFrame) -> DataFrame:
    """Of each item's mask: pixels of its skeleton before and after short line ends are pruned, rounds,
    merged line ends, lasting junctions, components."""
    import numpy as np
    import pandas as pd

    from mensura.operators.graph import pruned

    def f(key, m):
        diagonal = float(np.hypot(*m.shape))
        skeleton = raster.skeleton(m)
        clean, told = pruned(skeleton, max(4.0, 0.012 * diagonal))
        y, x = clean.nonzero()
        return pd.DataFrame({"item": key, "x": x, "y": y, "before": int(skeleton.sum()), "rounds": told["rounds"], "diagonal": diagonal})

    kind = mask.schema["item"].dataType.simpleString()
    pixels = stage(raster.per_item(mask, f, f"item {kind}, x int, y int, before int, rounds int, diagonal double"), "skeletons")
    scale = pixels.select("item", "diagonal").distinct()
    degree = stage(_degrees(pixels), "degrees")
    counted = lambda d, name: d.groupBy("item").agg(F.count("*").cast("int").alias(name))
    ends = counted(line_ends(degree.filter("degree = 1"), scale), "endpoints")
    forks = counted(lasting_junctions(degree.filter("degree >= 3"), pixels, scale), "junctions")
    out = pixels.groupBy("item").agg(F.first("before").alias("before"), F.count("*").cast("int").alias("after"), F.first("rounds").alias("rounds"))
    pieces = parts(pixels).groupBy("item").agg(F.max("component").alias("components"))
    for part in (ends, forks, pieces):
        out = out.join(part, "item", "left")
    return out.fillna(0).select("item", "before", "after", "rounds", "endpoints", "junctions", "components")


def candidates(pixels: DataFrame, most: int = 30, transition: DataFrame | None = None, geometry_only: bool = False) -> DataFrame:
    """Scored structure of items before suppression: item, x, y, kind, score, contrast, attention, by rank.
    pixels (item, x, y, contrast, attention) are an item's support, which is closed and cleaned first.

    Kinds: line ends (one a cluster), lasting junctions, the skeleton's pixel nearest to the middle of
    the transition, corners of the support, and places within four pixels of the skeleton whose contrast
    is the largest around and in the top 4 % of the support. What the rules of ``keypoints`` reject is
    left out; with geometry_only contrast and attention count as 0."""
    import numpy as np
    import pandas as pd

    from mensura.operators.phenotype import corners

    def f(key, m):
        whole, skeleton = raster.structural_support(np.pad(m, 2))
        y, x = whole.nonzero()
        own = max(1.0, float(np.hypot(np.ptp(x), np.ptp(y)))) if len(x) else 1.0
        found = corners(whole, 3 * most, apart=max(8, round(0.05 * own))).astype(int)
        corner = np.zeros(whole.shape, bool)
        corner[found[:, 1], found[:, 0]] = True
        return pd.DataFrame({"item": key, "x": x - 2, "y": y - 2, "skeleton": skeleton[y, x], "corner": corner[y, x], "diagonal": own})

    kind = pixels.schema["item"].dataType.simpleString()
    support = stage(raster.per_item(pixels, f, f"item {kind}, x int, y int, skeleton boolean, corner boolean, diagonal double"), "supports")
    maps = [F.lit(0.0).alias(m) if geometry_only else F.coalesce(m, F.lit(0.0)).cast("double").alias(m) for m in ("contrast", "attention")]
    support = stage(support.join(pixels.select(*XY, "contrast", "attention"), XY, "left").select(*support.columns, *maps), "supports")
    skeleton, scale = support.filter("skeleton"), support.select("item", "diagonal").distinct()
    degree = stage(_degrees(skeleton), "degrees")
    found = {"endpoint": line_ends(degree.filter("degree = 1"), scale), "junction": lasting_junctions(degree.filter("degree >= 3"), skeleton, scale), "corner": support.filter("corner")}
    if transition is not None:
        near = skeleton.join(grown(_with(transition.select(*XY), scale).withColumn("_w", _rounded(0.01, 2)), F.col("_w")), XY, "left_semi")
        middle = transition.groupBy("item").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumn("component", F.lit(0))
        found["basal_transition"] = _at_middle(middle, near)
    if not geometry_only:
        high = _with(support, quantiles(support, {"_high": ("contrast", 0.96)}, ["item"])).filter(F.col("contrast") >= F.col("_high"))
        high = high.join(grown(skeleton, 4), XY, "left_semi").withColumn("_r", F.floor(F.greatest(F.lit(5), F.floor(_rounded(0.05, 8) / 2)) / 2).cast("int"))
        reach = F.sequence(-F.col("_r"), F.col("_r"))
        around = high.select(*XY, F.explode(reach).alias("dx"), "_r").select(*XY, "dx", F.explode(reach).alias("dy"))
        around = around.select("item", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
        top = around.join(support.select(*XY, "contrast"), XY).groupBy("item", F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.max("contrast").alias("_top"))
        found["distinctive"] = high.join(top, XY).filter(F.col("contrast") >= F.col("_top"))
    every = None
    for name, places in found.items():
        named = places.select(*XY, F.lit(name).alias("kind"))
        every = named if every is None else every.unionByName(named)
    scored = every.join(support.select(*XY, "contrast", "attention"), XY).withColumn("score", keypoints.structure_score("kind", "contrast", "attention"))
    kept = keypoints.ordered(scored.filter(keypoints.accepted("kind", "score", geometry_only)), "item")
    return kept.select("item", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "kind", "score", "contrast", "attention", "rank")


# --- roots and bases -----------------------------------------------------------------------------------


def end_colours(ends: DataFrame, image: DataFrame, support: DataFrame, scale: DataFrame) -> DataFrame:
    """(item, x, y, colour) of line ends: how brown rather than green the image is within 1.2 % of the
    diagonal, from medians over the support there, or over all pixels if it has none; over those with
    some chroma if there are five or more."""
    at = _with(ends.select(*XY), scale).withColumn("_r", _rounded(0.012, 3))
    box = lambda v: F.explode(F.sequence(F.col(v) - F.col("_r"), F.col(v) + F.col("_r")))
    near = at.select("item", F.struct("x", "y").alias("end"), "y", "_r", box("x").alias("x")).select("item", "end", "x", box("y").alias("y"))
    near = near.join(image.select(*XY, "r", "g", "b"), XY).join(support.select(*XY, F.lit(True).alias("own")).distinct(), XY, "left")
    of = Window.partitionBy("item", "end")
    near = near.withColumn("_any", F.max("own").over(of)).filter(F.col("own") | F.col("_any").isNull())
    vivid = F.greatest("r", "g", "b") - F.least("r", "g", "b") >= 25
    near = near.withColumn("_n", F.count_if(vivid).over(of)).filter(vivid | (F.col("_n") < 5))
    m = near.groupBy("item", "end").agg(*[F.median(c).alias(c) for c in "rgb"])  # a few hundred pixels an end
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return m.select("item", "end.x", "end.y", (r + b - 2 * g + 0.12 * (255 - (r + g + b) / 3) + 0.1 * (r - g)).alias("colour"))


def roots(ends: DataFrame) -> DataFrame:
    """The root of each item among its line ends (item, x, y, colour, stub, width, far): the best of .55
    colour, .05 short stub, .15 width and .25 eccentricity, each scaled over the item's ends (a constant
    one counts as 1); with score and margin before the next, 1 for a single end. Ties in row order."""
    from mensura.operators.robust import unit_scale

    # The shorter the stub the better; scaling its negative would not do, as a constant one counts as 1.
    scaled = ends
    for trait in ("colour", "stub", "width", "far"):
        scaled = unit_scale(scaled, trait, ["item"], f"_{trait}")
    total = 0.55 * F.col("_colour") + 0.05 * (1 - F.col("_stub")) + 0.15 * F.col("_width") + 0.25 * F.col("_far")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "y", "x")
    ranked = scaled.withColumn("score", total).withColumns({"_k": F.row_number().over(order), "_next": F.lead("score").over(order)})
    return ranked.filter("_k = 1").select(*XY, "score", F.coalesce(F.col("score") - F.col("_next"), F.lit(1.0)).alias("margin"))


def bases(nodes: DataFrame, shoot: DataFrame, root: DataFrame, scale: DataFrame) -> DataFrame:
    """(item, node, failure, rule) for each item of scale: of nodes (item, node, x, y, score, region) the first by
    region (overlap, root, other), distance from where shoot and root meet, and score descending."""
    from mensura.operators.graph import NO_INTERFACE, NO_NODES, REGION_RULE

    by = lambda m: grown(_with(m.select(*XY), scale).withColumn("_w", _rounded(0.012, 2)), F.col("_w"))
    meet = stage(by(shoot).join(by(root), XY, "left_semi"), "interfaces")
    off = nearest(nodes, meet.withColumn("at", F.struct("y", "x")), "item", "node", "at").select("item", "node", "distance")
    order = F.when(F.col("region") == "shoot_root_overlap", 0).when(F.col("region") == "seed_base_root", 1).otherwise(2)
    best = nodes.join(off, ["item", "node"]).groupBy("item").agg(F.min(F.struct(order.alias("o"), "distance", (-F.col("score")).alias("s"), "node")).alias("b"))
    return _chosen(scale, best, nodes, meet, NO_INTERFACE, NO_NODES).withColumn("rule", F.lit(REGION_RULE))


def roi_bases(nodes: DataFrame, roi: DataFrame, transition: DataFrame, scale: DataFrame) -> DataFrame:
    """(item, node, failure, rule): of the nodes whose pixel lies in the region grown by 1 % of the diagonal, the
    nearest to the transition, within 8 % of it (12 pixels at least)."""
    from mensura.operators.graph import NO_NEAR_NODE, NO_NODES, NO_TRANSITION, ROI_RULE

    wide = grown(_with(roi.select(*XY), scale).withColumn("_w", _rounded(0.01, 2)), F.col("_w"))
    pixel = nodes.withColumns({"_nx": half_even("x").cast("int"), "_ny": half_even("y").cast("int")})
    inside = pixel.join(wide.select("item", F.col("x").alias("_nx"), F.col("y").alias("_ny")), ["item", "_nx", "_ny"], "left_semi")
    off = nearest(inside, transition.withColumn("at", F.struct("y", "x")), "item", "node", "at").select("item", "node", "distance")
    near = _with(inside.join(off, ["item", "node"]), scale).filter(F.col("distance") <= F.greatest(F.lit(12.0), 0.08 * F.col("diagonal")))
    best = near.groupBy("item").agg(F.min(F.struct("distance", (-F.col("score")).alias("s"), "node")).alias("b"))
    out = _chosen(scale, best, nodes, transition, NO_TRANSITION, NO_NODES)
    failure = F.when(F.col("node").isNull() & (F.col("failure") == ""), NO_NEAR_NODE).otherwise(F.col("failure"))
    return out.withColumns({"failure": failure, "rule": F.lit(ROI_RULE)})


def _chosen(scale: DataFrame, best: DataFrame, nodes: DataFrame, needed: DataFrame, without: str, no_nodes: str) -> DataFrame:
    has = lambda d, name: d.select("item").distinct().withColumn(name, F.lit(True))
    out = scale.select("item").join(best, "item", "left").join(has(nodes, "_n"), "item", "left").join(has(needed, "_m"), "item", "left")
    failure = F.when(F.col("_n").isNull(), no_nodes).when(F.col("_m").isNull(), without).otherwise("")
    return out.select("item", F.col("b.node").alias("node"), failure.alias("failure"))
