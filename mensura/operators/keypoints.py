"""Keypoint candidates: feature contrast, medoids, scored structure and role-keeping selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import c, clip, cosine
from mensura.operators.match import settled

# Prior score of each kind of structure.
PRIORS = {"endpoint": 0.68, "junction": 0.76, "basal_transition": 0.80, "corner": 0.32, "distinctive": 0.30}


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector of each group: positions are summed as rows, so any group size will do."""
    parts = df.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = parts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"))
    return packed.select(F.col(by).alias("_g"), F.transform("p", lambda x: x["m"]).alias("centroid"))


def contrast(df: DataFrame, by: str, vector: str, name: str = "contrast") -> DataFrame:
    """One less the cosine with the group's mean vector. Groups are few, so are their means; AQE
    chooses how they join."""
    return df.join(centroids(df, by, vector), c(by) == F.col("_g")).withColumn(name, 1 - cosine(vector, "centroid")).drop("_g", "centroid")


def grid_contrast(df: DataFrame, item: str, vector: str) -> DataFrame:
    """One less the cosine of each cell's vector with the mean over its 3 x 3 neighbourhood."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = df.select(item, "x", "y", F.explode(steps).alias("s"), vector)
    spread = spread.select(item, (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), F.posexplode(vector).alias("i", "v"))
    mean = spread.groupBy(item, "x", "y", "i").agg(F.avg("v").alias("m")).groupBy(item, "x", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("_mean"))
    return df.join(mean, [item, "x", "y"]).withColumn("contrast", 1 - cosine(vector, "_mean")).drop("_mean")


def medoids(df: DataFrame, by: str, vector: str, id_: str) -> DataFrame:
    """The member nearest to its group's mean, ties to the least id."""
    d = df.join(centroids(df, by, vector), c(by) == F.col("_g"))
    off = F.sqrt(F.aggregate(F.zip_with(vector, "centroid", lambda a, b: F.pow(a.cast("double") - b, 2)), F.lit(0.0), lambda s, x: s + x))
    best = d.groupBy(by).agg(F.min(F.struct(F.round(off, 9).alias("d"), F.col(id_).alias("i"))).alias("b"), F.count("*").alias("size"))
    return best.select(by, F.col("b.i").alias(id_), F.col("b.d").alias("distance"), "size")


def structure_score(kind: Column | str, contrast_: Column | str, attention: Column | str) -> Column:
    prior = F.lit(None).cast("double")
    for k, v in PRIORS.items():
        prior = F.when(c(kind) == k, v).otherwise(prior)
    return prior + 0.24 * c(contrast_) + 0.08 * c(attention)


def accepted(kind: Column | str, score: Column | str, geometry_only: bool = False) -> Column:
    """Endpoints, junctions and basal transitions always; corners and distinctive points by score."""
    return F.when(c(kind) == "corner", c(score) >= (0.32 if geometry_only else 0.56)).when(c(kind) == "distinctive", (c(score) >= 0.57) & F.lit(not geometry_only)).otherwise(F.lit(True))


def ordered(df: DataFrame, item: str) -> DataFrame:
    """Candidates ranked by score descending, kind, y, x."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), "kind", "y", "x")))


def cover(df: DataFrame, item: str, radius: float) -> DataFrame:
    """Structure coverage: basal points and endpoints first, then the rest by score; a point within the
    radius of a kept one adds its role to the first such rather than a point."""
    first = F.when(F.col("kind") == "basal_transition", 0).when(F.col("kind") == "endpoint", 1).otherwise(2)
    kept, every = settled(df.select(item, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "kind", "score"), item, [first, -F.col("score"), F.col("kind"), F.col("y"), F.col("x")], radius, touching=True)
    cell = lambda v: F.floor(F.col(v) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
    about = kept.select(item, F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("_o").alias("ko"), around.alias("s"))
    about = about.select(item, "kx", "ky", "ko", (cell("kx") + F.col("s.p")).alias("cx"), (cell("ky") + F.col("s.q")).alias("cy"))
    met = every.withColumns({"cx": cell("x"), "cy": cell("y")}).join(about, [item, "cx", "cy"])
    met = met.filter((F.pow(F.col("x") - F.col("kx"), 2) + F.pow(F.col("y") - F.col("ky"), 2) <= radius**2) & (F.col("ko") <= F.col("_o")))
    own = met.groupBy(item, "_o").agg(F.min("ko").alias("ko"), F.first("kind").alias("kind"))
    roles = own.groupBy(item, "ko").agg(F.array_sort(F.collect_set("kind")).alias("roles")).withColumnRenamed("ko", "_o")
    return every.join(roles, [item, "_o"]).select(item, "x", "y", "kind", "score", "roles")


def span_ratio(df: DataFrame, support: DataFrame, item: str) -> DataFrame:
    """Extent of an item's points along the principal axis of its support over the support's, clipped
    to 0 to 1.5."""
    from mensura.operators.stats import principal_axis

    axis = support.groupBy(item).agg(principal_axis("x", "y").alias("_a"))
    extent = lambda d, name: d.join(axis, item).groupBy(item).agg((F.max(F.col("x") * F.col("_a.dx") + F.col("y") * F.col("_a.dy")) - F.min(F.col("x") * F.col("_a.dx") + F.col("y") * F.col("_a.dy"))).alias(name))
    return extent(support, "_s").join(extent(df, "_p"), item).select(item, clip(F.col("_p") / F.greatest("_s", F.lit(1e-9)), 0.0, 1.5).alias("span_ratio"))
