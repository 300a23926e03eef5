"""Robust statistics: all exact, all skipping what is not finite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import c, finite
from mensura.operators.ranking import quantiles

MAD_SCALE = 1.4826


def finite_median(x) -> Column:
    return F.median(finite(x))


def quantile(x, p: float) -> Column:
    """Linear interpolation between order statistics, exact."""
    return F.percentile(finite(x), p)


def iqr(x) -> Column:
    return quantile(x, 0.75) - quantile(x, 0.25)


def with_mad(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """One row a group: n, centre (median) and scale (1.4826 times the median deviation), exact for groups
    of any size. The medians join back, so no window holds a group."""
    centre = quantiles(df, {"centre": (x, 0.5)}, by)
    both = df.join(centre.withColumnsRenamed({b: f"_{b}" for b in by}), _same(by)) if by else df.crossJoin(F.broadcast(centre))
    off = both.select(*by, "centre", finite(x).alias("_x"))
    scale = quantiles(off, {"_scale": (F.abs(F.col("_x") - F.col("centre")), 0.5)}, by).withColumnsRenamed({b: f"_{b}" for b in by})
    one = off.groupBy(*by).agg(F.count("_x").alias("n"), F.first("centre").alias("centre"))
    one = one.join(scale, _same(by)) if by else one.crossJoin(F.broadcast(scale))
    return one.select(*by, "n", "centre", (MAD_SCALE * F.col("_scale")).alias("scale"))


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for b in by:
        out &= F.col(b).eqNullSafe(F.col(f"_{b}"))
    return out


def robust_z(x, centre, scale) -> Column:
    return (c(x) - c(centre)) / F.greatest(c(scale), F.lit(1e-9))


def summarise(df: DataFrame, by: list[str], count: str, hit: str, noncollapse: str, cap: str, localisation: str) -> DataFrame:
    """The per-configuration summary in one aggregate, with its utility."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(c(noncollapse).cast("double")).alias("noncollapse_rate"), finite_median(count).alias("median_count"),
        iqr(count).alias("iqr_count"), F.avg(c(cap).cast("double")).alias("cap_rate"), finite_median(hit).alias("median_hit"),
        finite_median(localisation).alias("median_localisation"),
    )
    return out


def utility(f1, hit, noncollapse, localisation, cap) -> Column:
    """Repeatability plus hit and non-collapse, less localisation error (one if unknown) and cap."""
    z = lambda x: F.coalesce(finite(x), F.lit(0.0))
    return z(f1) + 0.25 * z(hit) + 0.15 * z(noncollapse) - 0.75 * F.coalesce(finite(localisation), F.lit(1.0)) - 0.25 * z(cap)


def best(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The row of each group that is first by order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_n(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group by order; each task keeps no more of a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def runs(df: DataFrame, by: list[str], x: str, gap: float, order: list[str]) -> DataFrame:
    """Adds run: the number, from one, of the stretch of a group's rows, in order of x, whose steps are
    at most ``gap``."""
    w = Window.partitionBy(*by).orderBy(x, *order)
    step = F.col(x) - F.lag(x).over(w)
    new = (step.isNull() | (step > gap)).cast("int")
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def tertiles(df: DataFrame, x: str, name: str, low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """low, medium or high against the global quantiles, which are one row; ties share a bin."""
    cuts = quantiles(df, {"_q1": (x, low), "_q2": (x, high)})
    label = F.when(c(x) <= F.col("_q1"), "low").when(c(x) <= F.col("_q2"), "medium").otherwise("high")
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, label).drop("_q1", "_q2")


def rank01(df: DataFrame, x: str, by: list[str], order: list[str], name: str = "rank01") -> DataFrame:
    """Dense 0 to 1 rank in a group; ties by order; a group of one gets 0."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(x, *order)) - 1
    return df.withColumn(name, rank / F.greatest(F.count("*").over(w) - 1, F.lit(1)))


def unit_scale(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """Min-max scaling in a group; a constant column scales to one."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return df.withColumn(name, F.when(high - low <= 1e-12, 1.0).otherwise((c(x) - low) / (high - low)))


def median_of(df: DataFrame, x: str, inner: list[str], outer: list[str], how: str) -> DataFrame:
    """Median over groups of the inner median or mean: two different things."""
    first = quantiles(df, {"_v": (x, 0.5)}, inner) if how == "median" else df.groupBy(*inner).agg(F.avg(finite(x)).alias("_v"))
    values = quantiles(first, {"value": ("_v", 0.5)}, outer).withColumnsRenamed({b: f"_{b}" for b in outer})
    sizes = first.groupBy(*outer).agg(F.count("*").alias("groups"))
    return (sizes.join(values, _same(outer)) if outer else sizes.crossJoin(F.broadcast(values))).select(*outer, "groups", "value")
