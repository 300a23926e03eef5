"""Rank tests and moments. Statistics are aggregates; only their p-values need Python, on one row."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.ranking import average_rank


def kruskal(df: DataFrame, x: str, by: str) -> DataFrame:
    """One row: h corrected for ties, groups."""
    ranked = average_rank(df, x, [], "_r")
    g = ranked.groupBy(by).agg(F.count("*").alias("n"), F.sum("_r").alias("s"))
    ties = df.groupBy(x).agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("t"))
    n = F.sum("n").cast("double")
    g = g.agg(n.alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count("*").alias("groups"))
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return g.crossJoin(F.broadcast(ties)).select(h.alias("h"), "groups", F.col("n").cast("bigint").alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho of the rows where both are there, n, and the two-sided p_value by Student's t (null
    below three rows or where a side is constant)."""
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    one = average_rank(average_rank(both, "x", [], "rx"), "y", [], "ry").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))

    def values(batches):
        for pdf in batches:
            yield pdf.assign(p_value=[spearman_p(r, int(n)) for r, n in zip(pdf["rho"], pdf["n"])])

    return one.mapInPandas(values, "rho double, n bigint, p_value double").withColumn("p_value", F.nanvl("p_value", F.lit(None)))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or rho is None or math.isnan(rho):
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    return beta_share((n - 2) / 2, 0.5, 1 - rho * rho)  # t**2 / (df + t**2) is rho**2


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))), from the inside out; as many terms as settle it."""
    last, terms = math.inf, 64
    while True:
        f = 1.0
        for k in range(terms, 0, -1):
            m = k // 2
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if k % 2 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            f = 1 + d / f
        if abs(f - last) <= 1e-14 * abs(f) or terms > 1 << 16:
            return 1 / f
        last, terms = f, 2 * terms


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees > x), by the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    if z < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= z / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def rank_sum_p(u: float, n1: int, n0: int, ties: float) -> float:
    """The two-sided p-value of Mann and Whitney's U: by its exact distribution if there are no ties and a
    side has eight values at most (and the other no more than 2,500), else normal with the ties and a
    correction for continuity."""
    if not n1 or not n0:
        return math.nan
    if not ties and min(n1, n0) <= 8 and max(n1, n0) <= 2500:
        ways = [1.0]  # of each sum, as products of (1 - q**(n + i)) / (1 - q**i) in turn
        small, large = sorted((n1, n0))
        for i in range(1, small + 1):
            more = ways + [0.0] * large
            for k in range(len(more) - 1, large + i - 1, -1):
                more[k] -= more[k - large - i]
            for k in range(i, len(more)):
                more[k] += more[k - i]
            ways = more
        beyond = sum(ways[math.ceil(max(u, n1 * n0 - u)) :]) / sum(ways)
        return min(1.0, 2 * beyond)
    n = n1 + n0
    var = n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))
    return normal_two_sided(max(0.0, abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(var)) if var > 0 else 1.0


def association(df: DataFrame, x: str, binary: str, group: str, other: str | None = None) -> DataFrame:
    """test, statistic, p_value of the association of x with a column of 0 and 1 (Mann-Whitney), with
    groups (Kruskal-Wallis) and, if given, with another number (Spearman). Rows without x take no part, in
    a test neither do those without its other side."""
    rows = df.select(F.col(x).alias("x"), F.col(binary).cast("int").alias("b"), F.col(group).alias("g"), *([F.col(other).alias("o")] if other else [])).filter("x IS NOT NULL")
    two = average_rank(rows.filter("b IN (0, 1)").select("x", "b"), "x", [], "r")
    n1, n0 = F.count_if(F.col("b") == 1), F.count_if(F.col("b") == 0)
    u = (F.sum(F.when(F.col("b") == 1, F.col("r"))) - n1 * (n1 + 1) / 2.0).alias("u")
    cubes = F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("t")
    ties = two.groupBy("x").agg(F.count("*").cast("double").alias("k")).agg(cubes)
    one = two.agg(u, n1.alias("n1"), n0.alias("n0")).crossJoin(F.broadcast(ties)).crossJoin(F.broadcast(kruskal(rows.filter("g IS NOT NULL").select("x", "g"), "x", "g").select("h", "groups")))
    if other:
        one = one.crossJoin(F.broadcast(spearman(rows, "x", "o").select("rho", F.col("p_value").alias("rho_p"))))

    def values(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rank_sum = ("mann_whitney_u", r.u, rank_sum_p(r.u, int(r.n1), int(r.n0), r.t))
                tests = [rank_sum, ("kruskal_wallis", r.h, chi2_tail(r.h, max(1, int(r.groups) - 1)))] + ([("spearman", r.rho, r.rho_p)] if other else [])
                yield pd.DataFrame(tests, columns=["test", "statistic", "p_value"])

    return one.mapInPandas(values, "test string, statistic double, p_value double")


def principal_axis(x: Column | str, y: Column | str) -> Column:
    """Aggregate: struct of the unit vector of the larger variance of a 2-D cloud."""
    sxx, syy, sxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    angle = 0.5 * F.atan2(2 * sxy, sxx - syy)
    return F.struct(F.cos(angle).alias("dx"), F.sin(angle).alias("dy"))


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Projection of array columns on their k leading components (MLlib, JVM-side)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready)
    return model.transform(ready).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")
