"""Audit of item tables: cascades, penalty scores, flags, duplicates, violations and gates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.scalar import c, clip, finite, flagged
from mensura.operators.ranking import quantiles
from mensura.operators.robust import MAD_SCALE
from mensura.staging import numbered


def cascade(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    return functools.reduce(lambda w, r: w.when(*r), rules[1:], F.when(*rules[0])).otherwise(otherwise)


def background_by_luminance(mean, deviation) -> Column:
    mean, deviation = c(mean), c(deviation)
    return cascade([(deviation > 45, "complex"), (mean < 55, "dark"), (mean > 200, "light")], "mid")


def background_by_fractions(alpha, white, black) -> Column:
    return cascade([(c(alpha) >= 0.1, "transparent"), (c(white) >= 0.6, "white"), (c(black) >= 0.6, "black")], "other")


def orientation(width, height, ratio: float = 1.15) -> Column:
    r = c(width) / F.greatest(c(height), F.lit(1))
    return cascade([(r >= ratio, "landscape"), (r <= 1 / ratio, "portrait")], "square")


def penalties(rules: dict[str, tuple[Column, float]], start: float = 100.0) -> tuple[Column, Column]:
    """(score: start less the weights of the conditions that hold, zero at least; list of their names)."""
    lost = functools.reduce(lambda a, b: a + b, [F.when(cond, F.lit(float(w))).otherwise(0.0) for cond, w in rules.values()])
    return F.greatest(F.lit(start) - lost, F.lit(0.0)), flagged({k: cond for k, (cond, _) in rules.items()})


def additive(terms: list[tuple[Column, float]], low: float = 0.0, high: float = 1.0) -> Column:
    return clip(functools.reduce(lambda a, b: a + b, [clip(x, 0.0, 1.0) * w for x, w in terms]), low, high)


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def nuisance(df: DataFrame, x: str, tail: float = 0.08) -> DataFrame:
    """Adds robust z, a score of how far it is out, and flags beyond the quantile tails; centre,
    scale and quantiles are one row."""
    one = quantiles(df, {"_med": (x, 0.5), "_lo": (x, tail), "_hi": (x, 1 - tail)})
    off = df.crossJoin(F.broadcast(one.select("_med"))).select(F.abs(c(x) - F.col("_med")).alias("_off"))
    mad = quantiles(off, {"_mad": ("_off", 0.5)}).select((MAD_SCALE * F.col("_mad")).alias("_mad"))
    z = (c(x) - F.col("_med")) / F.greatest(F.col("_mad"), F.lit(1e-9))
    out = df.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(mad))
    flags = flagged({"low_tail": c(x) < F.col("_lo"), "high_tail": c(x) > F.col("_hi"), "outlier": F.abs(z) > 3.5})
    return out.withColumns({"robust_z": z, "nuisance": clip(F.abs(z) / 3.5, 0.0, 1.0), "flags": flags}).drop("_med", "_lo", "_hi", "_mad")


def exact_groups(df: DataFrame, key: str, id_: str, prefix: str = "exact") -> DataFrame:
    """Rows whose key repeats, with a group label numbered by first member."""
    groups = df.groupBy(key).agg(F.min(id_).alias("first"), F.count("*").alias("size")).filter("size > 1")
    groups = numbered(groups, ["first"], "_n").withColumn("label", F.format_string(f"{prefix}_%03d", "_n")).drop("_n")
    return df.join(groups.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k")).drop("_k")


def split_leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).filter("splits > 1")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n): how many rows break each rule; a sound table has zero everywhere."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def gate(df: DataFrame, checks: dict[str, Column], human: tuple[str, ...] = ()) -> DataFrame:
    """One row: checks by name (human ones null) and the status; null checks don't count."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("boolean").alias("value")) for k, v in checks.items()]
    entries += [F.struct(F.lit(k).alias("key"), F.lit(None).cast("boolean").alias("value")) for k in human]
    out = df.withColumn("checks", F.map_from_entries(F.array(*entries)))
    passed = F.forall(F.map_values("checks"), lambda x: F.coalesce(x, F.lit(True)))
    return out.withColumns({"failed": F.array_join(F.array_sort(F.map_keys(F.map_filter("checks", lambda k, v: ~F.coalesce(v, F.lit(True))))), ";"), "status": F.when(passed, "pass").otherwise("stop_or_revise")})


# Checks as results name them, on the mean or median over items of a metric.
STRUCTURE_GATES = {
    "noncollapse_ratio_gte_0_83": ("noncollapse", "mean", ">=", 0.83),
    "repeatability_f1_gte_0_60": ("f1", "median", ">=", 0.60),
    "localization_error_lte_0_05": ("error", "median", "<=", 0.05),
    "photometric_count_difference_lte_1": ("count_difference", "median", "<=", 1.0),
    "safety_cap_hit_ratio_eq_0": ("cap_hit", "mean", "<=", 0.0),
    "skeleton_coverage_gte_0_55": ("coverage", "median", ">=", 0.55),
    "longitudinal_span_gte_0_65": ("span", "median", ">=", 0.65),
}
CLEAN_GATES = {
    "safety_cap_hit_rate_eq_0": ("cap_hit", "mean", "<=", 0.0),
    "repeatability_f1_gte_0_60": ("f1", "median", ">=", 0.60),
    "photometric_count_difference_lte_1": ("count_difference", "median", "<=", 1.0),
    "white_mask_hit_ratio_gte_0_80": ("mask_hit", "median", ">=", 0.80),
}


def machine_gate(df: DataFrame, rules: dict[str, tuple[str, str, str, float]]) -> DataFrame:
    """One row from a table of items: each metric that the rules name, as its mean or exact median over
    the items' finite values, with checks, failed and status as ``gate`` has them. A metric that no item
    has fails its checks, so an empty table passes none."""
    of = {metric: how for metric, how, _, _ in rules.values()}
    medians = quantiles(df, {m: (m, 0.5) for m, how in of.items() if how == "median"})
    means = df.agg(*[F.avg(finite(m)).alias(m) for m, how in of.items() if how == "mean"])
    holds = lambda m, sign, bound: F.col(m) >= bound if sign == ">=" else F.col(m) <= bound
    checks = {name: F.coalesce(holds(m, sign, bound), F.lit(False)) for name, (m, _, sign, bound) in rules.items()}
    return gate(medians.crossJoin(F.broadcast(means)).select(*of), checks)


def histogram(df: DataFrame, x: str) -> DataFrame:
    """One row: map of value to count with sorted keys."""
    counts = df.groupBy(F.col(x).cast("string").alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("histogram"))


def transitions(old: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """Old to new values of a review field with counts."""
    both = old.select(key, F.col(field).alias("old")).join(new.select(key, F.col(field).alias("new")), key)
    return both.groupBy("old", "new").agg(F.count("*").alias("n"))


class LockedSplitError(ValueError):
    """A locked split was asked for."""


def guard_splits(splits: list[str], locked: tuple[str, ...] = ("test",)) -> list[str]:
    """The splits, unless one is locked: the plan is refused before anything is read."""
    if found := sorted({s.lower() for s in splits} & set(locked)):
        raise LockedSplitError(f"locked: {', '.join(found)}")
    return splits


def require_only(df: DataFrame, column: str, allowed: set[str]) -> DataFrame:
    """df, with an error in its own plan on any other value (nulls too)."""
    good = c(column).isin(*sorted(allowed))
    return df.withColumn(column, F.when(good, c(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: "), F.coalesce(c(column).cast("string"), F.lit("null"))))))


def require(df: DataFrame, condition: Column, message: str) -> None:
    """Raises after writing, as a gate does: one row that breaks the condition is enough."""
    if not df.filter(~F.coalesce(condition, F.lit(False))).isEmpty():
        raise AssertionError(message)
