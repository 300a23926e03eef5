"""Exact quantiles and ranks of groups of any size.

Groups of a bounded number of rows take one aggregate. Of larger ones no task holds the values: order
statistics are found by selection, in rounds that each cut a range of values at points of a sketch, count
what lies between, exactly, and keep only what lies around the rank; ranks come from value counts that are
ranged and summed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import c, finite
from mensura.staging import running, stage

LIMIT = 100_000  # rows of a group whose values one task may hold
CUTS = 64  # ranges of a round


def _same(n: int, left: str, right: str) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(f"{left}.g{i}").eqNullSafe(F.col(f"{right}.g{i}")) for i in range(n)], F.lit(True))


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column | str, float]], by: list[str] | tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """One row a group: its columns ``by``, and for each name (x, share) the exact quantile of the finite
    values of x by linear interpolation, null where there are none. Without ``by`` there is one row, for
    an empty table too. Null groups are groups; repeated rows count each."""
    limit = LIMIT if limit is None else limit
    by, names = list(by), list(wanted)
    group = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[c(b).alias(g) for b, g in zip(by, group)], *[finite(x).alias(f"x{k}") for k, (x, _) in enumerate(wanted.values())])
    plain = [F.percentile(f"x{k}", p).alias(f"q{k}") for k, (_, p) in enumerate(wanted.values())]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    large = stage(sizes.filter(F.col("n") > limit).select(*group, F.lit(1).alias("one")), "large")
    if large.isEmpty():
        out = rows.groupBy(*group).agg(*plain)
    else:
        of = large.alias("b")
        near = F.broadcast(of) if not by else of
        same = _same(len(by), "a", "b")
        big = stage(rows.alias("a").join(near, same, "left_semi"), "big")
        out = functools.reduce(lambda a, b: a.alias("a").join(b.alias("b"), same, "left").select("a.*", *[f"b.q{k}" for k in range(len(names)) if f"q{k}" in b.columns]), [_selected(big, len(by), k, p, limit) for k, (_, p) in enumerate(wanted.values())], large)
        if by:
            small = rows.alias("a").join(near, same, "left_anti")
            out = out.drop("one").unionByName(small.groupBy(*group).agg(*plain))
    return out.select(*[F.col(g).alias(b) for b, g in zip(by, group)], *[F.col(f"q{k}").alias(name) for k, name in enumerate(names)])


def _selected(big: DataFrame, n_by: int, k: int, share: float, limit: int) -> DataFrame:
    """(group, qk): the quantile of column xk in each of the groups."""
    group = [f"g{i}" for i in range(n_by)]
    left = stage(big.select(*group, F.col(f"x{k}").alias("x")).filter("x IS NOT NULL"), "values")
    at = left.groupBy(*group).agg(F.count("*").alias("n")).withColumn("at", share * (F.col("n") - 1)).filter("n > 0")
    at = stage(at.withColumns({"low": F.floor("at"), "high": F.ceil("at")}), "places")
    both = F.array_distinct(F.array("low", "high"))
    ranks = at.select(*group, F.explode(both).alias("rank"))
    found = order_statistics(left, ranks, n_by, limit)
    pick = lambda name: found.select(*group, "rank", F.col("value").alias(name))
    same = _same(n_by, "a", "b")
    one = at.alias("a").join(pick("v").alias("b"), same & (F.col("a.low") == F.col("b.rank"))).select("a.*", "v")
    two = one.alias("a").join(pick("w").alias("b"), same & (F.col("a.high") == F.col("b.rank"))).select("a.*", "w")
    value = F.when(F.col("v") == F.col("w"), F.col("v")).otherwise((F.col("high") - F.col("at")) * F.col("v") + (F.col("at") - F.col("low")) * F.col("w"))
    return two.select(*group, value.alias(f"q{k}"))


def order_statistics(values: DataFrame, ranks: DataFrame, n_by: int, limit: int | None = None) -> DataFrame:
    """(g0..., rank, value) for values (g0..., x; no nulls) and wanted ranks (g0..., rank from 0, below the
    group's size). A range is left once it holds ``limit`` values: these are counted in one task."""
    limit = LIMIT if limit is None else limit
    group = [f"g{i}" for i in range(n_by)]
    keys = [*group, "rank"]
    near = F.broadcast if not n_by else lambda d: d  # without groups as many rows as ranks
    same = _same(n_by, "a", "b")
    inside = (F.col("b.low").isNull() | (F.col("a.x") > F.col("b.low"))) & (F.col("b.high").isNull() | (F.col("a.x") < F.col("b.high")))
    bounds = F.lit(None).cast("double")
    # k: the rank among the values between low and high, both exclusive.
    state = stage(ranks.select(*group, "rank", F.col("rank").alias("k"), bounds.alias("low"), bounds.alias("high"), bounds.alias("value")), "state")
    left = values
    while True:
        open_ = state.filter("value IS NULL")
        met = left.alias("a").join(near(open_.alias("b")), same & inside).select(*[F.col(f"b.{x}").alias(x) for x in (*keys, "k", "low", "high")], F.col("a.x").alias("x"))
        grid = F.percentile_approx("x", [i / CUTS for i in range(CUTS + 1)], 4096)
        cut = met.groupBy(*keys).agg(F.count("*").alias("n"), F.first("k").alias("k"), grid.alias("s"))
        place = F.floor(F.col("k") / F.col("n") * CUTS).cast("int")
        cut = cut.select(*keys, "n", F.element_at("s", F.greatest(place, F.lit(1))).alias("a"), F.element_at("s", F.least(place + 3, F.lit(CUTS + 1))).alias("b"))
        cut = stage(cut, "cuts")
        if cut.filter(F.col("n") > limit).isEmpty():
            break
        on = functools.reduce(lambda p, q: p & q, [F.col(f"m.{x}").eqNullSafe(F.col(f"c.{x}")) for x in keys])
        x, a, b = F.col("m.x"), F.col("c.a"), F.col("c.b")
        counted = met.alias("m").join(near(cut.alias("c")), on).groupBy(*[F.col(f"m.{y}").alias(y) for y in keys]).agg(
            F.first("m.k").alias("k"), F.first("m.low").alias("low"), F.first("m.high").alias("high"), F.first("c.a").alias("a"), F.first("c.b").alias("b"),
            F.count_if(x < a).alias("n0"), F.count_if(x == a).alias("n1"), F.count_if((x > a) & (x < b)).alias("n2"), F.count_if((x == b) & (b > a)).alias("n3"),
        )
        upto = [F.col("n0"), F.col("n0") + F.col("n1"), F.col("n0") + F.col("n1") + F.col("n2"), F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")]
        part = F.when(F.col("k") < upto[0], 0).when(F.col("k") < upto[1], 1).when(F.col("k") < upto[2], 2).when(F.col("k") < upto[3], 3).otherwise(4)
        p, k = F.col("part"), F.col("k")
        moved = counted.withColumn("part", part).select(
            *keys, F.when(p == 2, k - upto[1]).when(p == 4, k - upto[3]).otherwise(k).alias("k"),
            F.when(p == 2, F.col("a")).when(p == 4, F.col("b")).otherwise(F.col("low")).alias("low"),
            F.when(p == 2, F.col("b")).when(p == 0, F.col("a")).otherwise(F.col("high")).alias("high"),
            F.when(p == 1, F.col("a")).when(p == 3, F.col("b")).alias("value"),
        )
        state = stage(moved.unionByName(state.filter("value IS NOT NULL")), "state")
        left = stage(left.alias("a").join(near(state.filter("value IS NULL").alias("b")), same & inside, "left_semi"), "values")
    w = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    last = met.groupBy(*keys, "x").agg(F.count("*").alias("n"), F.first("k").alias("k")).withColumn("upto", F.sum("n").over(w))
    last = last.filter(F.col("upto") > F.col("k")).groupBy(*keys).agg(F.min("x").alias("value"))
    return last.unionByName(state.filter("value IS NOT NULL").select(*keys, "value"))


def average_rank(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """df with the rank from one of x in its group, ties sharing their mean; nulls rank first. Counts of
    distinct values are ranged by group and value and summed within ranges and before them, so no task
    holds a group's values."""
    group = [f"g{i}" for i in range(len(by))]
    counts = df.select(*[F.col(b).alias(g) for b, g in zip(by, group)], F.col(x).alias("x")).groupBy(*group, "x").agg(F.count("*").alias("n"))
    summed = running(counts, group, ["x"], "n", "before")
    ranks = summed.select(*group, "x", (F.col("before") + (F.col("n") + 1) / 2.0).alias("r"))
    same = functools.reduce(lambda p, q: p & q, [F.col(f"_d.{b}").eqNullSafe(F.col(f"_r.{g}")) for b, g in zip(by, group)], F.col(f"_d.{x}").eqNullSafe(F.col("_r.x")))
    return df.alias("_d").join(ranks.alias("_r"), same).select("_d.*", F.col("_r.r").alias(name))
