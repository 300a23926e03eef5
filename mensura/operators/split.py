"""Leakage-safe splits in repeatable hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import c, half_even, hash_bucket, seeded
from mensura.staging import running, stage


def by_hash_order(df: DataFrame, seed: str, keys: list[str], first: int, rest: int) -> DataFrame:
    """The first rows in hash order are for calibration, the next for pilot. Only the heads are
    sorted; all other rows drop out."""
    ordered = df.withColumn("_h", seeded(seed, *keys)).orderBy("_h", *keys).limit(first + rest)
    return ordered.withColumn("position", F.row_number().over(Window.orderBy("_h", *keys))).withColumn("part", F.when(F.col("position") <= first, "calibration").otherwise("pilot")).drop("_h")


def by_bucket(df: DataFrame, seed: str, key: str, share: float = 0.15) -> DataFrame:
    """val where the key's hash bucket of 10,000 is below the share, else train; row by row."""
    bucket = hash_bucket(seeded(seed, key))
    return df.withColumns({"bucket": bucket, "part": F.when(bucket < int(10_000 * share), "val").otherwise("train")})


def by_group(df: DataFrame, stratum: str, group: str, seed: str) -> DataFrame:
    """Whole groups to test, val and train by hash order within their stratum: of ten groups or more
    15 % each (half to even) to test and val, of four to nine one each, of three one to test."""
    groups = df.select(stratum, group).distinct()
    w = Window.partitionBy(stratum)
    rank = F.row_number().over(w.orderBy(seeded(seed, group), group))
    n = F.count("*").over(w)
    many = F.greatest(half_even(n * 0.15), F.lit(1))
    test = F.when(n >= 10, many).when(n >= 3, 1).otherwise(0)
    val = F.when(n >= 10, many).when(n >= 4, 1).otherwise(0)
    groups = groups.withColumns({"_r": rank, "_t": test, "_v": val})
    part = F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "val").otherwise("train")
    groups = groups.select(F.col(stratum).alias("_s"), F.col(group).alias("_g"), part.alias("part"))
    return df.join(groups, F.col(stratum).eqNullSafe(F.col("_s")) & F.col(group).eqNullSafe(F.col("_g"))).drop("_s", "_g")


def head_and_topup(df: DataFrame, stratum: str, order: list, each: int, total: int, id_: str) -> DataFrame:
    """The first ``each`` of every stratum, topped up to ``total`` from the rest in order."""
    w = Window.partitionBy(stratum).orderBy(*order)
    head = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= each).drop("_rn").withColumn("source_rule", F.lit("stratum"))
    rest = df.join(head.select(id_), id_, "left_anti")
    missing = max(0, total - head.count())
    return head.unionByName(rest.orderBy(*order).limit(missing).withColumn("source_rule", F.lit("topup")))


def one_per_series(df: DataFrame, series: str, order: list, most: int) -> DataFrame:
    """The best row of each series, the best ``most`` of those."""
    w = Window.partitionBy(series).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").orderBy(*order).limit(most)


class NoExactSplit(ValueError):
    """No split has the wanted counts, or none was found."""


def exact_plan(cells: dict[tuple[str | None, int], int], targets: dict[str, int], most: int = 500_000) -> list[tuple[str | None, int, str, int, int]]:
    """(stratum, size, split, first, end) places of groups within their cell, for cells {(stratum, size of a
    group): groups}. Every cell is dealt in the targets' shares as far as that goes in whole groups. What is
    left is fitted by a search, the largest groups first, each to the split that lacks most, that comes
    back from dead ends; if nothing fits, cells give more and more of their groups back to the search.

    Raises NoExactSplit: where targets don't add up to the rows, where the search has gone through all
    ways, or where it has met more than ``most`` dead ends."""
    total = sum(n * k for (_, n), k in cells.items())
    if sum(targets.values()) != total or min(targets.values(), default=0) < 0:
        raise NoExactSplit(f"targets {targets} for {total} rows")
    names, given = sorted(targets), 0
    order = sorted(cells, key=lambda c: (-c[1], c[0] is None, c[0] or ""))
    while True:
        base = {c: {k: max(0, cells[c] * targets[k] // max(1, total) - given) for k in names} for c in order}
        units = [c for c in order for _ in range(cells[c] - sum(base[c].values()))]
        lack = tuple(targets[k] - sum(c[1] * base[c][k] for c in order) for k in names)
        chosen = _fitted([c[1] for c in units], lack, [max(1, targets[k]) for k in names], most)
        if chosen is not None:
            break
        if not any(any(b.values()) for b in base.values()):
            raise NoExactSplit(f"no whole groups make {targets}")
        given = 4 * given + 1
    for c, k in zip(units, chosen):
        base[c][names[k]] += 1
    plan = []
    for c in order:
        at = 0
        for k in names:
            if base[c][k]:
                plan.append((*c, k, at, at + base[c][k]))
                at += base[c][k]
    return plan


def _fitted(sizes: list[int], lack: tuple[int, ...], targets: list[int], most: int) -> list[int] | None:
    """A split of each size (descending) so that their sums are what is lacking; None if there is none."""
    ones = next((i for i, n in enumerate(sizes) if n == 1), len(sizes))

    def ways(i: int, lack: tuple[int, ...]) -> list[int]:
        """Splits that the i-th size fits, the neediest last."""
        return sorted({lack[k]: k for k in range(len(lack)) if lack[k] >= sizes[i]}.values(), key=lambda k: (lack[k] / targets[k], lack[k]))

    dead: set[tuple[int, tuple[int, ...]]] = set()
    path: list[int] = []
    state, left = [lack], [ways(0, lack) if ones else []]
    while len(path) < ones:
        if left[-1]:
            k, now = left[-1].pop(), state[-1]
            then = (*now[:k], now[k] - sizes[len(path)], *now[k + 1 :])
            if (len(path) + 1, then) in dead:
                continue
            path.append(k)
            state.append(then)
            left.append(ways(len(path), then) if len(path) < ones else [])
            continue
        dead.add((len(path), state.pop()))
        if len(dead) > most:
            raise NoExactSplit(f"none found after {most} dead ends")
        left.pop()
        if not path:
            return None
        path.pop()
    # Whatever is lacking now, groups of one row make it.
    return path + [k for k, n in enumerate(state[-1]) for _ in range(n)]


def exact_counts(df: DataFrame, group: str, stratum: str, targets: dict[str, int], seed: str) -> DataFrame:
    """Groups (with their rows together) to splits of exactly the wanted numbers of rows, strata in the same
    shares as far as whole groups allow. The plan is made over counts of (stratum, size), which are fewer
    than twice the root of the rows a stratum; groups take its places by their rank in hash order within
    their cell, ranged, so no task holds all groups. A group's stratum is its least one; null groups and
    strata count as such. Raises NoExactSplit."""
    spark = df.sparkSession
    groups = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.min(stratum).alias("_s"))
    groups = stage(groups.withColumns({"_h": seeded(seed, "_g"), "_one": F.lit(1)}), "groups")
    cells = {(r["_s"], r["_n"]): r["k"] for r in groups.groupBy("_s", "_n").agg(F.count("*").alias("k")).collect()}
    kind = groups.schema["_s"].dataType.simpleString()
    plan = spark.createDataFrame(exact_plan(cells, targets), f"s {kind}, n long, part string, first long, end long")
    ranked = running(groups, ["_s", "_n"], ["_h", "_g"], "_one", "_rank")
    own = F.col("_s").eqNullSafe(F.col("s")) & (F.col("_n") == F.col("n")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("end"))
    chosen = ranked.join(plan, own).select("_g", "part")
    return df.join(chosen, c(group).eqNullSafe(F.col("_g"))).drop("_g")
