"""Evaluation rows and selections built from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.scalar import seeded
from mensura.operators.robust import finite_median


def per_item(views: DataFrame, item: str, capped: int) -> DataFrame:
    """From a row for each view (view, family, count, f1, error): mean repeatability, finite median
    error, mean count difference of photometric views against the identity, collapse and cap flags."""
    base = F.max(F.when(F.col("view") == "identity", F.col("count")))
    out = views.groupBy(item).agg(
        base.alias("count"), F.avg(F.when(F.col("view") != "identity", F.col("f1"))).alias("mean_f1"),
        finite_median(F.when(F.col("view") != "identity", F.col("error"))).alias("median_error"),
        F.avg(F.when(F.col("family") == "photometric", F.col("count"))).alias("_p"),
    )
    return out.withColumns({"photometric_difference": F.abs(F.col("_p") - F.col("count")), "collapse": (F.coalesce("count", F.lit(0)) < 2).cast("int"), "cap_hit": (F.col("count") >= capped).cast("int")}).drop("_p")


def region_hits(points: DataFrame, item: str) -> DataFrame:
    """Counts and shares of an item's points by region flags in_plant, in_root, in_shoot."""
    n = F.count("*")
    hits = {"plant": F.col("in_plant") == 1, "root_only": (F.col("in_root") == 1) & (F.col("in_shoot") == 0), "shoot": F.col("in_shoot") == 1, "background": F.col("in_plant") == 0}
    counts = [F.count_if(cond).alias(f"{k}_count") for k, cond in hits.items()]
    shares = [(F.count_if(cond) / F.greatest(n, F.lit(1))).alias(f"{k}_ratio") for k, cond in hits.items()]
    return points.groupBy(item).agg(n.alias("points"), *counts, *shares)


def dominant_regions(labels: DataFrame, by: list[str], region: str) -> DataFrame:
    """The most frequent region along each edge (ties by name) and its share."""
    k = labels.groupBy(*by, region).agg(F.count("*").alias("n"))
    g = k.groupBy(*by).agg(F.sum("n").alias("_t"), F.min(F.struct((-F.col("n")).alias("m"), region)).alias("_b"))
    return g.select(*by, F.col(f"_b.{region}").alias(region), (-F.col("_b.m") / F.col("_t")).alias("share"))


def pilot(df: DataFrame, stratum: str, id_: str, total: int, seed: str) -> DataFrame:
    """A pilot of ``total`` rows: one of each stratum, the rarest first, then in proportion. Each row's
    turn is its rank in the stratum (hash order) over the stratum's share, so one order serves all."""
    w = Window.partitionBy(stratum)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(seeded(seed, id_), id_)), "_n": F.count("*").over(w)})
    first = F.col("_r") == 1
    turn = F.when(first, F.lit(0.0)).otherwise((F.col("_r") - 0.5) / F.col("_n"))
    order = [F.desc(first), F.when(first, F.col("_n")), turn, stratum, id_]
    return ranked.withColumn("_turn", turn).orderBy(*order).limit(total).drop("_r", "_n", "_turn")
