"""The flagship summary: one multi-measure aggregate and its winner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators.ranking import quantiles
from mensura.session import table


def method_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per language: count, non-collapse rate, median, IQR, cap rate and utility of n_chars."""
    lines = F.size(F.split("text", "\n"))
    d = table(spark, sf, "documents").select("lang", "n_chars", lines.alias("n_lines"))
    g = d.groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("n_chars") > 1).cast("double")).alias("noncollapse"), F.avg((F.col("n_chars") >= 5000).cast("double")).alias("cap"))
    q = quantiles(d, {"med": ("n_chars", 0.5), "q1": ("n_chars", 0.25), "q3": ("n_chars", 0.75), "med_lines": ("n_lines", 0.5)}, ["lang"])
    g = g.alias("g").join(q.alias("q"), F.col("g.lang").eqNullSafe(F.col("q.lang"))).select("g.*", "med", (F.col("q3") - F.col("q1")).alias("iqr"), "med_lines")
    utility = F.least(F.col("med") / 5000, F.lit(1.0)) + 0.15 * F.col("noncollapse") - 0.25 * F.col("cap")
    return g.select(
        "lang", "n", F.round("noncollapse", 6).alias("noncollapse_rate"), F.round("med", 4).alias("median_chars"),
        F.round("iqr", 4).alias("iqr_chars"), F.round("cap", 6).alias("cap_rate"),
        F.round("med_lines", 4).alias("median_lines"), F.round(utility, 6).alias("utility"),
    )


QUERIES = {"method_summary": method_summary}
ORACLES = {
    "method_summary": """
WITH g AS (SELECT lang, count(*) AS n, avg((n_chars > 1)::INT) AS noncollapse, median(n_chars) AS med,
  quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr, avg((n_chars >= 5000)::INT) AS cap,
  median(len(string_split(text, chr(10)))) AS med_lines FROM documents GROUP BY lang)
SELECT lang, n, round(noncollapse, 6) AS noncollapse_rate, round(med, 4) AS median_chars, round(iqr, 4) AS iqr_chars,
  round(cap, 6) AS cap_rate, round(med_lines, 4) AS median_lines,
  round(least(med / 5000, 1.0) + 0.15 * noncollapse - 0.25 * cap, 6) AS utility FROM g""",
}
