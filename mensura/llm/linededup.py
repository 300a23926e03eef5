"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host and line: the pages of the host that hold the line over all pages of the host. Lines
above the ratio are boilerplate and leave the pages of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import narrowed, stage

BROADCAST_LINES = 1_000_000  # boilerplate lines (8 bytes each) up to which their table is broadcast


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(text: Column) -> Column:
    """Lines by content: trimmed, as 64-bit hashes; blank lines are null."""
    return F.transform(_lines(text), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, host: str, ratio: float, pages: int) -> DataFrame:
    """_host and lines: hashes of the lines on more than ``ratio`` of the host's pages and on at
    least ``pages`` of them. A host has at most (lines a page / ratio) of these, however many pages.
    Both counts are summed before the shuffle, so no host or line gathers rows in one task."""
    own = docs.select(F.col(host).alias("_host"), F.array_compact(F.array_distinct(_hashes(F.col("text")))).alias("_l"))
    totals = own.groupBy("_host").agg(F.count("*").alias("_pages"))
    counts = own.select("_host", F.explode("_l").alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    counts = counts.filter(F.col("_n") >= pages).withColumnRenamed("_host", "_h")
    often = counts.join(totals, F.col("_h").eqNullSafe(F.col("_host"))).filter(F.col("_n") > ratio * F.col("_pages"))
    return often.groupBy("_host").agg(F.collect_set("_line").alias("_common"))


def clean(docs: DataFrame, host: str = "source", ratio: float = 0.02, pages: int = 3, whole: bool = False) -> DataFrame:
    """docs, each row kept, with text less its boilerplate lines, and n_lines and n_dropped added (an
    existing column of these names is replaced). Other lines, blank ones too, stay as they are and in
    order; a line counts once a page however often it stands there, and repeated rows count as pages.
    Null text is empty and yields ''; null hosts form one host. With ``whole`` a page of nothing but
    boilerplate lines stays as it is: copies of a page have all their lines in common."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs, columns = narrowed(docs.select(*[f"`{c}`" for c in names]), "text", host)
    common = stage(boilerplate(docs, host, ratio, pages), "boilerplate")
    few = (common.agg(F.sum(F.size("_common")).alias("n")).first()["n"] or 0) <= BROADCAST_LINES
    joined = docs.join(F.broadcast(common) if few else common, docs[host].eqNullSafe(common["_host"]), "left")
    none = F.array().cast("array<bigint>")
    # Hash sets in array_intersect leave a page's few common lines, which each line is held against.
    drop = F.array_intersect(F.array_compact(_hashes(F.col("text"))), F.coalesce("_common", none))
    out = joined.withColumn("_drop", drop)
    kept = F.when(F.size("_drop") == 0, _lines(F.col("text"))).otherwise(
        F.filter(_lines(F.col("text")), lambda x: (F.trim(x) == "") | ~F.array_contains("_drop", F.xxhash64(F.trim(x)))))
    if whole:
        kept = F.when(F.forall(kept, lambda x: F.trim(x) == ""), _lines(F.col("text"))).otherwise(kept)
    out = out.withColumn("_kept", kept)
    size = F.size(_lines(F.col("text")))
    out = out.withColumns({"n_lines": size, "n_dropped": size - F.size("_kept"), "text": F.array_join("_kept", "\n")})
    return out.select(*columns, "n_lines", "n_dropped")


def oracle(ratio: float = 0.02, pages: int = 3) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l, row_number() OVER () AS k FROM documents),
e AS (SELECT k, doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
c AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT k) AS n FROM e WHERE trim(line, ' ') <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {pages} AND n > {ratio} * pages),
m AS (SELECT e.*, b.line IS NOT NULL AS common FROM e LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source AND trim(e.line, ' ') = b.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT common), '') AS text, count(*)::INT AS n_lines,
  (count(*) FILTER (common))::INT AS n_dropped FROM m GROUP BY k, doc_id"""
