"""The training-data queries, each over its whole table, and their DuckDB twins where SQL has them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import bpe, decontam, licenses, linededup, neardup, packing, periodic, perspectives, pii, quality, spelling, tokenfile, topk
from mensura.session import table

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op2_pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.detect(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [pii.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    digest = F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.listed(F.col("spans")).alias("spans"))


def op3_block_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.search(table(spark, sf, "embeddings"), every=50, k=5)


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY), end=1)


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.join(table(spark, sf, "documents"))


def op6_latent_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf, "conversations"))


def op8_site_lines(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.clean(table(spark, sf, "documents").select("doc_id", "text", "source")).drop("source")


def op9_bayes_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return quality.score(docs, table(spark, sf, "labels")).drop("text")


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY), 4096, end=1, keep_ids=False)


def op11_word_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Where ten divides the crc32 h of the decimal doc_id (a null id has none), words from a on repeat
    the p words that stand there."""
    hashed = table(spark, sf, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = F.when(F.pmod("h", F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = hashed.withColumns({"w": F.when(F.size(chosen) > 0, chosen), "g": F.floor(F.col("h") / 10)}).withColumn("n", F.size("w").cast("bigint"))
    split = split.withColumn("a", F.pmod("g", "n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8)))))
    again = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    docs = split.select("doc_id", F.coalesce(F.array_join(again, " "), F.col("text")).alias("text"))
    found = periodic.collapse(docs).withColumn("best", F.get(F.array_sort("runs", _longest), F.lit(0)))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _longest(a: Column, b: Column) -> Column:
    """Order of runs by exact length / period, from the greatest; ties by start, then period."""
    more = a["length"] * b["period"] - b["length"] * a["period"]
    return F.when(more != 0, -F.signum(more)).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")


def op12_bpe_automaton(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_VOCABULARY)
    both = bpe.decode(bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), path), path)
    decimal = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _one_letter_less(doc_id: int | None, run: bytes) -> bytes:
    """The run less one code point where 31 divides the crc32 of ``doc_id:run``; a null id changes none."""
    h = 1 if doc_id is None else zlib.crc32(run, zlib.crc32(b"%d:" % doc_id))
    if h % 31:
        return run
    s = run.decode()
    return (s[: h % len(s)] + s[h % len(s) + 1 :]).encode()


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.groups(table(spark, sf, "documents"), least=7, often=2, times=10, change=_one_letter_less)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pii_spans": op2_pii_spans,
    "op3_block_topk": op3_block_topk,
    "op4_token_files": op4_token_files,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_perspectives": op7_perspectives,
    "op8_site_lines": op8_site_lines,
    "op9_bayes_quality": op9_bayes_quality,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_word_runs": op11_word_runs,
    "op12_bpe_automaton": op12_bpe_automaton,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op3_block_topk": topk.ORACLE,
    "op7_perspectives": perspectives.ORACLE,
    "op8_site_lines": linededup.oracle(),
    "op11_word_runs": periodic.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
