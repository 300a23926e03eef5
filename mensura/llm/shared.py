"""Staging of intermediate tables, ranking within skewed groups, and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.staging import BATCHES, clear, place, stage, text_batches

__all__ = ["clear", "place", "stage", "text_batches"]

@contextlib.contextmanager
def own_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """``text_batches`` for what runs within, after which the session has its own settings again."""
    before = {key: spark.conf.get(key, None) for key in BATCHES}
    text_batches(spark, rows)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def released() -> None:
    """Gives memory that numpy, Arrow and Python have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with what it freed given back as its task ends. Spark keeps workers for
    the tasks of later stages, and a worker would go on holding the most that any of them took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return task


_sent: set[tuple[str, str]] = set()


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a small file of the driver to all executors, later ones too; what is returned gives its path
    within a task."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent:
        sc.addFile(path)
        _sent.add((sc.applicationId, path))
    return functools.partial(SparkFiles.get, os.path.basename(path))


def narrowed(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs as the needed columns and one struct ``rest`` of all others, whatever their names, and the
    expressions that give docs' columns again."""
    rest = [c for c in docs.columns if c not in needed]
    packed = docs.select(*needed, (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)).alias("rest"))
    return packed, [F.col(c) if c in needed else F.col("rest").getField(c).alias(c) for c in docs.columns]


def spread(key: Column, buckets: int) -> Column:
    """A bucket number by hash."""
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def positioned(df: DataFrame, group: list[str], order: list[str], width: str | None = None) -> DataFrame:
    """Adds ``position`` (from 0) in its group by ``order`` and, for a width column, ``start``: the
    sum of the widths before it. A group of any size is dealt over many tasks: rows are ranged by
    (group, order), numbered within each range, and each range adds what lies before it.
    ``order`` must tell all but interchangeable rows apart."""
    ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    here = Window.partitionBy("_range", *group).orderBy(*order)
    size = F.col(width) if width else F.lit(0)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *group).agg(F.count("*").alias("_n"), F.sum(size).alias("_w"))
    totals = totals.select(
        F.col("_range").alias("_at"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w"),
    )
    own = ranged.withColumns({
        "position": (F.row_number().over(here) - 1).cast("long"),
        "start": F.coalesce(F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
    })
    match = F.col("_range") == F.col("_at")
    for i, c in enumerate(group):
        match &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = own.join(totals, match)
    own = own.withColumns({"position": F.col("position") + F.col("_n"), "start": (F.col("start") + F.col("_w")).cast("long")})
    return own.drop("_range", "_at", "_n", "_w", *[f"_g{i}" for i in range(len(group))], *([] if width else ["start"]))


# --- words -----------------------------------------------------------------------------------
# A word is a maximal run of ASCII letters, digits and characters beyond ASCII, in lower case.

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    inverse = np.uint64(pow(int(_ODD), -1, 2**64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one more
    entry than texts). The hash of a word doesn't depend on where it stands."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    w = np.zeros(len(b) + 1, bool)
    w[1:] = _IS_WORD[b]
    edge = np.flatnonzero(w[1:] != w[:-1])
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    size = 1 << max(16, int(len(b)).bit_length())
    up, down = (_powers(1 << 20) if size <= 1 << 20 else _powers.__wrapped__(size))  # one table stays in memory
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return h, np.concatenate([[0], np.searchsorted(first, ends)]).astype(np.int64)


def chunked(texts: list[str | None], most: int = 500_000):
    """Ranges of texts with about ``most`` characters each, so that arrays stay small."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= most):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def shingles(words: np.ndarray, starts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words of each text, with where each text's begin. A text of fewer words
    has one shingle of all its words; one of no words has none."""
    count = np.diff(starts)
    size = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    out = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(out[-1]) - np.repeat(out[:-1], size) + np.repeat(starts[:-1], size)
    end = np.repeat(starts[1:], size)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k < end
        h = mix(h + _ODD) + np.where(there, words[np.minimum(at + k, len(words) - 1)] if len(words) else 0, np.uint64(0))
    return mix(h), out
