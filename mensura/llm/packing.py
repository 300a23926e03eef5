"""Best-fit packing by a plan over the length histogram.

Documents become pieces of at most ``capacity`` tokens. Best fit decreasing runs over counts of
lengths, not over documents, so the plan has a few rows a length whatever the corpus holds;
pieces then take planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.shared import lean, own_batches, shipped, spread, stage
from mensura.llm.wordids import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end: int = 1, keep_ids: bool = True) -> DataFrame:
    """Token ids of each text with ``end`` appended, cut at multiples of ``capacity``. Null text is
    empty and yields the one piece that holds ``end``. With keep_ids each piece carries its ids as
    little-endian unsigned 32-bit numbers."""
    path = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
        for batch in batches:
            for i, j, ids, ends in ids_of.ended(batch.column(1), end):
                size = np.diff(ends)
                n = -(-size // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                raw = [ids[a : a + m] for a, m in zip((ends[:-1][row] + start).tolist(), length.tolist())]
                out = [
                    batch.column(0).take(pa.array(row + i)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                yield pa.record_batch(out + [pa.array([x.tobytes() for x in raw], pa.binary())] * keep_ids, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), PIECES + ", ids binary" * keep_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over (length, count). Rows (length, first rank, last rank + 1, first
    sequence, pieces a sequence, offset): ranks fill one sequence after another.

    Sequences with the same room are kept as ranges of numbers. A sequence that best fit chooses for
    a length takes as many of it as fit, as its room then stays the smallest that does."""
    room: dict[int, list[tuple[int, int]]] = {}
    open_rooms: list[int] = []
    rows, opened = [], 0

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in room:
                room[r] = []
                bisect.insort(open_rooms, r)
            room[r].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(open_rooms, length)
            if i < len(open_rooms):
                r = open_rooms[i]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r]
                    open_rooms.pop(i)
            else:
                r, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = min(r // length, left)
            used = min(n, left // each)
            rows.append((length, rank, rank + used * each, first, each, capacity - r))
            rank, left = rank + used * each, left - used * each
            put(r - each * length, first, used)
            put(r, first + used, n - used)
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 1, keep_ids: bool = True) -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences are gapless from 0 and as
    few as best fit finds. Order within a length is by doc_id, piece and checksum, so repeated rows
    are interchangeable. An empty table gives no rows. Other columns of docs are ignored.

    The plan's rows grow with ``capacity`` only, which bounds what is collected and broadcast."""
    spark = docs.sparkSession
    with own_batches(spark, 4000):
        cut = stage(pieces(docs, vocabulary, capacity, end, keep_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, math.ceil(sum(counts.values()) / 20_000))
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    # From Arrow: Spark would take a list's rows through Python workers of their own, which then stay.
    slots = spark.createDataFrame(pa.table(dict(zip(["_length", "_lo", "_hi", "_first", "_each", "_at"], map(pa.array, rows.T.copy())))))
    cut = cut.withColumn("_bucket", spread(F.struct("doc_id", "piece", "start", "ids_crc32"), buckets))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(own) - 1)
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    into = F.col("_rank") - F.col("_lo")
    return ranked.join(F.broadcast(slots), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.floor(into / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + into % F.col("_each") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
