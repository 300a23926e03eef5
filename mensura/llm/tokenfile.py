"""Token ids in binary files of patched frame-of-reference blocks.

A file: magic, counts, doc ids with a null flag each, tokens a document, the index of block starts,
then the blocks. A block holds 256 ids: its minimum, the bit width that ``percentile`` of its
differences fit in, the differences' low bits at that width, one bit plane after another, and an
exception list of (place, high bits) for the outliers.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.llm.shared import own_batches, place, shipped, stage
from mensura.llm.wordids import word_ids

MAGIC, BLOCK = b"PFOR0001", 256
HEAD = struct.Struct("<8sQQQ")  # magic, documents, ids, blocks
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("unused", "u1"), ("exceptions", "<u2")])
_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)  # bits that each number takes
DOCS = "file string, row long, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary"


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for each i, size[i] of them."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _some(width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, its blocks), at most 4,096 at a time."""
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for some in np.array_split(rows, -(-len(rows) // 4096)):
            yield int(w), some


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """(starts of the blocks with the end appended, payload)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, "<u8"), b""
    v = np.full(blocks * BLOCK, ids[-1], np.uint32)
    v[:n] = ids
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1)
    d = v - low[:, None]
    if d.max() < 1 << 16:
        d = d.astype(np.uint16)
        need = _BITS[d]
    else:
        need = np.frexp(d.astype(np.float64))[1].astype(np.uint8)
    k = min(BLOCK - 1, math.ceil(percentile * BLOCK) - 1)
    width = np.partition(need, k, axis=1)[:, k]
    row, at = np.nonzero(need > width[:, None])
    outliers = np.bincount(row, minlength=blocks)
    head = np.zeros(blocks, BLOCK_HEAD)
    head["low"], head["width"], head["exceptions"] = low, width, outliers
    packed = BLOCK_HEAD.itemsize + width.astype(np.int64) * (BLOCK // 8)  # where the exceptions begin
    starts = np.concatenate([[0], np.cumsum(packed + 5 * outliers)])
    payload = np.empty(starts[-1], np.uint8)
    payload[starts[:-1, None] + np.arange(BLOCK_HEAD.itemsize)] = head.view(np.uint8).reshape(blocks, -1)
    for w, some in _some(width):
        planes = np.empty((len(some), w, BLOCK // 8), np.uint8)
        for b in range(w):
            planes[:, b] = np.packbits((d[some] >> d.dtype.type(b)).astype(np.uint8) & 1, axis=1, bitorder="little")
        payload[starts[some, None] + BLOCK_HEAD.itemsize + np.arange(w * BLOCK // 8)] = planes.reshape(len(some), -1)
    first = starts[:-1] + packed
    payload[_places(first, outliers)] = at
    high = (d[row, at].astype(np.uint32) >> width[row].astype(np.uint32)).astype("<u4")
    payload[_places(first + outliers, 4 * outliers)] = high.view(np.uint8)
    return starts.astype("<u8"), payload.tobytes()


def decode_blocks(starts: np.ndarray, payload: memoryview, n: int) -> np.ndarray:
    """The ids again."""
    at = starts[:-1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    head = raw[at[:, None] + np.arange(BLOCK_HEAD.itemsize)].reshape(-1).view(BLOCK_HEAD)
    out = np.empty((len(at), BLOCK), np.uint32)
    for w, some in _some(head["width"]):
        planes = raw[at[some, None] + BLOCK_HEAD.itemsize + np.arange(w * BLOCK // 8)].reshape(len(some), w, BLOCK // 8)
        kind = np.uint16 if w <= 16 else np.uint32
        got = np.zeros((len(some), BLOCK), kind)
        for b in range(w):
            got |= np.unpackbits(planes[:, b], axis=1, bitorder="little").astype(kind) << kind(b)
        out[some] = got
    outliers = head["exceptions"].astype(np.int64)
    first = at + BLOCK_HEAD.itemsize + head["width"].astype(np.int64) * (BLOCK // 8)
    row = np.repeat(np.arange(len(at)), outliers)
    high = raw[_places(first + outliers, 4 * outliers)].view("<u4")
    out[row, raw[_places(first, outliers)]] |= high << head["width"][row].astype(np.uint32)
    out += head["low"][:, None]
    return out.reshape(-1)[:n]


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.9) -> bytes:
    starts, payload = encode_blocks(ids, percentile)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(starts) - 1)
    return b"".join([head, docs.tobytes(), null.tobytes(), np.array(lengths, "<u8").tobytes(), starts.tobytes(), payload])


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, tokens a document, ids)."""
    magic, n_docs, n_ids, n_blocks = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    docs = np.frombuffer(raw, "<i8", n_docs, at)
    null = np.frombuffer(raw, np.uint8, n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u8", n_docs, at := at + n_docs).astype(np.int64)
    starts = np.frombuffer(raw, "<u8", n_blocks + 1, at := at + 8 * n_docs)
    payload = memoryview(raw)[at + 8 * (n_blocks + 1) :]
    return [None if z else int(d) for d, z in zip(docs, null)], lengths, decode_blocks(starts, payload, n_ids)


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 1, file_ids: int = 2_000_000, percentile: float = 0.9) -> DataFrame:
    """Writes the ids of all texts, ``end`` after each, in ascending doc_id order (nulls first; equal
    doc_ids by a hash of the text) to files of about ``file_ids`` ids under path, a folder that all
    executors share. Null text is empty. Returns the manifest (file, part, number, documents, ids,
    base: ids in all files before it). A retried task writes the same bytes under the same name."""
    sent = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        ids_of, context = word_ids(sent()), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        made, docs_, lengths, parts, size = [], [], [], [], 0

        def flush() -> None:
            nonlocal size
            if docs_:
                store.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{len(made):05d}.pfor"
                raw = encode_file(docs_, lengths, np.concatenate(parts), percentile)
                with store.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                    out.write(raw)
                store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
                made.append((name, part, len(made), len(docs_), size))
                docs_.clear(), lengths.clear(), parts.clear()
                size = 0

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, ids, ends in ids_of.ended(batch.column(1), end):
                k = i
                while k < j:  # a file ends with the document that fills it
                    last = min(j, i + int(np.searchsorted(ends[1:], ends[k - i] + file_ids - size)) + 1)
                    docs_ += doc_ids[k:last]
                    lengths += np.diff(ends[k - i : last - i + 1]).tolist()
                    parts.append(ids[ends[k - i] : ends[last - i]])
                    size += int(ends[last - i] - ends[k - i])
                    k = last
                    if size >= file_ids:
                        flush()
        flush()
        names, kinds = ["file", "part", "number", "documents", "ids"], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=names)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ranged = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
    ranged = ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with own_batches(docs.sparkSession, 4000):
        manifest = stage(ranged.mapInArrow(run, "file string, part int, number int, documents long, ids long"), "manifest")
    # Within a part by window, over the parts (a row each) likewise.
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts_ = manifest.groupBy("part").agg(F.sum("ids").alias("_all"))
    parts_ = parts_.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    based = manifest.withColumn("_own", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).join(parts_, "part")
    return based.select("file", "part", "number", "documents", "ids", (F.col("_own") + F.col("_before")).cast("long").alias("base"))


def read(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents of all files under path: file, row, doc_id, local_start, n_tokens, ids_crc32 and,
    with keep_ids, the ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, lengths, ids = decode_file(content.as_py())
                starts = np.cumsum(lengths) - lengths
                raw = [ids[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())]
                yield pa.record_batch(
                    [
                        pa.array([file] * len(docs), pa.string()), pa.array(np.arange(len(docs))), pa.array(docs, pa.int64()),
                        pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array([x.tobytes() for x in raw] if keep_ids else [None] * len(docs), pa.binary()),
                    ],
                    names=["file", "row", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = files.mapInArrow(run, DOCS)
    return found if keep_ids else found.drop("ids")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 1, **options) -> DataFrame:
    """Writes docs and reads them back: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, from the files."""
    spark = docs.sparkSession
    path = place(spark, "tokens")
    manifest = write(docs, path, vocabulary, end, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read(spark, path, keep_ids=False).join(manifest.select("file", "base"), "file")
    return found.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
