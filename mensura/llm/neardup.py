"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same words form a class. Classes meet in MinHash bands. Candidate pairs compare
their MinHash values in steps and go as soon as the posterior probability (uniform prior) of
reaching the threshold falls below the tolerance; the rest is verified on whole shingle sets.

No stage lists the pairs of a group. Buckets pass on spanning forests of the pairs that survive;
the components of these hold every link, and each is verified in blocks of bounded size whose tasks
return counts of links and a spanning forest again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import chunked, hashed_words, lean, mix, narrowed, own_batches, shingles, stage

HASHES, ROWS, STEP = 128, 4, 16
BUCKET, BLOCK = 512, 512
ONE_TASK = 300_000  # edges of two keys
BROADCAST_ROWS = 200_000  # rows of under 100 bytes up to which a table is broadcast
_R = np.random.default_rng(20240501)
_A = (_R.integers(0, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _R.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def minhash(sh: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES minima a text; texts without shingles get zeros."""
    out = np.zeros((len(starts) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        x, at = (sh >> np.uint64(32)).astype(np.uint32) ^ sh.astype(np.uint32), starts[:-1][some]
        for j in range(HASHES):
            y = x * _A[j] + _B[j]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            out[some, j] = np.minimum.reduceat(y, at)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of ROWS values, the band's own number mixed in."""
    parts = sig.reshape(len(sig), -1, ROWS).astype(np.uint64)
    h = np.tile(np.arange(parts.shape[1], dtype=np.uint64), (len(sig), 1))
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return h.astype(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, least matches) after each step. With m of n matches the similarity has the
    posterior Beta(m + 1, n - m + 1), above the threshold with probability P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, same: bool, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i < j if both sides are the same) that no step drops."""
    left, right = [], []
    for i in range(len(a)):
        j = np.arange(i + 1 if same else 0, len(b))
        count, at = np.zeros(len(j), np.int64), 0
        for n, least in steps:
            count = count + (b[j, at:n] == a[i, at:n]).sum(axis=1)
            keep = count >= least
            j, count, at = j[keep], count[keep], n
            if not len(j):
                break
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets (sorted, distinct) i and j."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    at = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    values, column, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = count > 1  # others lie in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    at, column = at[keep], number[column[keep]]
    out = np.zeros(len(i), np.int64)
    wide = max(1024, 8_000_000 // len(used))
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    for low in range(0, int(shared.sum()), wide):
        s, e = np.searchsorted(column, [low, low + wide])
        m = np.zeros((len(used), wide), np.float32)
        m[at[s:e], column[s:e] - low] = 1
        dense = m @ m.T
        out += dense[row[i], row[j]].astype(np.int64)
    return out


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    parent, out = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = _root(parent, a), _root(parent, b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _rooted(t: pa.Table) -> pa.Table:
    """components in one task."""
    u, v = t.column("u").to_pylist(), t.column("v").to_pylist()
    names = sorted(set(u) | set(v))
    at = {x: i for i, x in enumerate(names)}
    parent = list(range(len(names)))
    for a, b in zip(u, v):
        ra, rb = _root(parent, at[a]), _root(parent, at[b])
        parent[max(ra, rb)] = min(ra, rb)
    roots = [_root(parent, i) for i in range(len(names))]
    some = [i for i, r in enumerate(roots) if i != r]
    return pa.table({"node": pa.array([names[i] for i in some], t.schema.field("u").type), "root": pa.array([names[roots[i]] for i in some], t.schema.field("u").type)})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) of every node in an edge but the roots. Up to
    ONE_TASK edges are solved in one task; more by alternating large and small stars, each round a
    table in the shared folder."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, before = stage(e, "edges"), None
    if e.count() <= ONE_TASK:
        kind = e.schema["u"].dataType.simpleString()
        return stage(e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_rooted, f"node {kind}, root {kind}"), "roots")
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _signed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1).to_pylist()
        for s, e in chunked(text, 500_000):
            words, at = hashed_words(text[s:e])
            keys = [hashlib.blake2b(words[x:y].tobytes(), digest_size=16).digest() for x, y in zip(at, at[1:])]
            sh, starts = shingles(words, at, n)
            sig = minhash(sh, starts)
            band = bands(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(s, e - s), batch.column(2).slice(s, e - s), pa.array(keys, pa.binary()), pa.array(np.diff(starts)),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, band.size + 1, band.shape[1], dtype=np.int32), band.reshape(-1)),
                ],
                names=["doc_id", "hash", "key", "n", "sig", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Adds the shingle set and the MinHash values of each text, which leaves."""
    for batch in batches:
        text = batch.column(0).to_pylist()
        for s, e in chunked(text, 500_000):
            sh, starts = shingles(*hashed_words(text[s:e]), n)
            sets = [np.unique(sh[x:y]).tobytes() for x, y in zip(starts, starts[1:])]
            sig = [r.tobytes() for r in minhash(sh, starts)]
            rest = [batch.column(k).slice(s, e - s) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(sig, pa.binary()), *rest], names=["set", "sig", *batch.schema.names[1:]])


def classed(docs: DataFrame, n: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, hash of the text, key of the class; classes: key, class_id, hash of the row that
    stands for it, n_copies, n_links, group_id, group_hash)."""
    steps = least_matches(threshold, tolerance)
    typed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    schema = "doc_id long, hash long, key binary, n long, sig binary, bands array<long>"
    with own_batches(docs.sparkSession):
        signed = stage(typed.mapInArrow(lean(lambda it: _signed(it, n)), schema), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "hash")).alias("first")
    same = (F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))  # equal in a class
    nodes = stage(signed.groupBy("key").agg(first, F.count("*").alias("n_copies"), *same), "nodes")
    classes = nodes.select("key", F.col("first.doc_id").alias("class_id"), F.col("first.hash").alias("hash"), "n_copies")

    # Buckets of two classes or more; of those with the same members, one.
    worded = nodes.filter("n > 0")
    there = worded.select("key", F.explode("bands").alias("bucket"))
    marks = (F.count("*").alias("c"), F.min(F.xxhash64("key")).alias("low"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"))
    full = there.groupBy("bucket").agg(*marks).filter("c > 1").groupBy("c", "low", "x").agg(F.min("bucket").alias("bucket"))
    full = stage(full.select("bucket", "c"), "buckets")
    if full.count() <= BROADCAST_ROWS:
        members = worded.select("key", "sig", F.explode("bands").alias("bucket")).join(F.broadcast(full), "bucket")
    else:
        members = there.join(full, "bucket").join(worded.select("key", "sig"), "key")
    members = stage(members.select("bucket", "c", "key", F.when(F.col("c") <= BUCKET, F.col("sig")).alias("sig")), "members")

    def prune(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_pylist()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        pairs = forest(len(keys), *surviving(sig, sig, True, steps))
        return pa.table({"a": pa.array([keys[a] for a, _ in pairs], pa.binary()), "b": pa.array([keys[b] for _, b in pairs], pa.binary())})

    few = members.filter(F.col("c") <= BUCKET).select("bucket", "key", "sig")
    edges = few.groupBy("bucket").applyInArrow(prune, "a binary, b binary")
    # A larger bucket is no bound on its pairs: its members go on together, to be compared in blocks.
    many = members.filter(F.col("c") > BUCKET).select("bucket", "key")
    star = many.join(many.groupBy("bucket").agg(F.min("key").alias("b")), "bucket").select(F.col("key").alias("a"), "b")
    near = components(edges.union(star), "a", "b")
    roots = near.select("root").distinct()
    near = stage(near.union(roots.select(F.col("root").alias("node"), "root")), "near")

    # Each component in blocks: a class goes to the tasks of its block with every block.
    blocks = near.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    chosen = near.join(blocks, "root").join(classes, F.col("node") == F.col("key")).select("key", "root", "blocks", "class_id", F.col("hash").alias("_hash"))
    chosen = stage(chosen, "chosen")
    small = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    text = typed.join(small, typed["doc_id"].eqNullSafe(chosen["class_id"]) & (typed["hash"] == chosen["_hash"]))
    text = text.select("text", "key", "root", "blocks").dropDuplicates(["key"])  # repeated rows
    payload = text.mapInArrow(lean(lambda it: _sets(it, n)), "set binary, sig binary, key binary, root binary, blocks long")
    payload = payload.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    payload = payload.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    payload = payload.select("key", "set", "sig", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(t: pa.Table) -> pa.Table:
        keys, own, i = t.column("key").to_pylist(), np.array(t.column("own").to_pylist()), t.column("i")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        first = np.flatnonzero(own == i)
        same = i == t.column("j")[0].as_py()
        second = first if same else np.flatnonzero(own != i)
        a, b = surviving(sig[first], sig[second], same, steps)
        a, b = first[a], second[b]
        both, size = overlaps(sets, a, b), np.array([len(s) for s in sets])
        linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
        a, b = a[linked], b[linked]
        links = np.bincount(np.concatenate([a, b]), minlength=len(keys))
        tree = forest(len(keys), a, b)
        has = np.flatnonzero(links)
        out = [(keys[k], None, int(links[k])) for k in has] + [(keys[x], keys[y], 0) for x, y in tree]
        return pa.table({"a": pa.array([r[0] for r in out], pa.binary()), "b": pa.array([r[1] for r in out], pa.binary()), "links": pa.array([r[2] for r in out], pa.int64())})

    with own_batches(docs.sparkSession):
        found = stage(payload.groupBy("root", "i", "j").applyInArrow(verify, "a binary, b binary, links long"), "found")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    linked = components(found.filter("b IS NOT NULL"), "a", "b")
    linked = linked.union(linked.select("root").distinct().select(F.col("root").alias("node"), "root"))
    named = linked.join(classes.select(F.col("key").alias("node"), F.col("class_id").alias("doc_id"), "hash"), "node")
    groups = named.groupBy("root").agg(first)
    grouped = linked.join(groups, "root").select(F.col("node").alias("key"), "first")
    alone = F.col("first").isNull()
    known = classes.join(links, "key", "left").join(grouped, "key", "left").select(
        "key", "class_id", "hash", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("class_id")).otherwise(F.col("first.doc_id")).alias("group_id"),
        F.when(alone, F.col("hash")).otherwise(F.col("first.hash")).alias("group_hash"),
    )
    return signed.select("doc_id", "hash", "key"), known


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id that links lead to), copy_id (least doc_id
    of those with the same words), n_copies (how many those are), n_links (texts of other words whose
    n-word shingle sets have a Jaccard similarity of the threshold or more).

    A text of fewer than n words has one shingle of them all. Null and wordless texts share the
    class of no words, which has no links. Repeated rows are copies; null doc_ids are rows too and
    the least only where a class has no other. Other columns are ignored."""
    rows, known = classed(docs, n, threshold, tolerance)
    return rows.select("doc_id", "key").join(known, "key").select("doc_id", F.col("group_id").alias("class_id"), F.col("class_id").alias("copy_id"), "n_copies", "n_links")


def representatives(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """The rows of docs that stay when one document of each group of ``join`` does: the one of the
    least doc_id, and of the least text hash where doc_ids are equal or null; all wordless texts are
    one group. All columns."""
    _, known = classed(docs, n, threshold, tolerance)
    stay = known.filter(F.col("class_id").eqNullSafe(F.col("group_id")) & (F.col("hash") == F.col("group_hash")))
    stay = stay.select(F.col("class_id").alias("_id"), F.col("hash").alias("_hash"))
    packed, columns = narrowed(docs, "doc_id", "text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    # Of rows with the same doc_id and text, the one of the least other columns, as JSON has them.
    there = packed.join(stay, same, "left_semi").withColumns({"_h": F.xxhash64("text"), "_j": F.to_json(F.struct("rest"))})
    one = there.groupBy("doc_id", "_h").agg(F.min_by(F.struct("text", "rest"), "_j").alias("x"))
    return one.select("doc_id", "x.text", "x.rest").select(*columns)
