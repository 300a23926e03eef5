"""Exact top-k inner products by block-at-a-time pruning.

Vectors lie in blocks of consecutive ids. A block keeps the largest and smallest value of every
term (component), whose products with a query's terms sum to a bound on any score in the block.
Each query takes the blocks in order of that bound, scores a block through its forward index (the
packed rows) and stops when the next bound falls below its k-th score so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.shared import spread, stage

BLOCKS = "part int, number long, first long, ids binary, dims int, rows binary, queries binary, query_numbers binary, query_rows binary, floors binary"
FOUND = "query_number long, query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


_MOST = np.iinfo(np.int64).max


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers; beyond a long the nearest one, its least aside, so that it can be negated."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:  # every sum is exact in doubles
        return (x @ y.T).astype(np.int64)
    exact = a @ b.T  # modulo 2**64
    if most < 2**62:
        return exact
    about, error = x @ y.T, 1e-12 * (np.abs(x) @ np.abs(y).T)
    exact[about - error >= 2.0**63] = _MOST
    exact[about + error <= -(2.0**63)] = -_MOST
    for i, j in zip(*np.nonzero(np.abs(np.abs(about) - 2.0**63) < error)):  # too near the edge to tell in doubles
        exact[i, j] = max(-_MOST, min(_MOST, sum(u * v for u, v in zip(a[i].tolist(), b[j].tolist()))))
    return exact


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of q in a block with these largest and smallest values is greater. Large values are bounded
    in doubles, as their sums may not fit a long where the scores do."""
    up, down, high_, low_ = (x.astype(np.float64) for x in (np.maximum(q, 0), np.minimum(q, 0), high, low))
    most = float(np.abs(up - down).max(initial=0)) * max(float(np.abs(high_).max(initial=0)), float(np.abs(low_).max(initial=0))) * max(1, q.shape[1])
    bound = up @ high_.T + down @ low_.T
    return bound if most < 2**52 else bound + 1e-12 * (up @ np.abs(high_).T - down @ np.abs(low_).T) + 1.0


def _wide(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best by (score descending, id)."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def _kth(query: np.ndarray, score: np.ndarray, n: int, k: int, floor: np.ndarray) -> np.ndarray:
    """Each query's k-th score among its (sorted) best, its floor where it has fewer."""
    count = np.bincount(query, minlength=n)
    last = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(last, query, score)
    return np.where(count >= k, np.maximum(last, floor), floor)


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 1024, group: int = 16, query_block: int = 4096) -> DataFrame:
    """The k best of all other rows for every row whose vec_id is divisible by ``every``: query_id,
    rank, vec_id, score; ties to the smaller vec_id; fewer than k rows if there are fewer. Vectors
    that are null or hold a null or non-finite component, and null vec_ids, take no part; shorter
    vectors count as padded with zeros. Repeated query rows have k answers each, and only the query's own
    row is no candidate: others with its vec_id are. Components and scores beyond a long count as the nearest
    one. A task holds one group of blocks and one block of queries, whatever the table holds."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, passed = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        rows: list[list[int]] = []

        def cut(n: int) -> pa.RecordBatch:
            nonlocal number, passed
            a = np.array(ids[:n], np.int64)
            dims = max(map(len, rows[:n]))
            m = np.zeros((n, dims), np.int64)
            for i, r in enumerate(rows[:n]):
                m[i, : len(r)] = r
            del ids[:n], rows[:n]
            q = np.flatnonzero(a % every == 0)
            s = _dot(m[q], m)
            # The k-th score within its own block is a floor for a query's k-th score.
            worst = -s
            worst[np.arange(len(q)), q] = np.iinfo(np.int64).max
            floors = -np.partition(worst, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(q), np.iinfo(np.int64).min)
            first = (part << 40) + passed  # rows are numbered in this order
            number, passed = number + 1, passed + n
            values = (part, number - 1, first, a.tobytes(), dims, m.tobytes(), a[q].tobytes(), (first + q).astype(np.int64).tobytes(), m[q].tobytes(), floors.astype(np.int64).tobytes())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= 2 * block:
                yield cut(block)
        while ids:
            yield cut(min(block, len(ids)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_score(left.to_pylist(), right.to_pylist(), k)])

    typed = vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = typed.select("vec_id", quantised(F.col("embedding"), scale).alias("v")).repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    blocks = stage(ranged.mapInArrow(build, BLOCKS), "blocks")
    sizes = blocks.agg(F.count("*").alias("n"), F.sum(F.length("queries") / 8).alias("q")).first()
    groups, sets = max(1, math.ceil((sizes["n"] or 0) / group)), max(1, math.ceil((sizes["q"] or 0) / query_block))
    # Keys of both sides are of one type: Spark deals an int and a long of the same value to different tasks.
    blocks = blocks.withColumn("g", spread(F.struct("part", "number"), groups).cast("int"))
    index = blocks.select("first", "ids", "dims", "rows", "g", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("s"))
    asked = blocks.filter(F.length("queries") > 0).withColumn("s", spread(F.struct("number", "part"), sets).cast("int"))
    asked = asked.select("queries", "query_numbers", "dims", "query_rows", "floors", "s", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    found = index.groupBy("g", "s").cogroup(asked.groupBy("g", "s")).applyInArrow(score, FOUND)
    # Each group returned its k best; the best of those are the best of all, k a task before the shuffle.
    best = Window.partitionBy("query_number").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _score(blocks: list[dict], asked: list[dict], k: int) -> pa.RecordBatch:
    """The k best of these blocks for these queries."""
    empty = np.zeros(0, np.int64)
    if not blocks or not asked:
        return pa.record_batch([pa.array(empty)] * 4, names=["query_number", "query_id", "vec_id", "score"])
    dims = max(r["dims"] for r in [*blocks, *asked])
    matrix = lambda raw, d: _wide(np.frombuffer(raw, np.int64).reshape(-1, d) if d else np.zeros((0, 0), np.int64), dims)
    ids = [np.frombuffer(b["ids"], np.int64) for b in blocks]
    rows = [matrix(b["rows"], b["dims"]) if dims else np.zeros((len(i), 0), np.int64) for b, i in zip(blocks, ids)]
    rows = [m if len(m) == len(i) else np.zeros((len(i), dims), np.int64) for m, i in zip(rows, ids)]
    qid = np.concatenate([np.frombuffer(r["queries"], np.int64) for r in asked])
    own = np.concatenate([np.frombuffer(r["query_numbers"], np.int64) for r in asked])
    q = np.concatenate([matrix(r["query_rows"], r["dims"]) if r["dims"] else np.zeros((len(r["queries"]) // 8, dims), np.int64) for r in asked])
    floor = np.concatenate([np.frombuffer(r["floors"], np.int64) for r in asked])
    high, low = np.stack([m.max(axis=0) for m in rows]), np.stack([m.min(axis=0) for m in rows])
    bound = _bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    top, score, vec = empty, empty, empty
    kth = floor.copy()
    active = np.arange(len(qid))
    for step in range(len(blocks)):
        active = active[bound[active, order[active, step]] >= kth[active]]
        if not len(active):
            break
        new = [(top, score, vec)]
        for b in np.unique(order[active, step]):
            who = active[order[active, step] == b]
            s = _dot(q[who], rows[b])
            i, j = np.nonzero((s >= kth[who][:, None]) & (own[who][:, None] != blocks[b]["first"] + np.arange(len(ids[b]))))
            new.append((who[i], s[i, j], ids[b][j]))
        top, score, vec = (np.concatenate(x) for x in zip(*new))
        keep = _best(top, score, vec, k)
        top, score, vec = top[keep], score[keep], vec[keep]
        kth = _kth(top, score, len(qid), k, floor)
    return pa.record_batch([pa.array(own[top]), pa.array(qid[top]), pa.array(vec), pa.array(score)], names=["query_number", "query_id", "vec_id", "score"])


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.n <> q.n),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""
