"""Runs of words that repeat with a period, found by heavy/light lag counting.

At lag q a run of period q shows as a stretch of places whose word stands again q words on. The places
that match at each lag are counted first: pairs of a rare word's places one by one, those of all frequent
words of a text together by the exact autocorrelation of their indicators (FFT). Only lags with as many
matches as a run needs are scanned for such stretches, at a few places a period unless these match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import chunked, narrowed, text_batches

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
PARTS = 8  # scanned places in the shortest stretch that counts
SCAN = 4_000_000  # places scanned at a time


def needed(q: np.ndarray | int, least: int, times: int) -> np.ndarray:
    """Matches in a row at lag q of the shortest run: its length less the period."""
    return np.maximum(least, times * q) - q


def _ranges(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size[0] - 1, 0, 1, ... size[1] - 1 and so on."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def lag_counts(words: np.ndarray, starts: np.ndarray, times: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the exact number of places whose word stands again q places on, for q from 0 to its
    n // times words; and where each text's counts begin (one more entry than texts)."""
    n = np.diff(starts)
    most = n // times
    first = np.concatenate([[0], np.cumsum(most + 1)])
    counts = np.zeros(first[-1], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    kind = text * (np.int64(words.max(initial=0)) + 1) + words
    order = np.argsort(kind, kind="stable")
    kind, where = kind[order], order
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
    often = np.diff(np.r_[edge, len(kind)])
    own = text[where[edge]]
    # Pairs of f places cost f * f, a transform n log n.
    heavy = often.astype(np.float64) ** 2 > n[own] * np.log2(np.maximum(n[own], 2))
    left = np.repeat(often, often) - _ranges(often) - 1  # further places of the same word
    at = np.flatnonzero(np.repeat(~heavy, often) & (left > 0))
    k = 1
    while len(at):
        lag = where[at + k] - where[at]
        doc = text[where[at]]
        near = lag <= most[doc]
        np.add.at(counts, first[doc[near]] + lag[near], 1)
        at = at[near]  # further places are further away
        k += 1
        at = at[left[at] >= k]
    heavy = np.flatnonzero(heavy)
    for d in np.unique(own[heavy]):
        size = 1 << int(n[d] + most[d]).bit_length()  # no lag that counts wraps around
        power = np.zeros(size // 2 + 1)
        for w in heavy[own[heavy] == d]:
            sign = np.zeros(size)
            sign[where[edge[w] : edge[w] + often[w]] - starts[d]] = 1
            f = np.fft.rfft(sign)
            power += f.real**2 + f.imag**2
        counts[first[d] : first[d + 1]] += np.rint(np.fft.irfft(power, size)[: most[d] + 1]).astype(np.int64)
    return counts, first


def _stretches(same: np.ndarray, least: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of true begin and end that are as long as ``least`` at their begin."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    long = end - begin >= (least if isinstance(least, int) else least[begin])
    return begin[long], end[long]


def _scan(words: np.ndarray, begin: np.ndarray, n: np.ndarray, q: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(candidate, start, length) of the runs of text words[begin:begin + n] at lag q, of each candidate.
    A stretch of as many matches as are needed holds PARTS scanned places in a row."""
    need = needed(q, least, times)
    step = np.maximum(1, need // PARTS)
    size = -(-(n - q) // step) + 1  # one place more that never matches keeps candidates apart
    ends = np.cumsum(size)
    i = 0
    while i < len(q):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + SCAN, side="right")))
        rank = _ranges(size[i:j])
        which = np.repeat(np.arange(i, j), size[i:j])
        place = begin[which] + rank * step[which]
        inside = rank < size[which] - 1
        place = np.where(inside, place, 0)
        same = inside & (words[place] == words[np.where(inside, place + q[which], 0)])
        for a, b in zip(*_stretches(same, (need // step)[which])):
            c = int(which[a])
            low, high = max(0, (int(rank[a]) - 1) * int(step[c]) + 1), min(int(rank[b - 1] + 1) * int(step[c]), int(n[c] - q[c]))
            here = words[begin[c] + low : begin[c] + high] == words[begin[c] + low + q[c] : begin[c] + high + q[c]]
            for s, e in zip(*_stretches(here, int(need[c]))):
                yield c, low + int(s), int(e - s + q[c])
        i = j


def find(words: np.ndarray, starts: np.ndarray, least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """Of each text, words[starts[i]:starts[i + 1]], its runs as (start, length, period) by start, then
    period: longest stretches with smallest period q and at least ``least`` and ``times`` q words.

    Lags go from small to large by powers of two, none of which divides another of the same round. A
    run's matches at multiples of its period are taken from their counts: they are no part of a run
    whose smallest period is such a multiple (that would share fewer than a period with it)."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    counts, first = lag_counts(words, starts, times)
    n = np.diff(starts)
    size = np.diff(first)
    lag = _ranges(size)
    likely = np.flatnonzero((lag > 0) & (counts >= needed(lag, least, times)))
    text, lag = np.repeat(np.arange(len(n)), size)[likely], lag[likely]
    for r in range(int(lag.max(initial=0)).bit_length()):
        now = np.flatnonzero(lag >> r == 1)
        now = now[counts[likely[now]] >= needed(lag[now], least, times)]
        for c, s, long in _scan(words, starts[text[now]], n[text[now]], lag[now], least, times):
            d, q = int(text[now[c]]), int(lag[now[c]])
            if any(p < q and a <= s and s + long <= a + m for a, m, p in found[d]):
                continue  # a shorter period
            found[d].append((s, long, q))
            multiple = np.arange(q, min(long, size[d]), q)
            counts[first[d] + multiple] -= long - multiple
    return [sorted(x, key=lambda t: (t[0], t[2])) for x in found]


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, long, q in runs:
        edge[s + q] += 1
        edge[s + long] -= 1
    return np.cumsum(edge[:-1]) == 0


def collapse(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """docs with two more columns, ``n_words`` and ``runs`` (an array of start, length and period in
    words from 0, by start, then period), and the column text collapsed: the words outside runs and each
    run's first period, joined by one space. Words are runs of anything but ASCII white space.

    Null and empty texts have no words and the text ''. A word in several runs goes if any of them
    drops it. Repeated rows are repeated; columns of these names are replaced, all others stay."""
    text_batches(docs.sparkSession)
    packed, _ = narrowed(docs.drop("n_words", "runs"), "text")
    names = [c for c in docs.columns if c not in ("n_words", "runs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in chunked(texts, 3_000_000):
                split = [(t or "").encode().split() for t in texts[i:j]]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
                known = pa.array([w for x in split for w in x], pa.large_binary()).dictionary_encode()
                runs = find(known.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, least, times)
                out = [b" ".join([x[k] for k in np.flatnonzero(kept(len(x), r))] if r else x).decode() for x, r in zip(split, runs)]
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1).slice(i, j - i), pa.array(np.diff(starts)), pa.array(rows, kind)], names=["text", "rest", "n_words", "runs"])

    rest = packed.schema["rest"].dataType.simpleString()
    out = packed.mapInArrow(run, f"text string, rest {rest}, n_words bigint, runs {RUNS}")
    return out.select(*[F.col(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in names], "n_words", "runs")


ORACLE = """
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(string_split_regex(doc_id::VARCHAR, ''), lambda c: ascii(c))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM documents, steps),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 % 8 AS g FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g) AS p FROM e),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
k AS (SELECT doc_id, n, i, w[1 + i] AS w FROM (SELECT *, unnest(range(n)) AS i FROM x)),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND b.i - a.i <= a.n // 3),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM m)
  GROUP BY doc_id, q, z HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.s <= s.s AND t.s + t.l >= s.s + s.l)),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY 1),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM k ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""
