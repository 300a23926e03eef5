"""Benchmark decontamination by latent semantic retrieval.

Passages (two consecutive half windows of words) and benchmark items are TF-IDF vectors over a
bounded vocabulary; a distributed randomised SVD gives the latent space. A passage near an item by
cosine is taken for a paraphrase of it, with words replaced, left out or moved, if a common subsequence
has ``loose`` of the item's words, by their idf, and a check finds its answer (its last quarter). Text
that keeps ``least`` of the item's words in order is found whatever its cosine, by the item's rarest words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import chunked, hashed_words, lean, stage, text_batches

HALF = 32
SHORT = 4  # items of fewer words stand whole or not at all
DENSE = 64  # words that most documents have, multiplied as dense columns
PIECE, TOGETHER = 32, 512  # rows added up one after the other, and how many such sums at a time
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, word long"


@dataclass(frozen=True)
class Rare:
    """The rarest words of the items: sorted word hashes, where each word's entries begin (one more),
    the item and count of each entry, and of each item the count to reach and its words."""

    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    count: np.ndarray
    need: np.ndarray
    size: np.ndarray


@dataclass(frozen=True)
class Space:
    """Sorted word hashes with idf and latent loadings (idf included), the idf of other words, and
    the items: ids, word hashes, unit latent vectors, rarest words."""

    words: np.ndarray
    idf: np.ndarray
    other: float
    loadings: np.ndarray
    ids: list
    items: list[np.ndarray]
    vectors: np.ndarray
    rare: Rare


def begins(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours begin."""
    return np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]][: len(x)])


def place(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the vocabulary, -1 for other words."""
    out = np.full(len(h), -1)
    if not len(vocabulary):
        return out
    slot = (vocabulary >> np.uint64(46)).astype(np.int64)  # its words are sorted, so those of a slot follow each other
    first = np.full(1 << 18, -1, np.int32)
    first[slot[::-1]] = np.arange(len(slot))[::-1]
    at = first[h >> np.uint64(46)]
    some = np.flatnonzero(at >= 0)  # most others leave here
    at = at[some]
    while len(some):
        same = vocabulary[at] == h[some]
        out[some[same]] = at[same]
        more = np.flatnonzero(~same & (at + 1 < len(slot)))
        more = more[slot[at[more] + 1] == slot[at[more]]]
        some, at = some[more], at[more] + 1
    return out


def summed(rows: np.ndarray, pick: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The sum of rows[pick] over each run of ``pick``; runs begin at ``edge``. They are cut into pieces of
    at most PIECE, many pieces are added up at a time, the longest first, and then the pieces' sums."""
    space = np.empty((TOGETHER, rows.shape[1]), rows.dtype)
    while True:
        pieces = -(-np.diff(edge, append=len(pick)) // PIECE)
        first = np.cumsum(pieces) - pieces
        begin = np.repeat(edge - first * PIECE, pieces) + np.arange(pieces.sum()) * PIECE
        length = np.diff(begin, append=len(pick))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        out = np.empty((len(begin), rows.shape[1]), rows.dtype)
        for a in range(0, len(begin), TOGETHER):
            own, left = begin[a : a + TOGETHER], length[a : a + TOGETHER]
            total = rows.take(pick[own], axis=0)
            for k in range(1, int(left[0])):
                n = int(np.searchsorted(-left, -k))  # pieces longer than k
                total[:n] += rows.take(pick[own[:n] + k], axis=0, out=space[:n], mode="clip")
            out[order[a : a + TOGETHER]] = total
        if len(out) == len(edge):
            return out
        rows, pick, edge = out, np.arange(len(out)), first


def halves(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each half window begins, and the text it belongs to; texts without words have none."""
    n = -(-np.diff(starts) // HALF)
    text = np.repeat(np.arange(len(n)), n)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[:-1][text] + rank * HALF, text


def windows(begin: np.ndarray, n: int) -> np.ndarray:
    """The half window of each of n words."""
    return np.repeat(np.arange(len(begin)), np.diff(begin, append=n))


def latent(space: Space, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage: (latent vector, length of its TF-IDF vector, first word, end word, text); ``at``
    are the words' places in the vocabulary."""
    begin, text = halves(starts)
    wide = space.loadings.shape[1]
    sums = np.zeros((len(begin), wide + 1), np.float32)
    half = windows(begin, len(at))
    some = np.flatnonzero(at >= 0)
    if len(some):
        own = half[some]
        edge = begins(own)
        sums[own[edge], :wide] = summed(space.loadings, at[some], edge)
        sums[:, wide] = np.bincount(own, space.idf[at[some]] ** 2, minlength=len(begin))
    sums[:, wide] += np.bincount(half[at < 0], minlength=len(begin)) * space.other**2
    pair = np.flatnonzero(text[:-1] == text[1:])
    passage = sums.copy()
    passage[pair] += sums[pair + 1]
    end = np.minimum(begin + 2 * HALF, starts[1:][text]) if len(text) else begin
    return passage[:, :wide], np.sqrt(passage[:, wide]) + 1e-9, begin, end, text


def required(n: int, least: float) -> int:
    """The words of n that a subsequence of the share ``least`` has."""
    return next((c for c in range(n) if c / n >= least), n)


def rarest(items: list[np.ndarray], often: list[np.ndarray], least: float, most: int = 4) -> Rare:
    """A subsequence of ``required`` words leaves n - required out, so of any n - required + t words of
    the item it has t; the rarest ones are met least elsewhere."""
    entries, need = [], []
    for i, (w, df) in enumerate(zip(items, often)):
        m = required(len(w), least)
        need.append(min(m, most))
        entries += [(x, i, c) for x, c in zip(*np.unique(w[np.lexsort((w, df))[: len(w) - m + need[-1]]], return_counts=True))]
    word, item, count = np.array([e[0] for e in entries], np.uint64), np.array([e[1] for e in entries]), np.array([e[2] for e in entries])
    order = np.argsort(word, kind="stable")
    keys, first = np.unique(word[order], return_index=True)
    return Rare(keys, np.r_[first, len(word)], item[order], count[order], np.array(need), np.array([len(w) for w in items]))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def within_reach(rare: Rare, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) for every passage whose surroundings, an item's length to each side, hold as
    many of the item's rarest words as any subsequence that counts."""
    at = place(rare.keys, h)
    hit = np.flatnonzero(at >= 0)
    each = rare.first[at[hit] + 1] - rare.first[at[hit]]
    entry, hit = _ranges(rare.first[at[hit]], each), np.repeat(hit, each)
    n, text = rare.size[rare.item[entry]], np.searchsorted(starts, hit, side="right") - 1
    passages = -(-np.diff(starts) // HALF)
    rank = hit - starts[text]
    low, high = np.maximum((rank - 2 * HALF - n) // HALF + 1, 0), np.minimum((rank + n) // HALF, passages[text] - 1)
    passage = _ranges((np.cumsum(passages) - passages)[text] + low, high - low + 1)
    key = np.sort(passage * len(rare.item) + np.repeat(entry, high - low + 1))
    key = key[begins(key)]
    passage, entry = key // len(rare.item), key % len(rare.item)
    pair, back = np.unique(passage * len(rare.size) + rare.item[entry], return_inverse=True)
    enough = np.bincount(back, rare.count[entry], minlength=len(pair)) >= rare.need[pair % len(rare.size)]
    return pair[enough] // len(rare.size), pair[enough] % len(rare.size)


def places(a: list[int]) -> dict[int, int]:
    """Of each word a bit for each place where it stands."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


def common(masks: dict[int, int], n: int, b: list[int]) -> int:
    """Length of the longest common subsequence of b and the n words with these places."""
    full = v = (1 << n) - 1
    for x in b:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def heaviest(a: np.ndarray, weight: np.ndarray, b: list[int]) -> float:
    """The greatest weight of a common subsequence of b and the words a."""
    best = np.zeros(len(a) + 1)
    for x in b:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(a == np.uint64(x), best[:-1] + weight, 0)))
    return float(best[-1])


def shared(masks: dict[int, int], b: list[int]) -> int:
    """Words of b that stand among those of the places, each as often as it does there at most: no
    common subsequence is longer."""
    left: dict[int, int] = {}
    count = 0
    for x in b:
        m = masks.get(x)
        if m is not None:
            n = left.get(x)
            if n is None:
                n = m.bit_count()
            if n:
                count += 1
                left[x] = n - 1
    return count


def _found(spaces: list[Space], doc_ids: list, texts: list, cosine: float, least: float, loose: float, answer: float) -> list[tuple]:
    out: list[tuple] = []
    rules = [(_bound(space, least, loose), _judge(space, least, loose, answer)) for space in spaces]
    for s, e in chunked(texts, 450_000):
        h, starts = hashed_words(texts[s:e])
        for space, rule in zip(spaces, rules):
            out += [(doc_ids[s + t], space.ids[i], r[1], r[0], r[2], -r[3]) for (t, i), r in sorted(_rows(space, *rule, h, starts, cosine).items())]
    return out


def _rows(space: Space, likely: Callable, judged: Callable, h: np.ndarray, starts: np.ndarray, cosine: float) -> dict[tuple[int, int], tuple]:
    """Of each text and item it holds: (share, cosine, share of the answer, minus the word) of the best passage."""
    best: dict[tuple[int, int], tuple] = {}
    at = place(space.words, h)
    passage, norm, begin, end, text = latent(space, at, starts)
    if not len(begin):
        return best
    score = (passage @ space.vectors.T / norm[:, None]).ravel()
    near, rare = np.flatnonzero(score >= cosine), within_reach(space.rare, h, starts)
    many = len(space.ids)
    pair = np.unique(np.concatenate([near, rare[0] * many + rare[1]]))
    p, i = pair // many, pair % many
    low, high = np.maximum(starts[text[p]], begin[p] - space.rare.size[i]), np.minimum(starts[text[p] + 1], end[p] + space.rare.size[i])
    for k in np.flatnonzero(likely(at, low, high, i, score[pair] >= cosine)).tolist():
        found = judged(int(i[k]), h[low[k] : high[k]], bool(score[pair[k]] >= cosine))
        if found is not None:
            key = int(text[p[k]]), int(i[k])
            row = (found[0], float(score[pair[k]]), found[1], -int(begin[p[k]] - starts[key[0]]))
            best[key] = max(best.get(key, row), row)
    return best


def _bound(space: Space, least: float, loose: float, most: int = 500_000) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Tells of many stretches of words, each with an item, where the item's words that stand in it would do
    in some order; no other stretch can pass as ``_judge`` has it. About ``most`` words are taken at a time."""
    size = len(space.words)
    own = [np.unique(place(space.words, i), return_counts=True) for i in space.items]
    held = np.zeros((len(own), size), bool)
    for i, (w, _) in enumerate(own):
        held[i, w] = True
    key = np.concatenate([i * size + w for i, (w, _) in enumerate(own)])
    times = np.concatenate([c for _, c in own])
    weight = times * space.idf[key % size]
    need = np.array([required(len(i), least) for i in space.items])
    enough = loose * (1 - 1e-9) * np.bincount(key // size, weight)  # sums differ by their order

    def likely(at: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, near: np.ndarray) -> np.ndarray:
        out, ends, s = np.zeros(len(item), bool), np.cumsum(high - low), 0
        while s < len(item):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, side="right")))
            n, i = high[s:e] - low[s:e], item[s:e]
            pair, word = np.repeat(np.arange(e - s), n), at[_ranges(low[s:e], n)]
            there = np.flatnonzero((word >= 0) & held[i[pair], word])
            once = np.sort(pair[there] * size + word[there])
            once = once[begins(once)]
            pair = once // size
            entry = np.searchsorted(key, i[pair] * size + once % size)
            count, sums = (np.bincount(pair, x[entry], minlength=e - s) for x in (times, weight))
            out[s:e] = (count >= need[i]) | near[s:e] & (sums >= enough[i])
            s = e
        return out

    return likely


def _judge(space: Space, least: float, loose: float, answer: float) -> Callable[[int, np.ndarray, bool], tuple[float, float] | None]:
    lists = [i.tolist() for i in space.items]
    tails = [i[-max(3, len(i) // 4) :] for i in lists]
    masks, ends = [places(i) for i in lists], [places(t) for t in tails]
    need = [required(len(i), least) for i in lists]
    idf = [space.idf[place(space.words, i)] for i in space.items]
    weight = [{x: w for x, w in zip(i, v.tolist())} for i, v in zip(lists, idf)]
    total = [float(v.sum()) for v in idf]
    times = [Counter(i) for i in lists]
    known = [set(i) for i in lists]
    more = [len(i) - len(k) for i, k in zip(lists, known)]  # words that stand there again
    seen: dict[tuple[int, bool, bytes], tuple[float, float] | None] = {}  # by item and words, as copies come together

    def answered(i: int, b: list[int], length: int) -> tuple[float, float] | None:
        tail = common(ends[i], len(tails[i]), b) / len(tails[i])
        return (length / len(lists[i]), tail) if tail >= answer else None

    def shares(i: int, b: list[int], near: bool) -> tuple[float, float] | None:
        n = len(lists[i])
        there = known[i].intersection(b)
        if n < SHORT:  # these stand whole, in a row
            return (1.0, 1.0) if len(there) == len(known[i]) and any(b[k : k + n] == lists[i] for k in range(len(b) - n + 1)) else None
        if len(there) + more[i] >= need[i] and sum(masks[i][x].bit_count() for x in there) >= need[i] and shared(masks[i], b) >= need[i]:
            length = common(masks[i], n, b)
            if length >= need[i]:
                return answered(i, b, length)
        if near and sum(weight[i][x] * times[i][x] for x in there) >= loose * total[i]:
            kept = [x for x in b if x in there]
            if heaviest(space.items[i], idf[i], kept) >= loose * total[i]:
                return answered(i, b, common(masks[i], n, kept))
        return None

    def judged(i: int, words: np.ndarray, near: bool) -> tuple[float, float] | None:
        """(share of the item, share of its last quarter) in these words if both will do."""
        key = i, near, words.tobytes()
        if key not in seen:
            if len(seen) > 20_000:
                seen.clear()
            seen[key] = shares(i, words.tolist(), near)
        return seen[key]

    return judged


def _gram(texts: list[str], vocabulary: np.ndarray, idf: np.ndarray, basis: np.ndarray, often: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A basis) to total, where the rows of A are the passages' TF-IDF vectors of unit length. As a
    passage is the sum of two half windows, words are taken once by half window; ``often`` are places of
    words that many have, which are multiplied as dense columns, all others as sparse ones."""
    weight, dense = idf.astype(np.float32), np.full(len(vocabulary), -1)
    dense[often] = np.arange(len(often))
    weighted = basis.astype(np.float32) * weight[:, None]
    for s, e in chunked(texts, 450_000):
        h, starts = hashed_words(texts[s:e])
        begin, text = halves(starts)
        at = place(vocabulary, h)
        some = np.flatnonzero(at >= 0)
        if not len(some):
            continue
        word, half = at[some], windows(begin, len(h))[some]
        column = dense[word]
        d = np.bincount((half * len(often) + column)[column >= 0], minlength=len(begin) * len(often)).reshape(len(begin), -1).astype(np.float32)
        y = d @ weighted[often]
        rest = np.flatnonzero(column < 0)
        if len(rest):
            own = half[rest]
            edge = begins(own)
            y[own[edge]] += summed(weighted, word[rest], edge)

        # By word, then half window: the same word in the next half window comes next.
        bits = len(begin).bit_length()
        key = np.sort(word << bits | half)
        edge = begins(key)
        key, count = key[edge], np.diff(edge, append=len(key))
        word, half = key >> bits, key & ((1 << bits) - 1)
        value = count * idf[word]
        follows = np.zeros(len(begin), bool)
        follows[:-1] = text[1:] == text[:-1]
        both = np.flatnonzero((key[1:] == key[:-1] + 1) & follows[half[:-1]])
        own = np.bincount(half, value**2, minlength=len(begin))
        norm = own + 2 * np.bincount(half[both], value[both] * value[both + 1], minlength=len(begin))
        pair = np.flatnonzero(follows)
        norm[pair] += own[pair + 1]

        passage = y.copy()
        passage[pair] += y[pair + 1]
        passage /= np.maximum(norm, 1e-18)[:, None].astype(np.float32)
        back = passage.copy()
        back[pair + 1] += passage[pair]
        total[often] += weight[often, None] * (d.T @ back)
        rest = np.flatnonzero(dense[word] < 0)
        if len(rest):
            word, count = word[rest], count[rest]
            edge = begins(word)
            total[word[edge]] += weight[word[edge], None] * summed(back, np.repeat(half[rest], count), (np.cumsum(count) - count)[edge])


def counted(docs: DataFrame) -> DataFrame:
    """(w, n): of every word hash the documents that have it, and of null all documents. Tasks add up
    what they read, a bounded number of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words, counts, held = 0, [], [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            word, count = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *counts])
            order = np.argsort(word)
            word, sums = word[order], np.r_[0, np.cumsum(count[order])]
            edge = begins(word)
            return word[edge], np.diff(sums[np.r_[edge, len(word)]])

        for batch in batches:
            text = batch.column(0).to_pylist()
            n += len(text)
            for s, e in chunked(text, 300_000):
                x, starts = hashed_words(text[s:e])
                for a, b in zip(starts, starts[1:]):
                    x[a:b].sort()
                once = np.zeros(len(x), bool)  # a word of a text
                once[np.union1d(begins(x), starts[:-1][np.diff(starts) > 0])] = True
                x = np.sort(x[once])
                edge = begins(x)
                words.append(x[edge])
                counts.append(np.diff(edge, append=len(x)))
                held += len(edge)
            if held > 500_000:
                word, count = added()
                words, counts, held = [word], [count], len(word)
                if held > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(count)], names=["w", "n"])
                    words, counts, held = [], [], 0
        word, count = added()
        yield pa.RecordBatch.from_arrays([pa.array([*word.astype(np.int64).tolist(), None], pa.int64()), pa.array(np.r_[count, n])], names=["w", "n"])

    return docs.select("text").mapInArrow(lean(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, blocks: list[list[tuple]], rank: int, least: float, words: int, seed: int) -> list[Space]:
    """A latent space for each block of items: vocabulary from the items and the ``words`` that most
    documents have, frequencies over all documents in one pass for all blocks, and the SVD over the
    passages of all documents and the block's items, the items weighted to count as much."""
    h = np.unique(np.concatenate([hashed_words([t])[0] for items in blocks for _, t in items]))
    counts = stage(counted(docs), "counts")
    top = counts.filter("w IS NOT NULL").orderBy(F.desc("n"), "w").limit(words).collect()
    own = docs.sparkSession.createDataFrame(pa.table({"w": pa.array(h.astype(np.int64))}))
    found = {r["w"]: r["n"] for r in [*top, *counts.join(F.broadcast(own), "w", "left_semi").collect()]}
    common_words = np.array([r["w"] for r in top], np.int64).astype(np.uint64)
    vocabulary = np.unique(np.concatenate([h, common_words]))
    df = np.array([found.get(w, 0) for w in vocabulary.astype(np.int64).tolist()], float)
    n = max(1, sum(r["n"] for r in counts.filter("w IS NULL").collect()))
    idf = np.log1p((n + 1) / (df + 1))  # never 0: an item may stand in any share of the documents
    return [_space(docs, items, vocabulary, df, idf, common_words, float(np.log(n + 1)), rank, least, seed) for items in blocks]


def _space(docs: DataFrame, items: list[tuple], every: np.ndarray, df: np.ndarray, idf: np.ndarray, common_words: np.ndarray, other: float, rank: int, least: float, seed: int) -> Space:
    """The space of one block, over its own words and the frequent ones."""
    texts = [t or "" for _, t in items]
    h, at = hashed_words(texts)
    vocabulary = np.unique(np.concatenate([h, common_words]))
    own = np.searchsorted(every, vocabulary)
    df, idf = df[own], idf[own]
    often = np.argsort(-df, kind="stable")[:DENSE]
    r = np.random.default_rng(seed)
    k = min(rank + 16, len(vocabulary))
    # The driver holds a few matrices of vocabulary by rank in single precision; sums are in double.
    basis = np.linalg.qr(r.standard_normal((len(vocabulary), k), np.float32))[0]
    # A task's sum is a matrix, whatever it reads: no more tasks than keep all cores busy.
    read = docs.select("text").coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    for _ in range(2):
        def part(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(basis.shape), 0  # of a partition
            for batch in batches:
                t = batch.column(0).to_pylist()
                n += len(t)
                _gram(t, vocabulary, idf, basis, often, total)
            size = 512
            if n:
                for b in range(0, len(total), size):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([total[b : b + size].astype(np.float32).tobytes()], pa.binary())], names=["b", "m"])

        def added(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in t.column("m"))
            return pa.table({"b": pa.array([t.column("b")[0].as_py()]), "m": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        sums = read.mapInArrow(lean(part), "b long, m binary").groupBy("b").applyInArrow(added, "b long, m binary").collect()
        rest = np.zeros(basis.shape, np.float32)
        for row in sums:
            m = np.frombuffer(row["m"], np.float32).reshape(-1, k)
            rest[row["b"] : row["b"] + len(m)] = m
        del sums
        y = np.zeros(basis.shape)
        _gram(texts, vocabulary, idf, basis, often, y)
        y *= max(1.0, 4 * np.linalg.norm(rest) / max(np.linalg.norm(y), 1e-9))
        rest += y.astype(np.float32)
        basis = np.linalg.qr(rest)[0]
    basis = basis[:, :rank]
    loadings = basis * idf[:, None].astype(np.float32)
    item_words = [h[s:e] for s, e in zip(at, at[1:])]
    vectors = np.array([loadings[place(vocabulary, w)].sum(axis=0) for w in item_words], np.float32).reshape(len(items), -1)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    rare = rarest(item_words, [df[place(vocabulary, w)] for w in item_words], least)
    return Space(vocabulary, idf, other, loadings, [i for i, _ in items], item_words, vectors, rare)


# The parameters of contaminated and clean.
#   rank          dimensions of a space; block: items of a space, together: spaces of a pass over docs
#   cosine        of a passage that may be a paraphrase, loose: the share of the item's idf it keeps in order
#   least         the share that text of any cosine keeps in order; answer: of the item's last quarter
#   words         how many words of most documents a space has beside the items' own
def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 160, cosine: float = 0.2, least: float = 0.7, loose: float = 0.5, answer: float = 0.5, words: int = 8000, block: int = 200, together: int = 10, seed: int = 3) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer and word (where the passage begins) for every document and item
    that it holds: near one passage a subsequence of ``least`` of the item's words, or of ``loose`` of their
    idf if the passage's cosine is ``cosine`` or more, and of ``answer`` of its last quarter. Items of fewer than four
    words are held where they stand whole. Null and empty texts and items without words match nothing;
    repeated documents and item rows with the same text each match once for each id.

    Items are taken in blocks, so what a task holds does not grow with the benchmark."""
    typed = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], FOUND)
    for spaces in _spaces(typed, benchmark, rank, least, words, block, together, seed):

        def run(batches: Iterator[pa.RecordBatch], spaces: list[Space] = spaces) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = _found(spaces, batch.column(0).to_pylist(), batch.column(1).to_pylist(), cosine, least, loose, answer)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

        out = out.unionByName(typed.mapInArrow(lean(run), FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rank: int = 160, cosine: float = 0.2, least: float = 0.7, loose: float = 0.5, answer: float = 0.5, words: int = 8000, block: int = 200, together: int = 10, seed: int = 3) -> DataFrame:
    """The rows of docs (all columns) that hold no item by the rule of ``contaminated``."""
    out = docs
    for spaces in _spaces(docs, benchmark, rank, least, words, block, together, seed):

        def run(batches: Iterator[pa.RecordBatch], spaces: list[Space] = spaces) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text")).to_pylist()
                hit = {g[0] for g in _found(spaces, list(range(len(text))), text, cosine, least, loose, answer)}
                yield batch.filter(pa.array([k not in hit for k in range(len(text))], pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out


def _spaces(docs: DataFrame, benchmark: DataFrame, rank: int, least: float, words: int, block: int, together: int, seed: int) -> Iterator[list[Space]]:
    text_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").distinct()
    sets = -(-items.count() // (block * together))
    for b in range(sets):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == b) if sets > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in some.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        rows = [r for r in rows if len(hashed_words([r[1]])[0])]
        if rows:
            yield build(docs, [rows[i : i + block] for i in range(0, len(rows), block)], rank, least, words, seed)
