"""Groups of spelling variants: words one edit apart, found by Aho-Corasick automata over their halves.

If one code point of a word is inserted, deleted or replaced, one of its halves stays as it is: the first
at the other word's begin or the second at its end. The halves of all words are dealt to automaton shards,
and every word is sent to the shards that may hold a half of a word of its length or one more or less. A
shard scans its words; where a half is met at its place, those words with it meet whose other halves are
the same with one place left out, and the distance of each such pair is verified.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import mix, spread, stage, text_batches

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # letters of A-Z and U+00C0 to U+00FF in UTF-8, lower case
HELD = 200_000  # distinct words counted before they are sent on
SHARD, HOT = 20_000, 40_000  # words of a shard about; words with the same half that share a task
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FOUND = "word string, n_near bigint, form_n bigint, form string"


def size(word: bytes) -> int:
    """Code points of a run."""
    return len(word) - word.count(b"\xc3")


def counted(docs: DataFrame, least: int = 7, often: int = 2, change: Callable[[object, bytes], bytes] | None = None) -> DataFrame:
    """(word, n): the runs of the letters A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z in lower case,
    that have ``least`` code points and occur ``often`` times at least. ``change``, if given, makes of each
    doc_id and distinct run (UTF-8, long enough) of its text what is counted. Null texts have none."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in Counter(x for x in RUN.findall((t or "").encode().lower()) if len(x) >= least).items():
                    w = change(d, w) if change else w
                    if size(w) >= least:
                        total[w] += n
                if len(total) > HELD:
                    yield sent()
        yield sent()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").cast("bigint").alias("n")).filter(F.col("n") >= often)


def _spans(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal keys in a and b."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    count = high - low
    return np.repeat(np.arange(len(a)), count), order[np.repeat(low, count) + _spans(count)]


def _hits(words: list[str], own: dict[str, tuple[bool, bool]]) -> np.ndarray:
    """Rows (word, half, its length, 0 for first and 1 for second, own) for every half that stands at its
    place in a word; own: it is the word's. ``own`` says which halves of a word the shard has."""
    import ahocorasick

    halves: dict[str, list[int]] = {}
    for w, which in own.items():
        cut = len(w) // 2
        for kind, half in enumerate((w[:cut], w[cut:])):
            if which[kind]:
                ids = halves.setdefault(half, [-1, -1])
                ids[kind] = max(ids[kind], 0)
    automaton, k = ahocorasick.Automaton(), 0
    for half, ids in halves.items():
        first = second = -1
        if ids[0] >= 0:
            first, k = k, k + 1
        if ids[1] >= 0:
            second, k = k, k + 1
        automaton.add_word(half, (len(half), first, second))
    out: list[tuple] = []
    if not k:
        return np.zeros((0, 5), np.int64)
    automaton.make_automaton()
    for i, w in enumerate(words):
        n, which = len(w), own.get(w, (False, False))
        for end, (long, first, second) in automaton.iter(w):
            if first >= 0 and end + 1 == long and abs(2 * long - n) <= 2:
                out.append((i, first, long, 0, which[0] and long == n // 2))
            if second >= 0 and end + 1 == n and abs(2 * long - n) <= 2:
                out.append((i, second, long, 1, which[1] and long == n - n // 2))
    return np.array(out, np.int64).reshape(-1, 5)


class _Letters:
    """Code points of words, one byte each, in a row."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(words).encode("latin-1") + b"\0", np.uint8)

    def same(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """Letters that words a[i] and b[i] share at their begin, or their end if ``back``."""
        out = np.zeros(len(a), np.int64)
        shorter = np.minimum(self.size[a], self.size[b])
        order = np.argsort(shorter, kind="stable")
        i = 0
        while i < len(order):  # pairs of like length together, a bounded number of letters at a time
            j = min(len(order), i + 50_000)
            j = max(i + 1, min(j, i + 20_000_000 // max(1, int(shorter[order[j - 1]]))))
            part = order[i:j]
            step = np.arange(int(shorter[part].max()))
            x, y = self.start[a[part]], self.start[b[part]]
            if back:
                x, y, move = x + self.size[a[part]] - 1, y + self.size[b[part]] - 1, -step
            else:
                move = step
            inside = step[None, :] < shorter[part][:, None]
            at = lambda z: self.flat[np.where(inside, z[:, None] + move[None, :], len(self.flat) - 1)]
            alike = np.where(inside, at(x) == at(y), False)
            out[part] = np.where(alike.all(axis=1), alike.shape[1], np.argmin(alike, axis=1))
            i = j
        return out


def near_pairs(words: list[str], own: dict[str, tuple[bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) for every word a of the list and word b one edit from it, of which the shard has the first
    half and a has it too, or else the second. ``words`` are distinct."""
    hits = _hits(words, own)
    letters = _Letters(words)
    word, half, long, kind, mine = hits.T
    mine = mine.astype(bool)
    rest = letters.size[word] - long
    begin = letters.start[word] + np.where(kind == 0, long, 0)
    # Polynomial hashes of the other half, whole and with each place left out.
    item = np.repeat(np.arange(len(hits)), rest)
    place = _spans(rest)
    longest = int(rest.max(initial=0)) + 1
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest, BASE)])
        term = (letters.flat[begin[item] + place].astype(np.uint64) + np.uint64(1)) * power[place]
        total = np.cumsum(np.r_[np.uint64(0), term], dtype=np.uint64)
        first = np.cumsum(rest) - rest
        whole = total[first + rest] - total[first]
        before = total[:-1] - total[first[item]]
        out = before + (whole[item] - before - term) * INVERSE
        seed = mix(half.astype(np.uint64) * BASE + np.uint64(7))
        whole_key = mix(whole + seed)
        out_key = mix(out + seed[item])
        place_key = mix(out_key + place.astype(np.uint64) + np.uint64(1))
    some = np.flatnonzero(mine)
    gaps = np.flatnonzero(mine[item])
    a, b = _meet(place_key, place_key[gaps])  # one place differs
    replaced = item[a], item[gaps[b]]
    a, b = _meet(out_key, whole_key[some])  # the first word has one more
    longer = item[a], some[b]
    a, b = _meet(whole_key, out_key[gaps])  # the second word has one more
    a, b = (np.concatenate(x) for x in zip(replaced, longer, (a, item[gaps[b]])))
    good = (half[a] == half[b]) & (word[a] != word[b])
    a, b = a[good], b[good]
    x, y, second = word[a], word[b], kind[a] == 1
    key = np.unique(np.stack([x * len(words) + y, second]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
    x, y, second = key[0] // max(1, len(words)), key[0] % max(1, len(words)), key[1].astype(bool)
    front, back = letters.same(x, y, False), letters.same(x, y, True)
    more = np.maximum(letters.size[x], letters.size[y])
    good = (np.abs(letters.size[x] - letters.size[y]) <= 1) & (front + back >= more - 1)
    good &= ~(second & (front >= letters.size[y] // 2))  # met by the first half
    return x[good], y[good]


def _shard(rows: pa.Table) -> pa.Table:
    """Of each word of a shard how many near words it has there and the one of largest n."""
    own: dict[str, list[bool]] = {}
    n: dict[str, int] = {}
    for w, count, kind, mine in zip(*(rows.column(c).to_pylist() for c in ("word", "n", "kind", "own"))):
        n[w] = count
        if mine:
            own.setdefault(w, [False, False])[kind] = True
    words = sorted(n)
    a, b = near_pairs(words, {w: (x, y) for w, (x, y) in own.items()})
    often = np.array([n[w] for w in words], np.int64)
    order = np.lexsort((b, -often[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    return pa.table({
        "word": pa.array([words[i] for i in a[first]], pa.string()), "n_near": pa.array(np.diff(np.r_[first, len(a)]).astype(np.int64)),
        "form_n": pa.array(often[b[first]]), "form": pa.array([words[i] for i in b[first]], pa.string()),
    })


def near(words: DataFrame, least: int = 7) -> DataFrame:
    """(word, n, n_near, best, best_n) for distinct words of at least ``least`` code points below U+0100,
    with their counts n: how many others are one edit away, and the one of them with the largest n (ties:
    the smallest in code-point order), null if there is none."""
    if least < 2:
        raise ValueError("words need two halves")
    n, total = F.length("word"), words.count()
    first = lambda k: F.struct(F.lit(0).alias("kind"), F.substring("word", F.lit(1), k).alias("half"), (k == F.floor(n / 2)).alias("own"))
    second = lambda k: F.struct(F.lit(1).alias("kind"), F.substring("word", n - k + 1, k).alias("half"), (k == n - F.floor(n / 2)).alias("own"))
    floor = lambda x: F.floor(x / 2).cast("int")
    sides = F.array(first(floor(n - 1)), first(floor(n + 1)), second(floor(n)), second(floor(n + 2)))
    dealt = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*").filter("half <> ''")
    # Words with one half in common share a task up to HOT; more are dealt over several, which all of them visit.
    hot = dealt.groupBy("kind", "half").agg(F.count("*").alias("_c")).filter(F.col("_c") > HOT).select(F.col("kind").alias("_k"), F.col("half").alias("_h"), F.ceil(F.col("_c") / HOT).cast("int").alias("_blocks"))
    dealt = dealt.join(hot, (F.col("kind") == F.col("_k")) & (F.col("half") == F.col("_h")), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("own", F.col("own") & (F.pmod(F.xxhash64("word"), F.col("_blocks")) == F.col("block")))
    dealt = dealt.select("word", "n", "kind", "own", spread(F.struct("kind", "half"), max(1, math.ceil(total / SHARD))).alias("shard"), "block")
    found = dealt.groupBy("shard", "block").applyInArrow(_shard, FOUND)
    both = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("form_n"), F.lit(None).cast("string").alias("form"))
    both = both.unionByName(found.withColumn("n", F.lit(None).cast("bigint")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("a"), F.col("form").alias("b"))))
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").cast("bigint").alias("n_near"), best.alias("_b"))
    return out.select("word", "n", "n_near", F.col("_b.b").alias("best"), (-F.col("_b.a")).alias("best_n"))


def groups(docs: DataFrame, least: int = 7, often: int = 2, times: int = 10, change: Callable[[object, bytes], bytes] | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``counted``: the near word of largest n is a
    word's form if it occurs ``times`` as often; root is the last word that forms lead to, the word itself
    if it has none. Forms occur more and more often, so they never lead back; a table of links is doubled
    until nothing changes. Repeated rows count each; a table without words gives no rows."""
    words = stage(counted(docs, least, often, change), "words")
    formed = near(words, least).withColumn("_f", F.col("best_n") >= times * F.col("n"))
    formed = stage(formed.select("word", "n", "n_near", F.when(F.col("_f"), F.col("best")).alias("form"), F.when(F.col("_f"), F.col("best_n")).alias("form_n")), "forms")
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        to = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        links = stage(links.join(to, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    roots = links.select(F.col("word").alias("_w"), "root")
    return formed.join(roots, F.col("word") == F.col("_w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


ORACLE = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM r, steps),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS l FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
g AS (SELECT word, n, l, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS gap FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM g a JOIN g b ON a.gap = b.gap AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM g a JOIN w b ON a.gap = b.word UNION SELECT b.word, b.n, a.word, a.n FROM g a JOIN w b ON a.gap = b.word),
f AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min_by(other, struct_pack(a := -m, b := encode(other))) AS best, max(m) AS best_n FROM p GROUP BY 1),
o AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
z AS (SELECT word, word AS root, 0 AS k FROM o UNION ALL SELECT z.word, o.form, k + 1 FROM z JOIN o ON z.root = o.word WHERE o.form IS NOT NULL)
SELECT o.*, root FROM o JOIN (SELECT word, max_by(root, k) AS root FROM z GROUP BY 1) USING (word)"""
