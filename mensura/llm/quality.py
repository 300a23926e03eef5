"""Quality classifier: document evidence combined with host and path posteriors (empirical Bayes).

Linear classifiers give each document's evidence for good and for toxic text. A document's prior is
the posterior mean of its path (a section of a host): the path's mean of all other documents shrinks
toward its host's, and the host's toward the global one, each by the variance between groups that is
left after the noise within them, so that sparse sites lean on what is above them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import chunked, hashed_words, lean, narrowed, own_batches, stage

MARKS = "!#$%&*|=<>{}[]\\^~+"
SEPARATORS = "|\u00bb\u203a\u2022\u00b7"
N_SHAPE = 8
MOST_WORDS = 400
BROADCAST_SITES = 200_000  # paths or labels (a few dozen bytes each) up to which their table is broadcast
KINDS = ("good", "toxic")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")


@dataclass(frozen=True)
class Linear:
    """Weights of telling words (by hash, sorted) and of the shape features, with their scaling."""

    words: np.ndarray
    weights: np.ndarray
    shape: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def margin(self, x: "Features") -> np.ndarray:
        doc, word = x.hits(self.words)
        return np.bincount(doc, self.weights[word], minlength=len(x.shape)) + (x.shape - self.centre) / self.scale @ self.shape + self.bias


@dataclass(frozen=True)
class Features:
    """Shape features, and the distinct words of each text as (text, hash) sorted by both."""

    shape: np.ndarray
    doc: np.ndarray
    word: np.ndarray

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in words) of every occurrence."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(words, self.word), len(words) - 1)
        found = words[at] == self.word
        return self.doc[found], at[found]


def features(texts: list[str | None]) -> Features:
    shape = np.zeros((len(texts), N_SHAPE))
    docs, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in chunked(texts):
        h, at = hashed_words(texts[i:j])
        doc = np.repeat(np.arange(j - i), np.diff(at))
        order = np.lexsort((h, doc))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        docs.append(doc[order][first] + i)
        words.append(h[order][first])
        repeat = np.zeros(len(h), bool)
        repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        repeats, distinct, n = np.bincount(doc, repeat, minlength=j - i), np.bincount(doc[order][first], minlength=j - i), np.diff(at)
        for k in range(i, j):
            t = texts[k] or ""
            m = max(1, len(t))
            marks = sum(map(t.count, MARKS))
            shape[k] = (
                np.log1p(len(t)), np.log1p(1000 * marks / m), np.log1p(1000 * sum(map(t.count, SEPARATORS)) / m), np.log1p(100 * len(_CAPITALS.findall(t)) / m),
                np.log1p(1000 * t.count("!") / m), repeats[k - i] / max(1, n[k - i]), distinct[k - i] / max(1, n[k - i]), not t.strip(),
            )
    return Features(shape, np.concatenate(docs), np.concatenate(words))


def telling(counts: DataFrame, y: str, total: float, positive: float, least: float = 5.0) -> np.ndarray:
    """Words (w, of n texts, of which n_<y> are positive) whose share of texts differs between the
    classes by ``least`` standard errors (beyond chance among all words of a sample) and that some
    texts hold; at most MOST_WORDS."""
    n, n1, share = F.col("n"), F.col(f"n_{y}"), F.col("n") / total
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / positive + 1 / (total - positive)))
    z = F.abs((n1 / positive - (n - n1) / (total - positive)) / error)
    best = counts.filter(n >= 4).select("w", z.alias("z")).filter(F.col("z") >= least).orderBy(F.desc("z"), "w").limit(MOST_WORDS)
    return np.sort(np.array([r["w"] for r in best.collect()], np.int64).astype(np.uint64))


class Sums:
    """What one step of a fit needs of the labelled texts: loss, gradient and second derivatives of the
    logistic loss at some weights (words, shape, bias), where the classes count alike."""

    def __init__(self, words: np.ndarray, centre: np.ndarray, scale: np.ndarray, share: float):
        self.words, self.centre, self.scale, self.share = words, centre, scale, share
        self.size = len(words) + N_SHAPE + 1

    def of(self, shape: np.ndarray, hits: list[np.ndarray], y: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The sums over these texts, in one row."""
        x = np.zeros((len(y), self.size))
        x[np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.searchsorted(self.words, np.concatenate([np.zeros(0, np.uint64), *hits]))] = 1
        x[:, len(self.words) : -1] = (shape - self.centre) / self.scale
        x[:, -1] = 1
        m = x @ at
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        weight = np.where(y > 0, 0.5 / self.share, 0.5 / (1 - self.share))
        loss = weight @ np.logaddexp(0, np.where(y > 0, -m, m))
        return np.concatenate([[loss], (weight * (p - y)) @ x, (x.T @ (x * (weight * p * (1 - p))[:, None])).ravel()])


def descended(sums: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], n: float, sizes: dict[str, int], decay: float = 1e-4, most: int = 40) -> dict[str, np.ndarray]:
    """The weights of least mean loss plus half the decay times their squares (not the bias'), of each
    kind, by Newton's steps, which are halved where they lead up. ``sums`` adds up a point a kind."""
    trial, at, best, step, done = {k: np.zeros(p) for k, p in sizes.items()}, {}, {}, {}, set()
    for _ in range(most):
        got = sums({k: w for k, w in trial.items() if k not in done})
        for k, row in got.items():
            p = sizes[k]
            keep = np.r_[np.full(p - 1, decay), 0.0]
            w = trial[k]
            value = row[0] / n + keep @ (w * w) / 2
            if k in best and value > best[k] and np.abs(step[k]).max() > 1e-9:
                step[k] = step[k] / 2
            else:
                if k in best and best[k] - value < 1e-10:
                    done.add(k)
                at[k], best[k] = w, min(value, best.get(k, value))
                gradient, second = row[1 : p + 1] / n + keep * w, row[p + 1 :].reshape(p, p) / n + np.diag(keep + 1e-9)
                step[k] = -np.linalg.solve(second, gradient)
            trial[k] = at[k] + step[k]
        if len(done) == len(sizes):
            break
    return at


def sample(docs: DataFrame, labels: DataFrame, most: int | None, seed: int) -> DataFrame:
    """The labelled documents, one row a label: _id, good, toxic and text. Of documents with one doc_id
    that of the least text hash counts. ``most`` takes so many labels only, in hash order."""
    known = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("good"), F.col("toxic").cast("double").alias("toxic")).distinct()
    if most is not None:
        known = known.orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "good", "toxic").limit(most)
    texts = docs.select("doc_id", "text")
    if not texts.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text")
    small = labels.count() <= BROADCAST_SITES
    return texts.join(F.broadcast(known) if small else known, F.col("doc_id") == F.col("_id")).select("_id", "good", "toxic", "text")


def fitted(docs: DataFrame, labels: DataFrame, most: int | None, seed: int) -> list[Linear | None]:
    """A classifier for each of KINDS; None where the labels don't have both classes. The driver gets
    the telling words and sums over all labelled texts, which are added up in the executors."""
    seen = sample(docs, labels, most, seed).select(*KINDS, "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total = ["w", "n", *[f"n_{k}" for k in KINDS]], np.zeros(3)
        for batch in batches:
            y, text = [batch.column(k).to_numpy() for k in range(2)], batch.column(2).to_pylist()
            total += [len(text), *map(np.sum, y)]
            for s, e in chunked(text):
                x = features(text[s:e])
                word, at = np.unique(x.word, return_inverse=True)
                sums = [np.bincount(at, v[s:e][x.doc], minlength=len(word)) for v in y]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, [word.astype(np.int64), np.bincount(at, minlength=len(word)).astype(float), *sums])), names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[pa.array([t]) for t in total]], names=names)

    with own_batches(docs.sparkSession):
        counted = seen.mapInArrow(lean(words), "w long, n double, " + ", ".join(f"n_{k} double" for k in KINDS))
        counts = stage(counted.groupBy("w").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]]), "words")
    total = counts.filter("w IS NULL").first()
    n, positive = (float(total["n"]), {k: float(total[f"n_{k}"]) for k in KINDS}) if total else (0.0, {})
    able = [k for k in KINDS if 0 < positive.get(k, 0.0) < n]
    if not able:
        return [None] * len(KINDS)
    chosen = {k: telling(counts.filter("w IS NOT NULL"), k, n, positive[k]) for k in able}

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).to_pylist()
            for s, e in chunked(text):
                x = features(text[s:e])
                at = np.searchsorted(x.doc, np.arange(e - s + 1))
                own = [pa.array([np.intersect1d(x.word[i:j], chosen[k], assume_unique=True).tobytes() if k in chosen else b"" for i, j in zip(at, at[1:])], pa.binary()) for k in KINDS]
                y = [batch.column(k).slice(s, e - s) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, x.shape.T.copy()), *own, *y], names=[*shapes, *KINDS, *[f"y_{k}" for k in KINDS]])

    shapes = [f"s{i}" for i in range(N_SHAPE)]
    fields = [*[f"{c} double" for c in shapes], *[f"{k} binary" for k in KINDS], *[f"y_{k} double" for k in KINDS]]
    with own_batches(docs.sparkSession):
        marked = stage(seen.mapInArrow(lean(marks), ", ".join(fields)), "marked")
    told = marked.agg(*[F.avg(c).alias(f"m_{c}") for c in shapes], *[F.stddev_pop(c).alias(f"d_{c}") for c in shapes]).first()
    centre, scale = (np.array([told[f"{m}_{c}"] for c in shapes]) for m in "md")
    scale = scale + 1e-6
    rules = {k: Sums(chosen[k], centre, scale, positive[k] / n) for k in able}
    few = marked.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)  # a task's sums have one size, whatever it reads
    block = 1 << 14

    def added(points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(1 + w.size + w.size**2) for k, w in points.items()}
            for batch in batches:
                for s in range(0, batch.num_rows, 1000):
                    b = batch.slice(s, 1000)
                    shape = np.column_stack([b.column(i).to_numpy() for i in range(N_SHAPE)])
                    for k, w in points.items():
                        i = N_SHAPE + KINDS.index(k)
                        total[k] += rules[k].of(shape, [np.frombuffer(v, np.uint64) for v in b.column(i).to_pylist()], b.column(i + len(KINDS)).to_numpy(), w)
            for k, row in total.items():
                for i in range(0, len(row), block):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int64()), pa.array([row[i : i + block].tobytes()], pa.binary())], names=["k", "i", "m"])

        def joined(t: pa.Table) -> pa.Table:
            m = np.sum([np.frombuffer(v, float) for v in sorted(t.column("m").to_pylist())], axis=0)
            return pa.table({"k": t.column("k")[:1], "i": t.column("i")[:1], "m": pa.array([m.tobytes()], pa.binary())})

        parts = few.mapInArrow(lean(part), "k string, i long, m binary").groupBy("k", "i").applyInArrow(joined, "k string, i long, m binary").collect()
        return {k: np.concatenate([np.frombuffer(r["m"], float) for r in sorted(parts, key=lambda r: r["i"]) if r["k"] == k]) for k in points}

    found = descended(added, n, {k: r.size for k, r in rules.items()})
    return [Linear(chosen[k], found[k][: len(chosen[k])], found[k][len(chosen[k]) : -1], float(found[k][-1]), centre, scale) if k in able else None for k in KINDS]


@dataclass(frozen=True)
class Spread:
    """Sums over all documents and the variances of a score: within paths, between the paths of a
    host, between hosts."""

    n: float
    total: float
    within: float
    paths: float
    hosts: float


def spreads(sites: DataFrame, score: str) -> Spread:
    """Variances by moments. ``sites`` has a row a path: _h, _n, and of the score sum and sum of
    squares, ``<score>_1`` and ``<score>_2``. What a sum of squares between groups owes to the noise
    within them is subtracted, so sparse groups widen no prior."""
    s1, s2, n = F.col(f"{score}_1"), F.col(f"{score}_2"), F.col("_n").cast("double")
    of_host = (F.sum(n).alias("size"), F.sum(n * n).alias("squares"), F.sum(s1).alias("score"), F.sum(s1 * s1 / n).alias("between"), F.sum(s2 - s1 * s1 / n).alias("inside"), F.count("*").alias("k"))
    hosts = sites.groupBy("_h").agg(*of_host).withColumns({"own": F.col("score") * F.col("score") / F.col("size"), "share": F.col("squares") / F.col("size")})
    sums = hosts.agg(
        F.sum("size").alias("n"), F.sum("score").alias("total"), F.sum("inside").alias("inside"), F.sum("k").alias("k"), F.count("*").alias("h"),
        F.sum(F.col("between") - F.col("own")).alias("paths"), F.sum(F.col("size") - F.col("share")).alias("paths_n"), F.sum("own").alias("hosts"),
        F.sum(F.col("size") * F.col("size")).alias("hosts_nn"), F.sum("share").alias("share"), F.sum("squares").alias("squares"),
    ).first()
    if not sums["n"]:
        return Spread(0.0, 0.0, 0.0, 0.0, 0.0)
    n_, inside, k, h = sums["n"], max(sums["inside"], 0.0), sums["k"], sums["h"]
    within = inside / (n_ - k) if n_ > k else 0.0
    paths = max(0.0, (sums["paths"] - (k - h) * within) / sums["paths_n"]) if sums["paths_n"] > 0 else 0.0
    # A host's mean has the noise within / N + paths * nn / N**2 about its own value.
    noise = within * (h - 1) + paths * (sums["share"] - sums["squares"] / n_)
    room = n_ - sums["hosts_nn"] / n_
    hosts_ = max(0.0, (sums["hosts"] - sums["total"] ** 2 / n_ - noise) / room) if room > 0 else 0.0
    return Spread(n_, sums["total"], within, paths, hosts_)


def posteriors(x: Column, s: Spread, score: str) -> tuple[Column, Column, Column]:
    """(centre, host's posterior mean, path's posterior mean), all without the document itself, whose
    score is x. Columns _n, <score>_1 (path sums) and _host_n, _host_nn, <score>_host (host sums) are there."""
    one, n, host_n = F.lit(1.0), F.col("_n").cast("double") - 1, F.col("_host_n").cast("double") - 1
    safe = lambda a, b, other: F.when(b > 0, a / b).otherwise(other)
    centre = F.lit(s.total) - x if s.n > 1 else F.lit(s.total)
    centre = centre / F.lit(max(s.n - 1, 1.0))
    squares = F.col("_host_nn") - 2 * F.col("_n") + one  # sum of squares of the host's path sizes, one document less
    noise = safe(F.lit(s.within), host_n, F.lit(0.0)) + F.lit(s.paths) * safe(squares, host_n * host_n, F.lit(0.0))
    weight = F.when(host_n > 0, safe(F.lit(s.hosts), s.hosts + noise, F.lit(0.0))).otherwise(0.0)
    host = centre + weight * (safe(F.col(f"{score}_host") - x, host_n, centre) - centre)
    inner = F.when(n > 0, safe(F.lit(s.paths), s.paths + safe(F.lit(s.within), n, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    path = host + inner * (safe(F.col(f"{score}_1") - x, n, host) - host)
    return centre, host, path


def combined(scored: DataFrame, host: str, path: str, able: list[bool], keep: float) -> DataFrame:
    """The posteriors of rows with the classifiers' scores _good and _toxic, in place of these; kinds
    that no classifier was fitted for keep their score."""
    moments = [f for k in KINDS for f in (F.sum(f"_{k}").alias(f"{k}_1"), F.sum(F.col(f"_{k}") * F.col(f"_{k}")).alias(f"{k}_2"))]
    paths = stage(scored.groupBy(F.col(host).alias("_h"), F.col(path).alias("_s")).agg(F.count("*").alias("_n"), *moments), "paths")
    spread = {k: spreads(paths, k) for k in KINDS}
    hosts = paths.groupBy(F.col("_h").alias("_g")).agg(F.sum("_n").alias("_host_n"), F.sum(F.col("_n") * F.col("_n").cast("double")).alias("_host_nn"), *[F.sum(f"{k}_1").alias(f"{k}_host") for k in KINDS])
    sites = paths.join(hosts, F.col("_h").eqNullSafe(F.col("_g"))).drop("_g")
    small = F.broadcast(sites) if paths.count() <= BROADCAST_SITES else sites
    out = scored.join(small, scored[host].eqNullSafe(F.col("_h")) & scored[path].eqNullSafe(F.col("_s")))
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    found = {k: posteriors(F.col(f"_{k}"), spread[k], k) for k in KINDS}
    posterior = {k: 1 / (1 + F.exp(-(logit(F.col(f"_{k}")) + logit(found[k][2]) - logit(found[k][0])))) if ok else F.col(f"_{k}") for k, ok in zip(KINDS, able)}
    out = out.withColumns({"p_doc": F.col("_good"), "p_host": found["good"][1], "p_path": found["good"][2], "p_good": posterior["good"], "p_toxic": posterior["toxic"]})
    out = out.withColumn("accepted", (F.col("p_good") >= keep) & (F.col("p_toxic") < 0.5))
    return out.drop("_good", "_toxic", *paths.columns, *hosts.columns)


def _scored(docs: DataFrame, labels: DataFrame, host: str, path: str, most: int | None, keep: float, seed: int) -> DataFrame:
    """docs has the needed columns and ``rest`` only."""
    models = fitted(docs, labels, most, seed)
    neutral = (0.5, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = features(text)
            p = [1 / (1 + np.exp(-np.clip(m.margin(x), -30, 30))) if m else np.full(len(text), e) for m, e in zip(models, neutral)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, p)], names=[*batch.schema.names, "_good", "_toxic"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    with own_batches(docs.sparkSession):
        scored = stage(docs.mapInArrow(lean(run), fields + ", _good double, _toxic double"), "scored")
    return combined(scored, host, path, [m is not None for m in models], keep)


ADDED = ["p_doc", "p_host", "p_path", "p_good", "p_toxic", "accepted"]


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int | None = None, keep: float = 0.5, seed: int = 11) -> DataFrame:
    """docs (all rows; columns of the added names are replaced) with p_doc (the classifier's own), p_host
    and p_path (posterior means of the site's other documents), p_good (all of it), p_toxic (likewise)
    and accepted: p_good at least ``keep`` and p_toxic below one half. Labels may repeat or lack rows;
    with no usable label every document gets one half and is accepted. Null text is empty; null hosts
    and paths form groups of their own. Two classifiers, good quality and toxic, are fitted on all labels;
    ``most``, if given, takes so many in hash order and then by doc_id and label, so that ties at the
    bound don't matter. All other sums are over all documents, and partial before the shuffle, so hosts of any size
    will do. Columns of tables with addresses: ``sites``."""
    packed, columns = narrowed(docs, "doc_id", "text", host, path)
    out = _scored(packed, labels, host, path, most, keep, seed)
    return out.select(*[x for c, x in zip(docs.columns, columns) if c not in ADDED], *ADDED)


def accept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int | None = None, keep: float = 0.5, seed: int = 11) -> DataFrame:
    """The rows of docs that ``score`` accepts, as they are."""
    packed, columns = narrowed(docs, "doc_id", "text", host, path)
    return _scored(packed, labels, host, path, most, keep, seed).filter("accepted").select(*columns)


def sites(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds site_host and site_path, the host and first folder of an address, in lower case; null
    where the address has none. Columns of these names are replaced."""
    address = F.concat(F.when(F.col(url).contains("://"), "").otherwise("http://"), F.trim(F.col(url)))
    host = F.regexp_extract(F.lower(address), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    folder = F.regexp_extract(F.lower(address), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return pages.withColumns({"site_host": F.nullif(host, F.lit("")), "site_path": F.nullif(folder, F.lit(""))})
