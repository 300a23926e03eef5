"""Periodic runs against a plain search of all lags."""

import random

import numpy as np
import pytest

from mensura.llm import periodic


def plain_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(p < q and a <= i and i + n <= a + m for a, m, p in out):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    w, k, most = [], rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 10, 30, 100, 400])
    while len(w) < most:
        if rng.random() < 0.4:
            w += ([rng.randrange(k) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 12))[: rng.randrange(1, 200)]
        else:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
    return w


def found(lists, **kw):
    starts = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
    return periodic.find(np.array([x for w in lists for x in w], np.int64), starts, **kw)


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (1, 2)])
def test_runs_equal_plain_search(least, times):
    rng = random.Random(least)
    lists = [made(rng) for _ in range(300)]
    plain = [plain_runs(w, least, times) for w in lists]
    assert sum(map(len, plain)) > 100
    assert found(lists, least=least, times=times) == plain


def test_lag_counts_equal_plain_counts():
    rng = random.Random(5)
    lists = [made(rng) for _ in range(60)] + [[rng.choice([0, 0, 0, 1, 2, 7]) for _ in range(900)], [rng.randrange(40) for _ in range(700)]]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
    counts, first = periodic.lag_counts(np.array([x for w in lists for x in w], np.int64), starts)
    for k, w in enumerate(lists):
        for q in range(1, len(w) // 3 + 1):
            assert counts[first[k] + q] == sum(w[i] == w[i + q] for i in range(len(w) - q))


def test_long_repeats_and_noise_in_bounded_time():
    noise = np.random.default_rng(0).integers(0, 2, 60_000)
    assert periodic.find(np.zeros(200_000, np.int64), np.array([0, 200_000])) == [[(0, 200_000, 1)]]
    assert periodic.find(np.tile(np.arange(7), 30_000), np.array([0, 210_000])) == [[(0, 210_000, 7)]]
    assert all(n >= max(24, 3 * q) for _, n, q in periodic.find(noise, np.array([0, len(noise)]))[0])


def test_collapse_keeps_columns_and_handles_odd_rows(spark):
    once, loop = "a b c", " ".join(["x y z"] * 9)
    rows = [(1, None, "k", 5), (2, "", "k", None), (3, f"{once}\t{loop}\n end", None, 7), (3, f"{once}\t{loop}\n end", None, 7), (None, " \x0b one  two\xa0three ", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string, runs long")
    out = periodic.collapse(docs)
    assert out.columns == ["doc_id", "text", "rest", "n_words", "runs"]
    got = sorted(((r["doc_id"], r["text"], r["rest"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in out.collect()), key=repr)
    same = (3, "a b c x y z end", None, 31, [(3, 27, 3)])
    assert got == sorted([(1, "", "k", 0, []), (2, "", "k", 0, []), same, same, (None, "one two\xa0three", "k", 2, [])], key=repr)
    assert periodic.collapse(docs.limit(0)).count() == 0
