"""Spelling variants against a comparison of all pairs."""

import random
import re

import pytest

from mensura.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=10):
    out = {}
    for w, n in counts.items():
        close = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        form = close[0] if close and counts[close[0]] >= times * n else None
        out[w] = (n, len(close), form, counts[form] if form else None)
    roots = {}
    for w in counts:
        r = w
        while out[r][2]:
            r = out[r][2]
        roots[w] = r
    return {w: (*v, roots[w]) for w, v in out.items()}


def vocabulary(seed, letters="abé", n=260, sizes=range(7, 12)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:  # and words next to them
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return {w: rng.choice([2, 3, 20, 30, 200, 2000]) for w in sorted(words) if len(w) >= min(sizes)}


@pytest.mark.parametrize("shard, hot", [(20_000, 40_000), (40, 3)])
def test_near_words_equal_all_pairs(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "HOT", hot)
    counts = vocabulary(1) | {"x" * 3000: 5, "x" * 3001: 7, "x" * 1500 + "y" + "x" * 1499: 9}
    got = {r["word"]: (r["n"], r["n_near"], r["best"], r["best_n"]) for r in spelling.near(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    for w, n in counts.items():
        close = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        assert got.pop(w) == (n, len(close), close[0] if close else None, counts[close[0]] if close else None)
    assert not got


def test_short_words_have_halves_too(spark):
    counts = vocabulary(4, "ab", 60, range(2, 6))
    got = {r["word"]: r["n_near"] for r in spelling.near(spark.createDataFrame(list(counts.items()), "word string, n long"), least=2).collect()}
    assert got == {w: sum(near(w, v) for v in counts) for w in counts}


def test_groups_of_texts_equal_plain_ones(spark):
    counts = {"kitchen": 2000, "kitchén": 200, "kitchens": 20, "kitchenss": 2, "kitchxn": 200, "garden": 50, "Straßen"[:7].lower(): 3, "gardens": 30, "gardenz": 3, "gardena": 3, "zzzzzzz": 1}
    rng = random.Random(2)
    every = [w if rng.random() < 0.5 else w[0].upper() + w[1:] for w, n in counts.items() for _ in range(n)]
    rng.shuffle(every)
    docs = [(i, " ".join(every[i::40]) + rng.choice([".", " 12-", "\n"]), "k", "x") for i in range(40)]
    docs += [(None, "zzzzzzz", "k", "x"), (7, None, "k", "x"), (7, "", "k", "x"), (8, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àààààààà", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n string")
    plainly = {}
    for _, t, *_ in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            plainly[w] = plainly.get(w, 0) + 1
    plainly = {w: n for w, n in plainly.items() if len(w) >= 7 and n >= 2}
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.groups(df).collect()}
    assert got == plain(plainly) and got["kitchenss"][4] == "kitchen" and "ÀÀÀÀÀÀÀ" in got
    assert spelling.groups(df.limit(0)).count() == 0
    changed = {r["word"] for r in spelling.groups(df, change=lambda d, w: b"again" + w).collect()}
    assert "againgardens" in changed and "gardens" not in changed
