"""Exact quantiles and ranks by selection and ranged counts, and the p-values of rank tests."""

import itertools
import math
import random

import numpy as np
import pytest

from mensura.operators import audit, ranking, robust, stats


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(0)
    rows = []
    for g, n in (("a", 900), ("b", 500), (None, 400), ("c", 5)):
        for _ in range(n):
            x = rng.gauss(0, 1) if g == "b" else rng.choice([1.0, 1.0, 1.0, 2.0, rng.random(), rng.gauss(0, 1e9), math.nan, None, math.inf])
            rows.append((g, x, float(rng.randrange(20))))
    rows.append(("d", None, None))
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5).cache()
    return df, rows


def finite(values):
    return [v for v in values if v is not None and math.isfinite(v)]


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_by_selection_equal_plain_ones(table, by):
    df, rows = table
    wanted = {"q0": ("x", 0.5), "q1": ("x", 0.92), "q2": ("y", 0.1), "q3": ("x", 0.0), "q4": ("y", 1.0)}
    got = {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in ranking.quantiles(df, wanted, by, limit=40).collect()}
    assert set(got) == ({("a",), ("b",), (None,), ("c",), ("d",)} if by else {()})
    for key, values in got.items():
        own = [r for r in rows if not by or r[0] == key[0]]
        for (x, p), v in zip(wanted.values(), values):
            plain = finite(r[1 if x == "x" else 2] for r in own)
            assert v == (pytest.approx(float(np.quantile(plain, p)), rel=1e-12) if plain else None)
    assert got == {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in ranking.quantiles(df, wanted, by).collect()}


def test_quantiles_of_an_empty_table(table):
    df, _ = table
    assert [tuple(r) for r in ranking.quantiles(df.limit(0), {"q": ("x", 0.5)}).collect()] == [(None,)]
    assert ranking.quantiles(df.limit(0), {"q": ("x", 0.5)}, ["g"]).count() == 0


def test_selection_ends_on_one_repeated_value(spark):
    df = spark.createDataFrame([(7.0,)] * 300 + [(8.0,)], "x double")
    assert ranking.quantiles(df, {"low": ("x", 0.0), "mid": ("x", 0.5), "high": ("x", 1.0)}, limit=3).first() == (7.0, 7.0, 8.0)


def test_robust_scores_by_selection(table, monkeypatch):
    df, _ = table
    plain = [sorted(map(repr, f().collect())) for f in (lambda: robust.tertiles(df, "y", "t"), lambda: robust.with_mad(df, "x", ["g"]), lambda: audit.nuisance(df.select("g", "y"), "y"))]
    monkeypatch.setattr(ranking, "LIMIT", 60)
    assert plain == [sorted(map(repr, f().collect())) for f in (lambda: robust.tertiles(df, "y", "t"), lambda: robust.with_mad(df, "x", ["g"]), lambda: audit.nuisance(df.select("g", "y"), "y"))]


@pytest.mark.parametrize("by", [["g"], []])
def test_ranks_with_ties_equal_plain_ones(table, by):
    df, rows = table
    got = ranking.average_rank(df, "y", by, "r").collect()
    assert len(got) == len(rows)
    for key in {r[0] if by else 0 for r in rows}:
        own = [r[2] for r in rows if not by or r[0] == key]
        order = sorted(own, key=lambda v: (v is not None, v or 0))
        rank = {v: np.mean([i + 1 for i, w in enumerate(order) if w == v]) for v in set(own)}
        assert all(r["r"] == pytest.approx(rank[r["y"]]) for r in got if not by or r["g"] == key)


def test_rank_sum_p_is_that_of_all_orders():
    for n1, n0 in ((2, 3), (3, 4), (1, 6), (4, 4)):
        sums = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n0), n1)]
        for u in range(n1 * n0 + 1):
            high = max(u, n1 * n0 - u)
            assert stats.rank_sum_p(u, n1, n0, 0) == pytest.approx(min(1, 2 * sum(s >= high for s in sums) / len(sums)))
    assert math.isnan(stats.rank_sum_p(0, 0, 4, 0)) and stats.rank_sum_p(8, 4, 4, 8**3 - 8) == 1.0


def test_student_and_chi_square_tails_equal_integrals():
    for n, rho in ((3, 0.5), (5, -0.9), (12, 0.3), (400, 0.08), (100_000, 0.01)):
        v, t = n - 2, abs(rho) * math.sqrt((n - 2) / (1 - rho * rho))
        front = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        x = (np.arange(200_000) + 0.5) * t / 200_000
        assert stats.spearman_p(rho, n) == pytest.approx(1 - 2 * float((front * (1 + x * x / v) ** (-(v + 1) / 2)).sum() * t / 200_000), abs=1e-8)
    assert stats.spearman_p(1.0, 9) == 0 and math.isnan(stats.spearman_p(0.3, 2))
    for k, h in ((3, 0.4), (3, 20.0), (8, 5.0)):
        x = h + (np.arange(400_000) + 0.5) / 2000
        assert stats.chi2_tail(h, k) == pytest.approx(float((x ** (k / 2 - 1) * np.exp(-x / 2)).sum() / 2000 / (2 ** (k / 2) * math.gamma(k / 2))), abs=1e-7)


def test_association_leaves_out_what_is_missing(spark):
    rows = [(1.0, 1, "a", 2.0), (2.0, 0, "a", 1.0), (3.0, 1, "b", 4.0), (4.0, 0, "b", 3.0), (5.0, None, "b", None), (None, 1, "a", 1.0), (6.0, 1, None, 9.0)]
    got = {r["test"]: (r["statistic"], r["p_value"]) for r in stats.association(spark.createDataFrame(rows, "x double, b int, g string, o double"), "x", "b", "g", "o").collect()}
    assert got["mann_whitney_u"] == (3.0, pytest.approx(1.0))  # 1, 3 and 6 against 2 and 4
    assert got["spearman"][0] == pytest.approx(1 - 6 * (1 + 1 + 1 + 1) / (5 * 24))
    assert got["kruskal_wallis"][0] == pytest.approx(12 / 30 * (9 / 2 + 144 / 3) - 18)


def test_machine_gates_fail_on_what_is_missing(spark):
    metrics = list(dict.fromkeys(m for m, *_ in audit.STRUCTURE_GATES.values()))
    df = spark.createDataFrame([(1.0, 0.9, 0.01, 1.0, 0.0, 0.8, 0.7), (1.0, 0.7, math.nan, 0.0, 0.0, 0.6, 0.9), (1.0, 0.5, 0.04, 9.0, 0.0, 0.5, 0.6)], ", ".join(f"{m} double" for m in metrics))
    one = audit.machine_gate(df, audit.STRUCTURE_GATES).first()
    assert (one["f1"], one["error"], one["status"], one["failed"]) == (0.7, pytest.approx(0.025), "pass", "")
    none = audit.machine_gate(df.limit(0), audit.STRUCTURE_GATES).first()
    assert none["status"] == "stop_or_revise" and none["failed"].count(";") == len(audit.STRUCTURE_GATES) - 1
