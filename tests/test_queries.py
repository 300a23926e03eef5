"""Every query against its DuckDB twin on the smallest tables; the others return rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from mensura.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0 and df.schema == entry.queries()[name](spark, SF).schema


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_association_tests_equal_plain_ones(spark, duck):
    rows = duck.sql("SELECT n_chars, quality, lang FROM documents JOIN labels USING (doc_id)").fetchall()
    got = {r["test"]: r for r in entry.queries()["association_tests"](spark, SF).collect()}
    values = sorted(x for x, *_ in rows)
    rank = {x: (values.index(x) + 1 + values.index(x) + values.count(x)) / 2 for x in set(values)}
    n, ties = len(rows), sum(values.count(x) ** 3 - values.count(x) for x in set(values))
    good = [rank[x] for x, q, _ in rows if q == 1]
    n1, n0 = len(good), n - len(good)
    u = sum(good) - n1 * (n1 + 1) / 2
    z = max(0.0, abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got["mann_whitney_u"]["statistic"] == pytest.approx(u, abs=1e-6) and got["mann_whitney_u"]["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-5)
    groups = {}
    for x, _, g in rows:
        groups.setdefault(g, []).append(rank[x])
    h = (12 / (n * (n + 1)) * sum(sum(v) ** 2 / len(v) for v in groups.values()) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    k, step = len(groups) - 1, 1e-3  # the tail by adding up the density
    density = lambda x: x ** (k / 2 - 1) * math.exp(-x / 2) / (2 ** (k / 2) * math.gamma(k / 2))
    tail = sum(density(h + (i + 0.5) * step) * step for i in range(int(60 / step)))
    assert got["kruskal_wallis"]["statistic"] == pytest.approx(h, abs=1e-6) and got["kruskal_wallis"]["p_value"] == pytest.approx(tail, rel=1e-3, abs=1e-5)


def test_exact_count_split_keeps_copies_together(spark, duck):
    got = {r["doc_id"]: r["part"] for r in entry.queries()["exact_count_split"](spark, SF).collect()}
    texts = duck.sql("SELECT text, list(doc_id) FROM documents GROUP BY text").fetchall()
    n = sum(len(ids) for _, ids in texts)
    assert len(got) == n and all(len({got[i] for i in ids}) == 1 for _, ids in texts)
    assert sorted(list(got.values()).count(p) for p in ("test", "val", "train")) == [n // 10, n // 10, n - 2 * (n // 10)]


def test_hungarian_query_is_optimal(spark, duck):
    """By duality: prices that no pair undercuts and that the chosen pairs meet prove the least sum."""
    import numpy as np

    from mensura.operators import match
    from mensura.plans.geometry import _POINTS

    read = lambda i, j: duck.sql(f"SELECT item, x, y FROM ({_POINTS.format(i=i, j=j)}) ORDER BY item, x, y").fetchall()
    a, b = read(1, 2), read(3, 4)
    got = {r["item"]: r for r in entry.queries()["match_f1_hungarian"](spark, SF).collect()}
    for item in {r[0] for r in a}:
        p, q = (np.array([r[1:] for r in t if r[0] == item]) for t in (a, b))
        d = np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1))
        rows, cols = match.hungarian(d)
        price = np.zeros(len(q))  # of columns, by Bellman and Ford over the swaps of the chosen pairs
        own = d[rows, cols]
        for _ in range(len(q) + 1):
            price[cols] = np.minimum(price[cols], (price[cols][:, None] + d[rows][:, cols] - own[:, None]).min(axis=0))
        assert (d[rows][:, cols] - own[:, None] + price[cols][:, None] >= price[cols][None, :] - 1e-9).all()
        near = own[own <= 10]
        assert got[item]["matches"] == len(near) and (not len(near) or got[item]["error"] == pytest.approx(float(np.median(near)), abs=1e-6))


def test_skeletons_lie_in_their_masks(spark, duck):
    from mensura.operators import raster
    from mensura.plans import geometry

    mask = {(r["item"], r["x"], r["y"]) for r in raster.dilate_pixels(geometry._mask(spark, SF), 3).collect()}
    skel = {(r["item"], r["x"], r["y"]) for r in entry.queries()["mask_skeleton"](spark, SF).collect()}
    assert skel < mask

    def parts(cells):
        left, count = set(cells), {}
        while left:
            item, *_ = first = left.pop()
            stack = [first]
            while stack:
                i, x, y = stack.pop()
                near = {(i, x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & left
                left -= near
                stack += near
            count[item] = count.get(item, 0) + 1
        return count

    assert parts(skel) == parts(mask)
