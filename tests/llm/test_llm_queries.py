"""The registered queries on the smallest tables, and the pipeline's stages against plain versions."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from test_llm_operators import VOCABULARY, base_spans, jaccard_plain, words

import __spark_entry__ as entry
import corpus_pipeline
from mensura.llm import quality, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_pii_query(spark, documents):
    import hashlib

    got = {r["doc_id"]: r for r in entry.queries()["op2_pii_spans"](spark, SF).collect()}
    for d, t, _ in documents:
        b = base_spans(t)
        assert got[d]["base_sha256"] == hashlib.sha256(b.encode()).hexdigest()
        assert sum(got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")) == len(b.split(",")) * bool(b)


def encoded(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return {d: e.ids + [1] for (d, *_), e in zip(documents, t.encode_batch([x[1] or "" for x in documents], add_special_tokens=False))}


def test_token_queries(spark, documents):
    ids = encoded(documents)
    want, at = [], 0
    for d in sorted(ids):
        want.append((d, at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        at += len(ids[d])
    assert sorted(map(tuple, entry.queries()["op4_token_files"](spark, SF).collect())) == want
    packed_as_planned(entry.queries()["op10_best_fit_packing"](spark, SF).collect(), ids)


def packed_as_planned(rows, ids):
    want = sorted((d, k, k * 4096, len(x[k * 4096 : (k + 1) * 4096]), zlib.crc32(np.array(x[k * 4096 : (k + 1) * 4096], "<u4").tobytes())) for d, x in ids.items() for k in range(-(-len(x) // 4096)))
    assert sorted(tuple(r)[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)]).tolist()]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 4096


def test_join_query(spark, documents):
    got = sorted(map(tuple, entry.queries()["op5_jaccard_join"](spark, SF).collect()), key=str)
    assert got == jaccard_plain([(d, t) for d, t, _ in documents])[0]


def test_classifier_query(spark, duck):
    got = {r["doc_id"] for r in entry.queries()["op9_bayes_quality"](spark, SF).select("doc_id").collect()}
    assert got == {d for (d,) in duck.sql("SELECT doc_id FROM documents").fetchall()}


def test_classifier_on_labels_it_has_not_seen(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    got = quality.score(docs, labels.filter("doc_id % 4 <> 0")).join(labels, "doc_id").filter("doc_id % 4 = 0")
    rows = [(r["accepted"], bool(r["quality"]), bool(r["toxic"])) for r in got.collect()]
    assert len(rows) > 800 and np.mean([a == (q and not t) for a, q, t in rows]) >= 0.98
    assert np.mean([not a for a, q, t in rows if t]) >= 0.95 and np.mean([a for a, q, t in rows if q and not t]) >= 0.98


def held(duck, documents):
    items = [(i, words(t)) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()]
    return {(d, i) for d, t, *_ in documents for i, w in items if f" {' '.join(w)} " in f" {' '.join(words(t))} "}


def test_decontamination_query(spark, duck, documents):
    got = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op6_latent_decontamination"](spark, SF).collect()}
    assert got == held(duck, documents)


def test_decontamination_equals_subsequences(spark):
    """Every document and item of a larger table: what the candidate search finds is what a longest
    common subsequence of each passage with each item gives."""
    sf = SF.replace("0.001", "0.01")
    from mensura.llm import decontam

    docs, items = (duckdb.sql(f"SELECT {k}, text FROM '{sf}/{t}.parquet'").fetchall() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want, split = set(), [(i, words(t)) for i, t in items]
    for d, t in docs:
        own = words(t)
        for i, w in split:
            tail, n = w[-max(3, len(w) // 4) :], len(w)
            if len(set(w) & set(own)) < 0.3 * len(set(w)):
                continue
            for at in range(0, len(own), 32):
                region = own[max(0, at - n) : min(len(own), at + 64) + n]
                if decontam.common(decontam.places(w), n, region) / n >= 0.7 and decontam.common(decontam.places(tail), len(tail), region) / len(tail) >= 0.5:
                    want.add((d, i))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op6_latent_decontamination"](spark, sf).collect()}
    assert got == want and len(want) > 20


def test_pipeline_stages(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    read = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)

    def through(name, df):
        out = stages[name](spark, df, SF)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows

    first, rows = through("quality classifier", docs)
    accepted = {r["doc_id"] for r in entry.queries()["op9_bayes_quality"](spark, SF).collect() if r["accepted"]}
    assert {r["doc_id"] for r in rows} == accepted

    second, _ = through("line dedup", first)
    total, count = {}, {}
    for _, t, s in read(first):
        total[s] = total.get(s, 0) + 1
        for x in {x.strip(" ") for x in t.split("\n")} - {""}:
            count[s, x] = count.get((s, x), 0) + 1
    often = {k for k, n in count.items() if n >= 3 and n > 0.02 * total[k[0]]}
    want = [(d, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in often), s) for d, t, s in read(first)]
    before = {d: t for d, t, _ in read(first)}
    assert read(second) == sorted((w for w in want if w[1].strip() or w[1] == before[w[0]]), key=str)

    third, rows = through("n-gram Jaccard join", second)
    assert {r["doc_id"] for r in rows} == {g[1] for g in jaccard_plain([(d, t) for d, t, _ in read(second)])[0]}

    fourth, rows = through("benchmark decontamination", third)
    hit = {d for d, _ in held(duck, read(third))}
    assert {r["doc_id"] for r in rows} == {d for d, *_ in read(third)} - hit

    _, rows = through("best-fit packing", fourth)
    packed_as_planned(rows, encoded(read(fourth)))


def test_pipeline_takes_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, accepted string, _h int, rest string, n_lines string"
    rows = [(1, "a b c d e f g", "en", "s", 13, "x", 1, "r"), (1, "a b c d e f g", "en", "s", 13, "x", 1, "r"), (2, None, None, None, None, None, None, None), (None, "only text without an id", None, "s", 1, None, 2, None), (None, None, None, None, None, None, None, None), (5, "", "en", "s", 0, "y", 3, "q"), (6, "w " * 60_000, "de", "t", 1, "z", 4, "q")]
    rows = [(*r, "mine") for r in rows]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == 4  # copies, and the wordless, are one document each
    assert {r["n_lines"] for r in docs.collect()} == {"mine"}
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] > 0
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    lines = lambda i: "\n".join(" ".join(f"w{i}x{k}y{j}" for j in range(9)) for k in range(5))
    rows = [(i, lines(0 if i % 3 == 0 else i) + ("" if i % 3 == 0 else "\nmenu of the site"), "en", "s", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    second = stages["line dedup"](spark, docs, str(tmp_path))
    kept = stages["n-gram Jaccard join"](spark, spark.createDataFrame(second.collect(), second.schema), str(tmp_path)).collect()
    assert sorted(r["text"] for r in kept) == sorted([lines(0), *(lines(i) for i in range(90) if i % 3)])
