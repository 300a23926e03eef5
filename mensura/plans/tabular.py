"""Audit, duplicate, split, join, aggregate and ranking queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.functions import scalar as S
from mensura.operators import audit, dedup, robust, split
from mensura.operators.ranking import average_rank
from mensura.session import table
from mensura.staging import numbered, stage

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- audit -----------------------------------------------------------------------------------------

_PENALTIES = {"tiny": ("n_chars < 200", 35.0), "small": ("n_chars >= 200 AND n_chars < 600", 15.0), "huge": ("n_chars > 8000", 20.0), "one_line": ("n_lines = 1", 10.0), "marked": ("has_marks", 25.0)}
_STATS = "SELECT doc_id, lang, source, n_chars, len(string_split(text, chr(10))) AS n_lines, contains(text, '***') OR contains(text, '&&&') AS has_marks FROM documents"


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", "source", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"), (F.col("text").contains("***") | F.col("text").contains("&&&")).alias("has_marks"))


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    score, flags = audit.penalties({k: (F.expr(cond), w) for k, (cond, w) in _PENALTIES.items()})
    return _stats(spark, sf).withColumns({"score": score, "flags": flags})


_FLAG_SQL = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{k}' END" for k, (cond, _) in _PENALTIES.items()) + "], lambda x: x IS NOT NULL)"
_SCORE_SQL = "greatest(100.0 - (" + " + ".join(f"CASE WHEN {cond} THEN {w} ELSE 0.0 END" for cond, w in _PENALTIES.values()) + "), 0.0)::DOUBLE"
_AUDITED = f"SELECT *, {_SCORE_SQL} AS score, {_FLAG_SQL} AS flags FROM ({_STATS})"


@query(f"SELECT doc_id, score, array_to_string(flags, ';') AS flags FROM ({_AUDITED})")
def audit_flags(spark, sf):
    return _audited(spark, sf).select("doc_id", "score", F.concat_ws(";", "flags").alias("flags"))


@query(f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM ({_AUDITED})) GROUP BY flag")
def flag_histogram(spark, sf):
    return audit.flag_counts(_audited(spark, sf), "flags")


@query("""SELECT doc_id, CASE WHEN n_chars / 1000.0 > 8 THEN 'complex' WHEN n_chars < 400 THEN 'dark' WHEN n_chars > 3000 THEN 'light' ELSE 'mid' END AS background,
  CASE WHEN n_chars / greatest(length(source) * 300, 1) >= 1.15 THEN 'landscape' WHEN n_chars / greatest(length(source) * 300, 1) <= 1 / 1.15 THEN 'portrait' ELSE 'square' END AS orientation FROM documents""")
def background_cascade(spark, sf):
    d = table(spark, sf, "documents")
    rules = [(F.col("n_chars") / 1000.0 > 8, "complex"), (F.col("n_chars") < 400, "dark"), (F.col("n_chars") > 3000, "light")]
    return d.select("doc_id", audit.cascade(rules, "mid").alias("background"), audit.orientation("n_chars", F.length("source") * 300).alias("orientation"))


@query("""SELECT doc_id, CASE WHEN n_chars <= (SELECT quantile_cont(n_chars, 1/3.0) FROM documents) THEN 'low'
  WHEN n_chars <= (SELECT quantile_cont(n_chars, 2/3.0) FROM documents) THEN 'medium' ELSE 'high' END AS complexity FROM documents""")
def complexity_tertiles(spark, sf):
    return robust.tertiles(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "complexity").select("doc_id", "complexity")


@query("""WITH m AS (SELECT median(n_chars) AS med, quantile_cont(n_chars, 0.08) AS lo, quantile_cont(n_chars, 0.92) AS hi FROM documents),
s AS (SELECT 1.4826 * median(abs(n_chars - med)) AS mad FROM documents, m),
z AS (SELECT doc_id, n_chars, lo, hi, (n_chars - med) / greatest(mad, 1e-9) AS z FROM documents, m, s)
SELECT doc_id, round(z, 6) AS robust_z, round(least(greatest(abs(z) / 3.5, 0.0), 1.0), 6) AS nuisance,
 array_to_string(list_filter([CASE WHEN n_chars < lo THEN 'low_tail' END, CASE WHEN n_chars > hi THEN 'high_tail' END, CASE WHEN abs(z) > 3.5 THEN 'outlier' END], lambda x: x IS NOT NULL), ';') AS flags FROM z""")
def nuisance_score(spark, sf):
    d = audit.nuisance(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")
    return d.select("doc_id", F.round("robust_z", 6).alias("robust_z"), F.round("nuisance", 6).alias("nuisance"), F.concat_ws(";", "flags").alias("flags"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(source), '1$') THEN 'odd' ELSE 'other' END AS family, regexp_replace(lower(source || '_aug' || (doc_id % 4)::VARCHAR), '_aug[0-9]+$', '') AS identity,
  array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), ';') AS reasons FROM documents""")
def names_and_reasons(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.when(F.lower("source").endswith("1"), "odd").otherwise("other").alias("family"),
        S.identity(F.concat("source", F.lit("_aug"), (F.col("doc_id") % 4).cast("string"))).alias("identity"),
        F.concat_ws(";", S.flagged({"short": F.col("n_chars") < 200, "foreign": F.col("lang") != "en"})).alias("reasons"),
    )


# --- duplicates --------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT sha256(text) AS h, min(doc_id) AS first, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) > 1),
l AS (SELECT *, printf('exact_%03d', row_number() OVER (ORDER BY first)) AS label FROM g)
SELECT doc_id, label, size FROM documents JOIN l ON sha256(text) = h""")
def exact_dup_groups(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return audit.exact_groups(d, "h", "doc_id").select("doc_id", "label", "size")


def _simhash_sql() -> str:
    h = lambda k: f"(('0x' || substr(md5(w), {1 + 8 * k}, 8))::BIGINT)"
    bit = lambda k, b: f"CASE WHEN coalesce(sum((({h(k)} >> {b}) & 1) * 2 - 1), 0) > 0 THEN {1 << b}::BIGINT ELSE 0 END"
    half = lambda k: "printf('%08x', " + " + ".join(f"({bit(k, b)})" for b in range(32)) + ")"
    words = "SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM documents"
    return f"SELECT doc_id, {half(0)} || {half(1)} AS simhash FROM ({words}) GROUP BY doc_id"


def _hamming(a: str, b: str) -> str:
    return " + ".join(f"bit_count(xor(('0x' || substr({a}, {s}, 8))::BIGINT, ('0x' || substr({b}, {s}, 8))::BIGINT))" for s in (1, 9))


_SIM = _simhash_sql()
_PAIRS = lambda d: f"WITH s AS MATERIALIZED ({_SIM}) SELECT a.doc_id AS id_a, b.doc_id AS id_b, ({_hamming('a.simhash', 'b.simhash')})::INT AS distance FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE {_hamming('a.simhash', 'b.simhash')} <= {d}"


def _hashed(spark, sf) -> DataFrame:
    return dedup.token_simhash(table(spark, sf, "documents"), "doc_id", "text")


@query(_SIM)
def simhash_signatures(spark, sf):
    return _hashed(spark, sf)


# Copies of a signature are one class, named by its least member; the other members follow, a row each.
_CLASS_PAIRS = lambda d: f"WITH s AS MATERIALIZED ({_SIM}), c AS MATERIALIZED (SELECT simhash, min(doc_id) AS id, count(*) AS n FROM s GROUP BY 1) SELECT 'pair' AS kind, a.id AS id_a, b.id AS id_b, ({_hamming('a.simhash', 'b.simhash')})::INT AS distance, a.n AS copies_a, b.n AS copies_b FROM c a JOIN c b ON a.id < b.id WHERE {_hamming('a.simhash', 'b.simhash')} <= {d} UNION ALL SELECT 'copy', id, doc_id, 0, n, n FROM s JOIN c USING (simhash) WHERE doc_id > id"


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY simhash) AS class_id, count(*) OVER (PARTITION BY simhash) AS copies FROM ({_SIM})")
def near_dup_classes(spark, sf):
    return dedup.members(_hashed(spark, sf), "doc_id", "simhash")


@query(_CLASS_PAIRS(3))
def near_dup_pairs_hamming3(spark, sf):
    return dedup.class_links(_hashed(spark, sf), "doc_id", "simhash", 3)


@query(_CLASS_PAIRS(5))
def near_dup_pairs_hamming5(spark, sf):
    return dedup.class_links(_hashed(spark, sf), "doc_id", "simhash", 5)


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_PAIRS(3)}), b AS (SELECT id_a AS x, id_b AS y FROM e UNION ALL SELECT id_b, id_a FROM e),
r(node, reach) AS (SELECT DISTINCT x, x FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.reach = b.x),
m AS (SELECT node, min(reach) AS root FROM r GROUP BY node), l AS (SELECT root, count(*) AS size, printf('near_%03d', row_number() OVER (ORDER BY root)) AS label FROM m GROUP BY root)
SELECT node, root, size, label FROM m JOIN l USING (root)""")
def near_dup_components(spark, sf):
    return dedup.near_labels(dedup.near_components(_hashed(spark, sf), "doc_id", "simhash", 3)).select("node", "root", "size", "label")


_BUCKET = "(('0x' || substr(sha256('7|' || doc_id::VARCHAR), 1, 8))::BIGINT % 10000)"


@query(f"""WITH s AS MATERIALIZED ({_SIM}), r AS MATERIALIZED (SELECT doc_id, simhash, md5(text) AS h2, CASE WHEN {_BUCKET} < 1500 THEN 'val' ELSE 'train' END AS part FROM documents JOIN s USING (doc_id)), d AS MATERIALIZED (SELECT simhash, h2, part, min(doc_id) AS id, count(*) AS n FROM r GROUP BY ALL)
SELECT 'pair' AS kind, a.id AS id_a, b.id AS id_b, ({_hamming('a.simhash', 'b.simhash')})::INT AS distance, ({_hamming('a.h2', 'b.h2')})::INT AS second_distance, a.n AS copies_a, b.n AS copies_b
FROM d a JOIN d b ON a.id < b.id WHERE a.part <> b.part AND {_hamming('a.simhash', 'b.simhash')} <= 3 AND {_hamming('a.h2', 'b.h2')} <= 36
UNION ALL SELECT 'copy', id, doc_id, 0, 0, n, n FROM r JOIN d USING (simhash, h2, part) WHERE doc_id > id""")
def cross_split_near_dups(spark, sf):
    """Between classes of the same text in the same part; the members of a class follow, a row each."""
    d = split.by_bucket(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h2")), "7", "doc_id")
    rows = stage(_hashed(spark, sf).join(d, "doc_id"), "rows")
    of = stage(dedup.classes(rows, "doc_id", ["simhash", "h2", "part"]), "classes")
    same = of.select(F.col("simhash").alias("ha"), F.col("simhash").alias("hb"), F.lit(0).alias("distance")).distinct()
    pairs = dedup.hash_pairs(of, "simhash", 3).unionByName(same)
    side = lambda k: of.select(F.col("simhash").alias(f"h{k}"), *[F.col(x).alias(f"{x}_{k}") for x in ("class_id", "copies", "h2", "part")])
    both = pairs.join(side("a"), "ha").join(side("b"), "hb").withColumn("second_distance", S.hamming64("h2_a", "h2_b"))
    both = both.filter((F.col("part_a") != F.col("part_b")) & (F.col("second_distance") <= 36) & ((F.col("ha") != F.col("hb")) | (F.col("class_id_a") < F.col("class_id_b"))))
    first = F.col("class_id_a") < F.col("class_id_b")
    both = both.select(
        F.least("class_id_a", "class_id_b").alias("id_a"), F.greatest("class_id_a", "class_id_b").alias("id_b"), "distance", "second_distance",
        F.when(first, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_a"), F.when(first, F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_b"),
    )
    member = rows.join(of, ["simhash", "h2", "part"]).select(F.col("doc_id").alias("id"), "class_id", "copies")
    return dedup.with_members(both, member, ["distance", "second_distance"])


@query(f"""SELECT sha256(text) AS h, count(DISTINCT CASE WHEN {_BUCKET} < 1500 THEN 'val' ELSE 'train' END) AS splits, count(*) AS n FROM documents GROUP BY 1
HAVING count(DISTINCT CASE WHEN {_BUCKET} < 1500 THEN 'val' ELSE 'train' END) > 1""")
def leakage_violations(spark, sf):
    d = split.by_bucket(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "7", "doc_id")
    return audit.split_leaks(d, "h", "part")


# --- splits --------------------------------------------------------------------------------------------


@query("""SELECT doc_id, position, CASE WHEN position <= 20 THEN 'calibration' ELSE 'pilot' END AS part FROM (
SELECT doc_id, (row_number() OVER (ORDER BY sha256('42|' || doc_id::VARCHAR), doc_id))::INT AS position FROM documents) WHERE position <= 80""")
def hash_order_partition(spark, sf):
    return split.by_hash_order(table(spark, sf, "documents").select("doc_id"), "42", ["doc_id"], 20, 60).select("doc_id", "position", "part")


@query(f"SELECT doc_id, {_BUCKET} AS bucket, CASE WHEN {_BUCKET} < 1500 THEN 'val' ELSE 'train' END AS part FROM documents")
def hash_bucket_split(spark, sf):
    return split.by_bucket(table(spark, sf, "documents").select("doc_id"), "7", "doc_id")


@query("""WITH g AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('9|' || source), source) AS r, count(*) OVER (PARTITION BY lang) AS n FROM g),
p AS (SELECT lang, source, CASE WHEN r <= (CASE WHEN n >= 10 THEN greatest(round_even(n * 0.15, 0), 1) WHEN n >= 3 THEN 1 ELSE 0 END) THEN 'test'
 WHEN r <= (CASE WHEN n >= 10 THEN greatest(round_even(n * 0.15, 0), 1) WHEN n >= 3 THEN 1 ELSE 0 END) + (CASE WHEN n >= 10 THEN greatest(round_even(n * 0.15, 0), 1) WHEN n >= 4 THEN 1 ELSE 0 END) THEN 'val' ELSE 'train' END AS part FROM r)
SELECT doc_id, part FROM documents JOIN p USING (lang, source)""")
def stratum_group_split(spark, sf):
    return split.by_group(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "source", "9").select("doc_id", "part")


@query("""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
h AS (SELECT doc_id, 'stratum' AS source_rule FROM r WHERE r <= 5), t AS (SELECT doc_id, 'topup' AS source_rule FROM r WHERE r > 5 ORDER BY n_chars DESC, doc_id LIMIT greatest(0, 40 - (SELECT count(*) FROM h)))
SELECT * FROM h UNION ALL SELECT * FROM t""")
def stratified_head_topup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return split.head_and_topup(d, "lang", [F.desc("n_chars"), "doc_id"], 5, 40, "doc_id").select("doc_id", "source_rule")


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 80""")
def one_per_series_top80(spark, sf):
    return split.one_per_series(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 80)


@query("""SELECT c_custkey, CASE WHEN r <= 400 THEN 'top' ELSE 'holdout' END AS part, (floor((r - 1) / 24) + 1)::BIGINT AS page FROM (
SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_mktsegment, c_custkey) AS r FROM customer)""")
def rank_top_and_holdout(spark, sf):
    ranked = numbered(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), [F.desc("c_acctbal"), "c_mktsegment", "c_custkey"], "r")
    return ranked.select("c_custkey", F.when(F.col("r") <= 400, "top").otherwise("holdout").alias("part"), (F.floor((F.col("r") - 1) / 24) + 1).alias("page"))


@query()
def exact_count_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    n = d.count()
    return split.exact_counts(d, "h", "lang", {"test": n // 10, "train": n - 2 * (n // 10), "val": n // 10}, "5").select("doc_id", "part")


# --- joins and sets --------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) AND lang IN ('en', 'fr') AND n_chars >= 200")
def quality_anti_join(spark, sf):
    bad = table(spark, sf, "labels").filter(~S.truthy("quality")).select("doc_id")
    d = table(spark, sf, "documents").filter(F.col("lang").isin("en", "fr") & (F.col("n_chars") >= 200))
    return d.join(bad, "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def toxic_semi_join(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_lookup_defaults(spark, sf):
    found = table(spark, sf, "labels").withColumn("there", F.lit(True))
    d = table(spark, sf, "documents").select("doc_id").join(found, "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.col("there").isNull().alias("missing"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(c_mktsegment, '') AS segment, coalesce(n_name, '') AS nation FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def two_hop_lookup(spark, sf):
    l_ = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cu = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")  # fixed in size
    out = l_.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(cu, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("l_orderkey", "l_linenumber", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.coalesce("n_name", F.lit("")).alias("nation"))


@query("""SELECT o.o_orderkey AS order_id, o_totalprice AS total_left, round(sum(l_extendedprice), 2) AS total_right FROM orders o JOIN lineitem ON l_orderkey = o.o_orderkey GROUP BY ALL""")
def inner_join_suffixes(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total_left"))
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total_right"))
    return left.join(right, "order_id")


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS m_{t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def method_pivot(spark, sf):
    got = table(spark, sf, "events").groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.round(F.avg("value"), 6))
    return got.select("user_id", *[F.col(t).alias(f"m_{t}") for t in _TYPES])


@query("SELECT 'documents' AS side, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_set_diff(spark, sf):
    d, l_ = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    size = lambda a, b, name: a.join(b, "doc_id", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("side"), "missing")
    return size(d, l_, "documents").unionByName(size(l_, d, "labels"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem WHERE l_quantity > 30 UNION ALL SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem WHERE l_discount > 0.05) GROUP BY ALL""")
def union_all_counts(spark, sf):
    l_ = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_quantity", "l_discount")
    both = l_.filter("l_quantity > 30").unionByName(l_.filter("l_discount > 0.05"))
    return both.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT source, string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def value_sets(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.concat_ws(";", F.sort_array(F.collect_set("lang"))).alias("langs"), F.count_distinct("lang").alias("n_langs"))


@query("""WITH p AS (SELECT p_partkey, p_type, p_size FROM part), l AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'negative_size' AS "check", count(*) AS n FROM p WHERE p_size < 1 UNION ALL SELECT 'orphan_line', count(*) FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM p)
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT p_partkey FROM p GROUP BY 1 HAVING count(*) > 1)""")
def dataset_audit(spark, sf):
    p, l_ = table(spark, sf, "part").select("p_partkey", "p_size"), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return audit.violations({"negative_size": p.filter("p_size < 1"), "orphan_line": l_.join(p, "p_partkey", "left_anti"), "duplicate_key": p.groupBy("p_partkey").count().filter("count > 1")})


# --- aggregates ----------------------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS groups, round(median(v), 6) AS median_of_medians, (SELECT round(median(m), 6) FROM (SELECT avg(value) AS m FROM events e2 WHERE e2.event_type = e.event_type GROUP BY user_id)) AS median_of_means
FROM (SELECT user_id, event_type, median(value) AS v FROM events GROUP BY 1, 2) e GROUP BY event_type""")
def median_of_medians(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    a = robust.median_of(e, "value", ["user_id", "event_type"], ["event_type"], "median").withColumn("median_of_medians", F.round("value", 6)).drop("value")
    b = robust.median_of(e, "value", ["user_id", "event_type"], ["event_type"], "mean").select("event_type", F.round("value", 6).alias("median_of_means"))
    return a.join(b, "event_type")


@query("""SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / greatest(sum(l_extendedprice), 1), 8) AS pooled, round(avg(l_discount), 8) AS mean_ratio, count(*) FILTER (l_quantity > 25) AS large,
 min(l_quantity) AS low, median(l_quantity) AS mid, max(l_quantity) AS high FROM lineitem GROUP BY 1""")
def global_vs_mean_ratio(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(S.safe_ratio(F.sum(F.col("l_discount") * F.col("l_extendedprice")), F.sum("l_extendedprice")), 8).alias("pooled"), F.round(F.avg("l_discount"), 8).alias("mean_ratio"),
        F.count_if(F.col("l_quantity") > 25).alias("large"), F.min("l_quantity").alias("low"), F.median("l_quantity").alias("mid"), F.max("l_quantity").alias("high"))


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM k)
SELECT user_id, event_type AS dominant, round(n / t, 8) AS fraction FROM r WHERE r = 1""")
def mode_and_fractions(spark, sf):
    k = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    g = k.groupBy("user_id").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"))
    return g.select("user_id", F.col("b.event_type").alias("dominant"), F.round(-F.col("b.m") / F.col("t"), 8).alias("fraction"))


@query("SELECT string_agg(k || '=' || n::VARCHAR, ';' ORDER BY k) AS histogram FROM (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1)")
def value_histogram(spark, sf):
    h = audit.histogram(table(spark, sf, "events"), "event_type")
    return h.select(F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("histogram"))


@query("""WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1) SELECT event_type, count(*) AS n, round(any_value(c), 6) AS centre, round(1.4826 * median(abs(value - c)), 6) AS scale FROM events JOIN m USING (event_type) GROUP BY 1""")
def mad_by_type(spark, sf):
    got = robust.with_mad(table(spark, sf, "events").select("event_type", "value"), "value", ["event_type"])
    return got.select("event_type", "n", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


@query("""WITH g AS (SELECT lang, source, count(*) AS n, avg((n_chars > 200)::INT) AS noncollapse, median(n_chars) AS med, avg((n_chars > 5000)::INT) AS cap FROM documents GROUP BY 1, 2),
u AS (SELECT *, least(med / 5000, 1.0) + 0.25 * noncollapse + 0.15 * noncollapse - 0.75 - 0.25 * cap AS u FROM g)
SELECT lang, source, round(u, 8) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(u, 8) DESC, med DESC, source) AS r FROM u) WHERE r = 1""")
def best_configuration(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", "source").agg(F.avg((F.col("n_chars") > 200).cast("int")).alias("nc"), F.median("n_chars").alias("med"), F.avg((F.col("n_chars") > 5000).cast("int")).alias("cap"))
    g = g.withColumn("utility", F.round(robust.utility(F.least(F.col("med") / 5000, F.lit(1.0)), "nc", "nc", F.lit(float("nan")), "cap"), 8))
    return robust.best(g, ["lang"], F.desc("utility"), F.desc("med"), "source").select("lang", "source", "utility")


@query("""WITH g AS (SELECT avg((n_chars > 200)::INT) AS kept, avg((n_chars > 20000)::INT) AS cap, count(DISTINCT lang) AS langs FROM documents)
SELECT array_to_string(list_filter([CASE WHEN NOT cap <= 0.2 THEN 'cap' END, CASE WHEN NOT kept >= 0.9 THEN 'kept' END, CASE WHEN NOT langs >= 4 THEN 'langs' END], lambda x: x IS NOT NULL), ';') AS failed,
CASE WHEN cap <= 0.2 AND kept >= 0.9 AND langs >= 4 THEN 'pass' ELSE 'stop_or_revise' END AS status FROM g""")
def gate_decision(spark, sf):
    d = table(spark, sf, "documents").agg(F.avg((F.col("n_chars") > 200).cast("int")).alias("kept"), F.avg((F.col("n_chars") > 20000).cast("int")).alias("cap"), F.count_distinct("lang").alias("langs"))
    return audit.gate(d, {"kept": F.col("kept") >= 0.9, "cap": F.col("cap") <= 0.2, "langs": F.col("langs") >= 4}, ("visual_review",)).select("failed", "status")


@query(f"""SELECT doc_id, array_to_string(flags, ';') AS reasons, (row_number() OVER (ORDER BY score, n_chars DESC, doc_id))::INT AS priority FROM ({_AUDITED}) WHERE score < 60 QUALIFY row_number() OVER (ORDER BY score, n_chars DESC, doc_id) <= 100""")
def review_priority_reasons(spark, sf):
    order = ["score", F.desc("n_chars"), "doc_id"]
    head = _audited(spark, sf).filter("score < 60").orderBy(*order).limit(100)
    return head.select("doc_id", F.concat_ws(";", "flags").alias("reasons"), F.row_number().over(Window.orderBy(*order)).alias("priority"))


@query("""SELECT coalesce(l.quality, -1) AS old, (d.n_chars > 300)::INT AS new, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL""")
def review_transitions(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("v"))
    new = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("v"))
    return audit.transitions(old, new, "doc_id", "v")


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
def content_manifest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages), k AS (SELECT DISTINCT '/' || substr(event_type, 1, 3) AS link FROM events)
SELECT page_id, count(*) AS links, count(*) FILTER (link NOT IN (SELECT link FROM k)) AS missing FROM h GROUP BY page_id""")
def page_link_integrity(spark, sf):
    from mensura.sources.files import html_links

    known = table(spark, sf, "events").select(F.concat(F.lit("/"), F.substring("event_type", 1, 3)).alias("link")).distinct().withColumn("known", F.lit(1))
    found = html_links(table(spark, sf, "pages"), "page_id", "html", "href").join(known, "link", "left")
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("known").isNull()).alias("missing"))


# --- statistics ----------------------------------------------------------------------------------------

_RANKED = "SELECT quality, toxic, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)"


def _labelled(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang", F.size(F.split("text", "\n")).alias("n_lines"))
    return d.join(table(spark, sf, "labels"), "doc_id")


@query(f"WITH r AS ({_RANKED}) SELECT sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0 AS u, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM r")
def mann_whitney_u(spark, sf):
    n1 = F.count_if(F.col("quality") == 1)
    return average_rank(_labelled(spark, sf), "n_chars", [], "r").agg((F.sum(F.when(F.col("quality") == 1, F.col("r"))) - n1 * (n1 + 1) / 2.0).alias("u"), n1.alias("n1"), F.count_if(F.col("quality") == 0).alias("n0"))


@query("""WITH r AS (SELECT lang, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents),
g AS (SELECT lang, count(*) AS n, sum(r) AS s FROM r GROUP BY lang), t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM documents GROUP BY n_chars))
SELECT round((12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (sum(n)::DOUBLE * sum(n) * sum(n) - sum(n))), 6) AS h, count(*) AS groups FROM g, t""")
def kruskal_h(spark, sf):
    from mensura.operators.stats import kruskal

    return kruskal(table(spark, sf, "documents").select("lang", "n_chars"), "n_chars", "lang").select(F.round("h", 6).alias("h"), "groups")


@query("""WITH a AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS x, rank() OVER (ORDER BY l) + (count(*) OVER (PARTITION BY l) - 1) / 2.0 AS y FROM (SELECT n_chars, len(string_split(text, chr(10))) AS l FROM documents))
SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM a""")
def spearman_rho(spark, sf):
    from mensura.operators.stats import spearman

    d = table(spark, sf, "documents").select("n_chars", F.size(F.split("text", "\n")).alias("l"))
    return spearman(d, "n_chars", "l").select(F.round("rho", 6).alias("rho"), "n")


# Tails by adding up densities: of the normal from 0, of chi-square beyond h, of Student's t from 0.
@query("""WITH d AS (SELECT n_chars AS x, len(string_split(text, chr(10))) AS o, quality, lang FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS ro FROM d),
t AS (SELECT sum(k * k * k - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM d GROUP BY x)),
m AS (SELECT sum(rx) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0 AS u, count(*) FILTER (quality = 1)::DOUBLE AS n1, count(*) FILTER (quality = 0)::DOUBLE AS n0,
  corr(rx, ro) AS rho, count(*)::DOUBLE AS n FROM r),
g AS (SELECT count(*)::DOUBLE AS n, sum(rx) AS s FROM r GROUP BY lang),
h AS (SELECT (12.0 / (any_value(m.n) * (any_value(m.n) + 1)) * sum(g.s * g.s / g.n) - 3 * (any_value(m.n) + 1)) / (1 - any_value(t.t) / (any_value(m.n) * any_value(m.n) * any_value(m.n) - any_value(m.n))) AS h, count(*) - 1.0 AS k FROM g, m, t),
z AS (SELECT *, greatest(0.0, abs(u - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * (n + 1 - t / (n * (n - 1)))) AS z, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS s FROM m, t, h),
i AS (SELECT unnest(range(100000)) + 0.5 AS i)
SELECT 'mann_whitney_u' AS test, round(any_value(u), 6) AS statistic, round(1 - 2 * sum(exp(-power(z * i / 1e5, 2) / 2) / sqrt(2 * pi()) * z / 1e5), 5) AS p_value FROM z, i
UNION ALL SELECT 'kruskal_wallis', round(any_value(h), 6), round(sum(power(h + i / 500, k / 2 - 1) * exp(-(h + i / 500) / 2) / (power(2, k / 2) * gamma(k / 2)) / 500), 5) FROM z, i
UNION ALL SELECT 'spearman', round(any_value(rho), 6), round(1 - 2 * sum(exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt((n - 2) * pi()) * power(1 + power(s * i / 1e5, 2) / (n - 2), -(n - 1) / 2) * s / 1e5), 5) FROM z, i""")
def association_tests(spark, sf):
    from mensura.operators.stats import association

    got = association(_labelled(spark, sf), "n_chars", "quality", "lang", "n_lines")
    return got.select("test", F.round("statistic", 6).alias("statistic"), F.round("p_value", 5).alias("p_value"))


# Metrics of items by plain formulas of the documents' columns; every seventh document has no error.
_METRICS = {
    "noncollapse": ("n_chars > 100", "(n_chars > 100)::INT"), "f1": ("least(n_chars / 2000.0, 1.0)", "least(n_chars / 2000.0, 1.0)"),
    "error": ("CASE WHEN doc_id % 7 > 0 THEN 20.0 / n_chars END", "CASE WHEN doc_id % 7 > 0 THEN 20.0 / n_chars END"),
    "count_difference": ("doc_id % 4", "doc_id % 4"), "cap_hit": ("n_chars >= 30000", "(n_chars >= 30000)::INT"),
    "coverage": ("1.0 - 300.0 / (n_chars + 300)", "1.0 - 300.0 / (n_chars + 300)"), "span": ("doc_id % 100 / 100.0", "doc_id % 100 / 100.0"), "mask_hit": ("doc_id % 50 / 40.0", "doc_id % 50 / 40.0"),
}


def _gates_sql(rules: dict) -> str:
    of = {m: how for m, how, _, _ in rules.values()}
    metrics = ", ".join(f"{'avg' if how == 'mean' else 'median'}(({_METRICS[m][1]})::DOUBLE) AS {m}" for m, how in of.items())
    failed = ", ".join(f"CASE WHEN NOT coalesce({m} {sign} {bound}, false) THEN '{name}' END" for name, (m, _, sign, bound) in sorted(rules.items()))
    return f"""WITH o AS (SELECT {metrics} FROM documents WHERE n_chars > 0), g AS (SELECT *, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ';') AS failed FROM o)
SELECT {", ".join(f"round({m}, 6) AS {m}" for m in of)}, failed, CASE WHEN failed = '' THEN 'pass' ELSE 'stop_or_revise' END AS status FROM g"""


def _gates(spark, sf, rules: dict) -> DataFrame:
    of = list(dict.fromkeys(m for m, *_ in rules.values()))
    rows = table(spark, sf, "documents").filter("n_chars > 0").select(*[F.expr(f"double({_METRICS[m][0]})").alias(m) for m in of])
    return audit.machine_gate(rows, rules).select(*[F.round(m, 6).alias(m) for m in of], "failed", "status")


@query(_gates_sql(audit.STRUCTURE_GATES))
def structure_gates(spark, sf):
    return _gates(spark, sf, audit.STRUCTURE_GATES)


@query(_gates_sql(audit.CLEAN_GATES))
def clean_gates(spark, sf):
    return _gates(spark, sf, audit.CLEAN_GATES)
