"""Image measures, selections and evaluation rows over the driver tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions import scalar as S
from mensura.operators import evaluate, keypoints, match, plant, raster, robust, split
from mensura.plans.geometry import _POINTS, _mask, _points
from mensura.session import table
from mensura.staging import stage
from mensura.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# An image is a run of fifty vectors: a row each, a column a component, three channels from its digits.
_IMAGE = """SELECT vec_id // 50 AS item, i::INT AS x, (vec_id % 50)::INT AS y, floor(v * 1000)::BIGINT % 256 AS r, floor(v * 1700)::BIGINT % 256 AS g, floor(v * 2300)::BIGINT % 256 AS b
FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings)"""


def _image(spark, sf) -> DataFrame:
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.abs(F.col("v").cast("double")))
    channel = lambda k: F.floor(F.col("v") * k) % 256
    return d.select(F.floor(F.col("vec_id") / 50).cast("long").alias("item"), "x", (F.col("vec_id") % 50).cast("int").alias("y"), channel(1000).alias("r"), channel(1700).alias("g"), channel(2300).alias("b"))


@query(f"""WITH p AS ({_IMAGE}), f AS (SELECT item AS i, max(x) AS w, max(y) AS h FROM p GROUP BY 1), l AS (SELECT item, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM p JOIN f ON item = i WHERE x < 2 OR y < 2 OR x > w - 2 OR y > h - 2)
SELECT item, count(*) AS pixels, round(avg(l), 6) AS mean, round(median(l), 6) AS median, round(stddev_pop(l), 6) AS deviation FROM l GROUP BY item""")
def border_statistics(spark, sf):
    b = raster.border(_image(spark, sf), band=2)
    return b.select("item", "pixels", *[F.round(k, 6).alias(k) for k in ("mean", "median", "deviation")])


@query(f"""SELECT item, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM ({_IMAGE}) WHERE 2 * g - r - b >= 20 AND greatest(r, g, b) - least(r, g, b) >= 25 GROUP BY item""")
def vegetation_pixels(spark, sf):
    return raster.vegetation(_image(spark, sf)).groupBy("item").agg(F.count("*").alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH p AS ({_IMAGE}), m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM p),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60.0 * (g - b) / d WHEN v = g THEN 120 + 60.0 * (b - r) / d ELSE 240 + 60.0 * (r - g) / d END AS a FROM m),
k AS (SELECT *, round_even((CASE WHEN a < 0 THEN a + 360 ELSE a END / 2)::DOUBLE, 0) % 180 AS hue, CASE WHEN v = 0 THEN 0 ELSE round_even(255.0::DOUBLE * d / v, 0) END AS s FROM h)
SELECT item, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM k WHERE (hue BETWEEN 18 AND 100 AND s >= 24 AND v >= 22) OR (2 * g - r - b >= 10 AND g >= 35 AND g >= r - 3 AND g >= b - 3) GROUP BY item""")
def audit_vegetation_pixels(spark, sf):
    return raster.audit_vegetation(_image(spark, sf)).groupBy("item").agg(F.count("*").alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def _frames(image: DataFrame) -> DataFrame:
    return image.groupBy("item").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


@query(f"""WITH p AS ({_IMAGE}), f AS (SELECT item AS i, max(x) + 1 AS w, max(y) + 1 AS h, greatest(2, round_even(0.04 * least(max(x) + 1, max(y) + 1), 0)) AS t FROM p GROUP BY 1),
e AS (SELECT item, r, g, b, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round_even(255.0::DOUBLE * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b), 0) END AS s, 2 * g - r - b AS e FROM p JOIN f ON item = i WHERE NOT (x BETWEEN t AND w - 1 - t AND y BETWEEN t AND h - 1 - t)),
c AS (SELECT item, median(r) AS r0, median(g) AS g0, median(b) AS b0, median(s) AS s0, median(e) AS e0 FROM e GROUP BY 1), o AS (SELECT *, sqrt((r - r0) ** 2 + (g - g0) ** 2 + (b - b0) ** 2) AS off FROM e JOIN c USING (item)), k AS (SELECT item, median(off) AS o0 FROM o GROUP BY 1),
m AS (SELECT item, any_value(r0) AS r0, any_value(g0) AS g0, any_value(b0) AS b0, any_value(o0) AS o0, median(abs(off - o0)) AS od, any_value(s0) AS s0, 1.4826 * median(abs(s - s0)) AS ss, any_value(e0) AS e0, 1.4826 * median(abs(e - e0)) AS es FROM o JOIN k USING (item) GROUP BY 1)
SELECT item, r0, g0, b0, od <= 3.0 AS uniform, round(greatest(9.0, o0 + 6 * 1.4826 * od + 5), 4) AS "limit", round(least(greatest(s0 + 4 * ss, 45.0), 85.0), 4) AS saturation, round(least(greatest(e0 + 3 * es, 15.0), 30.0), 4) AS excess FROM m""")
def confident_mask_limits(spark, sf):
    image = _image(spark, sf)
    return plant.limits(image, _frames(image)).withColumns({k: F.round(k, 4) for k in ("limit", "saturation", "excess")})


@query()
def confident_mask_pixels(spark, sf):
    """Masks of images with a vivid bar on what is left of the noise."""
    image = _planted(spark, sf)
    return plant.confident(image, _frames(image)).groupBy("item", "uniform").agg(F.count("*").alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def _planted(spark, sf) -> DataFrame:
    """Images with a plant drawn in: a green bar whose length and place follow the item, a brown seed at its
    foot and a pale root below, on noise, which every third item has less of."""
    rows = _image(spark, sf)
    i, x, y = F.col("item"), F.col("x"), F.col("y")
    foot = 24 + i % 9
    part = F.when(x.between(14, 17) & y.between(4 + i % 5, foot), "shoot").when(x.between(14, 17) & y.between(foot + 1, foot + 4), "seed").when(x.between(15, 16) & y.between(foot + 5, 46), "root")
    colours = {"r": (60, 140, 200), "g": (150, 80, 180), "b": (50, 30, 140)}
    paint = lambda c: F.when(F.col("part") == "shoot", colours[c][0]).when(F.col("part") == "seed", colours[c][1]).when(F.col("part") == "root", colours[c][2]).otherwise(F.when(i % 3 == 0, 120 + F.col(c) % 3).otherwise(F.col(c) % 128 + 64))
    return stage(rows.withColumn("part", part).select("item", "x", "y", *[paint(c).cast("long").alias(c) for c in "rgb"], "part"), "planted")


@query()
def region_of_interest_measures(spark, sf):
    image = _planted(spark, sf)
    mask = lambda rule: image.filter(rule).select("item", "x", "y")
    hints = image.groupBy("item").agg(F.lit(15.0).alias("hint_x"), F.max("y").cast("double").alias("hint_y"))
    _, told = plant.region_of_interest(image, mask("part = 'shoot'"), mask("part IN ('seed', 'root')"), mask("part IS NOT NULL"), _frames(image), hints)
    return told.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in told.dtypes])


@query(f"""WITH p AS ({_IMAGE}), n AS (SELECT item, g, -4 * g + lag(g) OVER (PARTITION BY item, y ORDER BY x) + lead(g) OVER (PARTITION BY item, y ORDER BY x) + lag(g) OVER (PARTITION BY item, x ORDER BY y) + lead(g) OVER (PARTITION BY item, x ORDER BY y) AS lap FROM p)
SELECT item, round(var_pop(lap), 4) AS sharpness FROM n WHERE lap IS NOT NULL GROUP BY item""")
def sharpness(spark, sf):
    s = raster.laplacian_variance(_image(spark, sf), "g")
    return s.filter("sharpness IS NOT NULL").select("item", F.round("sharpness", 4).alias("sharpness"))


_CELLS = lambda i, j: f"SELECT DISTINCT item, floor(x)::INT AS x, floor(y)::INT AS y FROM ({_POINTS.format(i=i, j=j)})"
_WIDE = lambda t, r: f"SELECT DISTINCT item, x + a AS x, y + b AS y FROM {t}, (SELECT unnest(range(-{r}, {r} + 1))::INT AS a), (SELECT unnest(range(-{r}, {r} + 1))::INT AS b)"


def _cells(spark, sf, i: int, j: int) -> DataFrame:
    return _points(spark, sf, i, j).select("item", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).distinct()


@query(f"""WITH a AS ({_CELLS(5, 6)}), b AS ({_CELLS(7, 8)}), u AS ({_WIDE("a", 3)}), v AS ({_WIDE("b", 3)}) SELECT item, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM u JOIN v USING (item, x, y) GROUP BY item""")
def mask_interface(spark, sf):
    return raster.interface(_cells(spark, sf, 5, 6), _cells(spark, sf, 7, 8), 3).groupBy("item").agg(F.count("*").alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH a AS ({_CELLS(5, 6)}), b AS ({_CELLS(7, 8)}), s AS ({_WIDE("a", 4)}), r AS ({_WIDE("b", 4)}), q AS ({_POINTS.format(i=1, j=2)}),
f AS (SELECT q.vec_id, (s.item IS NOT NULL) AS s, (r.item IS NOT NULL) AS r FROM q LEFT JOIN s ON s.item = q.item AND s.x = least(greatest(round_even(q.x, 0), 0), 199) AND s.y = least(greatest(round_even(q.y, 0), 0), 199)
 LEFT JOIN r ON r.item = q.item AND r.x = least(greatest(round_even(q.x, 0), 0), 199) AND r.y = least(greatest(round_even(q.y, 0), 0), 199))
SELECT vec_id, CASE WHEN s AND r THEN 'shoot_root_overlap' WHEN s THEN 'shoot' WHEN r THEN 'seed_base_root' WHEN vec_id % 3 = 0 THEN 'other_plant' ELSE 'background' END AS region FROM f""")
def point_regions(spark, sf):
    p = raster.lookup(_points(spark, sf, 1, 2), raster.dilate_pixels(_cells(spark, sf, 5, 6), 4), 200, 200, name="shoot")
    p = raster.lookup(p, raster.dilate_pixels(_cells(spark, sf, 7, 8), 4), 200, 200, name="root")
    return p.select("vec_id", raster.region(F.col("shoot") == 1, F.col("root") == 1, F.col("vec_id") % 3 == 0).alias("region"))


@query(f"""WITH o AS ({_CELLS(5, 6)}), b AS ({_CELLS(7, 8)}), f AS (SELECT * FROM o WHERE x % 5 > 0 UNION SELECT * FROM b), i AS (SELECT DISTINCT vec_id // 50 AS item FROM embeddings),
n AS (SELECT item, count(*) AS organ, count(*) FILTER (x = 0 OR y = 0 OR x = 199 OR y = 199) AS on_border, count(*) FILTER (NOT EXISTS (SELECT 1 FROM f WHERE f.item = o.item AND f.x = o.x AND f.y = o.y)) AS outside FROM o GROUP BY item), m AS (SELECT item, count(*) AS whole FROM f GROUP BY item)
SELECT item, coalesce(organ, 0) AS organ, coalesce(whole, 0) AS whole, coalesce(outside, 0) AS outside, coalesce(on_border, 0) AS on_border, round(coalesce(organ, 0) / greatest(coalesce(whole, 0), 1), 6) AS ratio, (coalesce(organ, 0) > 0 AND coalesce(outside, 0) = 0 AND coalesce(on_border, 0) = 0)::INT AS sound
FROM i LEFT JOIN n USING (item) LEFT JOIN m USING (item)""")
def mask_integrity(spark, sf):
    organ = _cells(spark, sf, 5, 6)
    full = organ.filter("x % 5 > 0").union(_cells(spark, sf, 7, 8)).distinct()
    got = raster.integrity(organ, full, _points(spark, sf, 1, 2), 200, 200)
    return got.select("item", "organ", F.col("full").alias("whole"), "outside", "on_border", F.round("ratio", 6).alias("ratio"), "sound")


@query(f"""WITH g AS (SELECT item, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ({_CELLS(5, 6)}) GROUP BY item),
s AS (SELECT *, least(greatest(round_even((x1 - x0 + 1) * 1.6::DOUBLE, 0), round_even(200 * 0.6::DOUBLE, 0)), 200.0) AS w, least(greatest(round_even((y1 - y0 + 1) * 1.6::DOUBLE, 0), round_even(200 * 0.6::DOUBLE, 0)), 200.0) AS h FROM g),
t AS (SELECT *, least(greatest(round_even((x0 + x1 + 1 - w) / 2, 0), 0.0), 200 - w) AS l, least(greatest(round_even((y0 + y1 + 1 - h) / 2, 0), 0.0), 200 - h) AS t FROM s)
SELECT item, l::INT AS "left", t::INT AS top, (l + w)::INT AS "right", (t + h)::INT AS bottom FROM t""")
def crop_boxes(spark, sf):
    g = raster.geometry(_mask(spark, sf), 200, 200)
    return g.select("item", raster.conservative_crop("x0", "y0", "x1", "y1", F.lit(200), F.lit(200)).alias("b")).select("item", "b.*")


# --- selections and evaluation ---------------------------------------------------------------------


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def keep_first_per_source(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return robust.best(d, ["source"], F.desc("n_chars"), F.col("doc_id"))


@query("""SELECT l_orderkey, part, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS b FROM lineitem),
(VALUES ('worst'), ('best')) AS t(part) WHERE CASE part WHEN 'worst' THEN a ELSE b END <= 2""")
def worst_and_best_two(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    low = robust.first_n(d, ["l_orderkey"], 2, F.col("l_extendedprice"), F.col("l_linenumber")).withColumn("part", F.lit("worst"))
    high = robust.first_n(d, ["l_orderkey"], 2, F.desc("l_extendedprice"), F.col("l_linenumber")).withColumn("part", F.lit("best"))
    return low.union(high).select("l_orderkey", "part", "l_linenumber")


@query("""WITH s AS (SELECT l_orderkey AS item, l_linenumber AS n, l_returnflag AS kind, round(l_discount, 1) AS score, l_suppkey AS x, l_partkey AS y FROM lineitem)
SELECT item, n, row_number() OVER (PARTITION BY item ORDER BY score DESC, kind, y, x)::INT AS rank FROM s""")
def candidate_order(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("kind"), F.round("l_discount", 1).alias("score"), F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"))
    return keypoints.ordered(d, "item").select("item", "n", "rank")


_FLAGS = "(vec_id % 4 > 0)::INT AS in_plant, (vec_id % 3 = 0)::INT AS in_root, (vec_id % 5 < 2)::INT AS in_shoot"


@query(f"""WITH p AS (SELECT vec_id // 50 AS item, {_FLAGS} FROM embeddings) SELECT item, count(*) AS points, count(*) FILTER (in_plant = 1) AS plant_count, count(*) FILTER (in_root = 1 AND in_shoot = 0) AS root_only_count, count(*) FILTER (in_shoot = 1) AS shoot_count, count(*) FILTER (in_plant = 0) AS background_count,
round(count(*) FILTER (in_plant = 1) / count(*), 6) AS plant_ratio, round(count(*) FILTER (in_root = 1 AND in_shoot = 0) / count(*), 6) AS root_only_ratio, round(count(*) FILTER (in_shoot = 1) / count(*), 6) AS shoot_ratio, round(count(*) FILTER (in_plant = 0) / count(*), 6) AS background_ratio FROM p GROUP BY item""")
def region_hit_shares(spark, sf):
    flag = lambda c: c.cast("int")
    v = F.col("vec_id")
    p = table(spark, sf, "embeddings").select(F.floor(v / 50).cast("long").alias("item"), flag(v % 4 > 0).alias("in_plant"), flag(v % 3 == 0).alias("in_root"), flag(v % 5 < 2).alias("in_shoot"))
    h = evaluate.region_hits(p, "item")
    return h.select(*[F.round(c, 6).alias(c) if c.endswith("ratio") else c for c in h.columns])


@query("""WITH k AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS r, sum(n) OVER (PARTITION BY l_orderkey) AS t FROM k)
SELECT l_orderkey, l_returnflag, round(n / t, 6) AS share FROM r WHERE r = 1""")
def dominant_region(spark, sf):
    d = evaluate.dominant_regions(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")
    return d.withColumn("share", F.round("share", 6))


@query("""WITH v AS (SELECT l_orderkey AS item, CASE l_linenumber WHEN 1 THEN 'identity' ELSE l_returnflag END AS view, CASE l_linestatus WHEN 'F' THEN 'geometric' ELSE 'photometric' END AS family, l_quantity::DOUBLE AS count, l_discount::DOUBLE AS f1, l_tax::DOUBLE AS error FROM lineitem),
g AS (SELECT item, max(count) FILTER (view = 'identity') AS c, avg(f1) FILTER (view <> 'identity') AS f1, median(error) FILTER (view <> 'identity') AS e, avg(count) FILTER (family = 'photometric') AS p FROM v GROUP BY item)
SELECT item, c AS count, round(f1, 6) AS mean_f1, round(e, 6) AS median_error, round(abs(p - c), 6) AS photometric_difference, (coalesce(c, 0) < 2)::INT AS collapse, (c >= 48)::INT AS cap_hit FROM g""")
def evaluation_rows(spark, sf):
    d = table(spark, sf, "lineitem")
    v = d.select(
        F.col("l_orderkey").alias("item"), F.when(F.col("l_linenumber") == 1, "identity").otherwise(F.col("l_returnflag")).alias("view"),
        F.when(F.col("l_linestatus") == "F", "geometric").otherwise("photometric").alias("family"),
        F.col("l_quantity").cast("double").alias("count"), F.col("l_discount").cast("double").alias("f1"), F.col("l_tax").cast("double").alias("error"),
    )
    e = evaluate.per_item(v, "item", 48)
    return e.select("item", "count", *[F.round(k, 6).alias(k) for k in ("mean_f1", "median_error", "photometric_difference")], "collapse", "cap_hit")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3|' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r ORDER BY r = 1 DESC, CASE WHEN r = 1 THEN n END, CASE WHEN r = 1 THEN 0.0::DOUBLE ELSE (r - 0.5::DOUBLE) / n END, lang, doc_id LIMIT 60""")
def pilot_sixty(spark, sf):
    return evaluate.pilot(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, "3").select("doc_id", "lang")


@query("SELECT sha256(text) || '  ' || source || '/' || doc_id::VARCHAR AS value FROM documents")
def lock_file_lines(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"))
    return files.lock_lines(d)


@query(f"""WITH a AS ({_POINTS.format(i=1, j=2)}), b AS ({_POINTS.format(i=3, j=4)}) SELECT a.item, round(avg((EXISTS (SELECT 1 FROM b WHERE b.item = a.item AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10))::INT), 6) AS recall FROM a GROUP BY a.item""")
def event_recall(spark, sf):
    b = _points(spark, sf, 3, 4).withColumnRenamed("vec_id", "node")
    return match.recall(_points(spark, sf, 1, 2), b, "item", "vec_id", "node", 10.0).withColumn("recall", F.round("recall", 6))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sha256('9|' || event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 3")
def hash_order_head_per_user(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("_h", S.seeded("9", "event_id"))
    return robust.first_n(d, ["user_id"], 3, F.col("_h"), F.col("event_id")).drop("_h")


@query("""WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum((gap IS NULL OR gap > 3600000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, run::INT AS run, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM r GROUP BY user_id, run""")
def gap_merged_runs(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    g = robust.runs(d, ["user_id"], "at", 3_600_000_000, ["event_id"])
    return g.groupBy("user_id", "run").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@query("SELECT lang, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id) AS members, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def members_by_key(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    d = table(spark, sf, "documents").select("doc_id", "lang").join(toxic, "doc_id", "left_semi")
    return d.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ";").alias("members"), F.count("*").alias("n"))


@query("SELECT lang, CASE WHEN (('0x' || substr(sha256('7|' || doc_id::VARCHAR), 1, 8))::BIGINT % 10000) < 1500 THEN 'val' ELSE 'train' END AS part, sha256(string_agg(doc_id::VARCHAR || ' ' || sha256(text), chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY ALL")
def split_digests(spark, sf):
    d = split.by_bucket(table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h")), "7", "doc_id")
    one = F.array_sort(F.collect_list(F.struct("doc_id", "h")))
    return d.groupBy("lang", "part").agg(F.sha2(F.array_join(F.transform(one, lambda x: F.concat_ws(" ", x["doc_id"].cast("string"), x["h"])), "\n"), 256).alias("digest"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_transform(a, lambda w: lower(w)), list_transform(b, lambda w: lower(w))))), ';') AS evidence FROM p""")
def evidence_union(spark, sf):
    low = lambda c: F.transform(F.split(c, " "), lambda w: F.lower(w))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(low("p_name"), low("p_type"))), ";").alias("evidence"))


@query("""SELECT o_orderkey, coalesce(lower(trim(o_orderpriority)) IN ('1-urgent', '2-high'), false) AS urgent, coalesce(round(o_totalprice / nullif(o_orderkey % 3, 0), 6), 0.0) AS ratio,
'orders/' || substr(o_orderdate::VARCHAR, 1, 4) || '/' || o_orderkey::VARCHAR || '.JSON' AS path, '.json' AS suffix, o_orderkey::VARCHAR AS stem FROM orders""")
def path_and_ratio_projections(spark, sf):
    d = table(spark, sf, "orders")
    path = F.concat(F.lit("orders/"), F.substring(F.col("o_orderdate").cast("string"), 1, 4), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".JSON"))
    d = d.select("o_orderkey", F.coalesce(F.lower(F.trim("o_orderpriority")).isin("1-urgent", "2-high"), F.lit(False)).alias("urgent"), F.coalesce(F.round(F.col("o_totalprice") / F.nullif(F.col("o_orderkey") % 3, F.lit(0)), 6), F.lit(0.0)).alias("ratio"), path.alias("path"))
    return d.withColumns({"suffix": S.suffix("path"), "stem": S.stem("path")})


@query("""WITH b AS (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS alpha, (n_chars % 70) / 70.0::DOUBLE AS white, (n_chars % 60) / 60.0::DOUBLE AS black FROM documents)
SELECT doc_id, CASE WHEN alpha >= 0.1 THEN 'transparent' WHEN white >= 0.6 THEN 'white' WHEN black >= 0.6 THEN 'black' ELSE 'other' END AS background,
 round(least(greatest(0.5::DOUBLE * alpha + 0.3::DOUBLE * white + 0.2::DOUBLE * black, 0.0), 1.0), 6) AS score FROM b""")
def background_fractions(spark, sf):
    from mensura.operators import audit

    share = lambda k: (F.col("n_chars") % k) / float(k)
    b = table(spark, sf, "documents").select("doc_id", share(100).alias("alpha"), share(70).alias("white"), share(60).alias("black"))
    score = audit.additive([(F.col("alpha"), 0.5), (F.col("white"), 0.3), (F.col("black"), 0.2)])
    return b.select("doc_id", audit.background_by_fractions("alpha", "white", "black").alias("background"), F.round(score, 6).alias("score"))


@query(f"""WITH q AS (SELECT item, x AS gx, y AS gy, r / 255.0::DOUBLE AS v FROM ({_IMAGE})), w AS (SELECT q.*, quantile_cont(v, 0.9) OVER (PARTITION BY item) AS level, max(gx) OVER (PARTITION BY item) AS mx, max(gy) OVER (PARTITION BY item) AS my FROM q),
n AS (SELECT a.item, a.gx, a.gy, any_value(a.v) AS v, any_value(a.level) AS level, any_value(a.mx) AS mx, any_value(a.my) AS my, max(b.v) AS top FROM w a JOIN q b ON a.item = b.item AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY ALL)
SELECT item, gx AS x, gy AS y, round(v, 6) AS value FROM n WHERE v >= top AND v >= level AND gx > 0 AND gy > 0 AND gx < mx AND gy < my""")
def quantile_peaks_2d(spark, sf):
    d = _image(spark, sf).select("item", "x", "y", (F.col("r") / 255.0).alias("value"))
    return match.quantile_peaks(d, "item", "value", 0.9).select("item", "x", "y", F.round("value", 6).alias("value"))


@query("""SELECT r_regionkey, n_nationkey AS nation_n_nationkey, n_name AS nation_n_name FROM region JOIN nation ON n_regionkey = r_regionkey""")
def prefixed_join(spark, sf):
    n = S.prefixed(table(spark, sf, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name"), "nation_", ["r_regionkey"])
    return table(spark, sf, "region").select("r_regionkey").join(F.broadcast(n), "r_regionkey")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'reviewer' WHEN 'assistant' THEN 'model' ELSE role END AS role, count(*) AS n FROM conversations GROUP BY ALL")
def roles_relabelled(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", S.relabelled("role", {"user": "reviewer", "assistant": "model"}).alias("role"))
    return d.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, ((r - 1) // 12)::BIGINT AS sheet, (((r - 1) % 12) // 4)::BIGINT AS "row", ((r - 1) % 12 % 4)::BIGINT AS "column" FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents)""")
def contact_sheet_places(spark, sf):
    got = files.contact_sheets(table(spark, sf, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 4, 3)
    return got.select("doc_id", "sheet", "row", "column")


@query("SELECT upper(substr(md5(text), 1, 4)) AS block, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def hash_blocks(spark, sf):
    d = table(spark, sf, "documents").select(F.upper(F.substring(F.md5("text"), 1, 4)).alias("block"), "doc_id")
    return d.groupBy("block").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
