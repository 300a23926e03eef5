"""Series, curves, features, matching and graphs over the driver tables, with twins where SQL has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions import scalar as S
from mensura.operators import audit, curve, graph, keypoints, match, plant, raster, robust
from mensura.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- series ----------------------------------------------------------------------------------------

_SERIES = "SELECT user_id, event_id, ts, value, epoch_us(ts) / 3.6e9 - 437000 AS t FROM events"


def _series(spark, sf) -> DataFrame:
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 437000
    return table(spark, sf, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("o"), "value", hours.alias("t"))


@query("""WITH n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT user_id, median(value) AS c FROM events GROUP BY 1), s AS (SELECT e.user_id, any_value(c) + 1.0 * (1.4826 * median(abs(value - c))) AS lim FROM events e JOIN m USING (user_id) GROUP BY 1)
SELECT event_id, user_id, round(value, 6) AS value FROM n JOIN s USING (user_id) WHERE value >= a AND value >= b AND value >= lim""")
def robust_peaks_1d(spark, sf):
    p = match.peaks_1d(_series(spark, sf), "user_id", "o", "value", 1.0)
    return p.select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("""SELECT event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1), 8) AS rank01 FROM events""")
def rank01(spark, sf):
    d = robust.rank01(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", ["user_id"], ["event_id"])
    return d.select("event_id", F.round("rank01", 8).alias("rank01"))


@query(f"""WITH p AS ({_SERIES}), d AS (SELECT *, t - lag(t) OVER w AS dx, value - lag(value) OVER w AS dy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, CASE WHEN sqrt(px * px + py * py) * sqrt(dx * dx + dy * dy) > 1e-12 THEN degrees(acos(least(greatest((px * dx + py * dy) / (sqrt(px * px + py * py) * sqrt(dx * dx + dy * dy)), -1.0), 1.0))) END AS turn FROM e),
g AS (SELECT user_id, count(*) AS points, coalesce(sum(step), 0) AS length, sqrt((arg_max(t, (ts, event_id)) - arg_min(t, (ts, event_id))) ** 2 + (arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) ** 2) AS chord, coalesce(sum(turn), 0) AS turning FROM f GROUP BY 1)
SELECT user_id, points, round(length, 4) AS length, round(chord, 4) AS chord, round(length / greatest(chord, 1e-9), 4) AS sinuosity, round(turning, 3) AS turning FROM g""")
def polyline_metrics(spark, sf):
    m = curve.measures(_series(spark, sf), ["user_id"], "o", "t", "value")
    return m.select("user_id", "points", *[F.round(c, 4).alias(c) for c in ("length", "chord", "sinuosity")], F.round("turning", 3).alias("turning"))


@query(f"""WITH p AS ({_SERIES}), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM p),
g AS (SELECT user_id, max(t) FILTER (i = least(12, n)) - max(t) FILTER (i = 1) AS ax, max(value) FILTER (i = least(12, n)) - max(value) FILTER (i = 1) AS ay,
 max(t) FILTER (i = n) - max(t) FILTER (i = greatest(n - 11, 1)) AS bx, max(value) FILTER (i = n) - max(value) FILTER (i = greatest(n - 11, 1)) AS "by" FROM i GROUP BY 1)
SELECT user_id, round(CASE WHEN sqrt(ax * ax + ay * ay) * sqrt(bx * bx + "by" * "by") > 1e-12 THEN degrees(acos(least(greatest((ax * bx + ay * "by") / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + "by" * "by")), -1.0), 1.0))) END, 4) AS divergence FROM g""")
def divergence_angle_first_last12(spark, sf):
    return curve.divergence(_series(spark, sf), ["user_id"], "o", "t", "value").select("user_id", F.round("divergence", 4).alias("divergence"))


@query("""WITH i AS (SELECT event_id, user_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT *, ((least(11, n - (n + 1) % 2) - 1) // 2)::BIGINT AS h FROM i)
SELECT event_id, round(CASE WHEN i = 0 OR i = n - 1 THEN value ELSE list_sum(list_transform(range(-h, h + 1), lambda k: v[greatest(least(i + k, n - 1), 0) + 1])) / (2 * h + 1) END, 6) AS smooth FROM h""")
def smooth_series(spark, sf):
    return curve.smoothed(_series(spark, sf), ["user_id"], "o", "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("SELECT event_id, round(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS arc FROM events")
def cumulative_arc(spark, sf):
    w = Window.partitionBy("user_id").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    return _series(spark, sf).select("event_id", F.round(F.sum(F.abs("value")).over(w), 4).alias("arc"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf):
    """Optional extra: the reference has no time windows."""
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


# --- features --------------------------------------------------------------------------------------

_CENTRES = "WITH u AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2)"


@query(f"""{_CENTRES}, d AS (SELECT u.label, vec_id, round(sqrt(sum((v - m) ** 2)), 9) AS d FROM u JOIN c USING (label, i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r, count(*) OVER (PARTITION BY label) AS size FROM d) SELECT label, vec_id, round(d, 6) AS distance, size FROM r WHERE r = 1""")
def label_medoid(spark, sf):
    return keypoints.medoids(table(spark, sf, "embeddings"), "label", "embedding", "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"{_CENTRES} SELECT vec_id, round(1 - sum(v * m) / greatest(sqrt(sum(v * v)) * sqrt(sum(m * m)), 1e-12), 6) AS contrast FROM u JOIN c USING (label, i) GROUP BY 1")
def local_contrast_to_centroid(spark, sf):
    return keypoints.contrast(table(spark, sf, "embeddings"), "label", "embedding").select("vec_id", F.round("contrast", 6).alias("contrast"))


# An item is a run of fifty vectors, so items grow in number with the table and not in size.
_POINTS = "SELECT vec_id, vec_id // 50 AS item, round(embedding[{i}]::DOUBLE * 200 + 100, 6) AS x, round(embedding[{j}]::DOUBLE * 200 + 100, 6) AS y FROM embeddings"


def _points(spark, sf, i: int, j: int) -> DataFrame:
    at = lambda k: F.round(F.col("embedding")[k - 1].cast("double") * 200 + 100, 6)
    return table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).cast("long").alias("item"), at(i).alias("x"), at(j).alias("y"))


@query(f"""WITH a AS ({_POINTS.format(i=1, j=2)}), b AS ({_POINTS.format(i=3, j=4)}), d AS (SELECT a.item, a.vec_id, b.vec_id AS target, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM a JOIN b ON a.item = b.item)
SELECT item, vec_id, target, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY item, vec_id ORDER BY d, target) AS r FROM d WHERE d <= 12) WHERE r = 1""")
def nearest_neighbour_radius(spark, sf):
    b = _points(spark, sf, 3, 4).withColumnRenamed("vec_id", "target")
    return match.nearest(_points(spark, sf, 1, 2), b, "item", "vec_id", "target", 12.0).withColumn("distance", F.round("distance", 6))


@query(f"""WITH a AS ({_POINTS.format(i=1, j=2)}), b AS ({_POINTS.format(i=3, j=4)}), d AS (SELECT a.item, a.vec_id, b.vec_id AS target, sqrt((a.x * 9 - b.x) ** 2 + (a.y * 9 - b.y) ** 2) AS d FROM a JOIN b ON a.item // 10 = b.item // 10)
SELECT item // 10 AS item, vec_id, target, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), target) AS r FROM d) WHERE r = 1""")
def nearest_neighbour_any(spark, sf):
    """Points far beyond their targets, too."""
    wide = lambda d: d.withColumn("item", F.floor(F.col("item") / 10).cast("long"))
    a = wide(_points(spark, sf, 1, 2)).withColumns({"x": F.col("x") * 9, "y": F.col("y") * 9})
    b = wide(_points(spark, sf, 3, 4)).withColumnRenamed("vec_id", "target")
    return match.nearest(a, b, "item", "vec_id", "target").withColumn("distance", F.round("distance", 6))


@query(f"""WITH a AS ({_POINTS.format(i=1, j=2)}), b AS ({_POINTS.format(i=3, j=4)}), n AS (SELECT a.item, a.vec_id AS node, a.x, a.y, round(b.x, 2) AS score, ['shoot_root_overlap', 'seed_base_root', 'shoot'][1 + a.vec_id % 3] AS region FROM a JOIN b USING (vec_id)),
s AS (SELECT DISTINCT item, floor(x)::INT + i AS x, floor(y)::INT + j AS y FROM ({_POINTS.format(i=5, j=6)}), range(-4, 5) t(i), range(-4, 5) u(j)), r AS (SELECT DISTINCT item, floor(x)::INT + i AS x, floor(y)::INT + j AS y FROM ({_POINTS.format(i=7, j=8)}), range(-4, 5) t(i), range(-4, 5) u(j)),
m AS (SELECT * FROM s INTERSECT SELECT * FROM r), d AS (SELECT n.item, node, any_value(region) AS region, any_value(score) AS score, min(sqrt((n.x - m.x) ** 2 + (n.y - m.y) ** 2)) AS d FROM n JOIN m USING (item) GROUP BY 1, 2),
b1 AS (SELECT item, node FROM d QUALIFY row_number() OVER (PARTITION BY item ORDER BY list_position(['shoot_root_overlap', 'seed_base_root', 'shoot'], region), round(d, 9), score DESC, node) = 1)
SELECT i.item, node, CASE WHEN node IS NULL THEN 'no_shoot_root_interface' ELSE '' END AS failure, 'learned node ranked by interface-compatible region then interface distance' AS rule FROM (SELECT DISTINCT item FROM a) i LEFT JOIN b1 USING (item)""")
def interface_bases(spark, sf):
    """The base of each item among its nodes, by where two masks meet."""
    region = F.element_at(F.array(*map(F.lit, ("shoot_root_overlap", "seed_base_root", "shoot"))), (F.col("vec_id") % 3 + 1).cast("int"))
    score = _points(spark, sf, 3, 4).select("vec_id", F.round("x", 2).alias("score"))
    nodes = _points(spark, sf, 1, 2).join(score, "vec_id").withColumn("region", region).withColumnRenamed("vec_id", "node")
    pixels = lambda i, j: raster.dilate_pixels(_points(spark, sf, i, j).select("item", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")), 2)
    scale = nodes.select("item").distinct().withColumn("diagonal", F.lit(200.0))
    return plant.bases(nodes, pixels(5, 6), pixels(7, 8), scale)


@query(f"""WITH e AS (SELECT a.item, a.vec_id, a.x, a.y, round(b.x, 2) AS c, round(b.y / 7, 1) AS s, (a.vec_id % 5)::DOUBLE AS w, round(a.x + b.y, 0) AS f FROM ({_POINTS.format(i=1, j=2)}) a JOIN ({_POINTS.format(i=3, j=4)}) b USING (vec_id)),
u AS (SELECT *, {", ".join(f"CASE WHEN max({k}) OVER w1 - min({k}) OVER w1 <= 1e-12 THEN 1.0 ELSE ({k} - min({k}) OVER w1) / (max({k}) OVER w1 - min({k}) OVER w1) END AS u{k}" for k in "cswf")} FROM e WINDOW w1 AS (PARTITION BY item)),
t AS (SELECT *, 0.55::DOUBLE * uc + 0.05::DOUBLE * (1 - us) + 0.15::DOUBLE * uw + 0.25::DOUBLE * uf AS t FROM u), r AS (SELECT *, row_number() OVER o AS k, lead(t) OVER o AS n FROM t WINDOW o AS (PARTITION BY item ORDER BY t DESC, y, x))
SELECT item, x, y, round(t, 6) AS score, round(coalesce(t - n, 1), 6) AS margin FROM r WHERE k = 1""")
def root_choice(spark, sf):
    a, b = _points(spark, sf, 1, 2), _points(spark, sf, 3, 4).select("vec_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    traits = {"colour": F.round("bx", 2), "stub": F.round(F.col("by") / 7, 1), "width": (F.col("vec_id") % 5).cast("double"), "far": F.round(F.col("x") + F.col("by"), 0)}
    got = plant.roots(a.join(b, "vec_id").withColumns(traits))
    return got.select("item", "x", "y", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(f"""WITH a AS ({_POINTS.format(i=1, j=2)}), v AS (SELECT * FROM (VALUES ('identity', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('flip', -1.0, 0.0, 200.0, 0.0, 1.0, 0.0), ('turn', 0.8, -0.6, 30.0, 0.6, 0.8, -20.0)) AS t(view, a, b, tx, d, e, ty)),
m AS (SELECT vec_id, view, e / (a * e - b * d) * x + -b / (a * e - b * d) * y + (b * ty - e * tx) / (a * e - b * d) AS x, -d / (a * e - b * d) * x + a / (a * e - b * d) * y + (d * tx - a * ty) / (a * e - b * d) AS y FROM (SELECT a.vec_id, a.x, a.y, v.view, v.a, v.b, v.tx, v.d, v.e, v.ty FROM a, v))
SELECT vec_id, view, round(x, 6) AS x, round(y, 6) AS y FROM m WHERE x >= 0 AND x < 200 AND y >= 0 AND y < 200""")
def view_back_mapping(spark, sf):
    views = spark.createDataFrame([("identity", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("flip", [-1.0, 0.0, 200.0, 0.0, 1.0, 0.0]), ("turn", [0.8, -0.6, 30.0, 0.6, 0.8, -20.0])], "view string, m array<double>")
    p = _points(spark, sf, 1, 2).withColumn("view", F.explode(F.array(*map(F.lit, ("identity", "flip", "turn")))))
    return match.back_mapped(p, views, 200.0).select("vec_id", "view", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH o AS (SELECT l_partkey AS point, l_returnflag || l_linestatus AS view, l_discount / 3 AS distance, l_quantity / 50 AS score FROM lineitem),
g AS (SELECT point, count(DISTINCT view) / 4.0 AS presence, median(distance) AS error, avg(score) AS s FROM o GROUP BY 1), f AS (SELECT *, presence * exp(-error / 0.025) * least(greatest(s, 0.0), 1.0) AS confidence FROM g)
SELECT point, round(presence, 6) AS presence, round(error, 6) AS error, round(confidence, 6) AS confidence, (presence >= 0.75 AND error <= 0.025 AND confidence >= 0.15)::INT AS accepted FROM f""")
def consensus_filter(spark, sf):
    o = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("point"), F.concat("l_returnflag", "l_linestatus").alias("view"), (F.col("l_discount") / 3).alias("distance"), (F.col("l_quantity") / 50).alias("score"))
    c = match.consensus(o, ["point"], 4, confidence=0.15)
    return c.select("point", *[F.round(k, 6).alias(k) for k in ("presence", "error", "confidence")], "accepted")


@query(f"""WITH p AS (SELECT item, floor(x)::INT AS x, floor(y)::INT AS y, max(vec_id) AS v FROM ({_POINTS.format(i=5, j=6)}) GROUP BY ALL), b AS (SELECT item, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM p GROUP BY item)
SELECT item, x0, y0, x1, y1, area, round(sqrt((x1 - x0 + 1) ** 2 + (y1 - y0 + 1) ** 2), 6) AS diagonal, round(area / 40000.0, 8) AS area_share, (x0 = 0 OR y0 = 0 OR x1 = 199 OR y1 = 199)::INT AS touches_border FROM b""")
def mask_geometry(spark, sf):
    g = raster.geometry(_mask(spark, sf), 200, 200)
    return g.withColumns({"diagonal": F.round("diagonal", 6), "area_share": F.round("area_share", 8)})


def _mask(spark, sf) -> DataFrame:
    return _points(spark, sf, 5, 6).select("item", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).distinct()


@query(f"""WITH p AS (SELECT DISTINCT item, floor(x)::INT AS x, floor(y)::INT AS y FROM ({_POINTS.format(i=5, j=6)})), d AS (SELECT DISTINCT item, x + a.v AS x, y + b.v AS y FROM p, (VALUES (-2), (-1), (0), (1), (2)) AS a(v), (VALUES (-2), (-1), (0), (1), (2)) AS b(v))
SELECT item, count(*) AS area, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM d GROUP BY item""")
def mask_dilation(spark, sf):
    return raster.dilate_pixels(_mask(spark, sf), 2).groupBy("item").agg(F.count("*").alias("area"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH q AS ({_POINTS.format(i=7, j=8)}), p AS (SELECT DISTINCT item, floor(x)::INT AS x, floor(y)::INT AS y FROM ({_POINTS.format(i=5, j=6)}))
SELECT q.vec_id, (p.item IS NOT NULL)::INT AS hit FROM q LEFT JOIN p ON p.item = q.item AND p.x = least(greatest(round_even(q.x, 0), 0), 199) AND p.y = least(greatest(round_even(q.y, 0), 0), 199)""")
def mask_lookup(spark, sf):
    return raster.lookup(_points(spark, sf, 7, 8), _mask(spark, sf), 200, 200).select("vec_id", "hit")


@query(f"""WITH p AS (SELECT DISTINCT item, floor(x)::INT AS x, floor(y)::INT AS y FROM ({_POINTS.format(i=5, j=6)})), e AS (SELECT a.item, a.x, a.y FROM p a JOIN p b ON a.item = b.item AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)),
g AS (SELECT item, x, y, count(*) AS degree FROM e GROUP BY ALL) SELECT item, CASE WHEN degree = 1 THEN 'endpoint' WHEN degree >= 3 THEN 'junction' ELSE 'path' END AS kind, count(*) AS n FROM g GROUP BY ALL""")
def pixel_degrees(spark, sf):
    d = graph.degrees(graph.pixel_edges(_mask(spark, sf)))
    return d.groupBy("item", "kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, CASE (doc_id % 5) WHEN 0 THEN 'endpoint' WHEN 1 THEN 'junction' WHEN 2 THEN 'basal_transition' WHEN 3 THEN 'corner' ELSE 'distinctive' END AS kind, least(n_chars / 2000.0, 1) AS c, (doc_id % 10) / 10.0 AS a FROM documents),
v AS (SELECT *, CASE kind WHEN 'endpoint' THEN 0.68 WHEN 'junction' THEN 0.76 WHEN 'basal_transition' THEN 0.80 WHEN 'corner' THEN 0.32 ELSE 0.30 END::DOUBLE + 0.24::DOUBLE * c + 0.08::DOUBLE * a AS score FROM s)
SELECT doc_id, kind, round(score, 6) AS score FROM v WHERE CASE kind WHEN 'corner' THEN score >= 0.56 WHEN 'distinctive' THEN score >= 0.57 ELSE TRUE END""")
def structure_scores(spark, sf):
    kinds = F.array(*map(F.lit, ("endpoint", "junction", "basal_transition", "corner", "distinctive")))
    d = table(spark, sf, "documents").select("doc_id", kinds[(F.col("doc_id") % 5).cast("int")].alias("kind"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("c"), ((F.col("doc_id") % 10) / 10.0).alias("a"))
    d = d.withColumn("score", keypoints.structure_score("kind", "c", "a"))
    return d.filter(keypoints.accepted("kind", "score")).select("doc_id", "kind", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey, round(p_size * 518 / greatest(p_size, 40.0), 4) AS fitted, round(518.0 / greatest(p_size, 40), 6) AS scale, floor((518 - round_even(p_size * (518.0 / greatest(p_size, 40))::DOUBLE, 0)) / 2)::DOUBLE AS pad_x, floor((518 - round_even(40 * (518.0 / greatest(p_size, 40))::DOUBLE, 0)) / 2)::DOUBLE AS pad_y FROM part""")
def letterbox_mapping(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_size", S.letterbox("p_size", F.lit(40), 518).alias("m"))
    return d.select("p_partkey", F.round(F.col("p_size") * F.col("m.scale"), 4).alias("fitted"), F.round("m.scale", 6).alias("scale"), "m.pad_x", "m.pad_y")


# --- sequential, item by item --------------------------------------------------------------------------


@query()
def match_f1_hungarian(spark, sf):
    m = match.match_sets(_points(spark, sf, 1, 2), _points(spark, sf, 3, 4), "item", 10.0)
    return m.select("item", "n_a", "n_b", "matches", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1", "error")])


_GREEDY = f"""a AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY x, y) AS k FROM ({_POINTS.format(i=1, j=2)})), b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY x, y) AS k FROM ({_POINTS.format(i=3, j=4)})),
p AS (SELECT item, ka, kb, d, row_number() OVER (PARTITION BY item ORDER BY d, ka, kb) AS n FROM (SELECT a.item, a.k AS ka, b.k AS kb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM a JOIN b ON a.item = b.item) WHERE d <= 10),
g(item, n, ua, ub, ds) AS (SELECT DISTINCT item, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::DOUBLE[] FROM a UNION ALL SELECT item, pn, CASE WHEN free THEN list_append(ua, ka) ELSE ua END, CASE WHEN free THEN list_append(ub, kb) ELSE ub END, CASE WHEN free THEN list_append(ds, d) ELSE ds END
 FROM (SELECT g.*, p.n AS pn, p.ka, p.kb, p.d, NOT list_contains(ua, ka) AND NOT list_contains(ub, kb) AS free FROM g JOIN p ON p.item = g.item AND p.n = g.n + 1)),
h AS (SELECT item, arg_max(ds, n) AS ds FROM g GROUP BY item), m AS (SELECT item, count(*)::INT AS n_a, count(*)::INT AS n_b FROM a GROUP BY item),
f AS (SELECT item, n_a, n_b, len(ds)::INT AS matches, round(len(ds) / n_b, 6) AS precision, round(len(ds) / n_a, 6) AS recall, round(CASE WHEN len(ds) = 0 THEN 0 ELSE 2 * (len(ds) / n_b) * (len(ds) / n_a) / (len(ds) / n_b + len(ds) / n_a) END, 6) AS f1, round(list_median(ds), 6) AS error FROM h JOIN m USING (item))"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT * FROM f")
def match_f1_greedy(spark, sf):
    m = match.match_sets(_points(spark, sf, 1, 2), _points(spark, sf, 3, 4), "item", 10.0, "greedy")
    return m.select("item", "n_a", "n_b", "matches", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1", "error")])


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, y, x) AS k FROM (SELECT q.*, e.embedding[10]::DOUBLE AS score FROM ({_POINTS.format(i=1, j=2)}) q JOIN embeddings e USING (vec_id))),
r(item, k, kept) AS (SELECT DISTINCT item, 0::BIGINT, []::STRUCT(v BIGINT, x DOUBLE, y DOUBLE)[] FROM p UNION ALL
 SELECT r.item, p.k, CASE WHEN len(list_filter(r.kept, lambda q: sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) < 8)) = 0 THEN list_append(r.kept, {{'v': p.vec_id, 'x': p.x, 'y': p.y}}) ELSE r.kept END FROM r JOIN p ON p.item = r.item AND p.k = r.k + 1),
f AS (SELECT item, arg_max(kept, k) AS kept FROM r GROUP BY item), u AS (SELECT item, unnest(range(1, len(kept) + 1))::INT AS rank, unnest(kept).v AS vec_id FROM f) SELECT item, rank, vec_id FROM u""")
def greedy_nms(spark, sf):
    p = _points(spark, sf, 1, 2).join(table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[9].cast("double").alias("score")), "vec_id")
    return match.suppressed(p, "item", 8.0).select("item", "rank", "vec_id")


@query(f"""WITH RECURSIVE s AS (SELECT item, x, y, ['endpoint', 'junction', 'basal_transition', 'corner'][(vec_id % 4) + 1] AS kind, (vec_id % 97) / 97.0::DOUBLE AS score FROM ({_POINTS.format(i=1, j=2)})),
p AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE kind WHEN 'basal_transition' THEN 0 WHEN 'endpoint' THEN 1 ELSE 2 END, score DESC, kind, y, x) AS k FROM s),
r(item, k, kept) AS (SELECT DISTINCT item, 0::BIGINT, []::STRUCT(x DOUBLE, y DOUBLE, kind VARCHAR, score DOUBLE, roles VARCHAR[])[] FROM p UNION ALL
 SELECT item, pk, CASE WHEN place IS NULL OR place = 0 THEN list_append(kept, {{'x': px, 'y': py, 'kind': pkind, 'score': pscore, 'roles': [pkind]}})
  ELSE list_transform(kept, lambda q, i: {{'x': q.x, 'y': q.y, 'kind': q.kind, 'score': q.score, 'roles': CASE WHEN i = place THEN list_append(q.roles, pkind) ELSE q.roles END}}) END
 FROM (SELECT r.item, r.kept, p.k AS pk, p.x AS px, p.y AS py, p.kind AS pkind, p.score AS pscore, list_position(list_transform(r.kept, lambda q: (q.x - p.x) ** 2 + (q.y - p.y) ** 2 <= 36), true) AS place FROM r JOIN p ON p.item = r.item AND p.k = r.k + 1)),
f AS (SELECT item, unnest(arg_max(kept, k)) AS q FROM r GROUP BY item) SELECT item, q.x AS x, q.y AS y, q.kind AS kind, round(q.score, 6) AS score, array_to_string(list_sort(list_distinct(q.roles)), ';') AS roles FROM f""")
def structure_coverage(spark, sf):
    kinds = F.array(*map(F.lit, ("endpoint", "junction", "basal_transition", "corner")))
    p = _points(spark, sf, 1, 2).select("item", "x", "y", kinds[(F.col("vec_id") % 4).cast("int")].alias("kind"), ((F.col("vec_id") % 97) / 97.0).alias("score"))
    return keypoints.cover(p, "item", 6.0).withColumns({"score": F.round("score", 6), "roles": F.array_join("roles", ";")})


@query(f"""WITH p AS ({_POINTS.format(i=1, j=2)}), s AS ({_POINTS.format(i=3, j=4)}), a AS (SELECT item, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM s GROUP BY item),
e AS (SELECT s.item, max(x * cos(t) + y * sin(t)) - min(x * cos(t) + y * sin(t)) AS e FROM s JOIN a USING (item) GROUP BY 1), f AS (SELECT p.item, max(x * cos(t) + y * sin(t)) - min(x * cos(t) + y * sin(t)) AS f FROM p JOIN a USING (item) GROUP BY 1)
SELECT item, round(least(greatest(f / greatest(e, 1e-9), 0.0), 1.5), 6) AS span_ratio FROM e JOIN f USING (item)""")
def principal_span(spark, sf):
    return keypoints.span_ratio(_points(spark, sf, 1, 2), _points(spark, sf, 3, 4), "item").withColumn("span_ratio", F.round("span_ratio", 6))


@query(f"""WITH c AS (SELECT item, x, y, round_even(x, 0)::INT + a AS gx, round_even(y, 0)::INT + b AS gy FROM ({_POINTS.format(i=1, j=2)}), (SELECT unnest(range(-6, 7))::INT AS a), (SELECT unnest(range(-6, 7))::INT AS b)),
h AS (SELECT item, gx, gy, max(exp(-((gx - x) ** 2 + (gy - y) ** 2) / 8.0)) AS v FROM c WHERE gx BETWEEN 0 AND 199 AND gy BETWEEN 0 AND 199 GROUP BY ALL),
n AS (SELECT a.item, a.gx, a.gy, a.v, max(b.v) AS top FROM h a JOIN h b ON a.item = b.item AND abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2 WHERE a.v >= 0.35 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY v DESC, gy, gx) AS rank FROM n WHERE v >= top) SELECT item, gx AS x, gy AS y, round(v, 6) AS value FROM r WHERE rank <= 64""")
def heatmap_peaks(spark, sf):
    p = _points(spark, sf, 1, 2).withColumn("confidence", F.lit(1.0))
    h = raster.heatmap(p, 2.0, 200, 200).select("item", F.col("gx").alias("x"), F.col("gy").alias("y"), "value")
    return match.decoded(h, "item", "value").select("item", "x", "y", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE p AS (SELECT user_id, t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM ({_SERIES})),
s(user_id, a, b) AS (SELECT user_id, 0::BIGINT, max(k) FROM p GROUP BY user_id UNION ALL SELECT user_id, unnest([a, m]), unnest([m, b]) FROM (
 SELECT user_id, a, b, arg_max(k, (off, -k)) AS m, max(off) AS off FROM (SELECT user_id, a, b, k, sqrt((qx - r * dx) ** 2 + (qy - r * dy) ** 2) AS off FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((qx * dx + qy * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS r FROM (
  SELECT s.user_id, s.a, s.b, q.k, y.t - x.t AS dx, y.v - x.v AS dy, q.t - x.t AS qx, q.v - x.v AS qy FROM s JOIN p x ON x.user_id = s.user_id AND x.k = s.a JOIN p y ON y.user_id = s.user_id AND y.k = s.b JOIN p q ON q.user_id = s.user_id AND q.k > s.a AND q.k < s.b))) GROUP BY user_id, a, b) WHERE off > 5),
k AS (SELECT user_id, a AS k FROM s UNION SELECT user_id, b FROM s) SELECT user_id, k::INT AS position, round(t, 6) AS x, round(v, 6) AS y FROM k JOIN p USING (user_id, k)""")
def rdp_simplify(spark, sf):
    out = curve.simplified_paths(_series(spark, sf), "user_id", "event_id", "t", "value", 5.0)
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


def _slope(d: str) -> str:
    """SQL of the slope at a point from the steps d of the stretches and their lengths h."""

    def end(h0: str, h1: str, d0: str, d1: str) -> str:
        e = f"((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})"
        return f"CASE WHEN {e} * {d0} <= 0 THEN 0 WHEN {d0} * {d1} <= 0 AND abs({e}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {e} END"

    before = lambda c, n=1: f"lag({c}, {n}) OVER w"
    inner = f"CASE WHEN {before(d)} * {d} > 0 THEN (3 * h + 3 * {before('h')}) / ((2 * h + {before('h')}) / {before(d)} + (h + 2 * {before('h')}) / {d}) ELSE 0 END"
    first, last = end("h", "lead(h) OVER w", d, f"lead({d}) OVER w"), end(before("h"), before("h", 2), before(d), before(d, 2))
    return f"CASE WHEN n = 2 THEN coalesce({d}, {before(d)}) WHEN k = 0 THEN {first} WHEN k = n - 1 THEN {last} ELSE {inner} END"


_HERMITE = lambda v, m: f"(1 + 2 * u) * (1 - u) ** 2 * {v} + u * (1 - u) ** 2 * h * {m} + u ** 2 * (3 - 2 * u) * {v}1 + u ** 2 * (u - 1) * h * {m}1"


@query(f"""WITH r AS (SELECT user_id, event_id, t AS x, value AS y, lag(t) OVER w AS px, lag(value) OVER w AS py FROM ({_SERIES}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT user_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE px IS NULL OR px <> x OR py <> y),
g AS (SELECT *, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS h FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k)),
d AS (SELECT *, (lead(x) OVER w - x) / h AS dx, (lead(y) OVER w - y) / h AS dy, coalesce(sum(h) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM g WINDOW w AS (PARTITION BY user_id ORDER BY k)),
m AS (SELECT *, {_slope("dx")} AS mx, {_slope("dy")} AS my FROM d WINDOW w AS (PARTITION BY user_id ORDER BY k)),
i AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(mx) OVER w AS mx1, lead(my) OVER w AS my1, s + h AS s1, max(s) OVER (PARTITION BY user_id) AS total FROM m WINDOW w AS (PARTITION BY user_id ORDER BY k)),
j AS (SELECT *, unnest(range(48)) AS position FROM i WHERE k < n - 1 OR n = 1), c AS (SELECT *, total * (position / 47.0::DOUBLE) AS z FROM j), u AS (SELECT *, (z - s) / h AS u FROM c WHERE n = 1 OR (z >= s AND (z < s1 OR k = n - 2)))
SELECT user_id, position::INT AS position, round(CASE WHEN n = 1 THEN x ELSE {_HERMITE("x", "mx")} END, 5) AS x, round(CASE WHEN n = 1 THEN y ELSE {_HERMITE("y", "my")} END, 5) AS y FROM u""")
def pchip_resample(spark, sf):
    out = curve.resampled_paths(_series(spark, sf), "user_id", "event_id", "t", "value", 48)
    return out.withColumns({"x": F.round("x", 5), "y": F.round("y", 5)})


# The parts and suppliers of an order are a small graph, and orders grow in number.
_GRAPH = "SELECT l_orderkey AS item, 'p' || l_partkey AS a, 's' || l_suppkey AS b, l_extendedprice::DOUBLE AS weight FROM lineitem"


def _trade(spark, sf) -> DataFrame:
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    d = table(spark, sf, "lineitem")
    return d.select(F.col("l_orderkey").alias("item"), name("p", "l_partkey").alias("a"), name("s", "l_suppkey").alias("b"), F.col("l_extendedprice").cast("double").alias("weight"))


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight, a, b) AS k FROM ({_GRAPH})), w AS (SELECT item, a AS x, b AS y, k FROM e UNION ALL SELECT item, b, a, k FROM e),
r(item, k, node) AS (SELECT item, k, a FROM e UNION SELECT r.item, r.k, w.y FROM r JOIN w ON w.item = r.item AND w.x = r.node AND w.k < r.k)
SELECT item, a, b, round(weight, 6) AS weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.item = e.item AND r.k = e.k AND r.node = e.b)""")
def mst_geodesic(spark, sf):
    return graph.spanning_trees(_trade(spark, sf), "item", "a", "b", "weight").withColumn("weight", F.round("weight", 6))


@query(f"""WITH RECURSIVE e AS ({_GRAPH}), w AS (SELECT item, a AS x, b AS y, weight FROM e UNION ALL SELECT item, b, a, weight FROM e), f AS (SELECT item, least(min(a), min(b)) AS node FROM e GROUP BY item),
r(item, node, distance, hops, seen) AS (SELECT item, node, 0.0::DOUBLE, 0, [node] FROM f UNION ALL SELECT r.item, w.y, r.distance + w.weight, r.hops + 1, list_append(r.seen, w.y) FROM r JOIN w ON w.item = r.item AND w.x = r.node AND NOT list_contains(r.seen, w.y))
SELECT item, node, round(min(distance), 4) AS distance, arg_min(hops, distance) AS hops FROM r GROUP BY item, node""")
def dijkstra_paths(spark, sf):
    return graph.distances_from(_trade(spark, sf), "item", "a", "b", "weight").withColumn("distance", F.round("distance", 4))


@query(f"""WITH RECURSIVE e AS ({_GRAPH}), w AS (SELECT item, a AS x, b AS y, weight FROM e UNION ALL SELECT item, b, a, weight FROM e), f AS (SELECT item, least(min(a), min(b)) AS node FROM e GROUP BY item),
r(item, node, distance, seen) AS (SELECT item, node, 0.0::DOUBLE, [node] FROM f UNION ALL SELECT r.item, w.y, r.distance + w.weight, list_append(r.seen, w.y) FROM r JOIN w ON w.item = r.item AND w.x = r.node AND NOT list_contains(r.seen, w.y)),
b AS (SELECT item, node, arg_min(seen, distance) AS seen FROM r GROUP BY item, node)
SELECT item, node, unnest(range(len(seen)))::INT AS step, unnest(seen) AS via FROM b""")
def shortest_path_rows(spark, sf):
    return graph.path_rows(graph.shortest_trees(_trade(spark, sf), "item", "a", "b", "weight"), "item")


@query()
def mask_skeleton(spark, sf):
    return raster.skeleton_pixels(raster.dilate_pixels(_mask(spark, sf), 3))


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT item, floor(x)::INT AS x, floor(y)::INT AS y FROM ({_POINTS.format(i=5, j=6)})), d AS (SELECT DISTINCT item, x + a AS x, y + b AS y FROM p, (SELECT unnest(range(-2, 3))::INT AS a), (SELECT unnest(range(-2, 3))::INT AS b)),
e AS (SELECT a.item, a.x * 1000 + a.y AS i, b.x * 1000 + b.y AS j FROM p a JOIN p b ON a.item = b.item AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5), r(item, i, j) AS (SELECT item, i, i FROM e UNION SELECT r.item, r.i, e.j FROM r JOIN e ON e.item = r.item AND e.i = r.j),
c AS (SELECT item, i, min(j) AS root FROM r GROUP BY item, i), o AS (SELECT DISTINCT d.item, d.x, d.y, c.root FROM d JOIN p ON p.item = d.item AND abs(p.x - d.x) <= 2 AND abs(p.y - d.y) <= 2 JOIN c ON c.item = p.item AND c.i = p.x * 1000 + p.y)
SELECT item, count(*)::INT AS pixels, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM o GROUP BY item, root""")
def mask_components(spark, sf):
    c = raster.component_sizes(raster.dilate_pixels(_mask(spark, sf), 2))
    return c.select("item", "pixels", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query()
def skeleton_structures(spark, sf):
    return plant.structures(raster.dilate_pixels(_mask(spark, sf), 6))


@query()
def rooted_organ_paths(spark, sf):
    return graph.organ_path_table(raster.dilate_pixels(_mask(spark, sf), 6))


@query()
def structural_candidates(spark, sf):
    m = raster.dilate_pixels(_mask(spark, sf), 6)
    maps = {"contrast": ((F.col("x") * 7 + F.col("y") * 13) % 50) / 50.0, "attention": ((F.col("x") + F.col("y") * 3) % 20) / 20.0}
    return plant.candidates(m.withColumns(maps))


@query()
def point_conditioned_sweep(spark, sf):
    skel = raster.skeleton_pixels(raster.dilate_pixels(_mask(spark, sf), 3))
    p = _points(spark, sf, 5, 6).withColumn("score", F.lit(1.0))
    return graph.point_graphs(skel, p, [0.015, 0.025, 0.05])


@query(f"""WITH RECURSIVE {_GREEDY}, o AS (SELECT median(f1) AS f1, median(error) AS error FROM f), c AS (SELECT *, f1 >= 0.7 AS repeatable, coalesce(error, 1e9) <= 5.0 AS localised FROM o)
SELECT round(f1, 6) AS f1, round(error, 6) AS error, array_to_string(list_filter([CASE WHEN NOT localised THEN 'localised' END, CASE WHEN NOT repeatable THEN 'repeatable' END], lambda x: x IS NOT NULL), ';') AS failed, CASE WHEN repeatable AND localised THEN 'pass' ELSE 'stop_or_revise' END AS status FROM c""")
def gate_from_matches(spark, sf):
    m = match_f1_greedy(spark, sf)
    one = m.agg(robust.finite_median("f1").alias("f1"), robust.finite_median("error").alias("error"))
    gate = audit.gate(one, {"repeatable": F.col("f1") >= 0.7, "localised": F.coalesce(F.col("error"), F.lit(1e9)) <= 5.0}, ("visual_review",))
    return gate.select(F.round("f1", 6).alias("f1"), F.round("error", 6).alias("error"), "failed", "status")
