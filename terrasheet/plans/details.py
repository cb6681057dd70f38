"""Further queries: idioms of filtering, reshaping, geometry and statistics of the sheet workflow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X
from ..operators import fits as T
from ..operators import lines as L
from ..operators import relational as J
from ..operators import spatial as S
from .registry import boxes, det, pairs, query, ref, table, tiles

R6 = lambda c: F.round(c, 6)


@query("""SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 3) AND NOT contains(CASE WHEN p_size % 2 = 0 THEN 'tfw' ELSE 'tif' END, 'w')""")
def p02_p07_extension_and_class(spark, sf):
    p = table(spark, sf, "part")
    kinds = p.select("p_type").distinct().orderBy("p_type").limit(3)
    ext = F.when(F.col("p_size") % 2 == 0, "tfw").otherwise("tif")
    return p.join(kinds, "p_type", "left_semi").where(~F.contains(ext, F.lit("w"))).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))


@query("""SELECT image, seq FROM boxes WHERE x1 > 20 AND (x1+x2)/2 BETWEEN 25-10 AND 40+10 AND (y1+y2)/2 BETWEEN 3-1 AND 5+1""", "boxes")
def p03_p05_threshold_and_padding(spark, sf):
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return boxes(spark, sf).where((F.col("x1") > 20) & cx.between(25 - 10, 40 + 10) & cy.between(3 - 1, 5 + 1)).select("image", "seq")


@query("""SELECT id, coalesce(CAST(g AS VARCHAR), 'none') AS geoid, CAST(x AS VARCHAR) IS NOT NULL AS has_x FROM (SELECT id, x, CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS g FROM ref) WHERE x IS NOT NULL""", "ref")
def p10_p12_nulls_and_strings(spark, sf):
    r = ref(spark, sf).withColumn("g", F.when(F.col("id") % 4 != 0, F.col("id"))).dropna(subset=["x"])
    return r.select("id", F.coalesce(F.col("g").cast("string"), F.lit("none")).alias("geoid"), F.col("x").cast("string").isNotNull().alias("has_x"))


@query("""SELECT c_custkey AS id, n_name AS nation, r_name AS region, o.n AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON k = c_custkey""")
def j06_j17_left_merges(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(o, F.col("c_custkey") == F.col("k"), "left")
    return j.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "orders")


@query("""SELECT t.id, t.name, round(r.x, 6) AS x, round(r.y, 6) AS y FROM tiles t JOIN ref r ON r.id = t.num""", "tiles ref")
def j23_gcps_of_tiles(spark, sf):
    r = ref(spark, sf).withColumnRenamed("id", "num")
    return tiles(spark, sf).join(r, "num").select("id", "name", R6(F.col("x")).alias("x"), R6(F.col("y")).alias("y"))


@query("""SELECT id, i AS part, CASE WHEN i = 0 THEN x ELSE tx END AS ex, CASE WHEN i = 0 THEN y ELSE ty END AS ey FROM (SELECT id, grp, round(x, 6) AS x, round(y, 6) AS y, round(tx, 6) AS tx, round(ty, 6) AS ty, unnest([0, 1]) AS i FROM pairs)""", "pairs")
def r07_j28_line_endpoints(spark, sf):
    p = pairs(spark, sf)
    ends = F.array(F.struct(R6(F.col("x")).alias("ex"), R6(F.col("y")).alias("ey")), F.struct(R6(F.col("tx")).alias("ex"), R6(F.col("ty")).alias("ey")))
    return p.select("id", F.posexplode(ends).alias("part", "e")).select("id", "part", "e.ex", "e.ey")


@query("""SELECT grp, round(quantile_cont(y, 0), 6) AS p0, round(quantile_cont(y, 0.25), 6) AS p25, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75, round(quantile_cont(y, 1), 6) AS p100, round(sqrt(avg(y*y)), 6) AS rms FROM det GROUP BY grp""", "det")
def a05_a06_percentiles_and_rms(spark, sf):
    p = F.percentile("y", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    d = det(spark, sf).groupBy("grp").agg(p.alias("p"), R6(F.sqrt(F.avg(F.col("y") * F.col("y")))).alias("rms"))
    return d.select("grp", *[R6(F.col("p")[i]).alias(n) for i, n in enumerate(("p0", "p25", "p50", "p75", "p100"))], "rms")


@query("""SELECT image, round(min(x1), 6) AS x1, round(min(y1), 6) AS y1, round(max(x2), 6) AS x2, round(max(y2), 6) AS y2, count_if(x2 - x1 > 5) AS foreground FROM boxes GROUP BY image""", "boxes")
def a09_a22_extent_and_count(spark, sf):
    b = boxes(spark, sf).groupBy("image")
    return b.agg(R6(F.min("x1")).alias("x1"), R6(F.min("y1")).alias("y1"), R6(F.max("x2")).alias("x2"), R6(F.max("y2")).alias("y2"), F.count_if(F.col("x2") - F.col("x1") > 5).alias("foreground"))


@query("""SELECT count(*) AS images, count_if(n <= 2) AS few FROM (SELECT image, count(*) AS n FROM boxes GROUP BY image)""", "boxes")
def a23_corner_counts(spark, sf):
    n = boxes(spark, sf).groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("n") <= 2).alias("few"))


@query("""SELECT user_id, event_id AS id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS unsure_n, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_word FROM events""")
def w05_w07_counters_and_next(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.sum((F.col("event_type") == "error").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), n.alias("unsure_n"), F.lead("event_type").over(w).alias("next_word"))


@query("""WITH r AS (SELECT id, grp, y, row_number() OVER (PARTITION BY grp ORDER BY y, id) AS rn, lead(y) OVER (PARTITION BY grp ORDER BY y, id) AS second FROM det) SELECT grp, id, y AS d1, second AS d2 FROM r WHERE rn = 1""", "det")
def w02_two_smallest(spark, sf):
    w = Window.partitionBy("grp").orderBy("y", "id")
    d = det(spark, sf).withColumn("rn", F.row_number().over(w)).withColumn("d2", F.lead("y").over(w))
    return d.where("rn = 1").select("grp", "id", F.col("y").alias("d1"), "d2")


@query("""SELECT image, label AS top FROM (SELECT image, label, row_number() OVER (PARTITION BY image ORDER BY (x2-x1)*(y2-y1) DESC, label, seq) AS rn FROM boxes) WHERE rn = 1""", "boxes")
def t03_largest_box(spark, sf):
    b = boxes(spark, sf)
    return b.groupBy("image").agg(F.min_by("label", F.struct(-G.area(G.box()), F.col("label"), F.col("seq"))).alias("top"))


@query("""WITH l AS (SELECT DISTINCT s_nationkey AS b, s_name AS n FROM supplier), s AS (SELECT b, n, c_custkey AS id, round(100.0*(1 - levenshtein(n, c_name)*1.0/greatest(length(n), length(c_name), 1)), 4) AS score FROM l JOIN customer ON c_nationkey = b), r AS (SELECT *, row_number() OVER (PARTITION BY b, n ORDER BY score DESC, id) AS rn FROM s) SELECT b AS block, n AS name, id, score, rn AS place FROM r WHERE rn <= 5""")
def t04_fuzzy_top_five(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_name").alias("other"), F.col("c_custkey").alias("id"))
    best = J.best_matches(s, c, "block", "name", "other", X.edit_score(F.col("name"), F.col("other")), "id", 5)
    return best.select("block", "name", "id", "score", F.col("place").cast("long").alias("place"))


@query()
def t06_split_80_20(spark, sf):
    """A split that a hash of the id and a seed decides: repeatable, and without a sort."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.withColumn("part", F.when(F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(10)) < 8, "train").otherwise("val")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, list_sort(list_transform(a, x -> x)) AS cols FROM (SELECT p_partkey AS id, [p_size, p_size * 7 % 13, 2] AS a FROM part)""".replace("SELECT id, list_sort(list_transform(a, x -> x)) AS cols", "SELECT id, list_sort(a)[1] AS first, list_sort(a)[3] AS last"))
def t07_array_sort(spark, sf):
    a = F.array_sort(F.array("p_size", F.col("p_size") * 7 % 13, F.lit(2)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), a[0].alias("first"), a[2].alias("last"))


@query("""SELECT id, CAST(len(list_intersect(a, b)) AS INTEGER) AS both_n, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS only_a FROM (SELECT p_partkey AS id, list_distinct([p_size % 3, p_size % 5, p_size % 7]) AS a, [0, 1, 2] AS b FROM part)""")
def u03_u05_array_sets(spark, sf):
    a = F.array_distinct(F.array(F.col("p_size") % 3, F.col("p_size") % 5, F.col("p_size") % 7))
    b = F.array(F.lit(0), F.lit(1), F.lit(2))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.size(F.array_intersect(a, b)).alias("both_n"), F.size(F.array_except(a, b)).alias("only_a"))


@query("""SELECT id, round(0.4*least(x/1000,1) + 0.3*0.5 + 0.3*coalesce(nullif(id%3, 0)*0.1, 1), 6) AS weight FROM ref""", "ref")
def m05_match_weights(spark, sf):
    last = F.coalesce(F.nullif(F.col("id") % 3, F.lit(0)) * 0.1, F.lit(1.0))
    return ref(spark, sf).select("id", R6(0.4 * F.least(F.col("x") / 1000, F.lit(1.0)) + 0.3 * F.lit(0.5) + 0.3 * last).alias("weight"))


@query("""SELECT image, seq, k AS corner, CASE WHEN k IN (0, 3) THEN round(x1, 6) ELSE round(x2, 6) END AS x, CASE WHEN k IN (0, 1) THEN round(y1, 6) ELSE round(y2, 6) END AS y FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM boxes)""", "boxes")
def m07_box_corners(spark, sf):
    p = lambda x, y: F.struct(R6(F.col(x)).alias("x"), R6(F.col(y)).alias("y"))
    c = F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2"))
    return boxes(spark, sf).select("image", "seq", F.posexplode(c).alias("corner", "p")).select("image", "seq", "corner", "p.x", "p.y")


@query("""WITH a AS (SELECT DISTINCT CAST(floor(x1) AS BIGINT) AS r, CAST(floor(y1) AS BIGINT) AS c FROM boxes WHERE label = 'A'), b AS (SELECT DISTINCT CAST(floor(x1) AS BIGINT) AS r, CAST(floor(y1) AS BIGINT) AS c FROM boxes WHERE label = 'R') SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_n, round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) * 1.0 / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS iou""", "boxes")
def m09_mask_iou(spark, sf):
    px = boxes(spark, sf).groupBy(F.floor("x1").alias("r"), F.floor("y1").alias("c")).agg(F.bool_or(F.col("label") == "A").alias("a"), F.bool_or(F.col("label") == "R").alias("b"))
    return px.agg(F.count_if(F.col("a") & F.col("b")).alias("both_n"), R6(F.count_if(F.col("a") & F.col("b")) / F.nullif(F.count_if(F.col("a") | F.col("b")), F.lit(0))).alias("iou"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN NULL ELSE 'EPSG:' || (2274 + s_suppkey % 6) END AS crs FROM supplier""")
def m12_state_plane(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), G.state_plane(F.concat(F.lit("420"), (F.col("s_suppkey") % 6).cast("string"))).alias("crs"))


@query("""SELECT id, CASE WHEN abs(y) > 200 THEN 'ESRI:102740' ELSE 'EPSG:32615' END AS crs, round(x + 0.5*10 , 6) AS px, round(y - 0.5*20, 6) AS py FROM ref""", "ref")
def m13_m17_geotransform(spark, sf):
    """A world file's transform, its guessed reference system, and pixel (20, 10) through flip and shift."""
    world = G.affine(0.5, 0, F.col("x"), 0, 0.5, F.col("y"))
    flip = G.compose(G.affine(1, 0, 0, 0, 1, 0), G.affine(1, 0, 0, 0, -1, 0))
    x, y = G.apply(G.compose(world, flip), F.lit(10.0), F.lit(20.0))
    return ref(spark, sf).select("id", F.when(F.abs("y") > 200, "ESRI:102740").otherwise("EPSG:32615").alias("crs"), R6(x).alias("px"), R6(y).alias("py"))


@query("""SELECT id, round(degrees(x/6378137), 9) AS lon, round(degrees(2*atan(exp(y/6378137)) - pi()/2), 9) AS lat FROM (SELECT id, x*1000 AS x, y*1000 AS y FROM ref)""", "ref")
def m15_from_mercator(spark, sf):
    lon, lat = G.from_mercator(F.col("x") * 1000, F.col("y") * 1000)
    return ref(spark, sf).select("id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("""SELECT id, grp, round(x - 0.1*(tx-x), 6) AS ax, round(y - 0.1*(ty-y), 6) AS ay, round(tx + 0.1*(tx-x), 6) AS bx, round(degrees(atan2(ty-y, tx-x)), 2) AS angle FROM pairs""", "pairs")
def m23_m24_extend_lines(spark, sf):
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    return pairs(spark, sf).select("id", "grp", R6(F.col("x") - 0.1 * dx).alias("ax"), R6(F.col("y") - 0.1 * dy).alias("ay"), R6(F.col("tx") + 0.1 * dx).alias("bx"), F.round(F.degrees(F.atan2(dy, dx)), 2).alias("angle"))


@query("""SELECT image, max_by(x, seq) FILTER (x BETWEEN 28 AND 31) AS lat, max_by(x, seq) FILTER (x BETWEEN 40 AND 46) AS lon FROM (SELECT image, seq * 1000 + x1 AS seq, x1 AS x FROM boxes) GROUP BY image""", "boxes")
def m30_coordinate_slots(spark, sf):
    b = boxes(spark, sf).select("image", (F.col("seq") * 1000 + F.col("x1")).alias("seq"), F.col("x1").alias("x"))
    slot = lambda lo, hi: F.max_by(F.when(F.col("x").between(lo, hi), F.col("x")), F.when(F.col("x").between(lo, hi), F.col("seq")))
    return b.groupBy("image").agg(slot(28, 31).alias("lat"), slot(40, 46).alias("lon"))


@query("""SELECT image, seq, round(x1*cos(radians(30)) - y1*sin(radians(30)), 6) AS rx, round(x1*sin(radians(30)) + y1*cos(radians(30)), 6) AS ry, round(x1*2, 6) AS sx FROM boxes""", "boxes")
def m34_m38_rotate_and_scale(spark, sf):
    c, s = F.cos(F.radians(F.lit(30.0))), F.sin(F.radians(F.lit(30.0)))
    return boxes(spark, sf).select("image", "seq", R6(F.col("x1") * c - F.col("y1") * s).alias("rx"), R6(F.col("x1") * s + F.col("y1") * c).alias("ry"), R6(F.col("x1") * 2).alias("sx"))


@query("""WITH c AS (SELECT grp AS g, avg(x) AS cx, avg(y) AS cy FROM det GROUP BY grp) SELECT id, round(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)), 6) AS moved FROM det JOIN c ON grp = g""", "det")
def m37_distance_to_centroid(spark, sf):
    d = det(spark, sf)
    c = d.groupBy("grp").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return d.join(c, "grp").select("id", R6(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("moved"))


@query()
def m26_simplify(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    line = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    return line.select(F.col("o_custkey").alias("id"), F.size("p").alias("n"), F.size(L.simplify(F.col("p"), 20.0)).alias("kept"), R6(L.line_length(F.col("p"))).alias("length"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 100 * 1.0 AS ax, o_orderkey % 37 * 1.0 AS ay, o_orderkey % 71 * 1.0 AS bx, o_orderkey % 53 * 1.0 AS by_ FROM orders), p AS (SELECT a.k, a.id, b.id AS r_id, (a.bx-a.ax)*(b.by_-b.ay)-(a.by_-a.ay)*(b.bx-b.ax) AS det, a.ax, a.ay, a.bx, a.by_, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.by_ AS dy FROM s a JOIN s b ON a.k = b.k AND a.id < b.id), t AS (SELECT *, ((cx-ax)*(dy-cy)-(cy-ay)*(dx-cx))/det AS s, ((cx-ax)*(by_-ay)-(cy-ay)*(bx-ax))/det AS t FROM p WHERE det <> 0) SELECT k, id, r_id, round(ax+s*(bx-ax), 6) AS x, round(ay+s*(by_-ay), 6) AS y FROM t WHERE s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1""")
def m36_crossings(spark, sf):
    o = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), o.alias("id"), *[(o % m).cast("double").alias(c) for c, m in (("ax", 100), ("ay", 37), ("bx", 71), ("by", 53))])
    return L.crossings(s, s, "k").where("id < r_id").select("k", "id", "r_id", R6(F.col("x")).alias("x"), R6(F.col("y")).alias("y"))


@query()
def i15_distinct_lines(spark, sf):
    b = boxes(spark, sf).select("image", "seq", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    return L.distinct_lines(b, "image", ["seq", "ax", "ay", "bx", "by"], 5.0)


def least_turned_area(boxes, key: str, angles: list[float]):
    """(key, area, angle): of all boxes (key, w, h) of a key and all angles the least area round the turned box, to six places, and the smaller angle on ties.

    A box's angles are compared where it is, in arrays. Area and rank of the angle
    are one number, so that the least of a key is found by hash and not by sorting.
    """
    ranked = sorted(angles, key=lambda a: (abs(a), a))
    c, s = (np.abs(f(np.radians(ranked)))[None, :] for f in (np.cos, np.sin))

    def search(batches):
        for batch in batches:
            w, h = (batch.column(i).to_numpy(zero_copy_only=False)[:, None] for i in (1, 2))
            area = np.floor(((w * c + h * s) * (w * s + h * c)) * 1e6 + 0.5)
            at = area.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(area[np.arange(len(at)), at], from_pandas=True), pa.array(at)], names=["key", "area", "rank"])

    kind, n = dict(boxes.dtypes)[key], len(ranked)
    least = boxes.select(F.col(key), F.col("w").cast("double"), F.col("h").cast("double")).mapInArrow(search, f"key {kind}, area double, rank long")
    packed = least.withColumn("_p", F.col("area").cast("decimal(30,0)") * F.lit(n).cast("decimal(7,0)") + F.col("rank")).groupBy("key").agg(F.min(F.col("_p").cast("decimal(38,0)")).alias("_p"))
    # without any area, the first angle
    rank = F.coalesce(F.pmod("_p", F.lit(n).cast("decimal(7,0)")).cast("int"), F.lit(0))
    area = ((F.col("_p") - rank) / F.lit(n).cast("decimal(7,0)")).cast("double") / 1e6
    return packed.select(F.col("key").alias(key), area.alias("area"), F.element_at(F.array(*[F.lit(float(a)) for a in ranked]), rank + 1).alias("angle"))


@query("""WITH a AS (SELECT image, seq, label, x1, x2, y1, y2, unnest(range(-50, 51)) / 10.0 AS angle FROM boxes), s AS (SELECT *, round(((x2-x1)*abs(cos(radians(angle))) + (y2-y1)*abs(sin(radians(angle)))) * ((x2-x1)*abs(sin(radians(angle))) + (y2-y1)*abs(cos(radians(angle)))), 6) AS area FROM a) SELECT image, min(area) AS area, round(min_by(angle, (area, abs(angle), angle)), 1) AS angle FROM s GROUP BY image""", "boxes")
def i19_rotation_search(spark, sf):
    """Of 101 angles that with the least area round the turned box; the smaller one on ties."""
    b = boxes(spark, sf).select("image", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return least_turned_area(b, "image", [i / 10 for i in range(-50, 51)])


@query("""WITH w AS (SELECT *, 1 + id % 3 AS w FROM pairs), m AS (SELECT grp AS g, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*tx)/sum(w) AS mu, sum(w*ty)/sum(w) AS mv FROM w GROUP BY grp) SELECT grp, count(*) AS n, round(sum(w*((x-mx)*(tx-mu)+(y-my)*(ty-mv)))/sum(w*((x-mx)*(x-mx)+(y-my)*(y-my))), 6) AS a, round(sum(w*((x-mx)*(ty-mv)-(y-my)*(tx-mu)))/sum(w*((x-mx)*(x-mx)+(y-my)*(y-my))), 6) AS b FROM w JOIN m ON grp = g GROUP BY grp""", "pairs")
def m20_i17_weighted_similarity(spark, sf):
    g = T.fit_similarity(pairs(spark, sf), ["grp"], (1 + F.col("id") % 3).cast("double"))
    return g.select("grp", "n", R6(F.col("a")).alias("a"), R6(F.col("b")).alias("b"))


@query("""WITH l AS (SELECT conv_id, turn, text, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) SELECT conv_id, turn, coalesce(contains(before, 'the'), false) AS keyword FROM l""")
def d02_line_before(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf, "conversations").withColumn("before", F.lag(F.lower("text")).over(w))
    return c.select("conv_id", "turn", F.coalesce(F.contains("before", F.lit("the")), F.lit(False)).alias("keyword"))


@query("""SELECT num, CASE WHEN num % 2 = 0 THEN count(*) ELSE count(*) FILTER (regexp_matches(name, '[A-Z]$')) END AS dates, max_by(id, struct_pack(d := d, i := id)) AS last_id FROM tiles GROUP BY num""", "tiles")
def d03_dates_by_suffix(spark, sf):
    has = F.col("name").rlike("[A-Z]$")
    n = F.when(F.col("num") % 2 == 0, F.count(F.lit(1))).otherwise(F.count_if(has))
    return tiles(spark, sf).groupBy("num").agg(n.alias("dates"), F.max_by("id", F.struct("d", "id")).alias("last_id"))


@query("""SELECT id, key, val FROM (SELECT p_partkey AS id, unnest(['size', 'price']) AS key, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS val FROM part) WHERE key = 'size' OR val > 1000""")
def r01_flatten_map(spark, sf):
    m = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(m).alias("key", "val")).where("key = 'size' OR val > 1000")


@query("""SELECT image, seq, CAST(4 AS INTEGER) AS points, round(x1+x2, 6) AS sum_x FROM boxes""", "boxes")
def r05_flat_segmentation(spark, sf):
    """Corner lists to a flat list of numbers and back to pairs."""
    flat = F.flatten(F.array(*[F.array(x, y) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]))
    back = F.transform(F.sequence(F.lit(0), F.size("flat") - 1, F.lit(2)), lambda i: F.struct(F.get("flat", i).alias("x"), F.get("flat", i + 1).alias("y")))
    b = boxes(spark, sf).withColumn("flat", flat).withColumn("p", back)
    return b.select("image", "seq", F.size("p").alias("points"), R6(F.aggregate("p", F.lit(0.0), lambda s, v: s + v["x"]) / 2).alias("sum_x"))


@query("""SELECT t.id, coalesce(c.c_name, s.s_name, 'none') AS source FROM tiles t LEFT JOIN customer c ON c.c_custkey = CASE WHEN t.num % 2 = 0 THEN t.num ELSE -t.num END LEFT JOIN supplier s ON s.s_suppkey = t.num % 10""", "tiles")
def k08_attach_georeference(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    t = J.cascade_lookup(tiles(spark, sf), c, [F.when(F.col("num") % 2 == 0, F.col("num")).otherwise(-F.col("num"))], "k", "v", "a")
    t = J.cascade_lookup(t, s, [F.col("num") % 10], "k", "v", "b")
    return t.select("id", F.coalesce("a", "b", F.lit("none")).alias("source"))


@query("""SELECT count(*) AS edges, round(sum(d), 3) AS total FROM (SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM ref a JOIN ref b ON a.id < b.id AND abs(a.x-b.x) <= 6 AND abs(a.y-b.y) <= 6) WHERE d <= 6""", "ref")
def i08_eps_edges(spark, sf):
    r = ref(spark, sf)
    e = S.radius_join(r, r, 6.0).where("id < r_id")
    return e.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.round(F.sum("dist"), 3), F.lit(0.0)).alias("total"))
