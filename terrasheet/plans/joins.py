"""Queries over filters, lookups, spatial and fuzzy joins, sets and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X
from ..operators import near
from ..operators import relational as J
from ..operators import spatial as S
from ..operators import search as V
from .registry import boxes, det, pairs, query, ref, table, tiles

R6 = lambda c: F.round(c, 6)


@query("""WITH f AS (SELECT id, CASE WHEN id % 11 = 0 THEN '48201CIND0_' || num WHEN id % 7 = 0 THEN name || '_1' WHEN id % 5 = 0 THEN CAST(num AS VARCHAR) WHEN id % 13 = 0 THEN 'unsure' || num || '_1' ELSE name END || '.tif' AS file FROM tiles) SELECT id, file FROM f WHERE (contains(file, 'IND') OR contains(file, '_1.') OR length(file) < 12) AND NOT contains(file, 'unsure')""", "tiles")
def p01_index_sheets(spark, sf):
    num = F.col("num").cast("string")
    name = F.when(F.col("id") % 11 == 0, F.concat(F.lit("48201CIND0_"), num)).when(F.col("id") % 7 == 0, F.concat("name", F.lit("_1"))).when(F.col("id") % 5 == 0, num).when(F.col("id") % 13 == 0, F.concat(F.lit("unsure"), num, F.lit("_1"))).otherwise(F.col("name"))
    files = tiles(spark, sf).select("id", F.concat(name, F.lit(".tif")).alias("file"))
    return files.where(X.is_index_sheet(F.col("file")))


@query("""SELECT image, seq, label FROM boxes WHERE x1 BETWEEN 10 AND 30 AND y1 BETWEEN 2 AND 8 AND x2 - x1 > 3""", "boxes")
def p04_in_box(spark, sf):
    return boxes(spark, sf).where(F.col("x1").between(10, 30) & F.col("y1").between(2, 8) & (F.col("x2") - F.col("x1") > 3)).select("image", "seq", "label")


@query("""SELECT image, max(area) AS area FROM (SELECT image, round((x2-x1)*(y2-y1), 6) AS area FROM boxes) GROUP BY image""", "boxes")
def p14_largest(spark, sf):
    b = boxes(spark, sf).withColumn("area", R6(G.area(G.box())))
    return b.groupBy("image").agg(F.max_by("area", "area").alias("area"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey >= 900 THEN n.c_nationkey ELSE o_custkey END AS geoid FROM orders LEFT JOIN customer n ON o_custkey = c_custkey""")
def j01_id_lookup(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_custkey").agg(F.min("c_nationkey").cast("long").alias("g"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") >= 900, F.col("g")).otherwise(F.col("o_custkey")).alias("geoid"))


@query("""WITH k AS (SELECT c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT s_suppkey + 100000, s_name FROM supplier) SELECT o_orderkey AS id, v AS name FROM orders LEFT JOIN k ON k = CASE WHEN o_orderkey%2=0 THEN o_custkey ELSE o_custkey + 100000 END""")
def j02_two_table_lookup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 100000).alias("k"), F.col("s_name").alias("v"))
    o = table(spark, sf, "orders").withColumn("g", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 100000))
    return o.join(c.unionByName(s), F.col("g") == F.col("k"), "left").select(F.col("o_orderkey").alias("id"), F.col("v").alias("name"))


@query("""WITH cat AS (SELECT 'k' || c_custkey AS k, c_name AS v FROM customer), o AS (SELECT o_orderkey AS id, 'k' || o_custkey || CASE WHEN o_orderkey % 3 > 0 THEN 'x' ELSE '' END AS p FROM orders) SELECT id, coalesce(a.v, b.v, c.v, '') AS hit FROM o LEFT JOIN cat a ON a.k = p LEFT JOIN cat b ON b.k = left(p, 3) LEFT JOIN cat c ON c.k = left(p, 2)""")
def j03_prefix_fallback(spark, sf):
    """Two of three keys end in a letter and aren't in the catalogue."""
    cat = table(spark, sf, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_name").alias("v"))
    o = table(spark, sf, "orders").withColumn("p", F.concat(F.lit("k"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 > 0, "x").otherwise("")))
    keys = [F.col("p"), F.substring("p", 1, 3), F.substring("p", 1, 2)]
    return J.cascade_lookup(o, cat, keys, "k", "v", "hit", F.lit("")).select(F.col("o_orderkey").alias("id"), "hit")


@query("""WITH l AS (SELECT DISTINCT s_nationkey AS b, s_name AS n FROM supplier), s AS (SELECT b, n, c_custkey AS id, c_name, round(100.0*(1 - levenshtein(n, c_name)*1.0/greatest(length(n), length(c_name), 1)), 4) AS score FROM l JOIN customer ON c_nationkey = b), r AS (SELECT *, row_number() OVER (PARTITION BY b, n ORDER BY score DESC, id) AS rn FROM s) SELECT b AS block, n AS name, id AS best_id, c_name AS best, score FROM r WHERE rn = 1""")
def j04_fuzzy_best(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_name").alias("best"), F.col("c_custkey").alias("best_id"))
    return J.best_match(s, c, "block", "name", "best", X.edit_score(F.col("name"), F.col("best")), "best_id")


@query()
def j07_fuzzy_catalogue(spark, sf):
    """Misread tile names against all names of the catalogue by Indel ratio, 90 or more."""
    cat = tiles(spark, sf).select("name").distinct()
    odd = F.when(F.length("name") % 2 == 0, F.regexp_replace("name", "0$", "")).otherwise(F.concat(F.substring("name", 1, 5), F.lit("Q"), F.substring("name", 7, 20)))
    return V.fuzzy_catalogue(cat.select(odd.alias("name")), cat, "name", 90.0)


@query("""SELECT o_orderkey AS id, c_name AS name, s_name AS supplier FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON c_nationkey = s_nationkey AND o_orderkey % 10 = s_suppkey % 10""")
def j05_multi_key_joins(spark, sf):
    o, c, s = (table(spark, sf, t) for t in ("orders", "customer", "supplier"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("o_orderkey") % 10 == F.col("s_suppkey") % 10), "left")
    return j.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("s_name").alias("supplier"))


@query("""WITH t AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'x' || id WHEN id % 2 = 0 THEN name || '?' ELSE name END AS name FROM tiles), cat AS (SELECT name, min(id) AS first FROM tiles GROUP BY name), d AS (SELECT regexp_replace(name, '[^0-9]', '', 'g') AS dk, min(id) AS first FROM tiles GROUP BY 1) SELECT t.id, coalesce(cat.first, d.first) AS hit FROM t LEFT JOIN cat ON cat.name = t.name LEFT JOIN d ON d.dk = regexp_replace(t.name, '[^0-9]', '', 'g')""", "tiles")
def j08_digits_fallback(spark, sf):
    """Every second name has one character too many, every fifth isn't in the catalogue."""
    cat = tiles(spark, sf)
    t = cat.select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).when(F.col("id") % 2 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"))
    exact = cat.groupBy("name").agg(F.min("id").alias("first"))
    digits = cat.groupBy(F.regexp_replace("name", "[^0-9]", "").alias("name")).agg(F.min("id").alias("first"))
    out = J.cascade_lookup(t, exact, [F.col("name")], "name", "first", "a")
    out = J.cascade_lookup(out, digits, [F.regexp_replace("name", "[^0-9]", "")], "name", "first", "b")
    return out.select("id", F.coalesce("a", "b").alias("hit"))


@query("""WITH l AS (SELECT id, num, CAST(d + CAST(id % 900 AS INTEGER) AS DATE) AS d FROM tiles), e AS (SELECT num AS n2, d AS d2 FROM tiles), c AS (SELECT id, d, d2, row_number() OVER (PARTITION BY id ORDER BY abs(date_diff('day', d2, d)), d2) AS rn FROM l LEFT JOIN e ON num = n2) SELECT id, CASE WHEN abs(date_diff('day', d2, d)) <= 365 THEN d2 END AS nearest FROM c WHERE rn = 1""", "tiles")
def j09_nearest_date(spark, sf):
    t = tiles(spark, sf)
    shifted = t.withColumn("d", F.date_add("d", (F.col("id") % 900).cast("int")))
    return J.nearest_date(shifted, t.select("num", F.col("d").alias("other")), "num", "d", "other", "nearest", 365).select("id", "nearest")


@query("""WITH c AS (SELECT det.id, ref.id AS r_id, sqrt((det.x-ref.x)*(det.x-ref.x)+(det.y-ref.y)*(det.y-ref.y)) AS dist FROM det, ref), b AS (SELECT id, min(dist) AS dist FROM c GROUP BY id) SELECT id, round(dist, 6) AS dist FROM b""", "det ref")
def j10_nearest_point(spark, sf):
    return S.nearest_join(det(spark, sf), ref(spark, sf)).select("id", R6(F.col("dist")).alias("dist"))


@query("""WITH c AS (SELECT det.id, det.grp, sqrt((det.x-ref.x)*(det.x-ref.x)+(det.y-ref.y)*(det.y-ref.y)) AS dist FROM det, ref), b AS (SELECT id, grp, min(dist) AS dist FROM c GROUP BY id, grp) SELECT grp, count(*) AS n, round(sqrt(avg(dist*dist)), 6) AS rms FROM b WHERE dist < 15 GROUP BY grp""", "det ref")
def j11_nearest_within(spark, sf):
    d = det(spark, sf)
    near = S.nearest_join(d, ref(spark, sf)).where("dist < 15").join(d.select("id", "grp"), "id")
    return near.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), R6(F.sqrt(F.avg(F.col("dist") * F.col("dist")))).alias("rms"))


@query("""SELECT a.id, count(*) AS n, round(sum(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))), 4) AS total FROM det a JOIN ref b ON abs(a.x-b.x) <= 25 AND abs(a.y-b.y) <= 25 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 625 GROUP BY a.id""", "det ref")
def j12_radius_neighbours(spark, sf):
    return near.radius_sums(det(spark, sf), ref(spark, sf), 25.0).select("id", "n", F.round("total", 4).alias("total"))


@query("""WITH c AS (SELECT a.id, b.id AS r_id, abs(a.y - b.y) + 0.001*(b.id % 7) AS off FROM det a JOIN ref b ON abs(a.x-b.x) <= 20 AND abs(a.y-b.y) <= 20 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 400), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off, r_id) AS rn, lead(off) OVER (PARTITION BY id ORDER BY off, r_id) AS d2 FROM c) SELECT id, r_id, round(off, 6) AS d1, round(d2, 6) AS d2 FROM r WHERE rn = 1 AND d2 IS NOT NULL AND off <= 0.8 * d2""", "det ref")
def j13_ratio_test(spark, sf):
    two = near.two_best(det(spark, sf), ref(spark, sf).withColumn("more", 0.001 * (F.col("id") % 7)), 20.0, lambda dx, dy, more: abs(dy) + more, "more")
    return two.where(F.col("d1") <= 0.8 * F.col("d2")).select("id", "r_id", R6("d1").alias("d1"), R6("d2").alias("d2"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id, b.vec_id AS other, 1 - list_dot_product(a.e, b.e)/sqrt(list_dot_product(a.e, a.e)*list_dot_product(b.e, b.e)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS rn FROM c) SELECT vec_id AS id, other, round(d, 5) AS dist FROM r WHERE rn <= 2""")
def j14_descriptor_top2(spark, sf):
    """One descriptor in twenty is searched for in all others."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return V.nearest_vectors(e.where("id % 20 = 0"), e, 2).select("id", "other", F.round("dist", 5).alias("dist"))


@query("""SELECT r.id, count(b.image) AS n FROM ref r LEFT JOIN (SELECT image, x1*15 AS x1, x2*15 AS x2, y1*20 AS y1, y2*20 AS y2 FROM boxes) b ON r.x BETWEEN b.x1 AND b.x2 AND r.y BETWEEN b.y1 AND b.y2 GROUP BY r.id""", "ref boxes")
def j16_points_in_boxes(spark, sf):
    b = boxes(spark, sf).select((F.col("x1") * 15).alias("x1"), (F.col("x2") * 15).alias("x2"), (F.col("y1") * 20).alias("y1"), (F.col("y2") * 20).alias("y2"))
    hits = S.boxes_over(ref(spark, sf), b, 50.0)
    return ref(spark, sf).select("id").join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH a AS (SELECT o_custkey AS k, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), b AS (SELECT user_id AS k, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.k AS k, a.i AS i, p, v FROM a JOIN b ON a.k = b.k AND a.i = b.i""")
def j18_zip_join(spark, sf):
    o = table(spark, sf, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    e = table(spark, sf, "events").withColumn("j", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    z = o.join(e, (F.col("o_custkey") == F.col("user_id")) & (F.col("i") == F.col("j")))
    return z.select(F.col("o_custkey").alias("k"), F.col("i").cast("long").alias("i"), F.col("o_totalprice").alias("p"), F.col("value").alias("v"))


@query("""SELECT id, name FROM tiles WHERE num IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""", "tiles")
def j19_semi(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return tiles(spark, sf).join(c, F.col("num") == F.col("c_custkey"), "left_semi").select("id", "name")


@query("""WITH n AS (SELECT * FROM boxes WHERE seq % 2 = 0), o AS (SELECT * FROM boxes WHERE seq % 2 = 1) SELECT image, seq, x1, y1 FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.image = n.image AND least(n.x2,o.x2) > greatest(n.x1,o.x1) AND least(n.y2,o.y2) > greatest(n.y1,o.y1) AND (least(n.x2,o.x2)-greatest(n.x1,o.x1))*(least(n.y2,o.y2)-greatest(n.y1,o.y1)) / ((n.x2-n.x1)*(n.y2-n.y1)+(o.x2-o.x1)*(o.y2-o.y1)-(least(n.x2,o.x2)-greatest(n.x1,o.x1))*(least(n.y2,o.y2)-greatest(n.y1,o.y1))) > 0.1)""", "boxes")
def j20_drop_overlapping(spark, sf):
    b = boxes(spark, sf)
    return J.keep_dissimilar(b.where("seq % 2 = 0"), b.where("seq % 2 = 1"), "image", 0.1).select("image", "seq", "x1", "y1")


@query("""WITH t AS (SELECT image, seq, x1, y1, x2, y2, unnest(range(0, 8)) AS tx FROM boxes), u AS (SELECT *, unnest(range(0, 4)) AS ty FROM t), c AS (SELECT image, seq, tx, ty, least(greatest(x1-tx*8,0),10) AS a, least(greatest(x2-tx*8,0),10) AS b, least(greatest(y1-ty*8,0),10) AS c, least(greatest(y2-ty*8,0),10) AS d FROM u) SELECT image, seq, tx AS tile_x, ty AS tile_y, round((b-a)*(d-c), 6) AS area FROM c WHERE b > a AND d > c""", "boxes")
def j21_tile_boxes(spark, sf):
    t = S.tile_boxes(boxes(spark, sf), 10, 2)
    return t.select("image", "seq", F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y"), R6((F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1"))).alias("area"))


@query("""WITH f AS (SELECT regexp_replace(name, '[^0-9]', '', 'g') AS k, min(id) AS id FROM tiles GROUP BY 1) SELECT c_custkey AS cust, f.id AS tile FROM customer LEFT JOIN f ON f.k = '48201' || lpad(CAST(c_custkey AS VARCHAR), 4, '0')""", "tiles")
def j24_first_by_key(spark, sf):
    t = tiles(spark, sf).select(X.all_digits(F.col("name")).alias("k"), "id", "name")
    first = J.first_by(t, ["k"], [F.col("id")])
    c = table(spark, sf, "customer").withColumn("k", F.concat(F.lit("48201"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")))
    return c.join(first, "k", "left").select(F.col("c_custkey").alias("cust"), F.col("id").alias("tile"))


@query("""WITH l AS (SELECT left(name, length(name)-1) AS base, max(id) AS id FROM tiles WHERE regexp_matches(name, '[A-Za-z]$') GROUP BY 1) SELECT t.id, coalesce(l.id, -1) AS src FROM tiles t LEFT JOIN l ON l.base = CASE WHEN regexp_matches(t.name, '[A-Za-z]$') THEN left(t.name, length(t.name)-1) ELSE t.name END""", "tiles")
def j25_base_code(spark, sf):
    t = tiles(spark, sf)
    base, _ = X.split_name(F.col("name"))
    last = t.where(F.col("name").rlike("[A-Za-z]$")).groupBy(base.alias("base")).agg(F.max("id").alias("src"))
    return t.withColumn("base", base).join(last, "base", "left").select("id", F.coalesce("src", F.lit(-1)).alias("src"))


@query("""WITH fix AS (SELECT s_suppkey AS k, s_name AS fixed FROM supplier) SELECT c_custkey AS id, coalesce(fixed, c_name) AS name FROM customer LEFT JOIN fix ON k = c_custkey UNION ALL SELECT k + 1000000, fixed FROM fix""")
def j26_override(spark, sf):
    fix = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("fixed"))
    c = table(spark, sf, "customer").join(fix, F.col("c_custkey") == F.col("k"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("fixed", "c_name").alias("name"))
    return c.unionByName(fix.select((F.col("k") + 1000000).alias("id"), F.col("fixed").alias("name")))


@query("""WITH a AS (SELECT DISTINCT image, seq, x1, y1, x2, y2 FROM boxes WHERE seq <= 3), b AS (SELECT DISTINCT image AS i, seq AS s, x1 AS u1, y1 AS v1, x2 AS u2, y2 AS v2 FROM boxes WHERE seq > 3), p AS (SELECT *, least(x2,u2)-greatest(x1,u1) AS w, least(y2,v2)-greatest(y1,v1) AS h FROM a JOIN b ON image = i) SELECT image, seq, x1, y1, x2, y2, round(max(CASE WHEN w > 0 AND h > 0 THEN w*h/((x2-x1)*(y2-y1)+(u2-u1)*(v2-v1)-w*h) ELSE 0 END), 6) AS best FROM p GROUP BY image, seq, x1, y1, x2, y2""", "boxes")
def j27_best_overlap(spark, sf):
    b = boxes(spark, sf).drop("label").distinct()
    o = b.where("seq > 3").select("image", *[F.col(c).alias("o_" + c) for c in ("x1", "y1", "x2", "y2")])
    p = b.where("seq <= 3").join(o, "image").withColumn("iou", G.iou(G.box(), G.box("o_")))
    return p.groupBy("image", "seq", "x1", "y1", "x2", "y2").agg(R6(F.max("iou")).alias("best"))


@query("""SELECT id FROM tiles WHERE id % 3 = 0 INTERSECT SELECT id FROM tiles WHERE id % 2 = 0 EXCEPT SELECT id FROM tiles WHERE num < 100""", "tiles")
def u02_set_operations(spark, sf):
    t = tiles(spark, sf)
    return t.where("id % 3 = 0").select("id").intersect(t.where("id % 2 = 0").select("id")).subtract(t.where("num < 100").select("id"))


@query("""SELECT id, 'a' AS src FROM ref UNION ALL SELECT id, grp FROM det""", "ref det")
def u01_union_all(spark, sf):
    return ref(spark, sf).select("id", F.lit("a").alias("src")).unionByName(det(spark, sf).select("id", F.col("grp").alias("src")))


@query("""SELECT DISTINCT label, CAST(seq AS BIGINT) AS seq FROM boxes""", "boxes")
def u04_distinct(spark, sf):
    return boxes(spark, sf).select("label", F.col("seq").cast("long").alias("seq")).distinct()


@query("""WITH r AS (SELECT grp, ts, event_id, value, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) AS n, avg(value) OVER (PARTITION BY grp ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS m FROM (SELECT event_type AS grp, ts, event_id, value FROM events)) SELECT grp, event_id AS id, round(m, 6) AS mean FROM r WHERE n >= 25""")
def w01_moving_average(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("grp"), "ts", "event_id", "value")
    return J.moving_average(e, ["grp"], ["ts", "event_id"], "value", 25, "mean").select("grp", F.col("event_id").alias("id"), R6(F.col("mean")).alias("mean"))


@query("""WITH l AS (SELECT conv_id, turn, role, lower(text) AS text, lead(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations WHERE trim(text) <> '') SELECT conv_id, min_by(nxt, turn) AS next_line FROM l WHERE role = 'user' GROUP BY conv_id""")
def w03_next_line(spark, sf):
    c = table(spark, sf, "conversations").where(F.trim("text") != "").withColumn("t", F.lower("text"))
    c = c.withColumn("nxt", F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    return c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("nxt", "turn").alias("next_line"))


@query("""SELECT user_id, event_id AS id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM events""")
def w04_previous_line(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last("event_type").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.coalesce(F.lag("event_type").over(w), last).alias("before"))


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS page, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END AS num FROM orders), r AS (SELECT *, count(num) OVER (PARTITION BY k ORDER BY page) AS run FROM p), s AS (SELECT *, first_value(num) OVER (PARTITION BY k, run ORDER BY page) AS f, row_number() OVER (PARTITION BY k, run ORDER BY page) - 1 AS i FROM r) SELECT k, page, coalesce(f, 0) + i AS number, num IS NULL AS unsure FROM s""")
def s05_page_numbers(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 100).alias("num"))
    return J.carried_numbers(p, "k", "page", "num", "number").select("k", "page", "number", "unsure")


@query("""SELECT user_id, event_id AS id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 5 AS converged FROM events""")
def w06_convergence(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), (F.abs(F.col("value") - F.lag("value").over(w)) < 5).alias("converged"))


@query("""SELECT user_id, min(value) AS best, arg_min(event_id, struct_pack(v := value, e := event_id)) AS id FROM events GROUP BY user_id""")
def w08_best_iteration(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("best"), F.min_by("event_id", F.struct("value", "event_id")).alias("id"))


@query("""SELECT image, seq, round(x2-x1, 6) AS top, round(y2-y1, 6) AS side, round(2*((x2-x1)+(y2-y1)), 6) AS around FROM boxes""", "boxes")
def w09_side_lengths(spark, sf):
    p = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1"))])
    sides = F.zip_with(F.slice(p, 1, 4), F.slice(p, 2, 4), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    b = boxes(spark, sf).withColumn("s", sides)
    return b.select("image", "seq", R6(F.col("s")[0]).alias("top"), R6(F.col("s")[1]).alias("side"), R6(F.aggregate("s", F.lit(0.0), lambda a, v: a + v)).alias("around"))


@query("""SELECT grp, id, y FROM (SELECT grp, id, y, row_number() OVER (PARTITION BY grp ORDER BY y DESC, id) AS rn FROM det) WHERE rn <= 5""", "det")
def t02_top_n(spark, sf):
    w = Window.partitionBy("grp").orderBy(F.desc("y"), "id")
    return det(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("grp", "id", "y")


@query("""SELECT id, dist FROM (SELECT id, round(abs(tx - 2*x + y), 6) AS dist, x, y, grp FROM pairs ORDER BY dist, id, x, y, grp LIMIT 100)""", "pairs")
def t01_most_confident(spark, sf):
    p = pairs(spark, sf).withColumn("dist", R6(F.abs(F.col("tx") - 2 * F.col("x") + F.col("y"))))
    return p.orderBy("dist", "id", "x", "y", "grp").limit(100).select("id", "dist")
