"""Queries over the scalar functions: names, dates, geometry and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from .registry import boxes, det, dms, pairs, query, ref, table, tiles

R6 = lambda c: F.round(c, 6)


@query("""SELECT p_partkey AS id, regexp_extract(CAST(p_size AS VARCHAR)||p_name, '^([0-9]*)', 1) AS lead, nullif(regexp_extract(p_name, '^([0-9]*)', 1), '') AS lead_or_null, nullif(regexp_replace(p_brand, '[^0-9]', '', 'g'), '') AS digits FROM part""")
def x01_leading_digits(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), X.leading_digits(F.concat(F.col("p_size").cast("string"), "p_name")).alias("lead"), X.leading_digits_or_null(F.col("p_name")).alias("lead_or_null"), X.all_digits(F.col("p_brand")).alias("digits"))


@query("""SELECT id, regexp_extract(split_part(split_part(name || '_' || CAST(id AS VARCHAR) || '.tif', '.', 1), '_', 1), '^([0-9]*)', 1) AS index_key FROM tiles""", "tiles")
def x03_index_key(spark, sf):
    path = F.concat(F.lit("/maps/"), "name", F.lit("_"), F.col("id").cast("string"), F.lit(".tif"))
    return tiles(spark, sf).select("id", X.index_key(path).alias("index_key"))


@query("""SELECT s_suppkey AS id, translate(upper(s_name || 'o0tiqz€'), 'OTI€QZ', '011E07') AS fixed FROM supplier""")
def x05_fix_confusions(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), X.fix_confusions(F.concat("s_name", F.lit("o0tiqz€"))).alias("fixed"))


@query("""SELECT id, regexp_replace(name || 'ADDICK', '([0-9])([A-Za-z]{1})[A-Za-z]*$', '\\1\\2') AS kept FROM tiles""", "tiles")
def x06_keep_letters(spark, sf):
    return tiles(spark, sf).select("id", X.keep_letters(F.concat("name", F.lit("ADDICK")), 1).alias("kept"))


@query("""WITH t AS (SELECT id, regexp_replace(regexp_replace('Map no. ' || name || ' 8', ' 8$', 'B'), '[^A-Za-z0-9_]', '', 'g') AS s FROM tiles)
SELECT id, regexp_replace(substr(translate(upper(substr(s, instr(s, '48201C'))), 'OTI€QZ', '011E07'), 1, 13), '([0-9])([A-Za-z]{1})[A-Za-z]*$', '\\1\\2') AS clean FROM t""", "tiles")
def x07_clean_name(spark, sf):
    return tiles(spark, sf).select("id", X.clean_name(F.concat(F.lit("Map no. "), "name", F.lit(" 8")), "48201C").alias("clean"))


@query("""SELECT id, name AS clean FROM tiles""", "tiles")
def x07_aligned_name(spark, sf):
    """The key has one wrong character in every name."""
    wrong = F.when(F.col("id") % 3 == 0, "4B201C").when(F.col("id") % 3 == 1, "482X1C").otherwise("4820XC")
    return tiles(spark, sf).select("id", X.aligned_name(F.concat(F.lit("Map "), wrong, F.substring("name", 7, 9)), "48201C").alias("clean"))


@query("""WITH t AS (SELECT id, d, id % 4 AS k, CASE id % 4 WHEN 0 THEN 'Revised: ' || strftime(d, '%B') WHEN 1 THEN upper(strftime(d, '%B')) WHEN 2 THEN substr(strftime(d, '%B'), 4) ELSE 'x' END || ' ' || day(d) || ', ' || year(d) || ' and' AS s FROM tiles) SELECT id, CASE WHEN k = 3 OR (k = 2 AND NOT regexp_matches(s, '^[a-z]*(ary|ber)')) THEN NULL ELSE regexp_replace(regexp_replace(s, '^Revised: ', ''), ' and$', '') END AS date FROM t""", "tiles")
def x14_truncated_months(spark, sf):
    """Dates with whole months, and with months whose first three letters are lost."""
    month, k = F.date_format("d", "MMMM"), F.col("id") % 4
    name = F.when(k == 0, F.concat(F.lit("Revised: "), month)).when(k == 1, F.upper(month)).when(k == 2, F.substring(month, 4, 20)).otherwise("x")
    text = F.concat(name, F.lit(" "), F.day("d").cast("string"), F.lit(", "), F.year("d").cast("string"), F.lit(" and"))
    return tiles(spark, sf).select("id", X.first_loose_date(text).alias("date"))


@query()
def x10_weighted_ratio(spark, sf):
    """The weighted score of each supplier's name with two customers' names."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    c = table(spark, sf, "customer").select(F.explode(F.array("c_custkey", F.col("c_custkey") + 1)).alias("id"), "c_name")
    return s.join(c, "id").select("id", "c_name", X.weighted_ratio("s_name", "c_name").alias("score"))


@query("""SELECT id, CASE WHEN regexp_matches(name, '[A-Za-z]$') THEN left(name, length(name)-1) ELSE name END AS tile, CASE WHEN regexp_matches(name, '[A-Za-z]$') THEN right(name, 1) END AS suffix, replace(regexp_replace(name || '__1', '[^0-9_]', '', 'g'), '__', '_') AS second FROM tiles""", "tiles")
def x12_split_name(spark, sf):
    tile, suffix = X.split_name(F.col("name"))
    return tiles(spark, sf).select("id", tile.alias("tile"), suffix.alias("suffix"), X.secondary_key(F.concat("name", F.lit("__1"))).alias("second"))


@query("""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders""")
def x14_month_dates(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("REVISED:  "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and later"))
    return o.select(F.col("o_orderkey").alias("id"), X.parse_month_date(text).alias("day"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '/m/' || p_partkey || '.tfw' WHEN 1 THEN '/m/' || p_partkey || '.pgw' WHEN 2 THEN '/m/' || p_partkey || '.jgw' END AS world FROM part""")
def x15_world_file_path(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("TIF", "png", "jpg", "gif"))), F.col("p_size") % 4 + 1)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.world_file_path(F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"), F.lit("."), ext)).alias("world"))


@query("""SELECT s_suppkey AS id, TRY_CAST(regexp_replace(s_name, '[^0-9]', '', 'g') AS BIGINT) AS num FROM supplier""")
def x16_number_in(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), X.number_in(F.col("s_name")).alias("num"))


@query("""SELECT event_type AS grp, max_by(dir, n) AS newest, max(n) AS n FROM (SELECT event_type, CASE WHEN user_id % 50 = 0 THEN 'exp' ELSE 'exp' || (user_id % 50) END AS dir, CAST(user_id % 50 AS INTEGER) AS n FROM events) GROUP BY event_type""")
def x17_newest_run(spark, sf):
    k = F.col("user_id") % 50
    e = table(spark, sf, "events").withColumn("dir", F.when(k == 0, "exp").otherwise(F.concat(F.lit("exp"), k.cast("string"))))
    e = e.withColumn("n", X.run_number(F.col("dir")))
    return e.groupBy(F.col("event_type").alias("grp")).agg(F.max_by("dir", "n").alias("newest"), F.max("n").alias("n"))


@query("""SELECT id, round(((atan2(y-250, x-500)*180/pi()) + 360) % 360, 6) AS az FROM det""", "det")
def m01_azimuth(spark, sf):
    return det(spark, sf).select("id", R6(G.azimuth(F.col("x") - 500, F.col("y") - 250)).alias("az"))


@query("""SELECT id, grp, round((y - min(y) OVER (PARTITION BY grp)) / (max(y) OVER (PARTITION BY grp) - min(y) OVER (PARTITION BY grp)), 6) AS norm FROM det""", "det")
def m02_min_max(spark, sf):
    d = det(spark, sf)
    span = d.groupBy("grp").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return d.join(span, "grp").select("id", "grp", R6((F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("norm"))


@query("""WITH s AS (SELECT grp AS g, avg(y) AS m, stddev_pop(y) AS sd FROM det GROUP BY grp) SELECT id, grp FROM det JOIN s ON grp = g WHERE abs(y - m) <= 1.5 * sd""", "det")
def m03_non_outliers(spark, sf):
    d = det(spark, sf)
    s = d.groupBy("grp").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    return d.join(s, "grp").where(F.abs(F.col("y") - F.col("m")) <= 1.5 * F.col("sd")).select("id", "grp")


@query("""WITH p AS (SELECT grp AS g, quantile_cont(y, 0.99) AS p FROM det GROUP BY grp) SELECT id, round(least(greatest(y / p, 0), 1), 6) AS w FROM det JOIN p ON grp = g""", "det")
def m04_confidence_weights(spark, sf):
    d = det(spark, sf)
    p = d.groupBy("grp").agg(F.percentile("y", F.lit(0.99)).alias("p"))
    return d.join(p, "grp").select("id", R6(F.least(F.greatest(F.col("y") / F.nullif(F.col("p"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).alias("w"))


@query("""SELECT image, seq, round((x1+x2)/2, 6) AS cx, round((y1+y2)/2, 6) AS cy, round(CASE WHEN least(x2, 30) > greatest(x1, 10) AND least(y2, 8) > greatest(y1, 2) THEN (least(x2,30)-greatest(x1,10))*(least(y2,8)-greatest(y1,2)) / ((x2-x1)*(y2-y1) + 120 - (least(x2,30)-greatest(x1,10))*(least(y2,8)-greatest(y1,2))) ELSE 0 END, 6) AS iou FROM boxes""", "boxes")
def m08_box_iou(spark, sf):
    fixed = {k: F.lit(float(v)) for k, v in {"x1": 10, "y1": 2, "x2": 30, "y2": 8}.items()}
    return boxes(spark, sf).select("image", "seq", R6((F.col("x1") + F.col("x2")) / 2).alias("cx"), R6((F.col("y1") + F.col("y2")) / 2).alias("cy"), R6(G.iou(G.box(), fixed)).alias("iou"))


@query("""SELECT id, 'EPSG:' || (32600 + CAST(trunc((x*0.36 - 180 + 180)/6) AS INTEGER) + 1) AS utm, round(radians(x*0.36-180)*6378137, 3) AS mx FROM ref""", "ref")
def m11_utm_and_mercator(spark, sf):
    lon = F.col("x") * 0.36 - 180
    x, _ = G.to_mercator(lon, F.lit(0.0))
    return ref(spark, sf).select("id", G.utm_code(lon).alias("utm"), F.round(x, 3).alias("mx"))


@query("""SELECT id, round(2*x + 0.5*y + 3, 6) AS u, round(-0.5*x + 2*y - 7, 6) AS v, round(x, 6) AS back_x, round(y, 6) AS back_y FROM ref""", "ref")
def m16_apply_invert(spark, sf):
    t = G.compose(G.affine(1, 0, 3, 0, 1, -7), G.affine(2, 0.5, 0, -0.5, 2, 0))
    u, v = G.apply(t, F.col("x"), F.col("y"))
    r = ref(spark, sf).withColumns({"u": u, "v": v})
    bx, by = G.apply(G.invert(t), F.col("u"), F.col("v"))
    return r.select("id", R6(F.col("u")).alias("u"), R6(F.col("v")).alias("v"), R6(bx).alias("back_x"), R6(by).alias("back_y"))


@query("""SELECT image, seq, round(0.25*(x1+0.5) + 1000, 6) AS px, round(-0.25*(y1+0.5) + 2000, 6) AS py FROM boxes""", "boxes")
def m18_pixel_centers(spark, sf):
    x, y = G.pixel_center(G.affine(0.25, 0, 1000, 0, -0.25, 2000), F.col("y1"), F.col("x1"))
    return boxes(spark, sf).select("image", "seq", R6(x).alias("px"), R6(y).alias("py"))


@query("""SELECT id, i AS step, CAST(i*3 AS DOUBLE) AS at FROM (SELECT p_partkey AS id, p_size AS len, unnest(range(0, CAST(floor(p_size/3.0) AS BIGINT)+1)) AS i FROM part)""")
def m25_points_along(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(G.steps_along(F.col("p_size").cast("double"), 3, True)).alias("step", "at"))
    return p.select("id", F.col("step").cast("long").alias("step"), "at")


@query("""WITH t AS (SELECT id, x, y, least(greatest((x*3 + y*4)/25.0/100, 0), 1) AS t FROM ref) SELECT id, round(sqrt((x-300*t)*(x-300*t) + (y-400*t)*(y-400*t)), 6) AS dist FROM t""", "ref")
def m27_segment_distance(spark, sf):
    zero = F.lit(0.0)
    return ref(spark, sf).select("id", R6(G.segment_distance(F.col("x"), F.col("y"), zero, zero, F.lit(300.0), F.lit(400.0))).alias("dist"))


@query("""WITH t AS (SELECT id, deg || lpad(mi, 2, '0') || '30' AS d FROM dms) SELECT id, round(CAST(substr(d,1,2) AS DOUBLE) + CAST(substr(d,3,2) AS DOUBLE)/60 + CAST(substr(d,5,2) AS DOUBLE)/3600, 8) AS degrees FROM t""", "dms")
def m28_dms_degrees(spark, sf):
    text = F.concat("deg", F.lit("°"), F.lpad("mi", 2, "0"), F.lit("'30\""))
    return dms(spark, sf).select("id", F.round(G.dms_degrees(text), 8).alias("degrees"))


@query("""SELECT image, seq, CASE WHEN y1 < 5 THEN 'top' ELSE 'bottom' END || ' ' || CASE WHEN x1 < 25 THEN 'left' ELSE 'right' END AS sector FROM boxes""", "boxes")
def m29_sectors(spark, sf):
    return boxes(spark, sf).select("image", "seq", G.sector(F.col("x1"), F.col("y1"), F.lit(50.0), F.lit(10.0)).alias("sector"))


@query("""SELECT vec_id AS id, round(1 - list_dot_product(e, v) / sqrt(list_dot_product(e, e) * list_dot_product(v, v)), 5) AS dist FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)""")
def m31_cosine_distance(spark, sf):
    """Distances to one vector, which goes into the plan as a constant."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = e.where("vec_id = 0").first() or {"e": [0.0]}  # without it no distance
    return e.select(F.col("vec_id").alias("id"), F.round(G.cosine_distance(F.col("e"), F.array(*map(F.lit, one["e"]))), 5).alias("dist"))


@query("""SELECT grp, id, round(degrees(atan2(ty-y, tx-x)), 2) AS angle, round(sqrt((tx-x)*(tx-x)+(ty-y)*(ty-y)), 6) AS length FROM pairs""", "pairs")
def m32_displacements(spark, sf):
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    return pairs(spark, sf).select("grp", "id", F.round(F.degrees(F.atan2(dy, dx)), 2).alias("angle"), R6(F.hypot(dx, dy)).alias("length"))


@query("""SELECT o_orderkey AS id, coalesce(try_strptime(CASE WHEN o_orderkey%2=0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'bad' END, '%Y-%m-%d'), TIMESTAMP '1900-01-01')::DATE AS d FROM orders""")
def d05_default_date(spark, sf):
    s = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("bad")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.to_date(F.lit("1900-01-01"))).alias("d"))


@query("""SELECT e AS id, round(100.0*(1 - levenshtein(a, b)*1.0/greatest(length(a), length(b), 1)), 4) AS score FROM (SELECT s_suppkey AS e, s_name AS a, 'Supplier#' || (s_suppkey*7) AS b FROM supplier)""")
def x10_edit_score(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), X.edit_score(F.col("s_name"), F.concat(F.lit("Supplier#"), (F.col("s_suppkey") * 7).cast("string"))).alias("score"))


@query()
def x10_fuzzy_ratio(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(X.fuzzy_ratio("p_name", "p_type"), 6).alias("ratio"), F.round(X.partial_ratio("p_brand", "p_name"), 6).alias("partial"))


@query("""SELECT id, x > 500 AS state_plane, CASE WHEN y > 0 THEN 'up' ELSE 'down' END AS stage, round(coalesce(nullif(x, 0), -1), 4) AS x FROM ref""", "ref")
def p09_conditional_columns(spark, sf):
    return ref(spark, sf).select("id", (F.col("x") > 500).alias("state_plane"), F.when(F.col("y") > 0, "up").otherwise("down").alias("stage"), F.round(F.coalesce(F.nullif(F.col("x"), F.lit(0.0)), F.lit(-1.0)), 4).alias("x"))
