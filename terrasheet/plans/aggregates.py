"""Queries over fits, statistics, descriptors, detections and nested builds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import descriptors as D
from ..operators import fits as T
from ..operators import relational as J
from .registry import boxes, det, pairs, query, ref, table, tiles

R6 = lambda c: F.round(c, 6)
R4 = lambda c: F.round(c, 4)

CENTRED = """c AS (SELECT p.*, x-avg(x) OVER w AS dx, y-avg(y) OVER w AS dy, tx-avg(tx) OVER w AS du, ty-avg(ty) OVER w AS dv, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(tx) OVER w AS mu, avg(ty) OVER w AS mv FROM pairs p WINDOW w AS (PARTITION BY grp))"""


@query(f"""WITH {CENTRED}, g AS (SELECT grp, count(*) AS n, sum(dx*du+dy*dv)/sum(dx*dx+dy*dy) AS a, sum(dx*dv-dy*du)/sum(dx*dx+dy*dy) AS b, min(mx) AS mx, min(my) AS my, min(mu) AS mu, min(mv) AS mv FROM c GROUP BY grp HAVING count(*) >= 3) SELECT grp, n, round(a, 6) AS a, round(b, 6) AS b, round(mu-a*mx+b*my, 4) AS tx0, round(mv-b*mx-a*my, 4) AS ty0 FROM g""", "pairs")
def a01_group_similarity(spark, sf):
    g = T.fit_similarity(pairs(spark, sf), ["grp"])
    return g.select("grp", "n", R6(F.col("a")).alias("a"), R6(F.col("b")).alias("b"), R4(F.col("tx0")).alias("tx0"), R4(F.col("ty0")).alias("ty0"))


@query(f"""WITH {CENTRED}, g AS (SELECT grp, count(*) AS n, sum(dx*du+dy*dv)/sum(dx*dx+dy*dy) AS a, min(mx) AS mx, min(my) AS my, min(mu) AS mu, min(mv) AS mv FROM c GROUP BY grp) SELECT grp, n, round(a, 6) AS a, round(mu-a*mx, 4) AS tx0, round(mv-a*my, 4) AS ty0 FROM g""", "pairs")
def m21_scale_fit(spark, sf):
    return T.fit_scale(pairs(spark, sf), ["grp"]).select("grp", "n", R6(F.col("a")).alias("a"), R4(F.col("tx0")).alias("tx0"), R4(F.col("ty0")).alias("ty0"))


@query(f"""WITH {CENTRED}, s AS (SELECT grp, count(*) AS n, sum(dx*dx) AS xx, sum(dx*dy) AS xy, sum(dy*dy) AS yy, sum(dx*du) AS xu, sum(dy*du) AS yu, sum(dx*dv) AS xv, sum(dy*dv) AS yv FROM c GROUP BY grp) SELECT grp, n, round((xu*yy-yu*xy)/(xx*yy-xy*xy), 6) AS a, round((yu*xx-xu*xy)/(xx*yy-xy*xy), 6) AS b, round((xv*yy-yv*xy)/(xx*yy-xy*xy), 6) AS d, round((yv*xx-xv*xy)/(xx*yy-xy*xy), 6) AS e FROM s""", "pairs")
def m19_affine_fit(spark, sf):
    return T.fit_affine(pairs(spark, sf), ["grp"]).select("grp", "n", *[R6(F.col(c)).alias(c) for c in "abde"])


@query(f"""WITH {CENTRED} SELECT grp, count(*) AS n, round(degrees(atan2(sum(dx*dv-dy*du), sum(dx*du+dy*dv))), 6) AS angle FROM c GROUP BY grp""", "pairs")
def m22_rigid_fit(spark, sf):
    return T.fit_rigid(pairs(spark, sf), ["grp"]).select("grp", "n", R6(F.col("angle")).alias("angle"))


@query("""SELECT label, count(*) AS n, count(DISTINCT image) AS images FROM boxes GROUP BY label""", "boxes")
def a02_value_counts(spark, sf):
    return boxes(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image").alias("images"))


@query("""SELECT count_if(n > 2) AS over2, count_if(n > 5) AS over5, CAST(sum(CASE WHEN n > 5 THEN n ELSE 0 END) AS BIGINT) AS rows5 FROM (SELECT image, count(*) AS n FROM boxes GROUP BY image)""", "boxes")
def a03_counts_over(spark, sf):
    n = boxes(spark, sf).groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 2).alias("over2"), F.count_if(F.col("n") > 5).alias("over5"), F.coalesce(F.sum(F.when(F.col("n") > 5, F.col("n"))), F.lit(0)).alias("rows5"))


@query("""SELECT grp, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.025), 6) AS lo, round(quantile_cont(y, 0.975), 6) AS hi, round(quantile_cont(y, 0.9), 6) AS p90, round(count_if(y > 50)*1.0/count(*), 6) AS rate FROM det GROUP BY grp""", "det")
def a04_residual_statistics(spark, sf):
    p = lambda q: R6(F.percentile("y", F.lit(q)))
    return det(spark, sf).groupBy("grp").agg(R6(F.avg("y")).alias("mean"), R6(F.stddev_samp("y")).alias("sd"), p(0.5).alias("median"), p(0.025).alias("lo"), p(0.975).alias("hi"), p(0.9).alias("p90"), R6(F.count_if(F.col("y") > 50) / F.count(F.lit(1))).alias("rate"))


@query("""SELECT round(stddev_pop(v), 6) AS sd, count(*) AS n FROM (SELECT x - avg(x) OVER () AS v FROM ref UNION ALL SELECT y - avg(y) OVER () FROM ref)""", "ref")
def a07_pooled_deviation(spark, sf):
    r = ref(spark, sf)
    m = r.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.lit(1).alias("k"))
    v = r.withColumn("k", F.lit(1)).join(m, "k").select(F.explode(F.array(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).alias("v"))
    return v.agg(R6(F.stddev_pop("v")).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("""SELECT grp, round(min(x)-(max(x)-min(x))/2, 6) AS x1, round(max(x)+(max(x)-min(x))/2, 6) AS x2, round(min(y)-(max(y)-min(y))/2, 6) AS y1, round(max(y)+(max(y)-min(y))/2, 6) AS y2 FROM det GROUP BY grp""", "det")
def a08_enlarged_bounds(spark, sf):
    lo, hi = (lambda c: F.min(c) - (F.max(c) - F.min(c)) / 2), (lambda c: F.max(c) + (F.max(c) - F.min(c)) / 2)
    return det(spark, sf).groupBy("grp").agg(R6(lo("x")).alias("x1"), R6(hi("x")).alias("x2"), R6(lo("y")).alias("y1"), R6(hi("y")).alias("y2"))


@query("""WITH n AS (SELECT a.grp, a.id, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS d, round(CASE WHEN atan2(b.y-a.y, b.x-a.x) < 0 THEN degrees(atan2(b.y-a.y, b.x-a.x)) + 360 ELSE degrees(atan2(b.y-a.y, b.x-a.x)) END, 9) AS az FROM det a JOIN det b ON a.grp = b.grp AND abs(a.x-b.x) <= 20 AND abs(a.y-b.y) <= 20 WHERE (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) <= 400) SELECT grp, id, round(coalesce(1-avg(CASE WHEN az BETWEEN -45 AND 45 THEN d END)/20, 2), 5) AS b0, round(coalesce(1-avg(CASE WHEN az BETWEEN 45 AND 135 THEN d END)/20, 2), 5) AS b1, round(coalesce(1-avg(CASE WHEN az BETWEEN 135 AND 225 THEN d END)/20, 2), 5) AS b2, round(coalesce(1-avg(CASE WHEN az BETWEEN 225 AND 315 THEN d END)/20, 2), 5) AS b3 FROM n GROUP BY grp, id""", "det")
def a10_descriptors(spark, sf):
    d = D.descriptors(det(spark, sf), 20.0)
    return d.select("grp", "id", *[F.round(F.col("descriptor")[i], 5).alias(f"b{i}") for i in range(4)])


def _weighted_bins() -> str:
    """The SQL of overlapping bins of 60 degrees every 30, for two radii, with weights."""
    cols, filled = [], []
    for r in (18, 7):
        for k in range(12):
            near = f"d <= {r} AND az BETWEEN {k * 30 - 30} AND {k * 30 + 30}"
            mean = f"CASE WHEN sum(w) FILTER ({near}) > 0 THEN sum(w * d) FILTER ({near}) / (sum(w) FILTER ({near}) + 1e-6) ELSE avg(d) FILTER ({near}) END"
            cols.append(f"round(coalesce(1 - ({mean}) / {r}, 2), 5) AS b{len(cols)}")
            filled.append(f"CASE WHEN count(*) FILTER ({near}) > 0 THEN 1.0 ELSE 0.0 END")
    return f"""WITH p AS (SELECT *, (id * 37 % 100) / 100.0 AS w FROM det), n AS (SELECT a.grp, a.id, b.w, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS d, round(CASE WHEN atan2(b.y-a.y, b.x-a.x) < 0 THEN degrees(atan2(b.y-a.y, b.x-a.x)) + 360 ELSE degrees(atan2(b.y-a.y, b.x-a.x)) END, 9) AS az FROM p a JOIN p b ON a.grp = b.grp AND abs(a.x-b.x) <= 18 AND abs(a.y-b.y) <= 18)
SELECT grp, id, {", ".join(cols)}, round(({" + ".join(filled)}) / {len(cols)}, 5) AS quality FROM n GROUP BY grp, id"""


@query(_weighted_bins(), "det")
def a10_weighted_descriptors(spark, sf):
    p = det(spark, sf).withColumn("confidence", F.col("id") * 37 % 100 / 100.0)
    d = D.descriptors(p, [18.0, 7.0], step=60, stride=30, weight="confidence")
    return d.select("grp", "id", *[F.round(F.col("descriptor")[i], 5).alias(f"b{i}") for i in range(24)], F.round("quality", 5).alias("quality"))


@query("""SELECT tile, count(*) AS suffixes, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT CASE WHEN regexp_matches(name, '[A-Za-z]$') THEN left(name, length(name)-1) ELSE name END AS tile, CASE WHEN regexp_matches(name, '[A-Za-z]$') THEN right(name, 1) ELSE '' END AS suffix, count(*) AS n FROM tiles GROUP BY 1, 2) GROUP BY tile""", "tiles")
def a11_nested_catalogue(spark, sf):
    """A tile's suffixes with their dates as a map, built from flat rows; the query counts what it holds."""
    t = tiles(spark, sf)
    has = F.col("name").rlike("[A-Za-z]$")
    t = t.withColumn("tile", F.when(has, F.substring("name", 1, F.length("name") - 1)).otherwise(F.col("name"))).withColumn("suffix", F.when(has, F.right("name", F.lit(1))).otherwise(""))
    by = t.groupBy("tile", "suffix").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("dates"))
    nested = by.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("suffix", "dates"))).alias("m"))
    return nested.select("tile", F.size("m").cast("long").alias("suffixes"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, v: s + F.size(v)).alias("rows"))


@query("""SELECT id, CASE WHEN n = 0 THEN name ELSE name || '_' || n END AS unique_name FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS n FROM tiles)""", "tiles")
def a12_unique_names(spark, sf):
    return J.numbered_names(tiles(spark, sf), "name", ["id"], "unique_name").select("id", "unique_name")


@query("""SELECT num, arg_min(id, struct_pack(d := d, i := id)) AS first_id, arg_max(id, struct_pack(d := d, i := id)) AS last_id FROM tiles GROUP BY num""", "tiles")
def a12_first_last_wins(spark, sf):
    return tiles(spark, sf).groupBy("num").agg(F.min_by("id", F.struct("d", "id")).alias("first_id"), F.max_by("id", F.struct("d", "id")).alias("last_id"))


@query("""SELECT r_id, id, round(ratio, 6) AS ratio FROM (SELECT c_custkey % 200 AS r_id, c_custkey AS id, abs(c_acctbal)/10000 AS ratio, row_number() OVER (PARTITION BY c_custkey % 200 ORDER BY abs(c_acctbal), c_custkey) AS rn FROM customer) WHERE rn = 1""")
def a13_best_match_per_reference(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 200).alias("r_id"), F.col("c_custkey").alias("id"), (F.abs("c_acctbal") / 10000).alias("ratio"))
    return J.first_by(c, ["r_id"], [F.col("ratio"), F.col("id")]).select("r_id", "id", R6(F.col("ratio")).alias("ratio"))


@query("""SELECT label, round(sum(o*t)/(sum(o+t-o*t)+1e-10), 6) AS iou FROM (SELECT label, (x1 % 10)/10 AS o, y1/10 AS t FROM boxes) GROUP BY label""", "boxes")
def a14_soft_iou(spark, sf):
    o, t = (F.col("x1") % 10) / 10, F.col("y1") / 10
    return boxes(spark, sf).groupBy("label").agg(R6(F.sum(o * t) / (F.sum(o + t - o * t) + 1e-10)).alias("iou"))


@query("""SELECT CAST(floor(x1/5) AS BIGINT) AS r, CAST(floor(y1/2) AS BIGINT) AS c, label, round(avg(x2-x1), 6) AS p, count(*) AS hits FROM boxes GROUP BY 1, 2, 3""", "boxes")
def a15_mosaic_average(spark, sf):
    return boxes(spark, sf).groupBy(F.floor(F.col("x1") / 5).alias("r"), F.floor(F.col("y1") / 2).alias("c"), "label").agg(R6(F.avg(F.col("x2") - F.col("x1"))).alias("p"), F.count(F.lit(1)).alias("hits"))


@query("""WITH m AS (SELECT CAST(floor(x1/5) AS BIGINT) AS r, CAST(floor(y1/2) AS BIGINT) AS c, label, round(avg(x2-x1), 9) AS p FROM boxes GROUP BY 1, 2, 3) SELECT r, c, label AS best FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY p DESC, label) AS rn FROM m) WHERE rn = 1""", "boxes")
def a17_argmax_class(spark, sf):
    m = boxes(spark, sf).groupBy(F.floor(F.col("x1") / 5).alias("r"), F.floor(F.col("y1") / 2).alias("c"), "label").agg(F.round(F.avg(F.col("x2") - F.col("x1")), 9).alias("p"))
    return m.groupBy("r", "c").agg(F.min_by("label", F.struct(-F.col("p"), F.col("label"))).alias("best"))


@query("""WITH a AS (SELECT CAST(round(x1) AS BIGINT) AS angle, count(*) AS n FROM boxes GROUP BY 1) SELECT a.angle, a.n AS n, CAST(a.n + sum(b.n) AS BIGINT) AS score FROM a JOIN a b ON b.angle BETWEEN a.angle - 2 AND a.angle + 2 GROUP BY a.angle, a.n""", "boxes")
def a18_popular_angles(spark, sf):
    a = boxes(spark, sf).groupBy(F.round("x1").cast("long").alias("angle")).agg(F.count(F.lit(1)).alias("n"))
    near = a.select(F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.col("angle") + k)).alias("angle"), F.col("n").alias("m"))
    return a.join(near, "angle").groupBy("angle", "n").agg((F.col("n") + F.sum("m")).alias("score"))


@query("""WITH s AS (SELECT image, x1, y1, CASE WHEN y1 < 5 THEN 't' ELSE 'b' END || CASE WHEN x1 < 25 THEN 'l' ELSE 'r' END AS sector FROM boxes) SELECT image, count(DISTINCT sector) AS sectors, count(DISTINCT sector) >= 4 AS all_present, count(DISTINCT sector) >= 3 AS most_present, round(avg(x1), 6) AS cx, round(min(y1)-1, 6) AS y1, round(max(y1)+1, 6) AS y2 FROM s GROUP BY image""", "boxes")
def a20_sector_groups(spark, sf):
    s = F.concat(F.when(F.col("y1") < 5, "t").otherwise("b"), F.when(F.col("x1") < 25, "l").otherwise("r"))
    n = F.size(F.collect_set(s))
    return boxes(spark, sf).groupBy("image").agg(n.cast("long").alias("sectors"), (n >= 4).alias("all_present"), (n >= 3).alias("most_present"), R6(F.avg("x1")).alias("cx"), R6(F.min("y1") - 1).alias("y1"), R6(F.max("y1") + 1).alias("y2"))


@query("""WITH s AS (SELECT avg(y) FILTER (grp = 'click') AS m1, var_samp(y) FILTER (grp = 'click') AS v1, count(*) FILTER (grp = 'click') AS n1, avg(y) FILTER (grp = 'view') AS m2, var_samp(y) FILTER (grp = 'view') AS v2, count(*) FILTER (grp = 'view') AS n2 FROM det) SELECT n1, n2, round((m1-m2)/sqrt(v1/n1+v2/n2), 5) AS t, round(power(v1/n1+v2/n2, 2)/(power(v1/n1, 2)/(n1-1)+power(v2/n2, 2)/(n2-1)), 3) AS df FROM s""", "det")
def a24_welch_t(spark, sf):
    d = det(spark, sf)
    of = lambda g: F.when(F.col("grp") == g, F.col("y"))
    s = d.agg(*[f(of(g)).alias(n) for g, i in (("click", 1), ("view", 2)) for f, n in ((F.avg, f"m{i}"), (F.var_samp, f"v{i}"), (F.count, f"n{i}"))])
    a, b = F.col("v1") / F.nullif(F.col("n1"), F.lit(0)), F.col("v2") / F.nullif(F.col("n2"), F.lit(0))
    return s.select("n1", "n2", F.round((F.col("m1") - F.col("m2")) / F.sqrt(a + b), 5).alias("t"), F.round(F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n2") - 1)), 3).alias("df"))


@query("""WITH m AS (SELECT grp, y - avg(y) OVER (PARTITION BY grp) AS d FROM det) SELECT grp, count(*) AS n, round(avg(d*d*d)/power(avg(d*d), 1.5), 5) AS skew, round(avg(d*d*d*d)/power(avg(d*d), 2) - 3, 5) AS kurt FROM m GROUP BY grp""", "det")
def a25_normality_moments(spark, sf):
    return det(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.skewness("y"), 5).alias("skew"), F.round(F.kurtosis("y"), 5).alias("kurt"))


@query("""WITH e AS (SELECT event_type AS phase, user_id % 20 AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2) SELECT phase, epoch, loss, epoch = arg_min(epoch, struct_pack(l := loss, e := epoch)) OVER (PARTITION BY phase) AS best FROM e""")
def a26_epoch_metrics(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("phase"), (F.col("user_id") % 20).alias("epoch")).agg(R6(F.avg("value")).alias("loss"))
    best = e.groupBy("phase").agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("b"))
    return e.join(best, "phase").select("phase", "epoch", "loss", (F.col("epoch") == F.col("b")).alias("best"))


@query("""SELECT grp, CAST(least(greatest(floor(y/10)+1, 0), 11) AS BIGINT) AS bin, count(*) AS n FROM det GROUP BY 1, 2""", "det")
def a27_histogram(spark, sf):
    return det(spark, sf).groupBy("grp", F.width_bucket(F.col("y"), F.lit(0.0), F.lit(100.0), F.lit(10)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query()
def a28_kmeans(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=["y"], outputCol="features", handleInvalid="skip").transform(det(spark, sf))
    if d.isEmpty():  # no values, no clusters
        return d.select(F.lit(0).alias("prediction"), F.lit(0).cast("long").alias("n"), F.col("y").alias("lo"), F.col("y").alias("hi"))
    return KMeans(k=3, seed=1).fit(d).transform(d).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), R6(F.min("y")).alias("lo"), R6(F.max("y")).alias("hi"))


@query("""SELECT o_orderpriority AS class, count(*) AS n, dense_rank() OVER (ORDER BY o_orderpriority) AS idx FROM orders GROUP BY 1""")
def s09_class_index(spark, sf):
    """Class numbers by name: the window runs over the distinct classes alone."""
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("idx", F.dense_rank().over(Window.orderBy("class")).cast("long"))
