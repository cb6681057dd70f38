"""Queries over the sources and sinks: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.lineage import shared_dir
from ..sources import files as S
from .registry import boxes, query, ref, table

R6 = lambda c: F.round(c, 6)


def _new(spark, kind):
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@query("""SELECT p_partkey AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part""")
def s01_csv_round_trip(spark, sf):
    path = _new(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.csv(path, header=True, sep="\t")
    return S.read_csv(spark, path, "id long, name string, size int, price double", "\t")


@query("""SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS line1, 0.0::DOUBLE AS line2, CAST(NULL AS DOUBLE) AS line3, -CAST(p_size AS DOUBLE) AS line4, p_retailprice AS line5, CAST(p_partkey AS DOUBLE) AS line6 FROM part""")
def s07_world_files(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat_ws("\n", F.col("p_size").cast("string"), F.lit(" 0.0 "), F.lit(""), F.lit("none"), (-F.col("p_size")).cast("string"), F.col("p_retailprice").cast("string"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), *S.parse_world_file(text))


@query("""SELECT id, round(x, 6) AS c, round(y, 6) AS f, 0.25::DOUBLE AS a, -0.25::DOUBLE AS e FROM ref""", "ref")
def k05_world_file_write(spark, sf):
    t = G.affine(0.25, 0, F.col("x"), 0, -0.25, F.col("y"))
    path = _new(spark, "world")
    ref(spark, sf).select("id", S.world_file_text(t).alias("text")).write.parquet(path)
    back = spark.read.parquet(path).select("id", *S.parse_world_file(F.col("text")))
    return back.select("id", R6(F.col("line5")).alias("c"), R6(F.col("line6")).alias("f"), F.col("line1").alias("a"), F.col("line4").alias("e"))


@query("""SELECT image, CAST(seq AS INTEGER) AS cls, round((x1+x2)/2/100, 6) AS xc, round((y1+y2)/2/20, 6) AS yc, round((x2-x1)/100, 6) AS w, round((y2-y1)/20, 6) AS h FROM boxes""", "boxes")
def k07_yolo_labels(spark, sf):
    path = _new(spark, "yolo")
    b = boxes(spark, sf)
    b.select(F.concat_ws(" ", F.col("image").cast("string"), S.yolo_line(F.col("seq"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 100.0, 20.0)).alias("value")).write.text(path)
    lines = spark.read.text(path)
    return lines.select(F.substring_index("value", " ", 1).cast("long").alias("image"), *S.parse_yolo(F.regexp_replace("value", "^[0-9]+ ", "")))


@query("""SELECT image AS image_id, row_number() OVER (PARTITION BY image ORDER BY seq, label, x1, y1, x2, y2) AS id, label AS category, round(x1, 6) AS x, round(y1, 6) AS y, round(x2-x1, 6) AS w, round(y2-y1, 6) AS h, round((x2-x1)*(y2-y1), 6) AS area FROM boxes WHERE x2 > x1 AND y2 > y1""", "boxes")
def k06_coco_round_trip(spark, sf):
    path = _new(spark, "coco")
    S.coco_json(boxes(spark, sf)).select("json").write.text(path)
    d = S.parse_coco(spark.read.text(path), "value")
    return d.select("image_id", "id", "category", *[R6(F.col(c)).alias(c) for c in ("x", "y", "w", "h", "area")])


@query("""SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM ref""", "ref")
def k02_geojson(spark, sf):
    f = S.geojson_points(ref(spark, sf))
    p = F.from_json("feature", "struct<geometry:struct<coordinates:array<double>>,properties:struct<id:long>>")
    d = f.select(p.alias("p"))
    return d.select(F.col("p.properties.id").alias("id"), F.round(F.col("p.geometry.coordinates")[0], 4).alias("x"), F.round(F.col("p.geometry.coordinates")[1], 4).alias("y"))
