"""Vector layers there and back, against known bytes, and how little of them a box reads."""

import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from terrasheet.sources import layers as L

ROWS = f"id long, name string, size double, flag boolean, day date, {L.SHAPE}"


def shapes(kind, n=120):
    rng = random.Random(n)
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
        ring = lambda r, x=x, y=y: [(x - r, y - r), (x - r, y + r), (x + r, y + r), (x + r, y - r), (x - r, y - r)]
        parts = {"point": [[(x, y)]], "line": [[(x, y), (x + 5, y + rng.random())], [(x + 9, y), (x + 9, y + 2), (x + 1, y)]][: 1 + i % 2], "polygon": [ring(9.0), ring(3.0)[::-1]][: 1 + i % 2]}[kind]
        out.append((i, f"näme {i}" if i % 5 else None, rng.uniform(-1e9, 1e-9), i % 3 == 0, datetime.date(2020, 1, 1 + i % 28) if i % 4 else None, kind, [[{"x": a, "y": b} for a, b in p] for p in parts]))
    return out


def plain(rows):
    return sorted((r["id"], r["name"], r["size"], r["flag"], r["day"], r["kind"], tuple(tuple((p["x"], p["y"]) for p in part) for part in r["parts"])) for r in rows)


@pytest.mark.parametrize("kind", ["point", "line", "polygon"])
def test_shapefiles(spark, tmp_path, kind):
    d = spark.createDataFrame(shapes(kind), ROWS).repartition(3)
    L.write_shapefile(d, f"file://{tmp_path}/layer", kind)
    back = L.read_shapefile(spark, f"file://{tmp_path}/layer", records=17)
    assert back.rdd.getNumPartitions() >= 7 and set(back.columns) >= {"id", "name", "size", "flag", "day", "record", "x1"}
    assert plain(back.collect()) == plain(d.collect())
    box = (200.0, 300.0, 520.0, 610.0)
    want = {r["id"] for r in L.boxed(d).where(L.in_box(box)).collect()}
    near = L.read_shapefile(spark, f"file://{tmp_path}/layer", box)
    assert {r.id for r in near.collect()} == want and 0 < len(want) < 60
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "x1" in plan
    (tmp_path / "none").mkdir()
    assert L.read_shapefile(spark, f"file://{tmp_path}/none").count() == 0


def test_a_box_is_judged_before_a_shape_is_decoded(spark, tmp_path):
    """Places outside the box may be spoilt: they are never read."""
    d = spark.createDataFrame([(i, None, 1.0, True, None, "polygon", [[{"x": i * 100.0, "y": 0.0}, {"x": i * 100.0, "y": 5.0}, {"x": i * 100.0 + 5, "y": 5.0}]]) for i in range(5)], ROWS).coalesce(1)
    L.write_shapefile(d, f"file://{tmp_path}/x", "polygon")
    (shp,) = (tmp_path / "x").glob("*.shp")
    raw = bytearray(shp.read_bytes())
    at = 100
    while at < len(raw):
        n = struct.unpack_from(">i", raw, at + 4)[0] * 2
        if struct.unpack_from("<d", raw, at + 12)[0] != 200.0:
            raw[at + 8 + 36 : at + 8 + 44] = struct.pack("<2i", -7, 10**9)
        at += 8 + n
    shp.write_bytes(raw)
    assert [r.id for r in L.read_shapefile(spark, f"file://{tmp_path}/x", (150.0, 0.0, 250.0, 9.0)).collect()] == [2]
    with pytest.raises(Exception, match="struct|unpack|buffer"):
        L.read_shapefile(spark, f"file://{tmp_path}/x").collect()


def test_limits_and_nulls(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", None, None, None, None, None), (2, None, 2.5, False, None, "line", [])], ROWS).coalesce(1)
    L.write_shapefile(d, f"file://{tmp_path}/n", "line")
    rows = sorted(L.read_shapefile(spark, f"file://{tmp_path}/n").collect(), key=lambda r: r.id)
    assert [(r.id, r.name, r.size, r.flag, r.kind, r.parts, r.x1) for r in rows] == [(1, "a", None, None, None, None, None), (2, None, 2.5, False, None, None, None)]
    with pytest.raises(Exception, match="254 bytes"):
        L.write_shapefile(d.withColumn("name", F.lit("x" * 300)), f"file://{tmp_path}/m", "line")


def test_wkb():
    line = struct.pack("<BII4d", 1, 2, 2, 1, 2, 3, 4)
    assert L.encode_wkb("line", [[{"x": 1, "y": 2}, {"x": 3, "y": 4}]]) == line and L.decode_wkb(line) == ("line", [[(1, 2), (3, 4)]])
    assert L.decode_wkb(struct.pack(">BI2d", 0, 1, 5, 6)) == ("point", [[(5, 6)]])
    assert L.decode_wkb(struct.pack("<BI3d", 1, 1001, 5, 6, 7)) == ("point", [[(5, 6)]]) and L.decode_wkb(struct.pack("<BII2d", 1, 0x20000001, 4326, 5, 6)) == ("point", [[(5, 6)]])
    two = struct.pack("<BII", 1, 5, 2) + line + line
    assert L.decode_wkb(two) == ("line", [[(1, 2), (3, 4)]] * 2)
    with pytest.raises(ValueError):
        L.decode_wkb(struct.pack("<BI", 1, 7))


@pytest.mark.parametrize("kind", ["point", "line", "polygon"])
def test_parquet_layers(spark, tmp_path, kind):
    d = spark.createDataFrame(shapes(kind, 300), ROWS).union(spark.createDataFrame([(900, None, None, None, None, None, None)], ROWS))
    path = f"file://{tmp_path}/layer"
    L.write_layer(d, path, 100.0)
    assert plain(L.read_layer(spark, path).where("kind IS NOT NULL").collect()) == plain(d.where("kind IS NOT NULL").collect())
    near = L.read_layer(spark, path, (200.0, 300.0, 420.0, 510.0))
    want = L.boxed(d).where(L.in_box((200.0, 300.0, 420.0, 510.0))).count()
    assert near.count() == want > 0
    assert "LessThanOrEqual(x1,420.0)" in near._jdf.queryExecution().executedPlan().toString()
