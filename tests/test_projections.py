"""Projections against published points, and both ways."""

import math

import pytest
from pyspark.sql import functions as F

from terrasheet.functions import projections as P
from terrasheet.functions.geometry import affine


def at(spark, p, lon, lat):
    x, y = p.forward(F.lit(float(lon)), F.lit(float(lat)))
    return tuple(spark.range(1).select(x, y).first())


def test_published_points(spark):
    """Worked examples of textbooks and guidance notes on map projections."""
    snyder = P.LambertConic(33, 45, 23, -96, 0, 0, P.CLARKE_1866)
    assert at(spark, snyder, -75, 35) == pytest.approx((1894410.9, 1564649.5), abs=0.1)
    texas = P.LambertConic(28 + 23 / 60, 30 + 17 / 60, 27 + 50 / 60, -99, 2_000_000, 0, P.CLARKE_1866, P.US_FOOT)
    assert at(spark, texas, -96, 28.5) == pytest.approx((2963503.91, 254759.80), abs=0.05)
    utm = P.TransverseMercator(-75, 0, 0.9996, 0, 0, P.CLARKE_1866)
    assert at(spark, utm, -73.5, 40.5) == pytest.approx((127106.5, 4484124.4), abs=0.1)
    britain = P.TransverseMercator(-2, 49, 0.9996012717, 400_000, -100_000, P.AIRY)
    assert at(spark, britain, 0.5, 50.5) == pytest.approx((577274.99, 69740.50), abs=0.02)


@pytest.mark.parametrize("code,unit", [("EPSG:32615", 1), ("EPSG:32733", 1), (26914, 1), ("EPSG:3857", 1), *[(c, P.US_FOOT) for c in (2275, 2276, 2277, 2278, 2279)]])
def test_round_trips(spark, code, unit):
    p = P.projection(code)
    lon0 = getattr(p, "lon0", -95)
    pts = spark.createDataFrame([(lon0 + dx / 2, lat) for dx in range(-7, 8) for lat in (-40.0, 0.0, 25.0, 29.76, 36.5, 60.0)], "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    back = pts.withColumns({"x": x, "y": y}).withColumns({"l": lon, "m": lat})
    x, y = p.forward(F.col("l"), F.col("m"))
    for r in back.withColumns({"x2": x, "y2": y}).collect():
        assert math.hypot(r.x - r.x2, r.y - r.y2) * unit < 1e-6
        assert (r.l, r.m) == pytest.approx((r.lon, r.lat), abs=1e-11)


def test_by_own_codes_and_affine(spark):
    d = spark.createDataFrame([("EPSG:3857", -10_622_000.0, 3_470_000.0), ("EPSG:4326", -95.4, 29.7), ("EPSG:1", 0.0, 0.0)], "code string, x double, y double")
    rows = d.select("code", P.reproject_by(F.col("x"), F.col("y"), F.col("code"), ["EPSG:3857", "EPSG:4326"], 2278).alias("p")).collect()
    assert rows[2].p is None and all(2.5e6 < r.p.x < 3.5e6 and 1.3e7 < r.p.y < 1.45e7 for r in rows[:2])
    t = affine(0.5, 0.0, -10_622_000.0, 0.0, -0.25, 3_470_000.0)
    r = spark.range(1).select(P.reproject_affine(t, 3857, 4326).alias("t")).first().t
    assert (r.c, r.f) == pytest.approx((-95.4190, 29.7387), abs=1e-3)
    assert (r.a, r.e) == pytest.approx((math.degrees(0.5 / 6378137), -math.degrees(0.25 / 6378137)), rel=1e-6) and (r.b, r.d) == (0, 0)
    with pytest.raises(ValueError):
        P.projection(9999)


def test_lookup_rounds_ties_as_sql(spark, tmp_path):
    """Balances in cents make latitudes that end in a five in the fifth decimal, whose doubles lie on either side of it: the rows are the SQL's, digit by digit."""
    import duckdb

    from terrasheet.plans import ORACLES, QUERIES

    n = 4000
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS c_custkey, CAST(range * 10 + 366570 AS DOUBLE) / 100 AS c_acctbal FROM range({n})) TO '{tmp_path}/customer.parquet'")
    con.sql(f"COPY (SELECT range AS o_orderkey, range // 2 AS o_custkey FROM range({2 * n + 4})) TO '{tmp_path}/orders.parquet'")
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    want = con.sql(ORACLES["j02_reprojected_lookup"]).fetchall()
    got = QUERIES["j02_reprojected_lookup"](spark, str(tmp_path)).collect()
    even = lambda rows: sorted(tuple(r) for r in rows if r[0] % 2 == 0 and r[1] is not None)
    assert len(got) == len(want) == 2 * n + 4 and even(got) == even(want) and len(even(got)) == n
    feet = dict((r[0], tuple(r)[1:]) for r in want)
    assert all(tuple(r)[1:] == (pytest.approx(feet[r.id][0], abs=2e-4), pytest.approx(feet[r.id][1], abs=2e-4)) for r in got if r.x is not None)
    assert sorted(r.id for r in got if r.x is None) == [2 * n, 2 * n + 1, 2 * n + 2, 2 * n + 3]
