"""Queries over vector layers: zones written as layers and read back, whole and by a box."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import layers as L
from .files import _new
from .regions import _ZONES, zones
from .registry import query

_BOX = (200.0, 50.0, 700.0, 300.0)
_MEETS = f"zx - 2 * r <= {_BOX[2]} AND zx + 2 * r >= {_BOX[0]} AND zy - r <= {_BOX[3]} AND zy + r >= {_BOX[1]}"


@query(f"""WITH z AS ({_ZONES}) SELECT pid, round(zx - 2 * r, 6) AS x1, round(zy + r, 6) AS y2, 7 + CASE WHEN pid % 3 = 0 THEN 5 ELSE 0 END AS places FROM z WHERE {_MEETS}""")
def s02_shapefile_by_box(spark, sf):
    """Zones written as shapefiles by the tasks; those that a box meets are read back."""
    path = _new(spark, "zones")
    L.write_shapefile(zones(spark, sf).select("pid", F.col("rings").alias("parts")), path, "polygon")
    near = L.read_shapefile(spark, path, _BOX)
    places = F.aggregate(F.transform("parts", lambda p: F.size(p)), F.lit(0), lambda s, n: s + n)
    return near.select("pid", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), places.alias("places"))


@query(f"""WITH z AS ({_ZONES}) SELECT pid, round(zx + 2 * r, 6) AS x2, round(zy - r, 6) AS y1, CASE WHEN pid % 3 = 0 THEN 2 ELSE 1 END AS rings FROM z WHERE {_MEETS}""")
def k02_parquet_layer(spark, sf):
    """Zones as well-known binary with bounding boxes, which the scan compares with the box."""
    path = _new(spark, "zones")
    L.write_layer(zones(spark, sf).select("pid", F.lit("polygon").alias("kind"), F.col("rings").alias("parts")), path, 100.0)
    return L.read_layer(spark, path, _BOX).select("pid", F.round("x2", 6).alias("x2"), F.round("y1", 6).alias("y1"), F.size("parts").alias("rings"))
