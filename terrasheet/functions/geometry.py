"""Points, boxes and transforms of the plane, as column expressions.

An affine transform is a struct (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
#: State-plane zones of Texas by FIPS number.
STATE_PLANE = {"4201": "EPSG:2275", "4202": "EPSG:2276", "4203": "EPSG:2277", "4204": "EPSG:2278", "4205": "EPSG:2279"}


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360); an angle just below 0 is 0."""
    az = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))
    return F.when(az < 360, az).otherwise(0.0)


def intersection(a: dict, b: dict) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: dict) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def iou(a: dict, b: dict) -> Column:
    both = intersection(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def box(prefix: str = "") -> dict:
    return {k: F.col(prefix + k) for k in ("x1", "y1", "x2", "y2")}


def utm_code(lon: Column) -> Column:
    zone = ((lon + 180) / 6).cast("int") + 1
    return F.concat(F.lit("EPSG:"), (32600 + zone).cast("string"))


def state_plane(zone: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATE_PLANE.items() for x in kv]), zone)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def sector(x: Column, y: Column, width: Column, height: Column) -> Column:
    side = F.when(x < width / 2, "left").otherwise("right")
    return F.concat(F.when(y < height / 2, "top").otherwise("bottom"), F.lit(" "), side)


def dms_degrees(s: Column) -> Column:
    """Degrees of `DDMMSS` among a text's digits; of seven or more the third is dropped; null for fewer than six."""
    d = F.regexp_replace(s, "[^0-9]", "")
    six = F.when(F.length(d) >= 7, F.concat(F.substring(d, 1, 2), F.substring(d, 4, 4))).when(F.length(d) == 6, d)
    part = lambda i: F.substring(six, i, 2).cast("double")
    return part(1) + part(3) / 60 + part(5) / 3600


def affine(a, b, c, d, e, f) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def apply(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t["a"] * x + t["b"] * y + t["c"], t["d"] * x + t["e"] * y + t["f"]


def compose(t: Column, u: Column) -> Column:
    """u first, then t."""
    return affine(
        t["a"] * u["a"] + t["b"] * u["d"], t["a"] * u["b"] + t["b"] * u["e"], t["a"] * u["c"] + t["b"] * u["f"] + t["c"],
        t["d"] * u["a"] + t["e"] * u["d"], t["d"] * u["b"] + t["e"] * u["e"], t["d"] * u["c"] + t["e"] * u["f"] + t["f"],
    )


def invert(t: Column) -> Column:
    det = F.nullif(t["a"] * t["e"] - t["b"] * t["d"], F.lit(0.0))
    a, b, d, e = t["e"] / det, -t["b"] / det, -t["d"] / det, t["a"] / det
    return affine(a, b, -(a * t["c"] + b * t["f"]), d, e, -(d * t["c"] + e * t["f"]))


def pixel_center(t: Column, row: Column, col: Column) -> tuple[Column, Column]:
    return apply(t, col + 0.5, row + 0.5)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length > 0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def steps_along(length: Column, step: float, end: bool) -> Column:
    """Distances 0, step, 2 step, ... along a line; with `end`, one on its whole multiple too."""
    n = F.floor(length / step).cast("int") if end else F.ceil(F.floor(length) / step).cast("int") - 1
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: i * F.lit(float(step)))).otherwise(F.array().cast("array<double>"))


def polygon(b: dict) -> Column:
    """A box as a closed ring of five points, from its first corner; null if it is empty."""
    at = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"), at("x1", "y1")))


def to_matrix(t: Column) -> Column:
    """An affine struct as the nine numbers of a 3 x 3 matrix, by rows."""
    return F.array(*[t[k] for k in "abcdef"], *map(F.lit, (0.0, 0.0, 1.0)))


def from_matrix(m: Column) -> Column:
    return affine(*[F.get(m, F.lit(i)) for i in range(6)])


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, b: dict) -> Column:
    """The part of the segment from a to b that lies in box `b` as a struct (ax, ay, bx, by); null if there is none of any length."""
    enter, leave, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q, lo, hi in ((ax, bx, b["x1"], b["x2"]), (ay, by, b["y1"], b["y2"])):
        to_lo, to_hi = (lo - p) / F.nullif(q - p, F.lit(0.0)), (hi - p) / F.nullif(q - p, F.lit(0.0))
        # a segment along this side's axis has no such places: greatest and least pass over nulls
        enter.append(F.least(to_lo, to_hi))
        leave.append(F.greatest(to_lo, to_hi))
        out = out | ((p == q) & ((p < lo) | (p > hi)))
    t, u = F.greatest(*enter), F.least(*leave)
    at = lambda p, q, t: p + t * (q - p)
    return F.when(~out & (t < u), F.struct(at(ax, bx, t).alias("ax"), at(ay, by, t).alias("ay"), at(ax, bx, u).alias("bx"), at(ay, by, u).alias("by")))
