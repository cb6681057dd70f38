"""Lines and polygons given as arrays of points: simplifying, crossing, de-duplicating, containing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

POINTS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def _far(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = (dx * dx + dy * dy) ** 0.5
    return abs(dx * (p[1] - a[1]) - dy * (p[0] - a[0])) / n if n else ((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2) ** 0.5


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas and Peucker's line: the ends stay, and a point further than the tolerance from its chord splits it."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i > 1:
            k = max(range(i + 1, j), key=lambda m: _far(points[m], points[i], points[j]))
            if _far(points[k], points[i], points[j]) > tolerance:
                keep.add(k)
                stack += [(i, k), (k, j)]
    return [points[i] for i in sorted(keep) if 0 <= i < len(points)]


def simplify(points: Column, tolerance: float) -> Column:
    @F.pandas_udf(POINTS)
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [{"x": x, "y": y} for x, y in simplified([(q["x"], q["y"]) for q in p], tolerance)] for p in lines])

    return run(points)


def line_length(points: Column) -> Column:
    legs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.when(F.size(points) > 1, F.aggregate(legs, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a closed ring, by the number of sides that a ray to the right crosses."""
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))), 1).otherwise(0))
    return F.aggregate(sides, F.lit(0), lambda s, v: s + v) % 2 == 1


def crossings(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Where segments (id, ax, ay, bx, by) of the same key cross: (key, id, r_id, x, y)."""
    r = right.select(*[F.col(c).alias("r_" + c) for c in (key, "id", "ax", "ay", "bx", "by")])
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    vx, vy = F.col("r_bx") - F.col("r_ax"), F.col("r_by") - F.col("r_ay")
    wx, wy = F.col("r_ax") - F.col("ax"), F.col("r_ay") - F.col("ay")
    det = F.nullif(ux * vy - uy * vx, F.lit(0.0))
    both = left.join(r, F.col(key) == F.col("r_" + key)).withColumn("_s", (wx * vy - wy * vx) / det).withColumn("_t", (wx * uy - wy * ux) / det)
    both = both.where("_s BETWEEN 0 AND 1 AND _t BETWEEN 0 AND 1")
    return both.select(key, "id", "r_id", (F.col("ax") + F.col("_s") * ux).alias("x"), (F.col("ay") + F.col("_s") * uy).alias("y"))


def distinct_lines(lines: DataFrame, key: str, order: list[str], least: float) -> DataFrame:
    """Lines (ax, ay, bx, by) of each image that aren't near a line kept before them: both ends nearer than `least`, in either direction.

    The order decides, so that the lines of an image are read one after another,
    in a task that holds many images; only the image's kept lines are remembered.
    """
    names = lines.columns
    at = [names.index(c) for c in (key, "ax", "ay", "bx", "by")]

    def near(p, q) -> bool:
        return (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 < least * least

    def run(batches):
        image, kept = object(), []
        for pdf in batches:
            keep = []
            for row in pdf.itertuples(index=False, name=None):
                own, ax, ay, bx, by = (row[i] for i in at)
                if own != image:
                    image, kept = own, []
                a, b = (ax, ay), (bx, by)
                fresh = not any((near(a, c) and near(b, d)) or (near(a, d) and near(b, c)) for c, d in kept)
                if fresh:
                    kept.append((a, b))
                keep.append(fresh)
            yield pdf[keep]

    return lines.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, lines.schema)
