"""Queries without SQL: laws that their results must keep."""

import collections
import itertools
import math
import random

from pyspark.sql import functions as F

from terrasheet.operators import lines as L
from terrasheet.plans import QUERIES


def test_kmeans_parts_the_line(spark, data):
    """Three clusters of all values, whose ranges don't overlap."""
    rows = sorted(QUERIES["a28_kmeans"](spark, data).collect(), key=lambda r: r.lo)
    events = spark.read.parquet(f"{data}/events.parquet")
    assert len(rows) == 3 and sum(r.n for r in rows) == events.count()
    assert all(a.hi < b.lo for a, b in itertools.pairwise(rows))


def test_split_is_repeatable(spark, data):
    got = {r.part: r.n for r in QUERIES["t06_split_80_20"](spark, data).collect()}
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert sum(got.values()) == n and abs(got["train"] - 0.8 * n) < 5 * math.sqrt(0.16 * n)
    assert got == {r.part: r.n for r in QUERIES["t06_split_80_20"](spark, data).collect()}


def test_distinct_lines_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(k % 4, k, *(float(rng.randint(0, 12)) for _ in range(4))) for k in range(240)]
    got = {(r.image, r.seq) for r in L.distinct_lines(spark.createDataFrame(rows, "image long, seq long, ax double, ay double, bx double, by double"), "image", ["seq"], 3.0).collect()}
    kept, near = collections.defaultdict(list), lambda p, q: math.dist(p, q) < 3
    for image, seq, ax, ay, bx, by in rows:
        a, b = (ax, ay), (bx, by)
        if not any((near(a, c) and near(b, d)) or (near(a, d) and near(b, c)) for _, c, d in kept[image]):
            kept[image].append((seq, a, b))
    assert got == {(i, s) for i, v in kept.items() for s, _, _ in v}


def test_simplified_lines_stay_near(spark):
    """The ends stay, what goes lies within the tolerance of the chord over it, and what stays has a reason to."""
    rng = random.Random(4)
    lines = [[(float(x), rng.gauss(0, 6)) for x in range(0, 200, 5)] for _ in range(15)] + [[(0.0, 0.0), (1.0, 0.0)], [(2.0, 2.0)]]
    d = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in enumerate(lines)], "k int, p array<struct<x:double,y:double>>")
    for r in d.select("k", L.simplify(F.col("p"), 5.0).alias("s")).collect():
        line, kept = lines[r.k], [(p.x, p.y) for p in r.s]
        at = [line.index(p) for p in kept]
        assert kept[0] == line[0] and kept[-1] == line[-1] and at == sorted(at)
        for i, j in itertools.pairwise(at):
            (ax, ay), (bx, by) = line[i], line[j]
            assert all(abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / math.dist(line[i], line[j]) <= 5.0 for x, y in line[i + 1 : j])
        assert len(line) < 3 or len(kept) < len(line)
