"""Projective fits, RANSAC and ICP steps recover transforms."""

import random

import numpy as np
import pytest

from terrasheet.operators import homography as H

KIND = "g string, id long, x double, y double, tx double, ty double"
M = np.array([[1.2, -0.3, 40.0], [0.2, 0.9, -7.0], [2e-4, -1e-4, 1.0]])


def through(m, x, y):
    u, v, w = np.asarray(m).reshape(3, 3) @ (x, y, 1)
    return float(u / w), float(v / w)


def matches(rng, m, n, wrong=0.0, g="g", noise=0.0):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 1000) + 3e6, rng.uniform(0, 800) - 1e6
        u, v = through(m, x - 3e6, y + 1e6)
        if rng.random() < wrong:
            u, v = rng.uniform(0, 1000), rng.uniform(0, 1000)
        out.append((g, i, x, y, u + 5e6 + rng.gauss(0, noise), v + rng.gauss(0, noise)))
    return out


def test_projective_fit(spark):
    rng = random.Random(1)
    rows = matches(rng, M, 60) + matches(rng, M, 3, g="few") + [("line", i, float(i), 2.0 * i, float(i), 1.0) for i in range(9)] + [("one", i, 1.0, 1.0, float(i), 2.0) for i in range(5)]
    got = {r.g: r for r in H.fit_homography(spark.createDataFrame(rows, KIND), ["g"]).collect()}
    for _, _, x, y, u, v in rows[:60]:
        assert through(got["g"].m, x, y) == pytest.approx((u, v), abs=1e-3)
    assert got["few"].m is None and got["line"].m is None and got["one"].m is None


def test_ransac_with_most_matches_wrong(spark):
    """A third of the matches are right; a large group is tested in chunks and sampled from a pool."""
    rng = random.Random(3)
    rows = matches(rng, M, 120, wrong=0.68, noise=0.3) + matches(rng, np.diag([2.0, 2.0, 1.0]), 40, wrong=0.2, g="h") + matches(rng, M, 3, g="few") + [("g", 900, None, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, KIND).repartition(3)
    got = {r.g: r for r in H.ransac_homography(d, ["g"], 1000, 3.0).collect()}
    assert set(got) == {"g", "h"} and 30 <= got["g"].inliers <= 60 and got["g"].rows == 120
    for g, m in (("g", M), ("h", np.diag([2.0, 2.0, 1.0]))):
        for x, y in ((100, 100), (900, 100), (900, 700), (500, 400)):
            u, v = through(m, x, y)
            assert through(got[g].m, x + 3e6, y - 1e6) == pytest.approx((u + 5e6, v), abs=3.0)
    again = {r.g: r for r in H.ransac_homography(d.repartition(5), ["g"], 1000, 3.0).collect()}
    assert {g: (r.hypothesis, r.inliers) for g, r in again.items()} == {g: (r.hypothesis, r.inliers) for g, r in got.items()}
    assert H.ransac_homography(d.limit(0), ["g"]).count() == 0


def test_chunks_and_pool(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 100)
    rows = matches(random.Random(4), M, 700, wrong=0.3)
    got = H.ransac_homography(spark.createDataFrame(rows, KIND), ["g"], 200, 1.0, pool=150).first()
    right = sum(np.hypot(*(np.array(through(got.m, r[2], r[3])) - r[4:])) < 1 for r in rows)
    assert got.inliers <= right and right > 450


def test_the_literal_correspondences(spark):
    """Six pairs, the last two of them wrong: the first four agree exactly with one transform, so that they are found."""
    src = [(100, 200), (150, 250), (300, 350), (400, 450), (500, 600), (800, 900)]
    dst = [(110, 210), (160, 260), (320, 360), (430, 460), (700, 800), (900, 1000)]
    rows = [("g", i, float(a), float(b), float(c), float(d)) for i, ((a, b), (c, d)) in enumerate(zip(src, dst, strict=True))]
    got = H.ransac_homography(spark.createDataFrame(rows, KIND), ["g"], 1000, 5.0).first()
    assert got.inliers >= 4 and got.rows == 6
    near = [np.hypot(*(np.array(through(got.sample, *s)) - d)) < 5 for s, d in zip(src, dst, strict=True)]
    assert sum(near) == got.inliers


@pytest.mark.parametrize("switches,m", [((True, True, True), M), ((True, True, False), [1.2, -0.3, 4, 0.2, 0.9, -7, 0, 0, 1]), ((False, True, False), [1.1, -0.2, 4, 0.2, 1.1, -7, 0, 0, 1]), ((True, False, False), [1.1, 0, 4, 0, 0.8, -7, 0, 0, 1]), ((False, False, False), [1.1, 0, 4, 0, 1.1, -7, 0, 0, 1])])
def test_each_switch_recovers_its_own_transform(spark, switches, m):
    rng = random.Random(7)
    rows = [("g", i, x, y, *map(float, through(m, x, y))) for i, x, y in ((i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(30))]
    d = spark.createDataFrame(rows, KIND)
    got = H.adjust(d, *switches)
    assert got == pytest.approx(np.asarray(m, float).ravel().tolist(), abs=1e-8)
    assert H.adjust(d.limit(0), *switches) is None


def test_matrix_icp(spark):
    rng = random.Random(5)
    pts = [(i, 40.0 * (i % 12) + rng.uniform(-9, 9), 40.0 * (i // 12) + rng.uniform(-9, 9)) for i in range(144)]
    m = [1.01, 0.01, 2.0, -0.006, 0.99, 3.0, 1e-5, -1e-5, 1.0]
    ref = [(i, *map(float, through(m, x, y))) for i, x, y in pts]
    log = H.matrix_icp(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(ref, "id long, x double, y double"), 12).collect()
    assert log[-1].rms < 1e-3 and log[-1].m == pytest.approx(m, abs=1e-4)
