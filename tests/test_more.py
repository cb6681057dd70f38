"""Searches, clusters, registration variants, names and statistics against brute force and known values."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from terrasheet.functions.text import partial, ratio
from terrasheet.operators import cells as C
from terrasheet.operators import iterative as I
from terrasheet.operators import names as N
from terrasheet.operators import search as V
from terrasheet.operators import spatial as S
from terrasheet.operators import statistics as T
from terrasheet.sources import files

XY = "id long, x double, y double"


def nearest(p, ref):
    return min((math.hypot(p[1] - r[1], p[2] - r[2]), r[0]) for r in ref)


@pytest.mark.parametrize("far", [0.0, 1e5])
def test_nearest_join_with_crowds_and_outliers(spark, far):
    rng = random.Random(2)
    ref = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(300 + i, 900 + rng.random() * 50, rng.random() * 900) for i in range(60)]
    pts = [(i, rng.uniform(-2, 1000), rng.uniform(-2, 1000)) for i in range(120)] + [(200 + i, far * rng.random(), -far) for i in range(20)]
    got = {r.id: (r.dist, r.r_id) for r in S.nearest_join(spark.createDataFrame(pts, XY), spark.createDataFrame(ref, XY)).collect()}
    assert set(got) == {p[0] for p in pts}
    for p in pts:
        want = nearest(p, ref)
        assert got[p[0]][0] == pytest.approx(want[0], rel=1e-12)
        assert got[p[0]][1] == want[1] or far


def test_nearest_pairs_stay_few_on_clusters(spark):
    """Dense spots of several widths, one place many times over, and a far outlier: no point meets more than a few of them."""
    rng = random.Random(8)
    spots = [(rng.uniform(0, 1000), rng.uniform(0, 1000), 10 ** rng.uniform(-3, 2)) for _ in range(12)]
    one = lambda i: (i, *((lambda s: (rng.gauss(s[0], s[2]), rng.gauss(s[1], s[2])))(rng.choice(spots))))
    ref = [one(i) for i in range(3000)] + [(5000 + i, 77.0, 77.0) for i in range(400)] + [(9000, 1e7, 1e7), (9001, None, 1.0), (9002, float("nan"), 1.0)]
    pts = [one(i) for i in range(600)] + [(1000 + i, 77.0 + i * 1e-4, 77.0) for i in range(50)] + [(2000, None, 5.0)]
    tree = C.build_cells(spark.createDataFrame(ref, XY))
    asked = spark.createDataFrame(pts, XY)
    assert C.candidates(asked, tree).count() <= 30 * len(pts)
    got = {r.id: (r.dist, r.r_id) for r in C.nearest(asked, tree).collect()}
    assert set(got) == {p[0] for p in pts if p[1] is not None}
    places = [r for r in ref if r[1] is not None and not math.isnan(r[1])]
    for p in pts:
        if p[1] is not None:
            assert got[p[0]] == pytest.approx(nearest(p, places), rel=1e-12)


def test_nearest_join_of_few(spark):
    one = spark.createDataFrame([(1, 5.0, 5.0)], XY)
    assert S.nearest_join(one, one.limit(0)).count() == 0 and S.nearest_join(one.limit(0), one).count() == 0
    assert [(r.r_id, r.dist) for r in S.nearest_join(spark.createDataFrame([(7, 8.0, 9.0)], XY), one).collect()] == [(1, 5.0)]


def test_clusters_by_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(200)] + [(200 + i, 3 + rng.gauss(0, 0.02), 3 + rng.gauss(0, 0.02)) for i in range(150)] + [(400, 50.0, 50.0), (401, 60.0, 60.0), (402, 60.0, 60.0)]
    eps, parent = 0.4, {p[0]: p[0] for p in pts}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    linked = set()
    for i, a in enumerate(pts):
        for b in pts[:i]:
            if math.hypot(a[1] - b[1], a[2] - b[2]) <= eps:
                linked |= {a[0], b[0]}
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    got = {r.id: r.cluster for r in I.cluster(spark.createDataFrame(pts, XY), eps).collect()}
    assert got == {p[0]: root(p[0]) if p[0] in linked else None for p in pts}


def test_fuzzy_catalogue_by_brute_force(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("ABC01") for _ in range(rng.choice((2, 5, 10, 11, 15, 16, 17, 18, 24)))) for _ in range(60)]
    cat = list(names[:30])
    for n in names[:50]:
        w = list(n)
        for _ in range(rng.randint(0, 2)):
            w.pop(rng.randrange(len(w))) if rng.random() < 0.5 and len(w) > 1 else w.insert(rng.randrange(len(w)), "Z")
        cat.append("".join(w))
    got = {r.name: (r.best, r.score) for r in V.fuzzy_catalogue(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(n,) for n in cat], "n string"), "n", 85.0).collect()}
    want = {}
    for n in set(names):
        s, b = min((-ratio(n, c), c) for c in set(cat))
        if -s >= 85:
            want[n] = (b, -s)
    assert len(want) > 30 and {n: (b, pytest.approx(s)) for n, (b, s) in want.items()} == got


def test_nearest_vectors_in_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    got = V.nearest_vectors(df.where("id % 10 = 0"), df, 3, block=4).collect()
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for i in range(0, 90, 10):
        want = sorted((round(cos(rows[i][1], v), 9), j) for j, v in rows[:90] if j != i)[:3]
        assert [(r.dist, r.other) for r in sorted((r for r in got if r.id == i), key=lambda r: r.place)] == [(pytest.approx(d, abs=2e-9), j) for d, j in want]


def test_robust_fit_leaves_wrong_matches_out(spark):
    rng = random.Random(1)
    turn = math.radians(1.5)
    rows = []
    for i in range(120):
        x, y = rng.uniform(0, 100), rng.uniform(0, 100)
        tx, ty = 5 + math.cos(turn) * x - math.sin(turn) * y, -8 + math.sin(turn) * x + math.cos(turn) * y
        rows.append((i, x, y, tx + (300 + 9 * i if i % 10 == 0 else 0), ty - (200 + 7 * i if i % 10 == 0 else 0), 1.0))
    fit, left = I.robust_fit(spark.createDataFrame(rows, "id long, x double, y double, tx double, ty double, weight double"), eps=0.1)
    assert fit == pytest.approx((math.cos(turn), math.sin(turn), 5, -8), abs=1e-6)
    assert not any(r.id % 10 == 0 for r in left.collect())


def test_icp_variants_find_the_way_back(spark):
    rng = random.Random(3)
    ref = [(i, rng.uniform(0, 400), rng.uniform(0, 400), "ab"[i % 2]) for i in range(150)]
    r = spark.createDataFrame(ref, XY + ", layer string")
    c, s = math.cos(math.radians(0.4)), math.sin(math.radians(0.4))
    m = r.select("id", (F.col("x") * c - F.col("y") * s + 1).alias("x"), (F.col("x") * s + F.col("y") * c - 1).alias("y"), "layer")
    for log in (I.icp(m, r, 12, kind="rigid", mean_error=True), I.weighted_icp(m, r, {"a": 0.8, "b": 0.2}, 12, 40.0)):
        assert min(x.rms for x in log.collect()) < 1e-6
    small = r.select("id", (F.col("x") / 25 + 3).alias("x"), (F.col("y") / 25 - 2).alias("y"))
    assert I.icp(small, r, 5, start=I.bounds_transform(small, r)).first().rms < 1e-6


def test_vote_order_stops_at_the_first_conflict(spark):
    order = lambda rows: [(r.a, r.b) for r in I.vote_order(spark.createDataFrame(rows, "a long, b long, votes long")).orderBy(F.desc("votes")).collect()]
    assert order([(1, 1, 9), (2, 2, 8), (1, 3, 7), (4, 4, 6)]) == [(1, 1), (2, 2)]
    assert order([(1, 1, 9), (2, 2, 5), (3, 3, 4)]) == [(1, 1), (2, 2)]
    assert order([(1, 1, 0)]) == []


def test_adaptive_clip(spark):
    rng = random.Random(7)
    rows = [("g", i, rng.gauss(0, 1), 1 if i % 2 else -1) for i in range(200)] + [("h", i, rng.gauss(0, 1), 1) for i in range(200)]

    def clip(values):
        while True:
            plus = sum(t > 0 for _, t in values)
            most = abs(2 * plus - len(values))
            rest = len(values) - most
            w = 1 if rest > most else 3 if 0.1 * most > rest else 2
            mean = sum(v for v, _ in values) / len(values)
            sd = math.sqrt(sum((v - mean) ** 2 for v, _ in values) / len(values))
            kept = [(v, t) for v, t in values if abs(v - mean) <= w * sd + 1e-12]
            if len(kept) == len(values):
                return kept
            values = kept

    got = collections.Counter(r.g for r in I.clip_outliers(spark.createDataFrame(rows, "g string, id long, v double, turn int"), ["g"], "v", None, "turn").collect())
    assert got == {g: len(clip([(v, t) for k, _, v, t in rows if k == g])) for g in "gh"}


def test_student_p():
    for t, n, p in ((2.228139, 10, 0.05), (0.0, 5, 1.0), (12.7062, 1, 0.05), (1.959964, 1e7, 0.05)):
        assert T.incomplete_beta(n / 2, 0.5, n / (n + t * t)) == pytest.approx(p, abs=1e-5)


def test_names_from_ocr(spark):
    d = spark.createDataFrame([(1, ["HARRIS", "482O1C0225G"]), (2, ["panel number 0310b"]), (3, ["see 0440 of"]), (4, ["a", "b"])], "id long, t array<string>")
    got = {r.id: (r.name, r.way) for r in N.secondary_name(d, "id", "t", "48201C", 60.0).collect()}
    assert got[1][1] == "key" and got[2] == ("48201C0310B", "lettered") and got[3] == ("48201C0440", "digits") and got[4] == ("48201C_ab", "short")
    lines = spark.createDataFrame([(1, "map 48201C 0225 end"), (2, "nothing here at all")], "id long, line string")
    found = {r.id: r.word for r in N.words_like(lines, "id", "line", "48201C", 70.0).collect()}
    assert found == {1: "48201C0225"} and partial("48201C", "48201C") == 100.0
    tiles = spark.createDataFrame([(1, "48201C02258"), (1, "HARRIS 1985"), (2, "48201C0225")], "id long, line string")
    assert {r.id: r.name for r in N.index_tile_name(tiles, "id", "line", "48201").collect()} == {1: "0225", 2: "0225"}


def test_dates_from_ocr(spark):
    texts = ["January 5,1990", "JAN 5, 1990", "5 january 1990", "1/5/1990", "1990-01-05", "|January 5, 1990", "Janvier 5, 1990", "", None]
    days = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(N.parse_date(F.col("t"))).collect()]
    assert [str(d) for d in days[:6]] == ["1990-01-05"] * 6 and days[6:] == [None] * 3


def test_image_list_and_world_files(spark, tmp_path):
    for name in ("a.TIF", "b.txt", "sub/c.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.list_images(spark, str(tmp_path)).collect()) == ["a.TIF", "c.jpeg"]
    world = tmp_path / "w"
    world.mkdir()
    (world / "s.TFW").write_text("1\n0\n0\n-1\n10\n20\n")
    assert [(r.line1, r.line4, r.line6) for r in files.read_world_files(spark, str(world)).collect()] == [(1.0, -1.0, 20.0)]


def test_repeated_names_are_compared_once(spark):
    left = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (2, "abcd")], "b int, n string")
    right = spark.createDataFrame([(1, f"abc{c}", 10 * i + j) for i, c in enumerate("dxyzabefg") for j in range(4)] + [(1, "abcd", 900)], "b int, m string, id long")
    score = F.when(F.col("m") == "abcd", 100.0).otherwise(75.0)
    from terrasheet.operators import relational as J

    got = [(r.b, r.n, r.id, r.score, r.place) for r in J.best_matches(left, right, "b", "n", "m", score, "id", 7).orderBy("place").collect()]
    assert got == [(1, "abcd", i, s, k + 1) for k, (i, s) in enumerate([*((i, 100.0) for i in (0, 1, 2, 3, 900)), (10, 75.0), (11, 75.0)])]
    best = J.best_match(left, right, "b", "n", "m", score, "id")
    assert [(r.b, r.n, r.id, r.m, r.score) for r in best.collect()] == [(1, "abcd", 0, "abcd", 100.0)]
    # the score is worked out once for each pair of names
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [b#" in plan[plan.index("Join") :]


def test_rotation_search_sorts_nothing(spark):
    from terrasheet.plans.details import least_turned_area

    b = spark.createDataFrame([(1, 4.0, 2.0), (1, 3.0, 3.0), (2, 0.0, 0.0), (3, None, 1.0), (4, 2.0, 1.0)], "image int, w double, h double")
    found = least_turned_area(b, "image", [-2.0, -1.0, 1.0, 2.0])
    turned = lambda w, h, t: round((w * math.cos(t) + h * math.sin(t)) * (w * math.sin(t) + h * math.cos(t)), 6)
    t = math.radians(1)
    assert {r.image: (r.area, r.angle) for r in found.collect()} == {1: (min(turned(4, 2, t), turned(3, 3, t)), -1.0), 2: (0.0, -1.0), 3: (None, -1.0), 4: (turned(2, 1, t), -1.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Generate" not in plan
