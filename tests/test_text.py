"""Weighted scores and key alignment."""

import random

import pytest
from pyspark.sql import functions as F

from terrasheet.functions import text as X


def brute_ratio(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = [0] + [0] * len(b) if not row else row
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_weighted_scores():
    """Examples that the documentation of fuzzy matching gives, to a point."""
    assert X.weighted("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 95 and X.weighted("New York Jets", "new york jets") == 100
    assert X.weighted("cowboys", "Dallas Cowboys") == 90
    assert X.weighted("new york jets", "New York Giants") == pytest.approx(78, abs=1)
    assert X.weighted("", "x") == 0 and X.weighted("--", "x") == 0 and X.weighted(None, "x") is None
    assert X.set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear", X.ratio) == 100


def test_weighted_by_brute_force():
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 5)))
    part = lambda a, b: max((brute_ratio(*(lambda s, t: (s, t[max(0, i) : i + len(s)]))(*sorted((a, b), key=len))) for i in range(1 - min(len(a), len(b)), max(len(a), len(b)))), default=0.0)
    for _ in range(150):
        a, b = text(), text()
        p, q = set(a.split()), set(b.split())
        both, one, two = (" ".join(sorted(s)) for s in (p & q, p - q, q - p))
        sides = [both, (both + " " + one).strip(), (both + " " + two).strip()]
        f, scale = (brute_ratio, 1.0) if max(len(a), len(b)) / min(len(a), len(b)) < 1.5 else (part, 0.9 if max(len(a), len(b)) / min(len(a), len(b)) <= 8 else 0.6)
        sets = [f(sides[i], sides[j]) for i, j in ((0, 1), (0, 2), (1, 2)) if sides[i] or i]
        want = max(brute_ratio(a, b), *([] if scale == 1.0 else [scale * part(a, b)]), 0.95 * scale * f(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 0.95 * scale * max(sets))
        assert X.weighted(a, b) == round(want)


def test_alignment():
    assert X.partial_alignment("xx48201C0225", "48201C") == (100.0, 2, 8)
    score, start, stop = X.partial_alignment("MAP48Z01C0225G", "48201C")
    assert (start, stop) == (3, 9) and score == pytest.approx(100 * 10 / 12)
    assert X.partial_alignment("48", "48201C") == (100.0, 0, 2)


def test_names_with_misread_keys(spark):
    names = {"48201C0225G": "48201C0225G", "Map 482O1C 0225 8": "48201C0225B", "48X01C0660L": "48201C0660L", "no. 4820IC0100GADDICK": "48201C0100G", "4S201C0315 M": "48201C0315M", None: None}
    d = spark.createDataFrame([(n,) for n in names], "s string")
    got = {r.s: r.n for r in d.select("s", X.aligned_name(F.col("s"), "48201C").alias("n")).collect()}
    assert got == names


def test_the_end_of_a_name_is_not_its_key():
    # five of six characters at the end, cut off by it, against five of six in the misread key
    assert X.partial_alignment("MAP482X1C4821C", "48201C")[1:] == (3, 9)
    assert X.partial_alignment("8201C0225", "48201C")[1:] == (0, 5)


def test_misread_names_that_end_like_their_key(spark):
    d = spark.createDataFrame([("Map 482X1C4821C",), ("Map 4B201C8201C",), ("Map 4820XC4820C",)], "s string")
    assert {r.n for r in d.select(X.aligned_name(F.col("s"), "48201C").alias("n")).collect()} == {"48201C4821C", "48201C8201C", "48201C4820C"}
