"""Tests of distributions from grouped moments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            out *= c * d
        if abs(c * d - 1) < 1e-15 or m > 100_000:
            return front * out


@F.pandas_udf(DoubleType())
def two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Student's two-sided p; null where t or df is."""
    return pd.Series([None if pd.isna(x) or pd.isna(n) else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)], dtype="float64")


def welch(df: DataFrame, value: str, first: Column, second: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, n1, n2, t, df, p): Welch's test of the values of the rows `first` against those of `second`."""
    of = lambda cond, f, n: f(F.when(cond, F.col(value))).alias(n)
    parts = [of(c, f, f"{n}{i}") for i, c in ((1, first), (2, second)) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))]
    s = df.groupBy(*(keys or [])).agg(*parts)
    a, b = F.col("v1") / F.nullif(F.col("n1"), F.lit(0)), F.col("v2") / F.nullif(F.col("n2"), F.lit(0))
    s = s.withColumn("t", (F.col("m1") - F.col("m2")) / F.sqrt(F.nullif(a + b, F.lit(0.0))))
    s = s.withColumn("df", F.pow(a + b, 2) / F.nullif(F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n2") - 1), F.lit(0.0)))
    return s.select(*(keys or []), "n1", "n2", "t", "df", two_sided_p("t", "df").alias("p"))


def normality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, k2, p): D'Agostino's K squared from the skewness and kurtosis of each group of 8 values or more."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("_g"), (F.kurtosis(value) + 3).alias("_b"))
    n, c = F.col("n").cast("double"), F.col
    # step by step: as one expression the plan's code would outgrow a method
    g = g.where("n >= 8").withColumns(
        {
            "_y": c("_g") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))),
            "_beta": 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)),
            "_x": (c("_b") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))),
            "_sb": 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))),
        }
    )
    g = g.withColumns({"_w2": F.sqrt(2 * (c("_beta") - 1)) - 1, "_k": 6 + 8 / c("_sb") * (2 / c("_sb") + F.sqrt(1 + 4 / (c("_sb") * c("_sb"))))})
    g = g.withColumns({"_t": 1 + c("_x") * F.sqrt(2 / (c("_k") - 4)), "_z1": F.asinh(c("_y") / F.sqrt(2 / (c("_w2") - 1))) / F.sqrt(F.log(F.sqrt(c("_w2"))))})
    g = g.withColumn("_z2", ((1 - 2 / (9 * c("_k"))) - F.signum("_t") * F.pow((1 - 2 / c("_k")) / F.abs("_t"), F.lit(1 / 3))) / F.sqrt(2 / (9 * c("_k"))))
    g = g.withColumn("k2", c("_z1") * c("_z1") + c("_z2") * c("_z2"))
    return g.select(*keys, "n", "k2", F.exp(-c("k2") / 2).alias("p"))
