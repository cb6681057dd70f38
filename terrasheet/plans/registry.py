"""Registers queries with their SQL, and the views of the test tables that stand for map inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views in portable SQL, as WITH terms of the oracle queries.
VIEWS = {
    "det": "SELECT event_id AS id, event_type AS grp, CAST((event_id*7919)%10007 AS DOUBLE)/10 AS x, value AS y FROM events",
    "ref": "SELECT c_custkey AS id, CAST((c_custkey*6007)%10007 AS DOUBLE)/10 AS x, c_acctbal/20 AS y FROM customer",
    "boxes": "SELECT l_orderkey AS image, l_linenumber AS seq, l_returnflag AS label, l_quantity AS x1, l_discount*100 AS y1, l_quantity+1+l_linenumber AS x2, l_discount*100+1+l_tax*100 AS y2 FROM lineitem",
    "pairs": "SELECT l_orderkey AS id, l_returnflag AS grp, l_quantity AS x, l_tax*100 AS y, 2*l_quantity-l_tax*100+l_discount AS tx, l_quantity+2*l_tax*100-l_discount AS ty FROM lineitem",
    "dms": "SELECT o_orderkey AS id, CAST(o_orderkey%60+20 AS VARCHAR) AS deg, CAST(o_custkey%60 AS VARCHAR) AS mi FROM orders",
    "tiles": "SELECT o_orderkey AS id, '48201C' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') || CASE WHEN o_orderkey%3=0 THEN chr(CAST(65+o_orderkey%8 AS INTEGER)) ELSE '' END AS name, o_custkey AS num, CAST(o_orderdate AS DATE) AS d FROM orders",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected points, in groups."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("grp"), ((F.col("event_id") * 7919) % 10007).cast("double").alias("_x"), F.col("value").alias("y")).select("id", "grp", (F.col("_x") / 10).alias("x"), "y")


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (((F.col("c_custkey") * 6007) % 10007).cast("double") / 10).alias("x"), (F.col("c_acctbal") / 20).alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection boxes of images; there is no unique key."""
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("label"), q.alias("x1"), d.alias("y1"), (q + 1 + F.col("l_linenumber")).alias("x2"), (d + 1 + F.col("l_tax") * 100).alias("y2"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondences (x, y) to (tx, ty) near a similarity with a = 2, b = 1."""
    q, t, d = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("grp"), q.alias("x"), t.alias("y"), (2 * q - t + d).alias("tx"), (q + 2 * t - d).alias("ty"))


def dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and minute text."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 60 + 20).cast("string").alias("deg"), (F.col("o_custkey") % 60).cast("string").alias("mi"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile names with dates; some names end in a letter."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("48201C"), F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.when(k % 3 == 0, F.chr(65 + k % 8)).otherwise(""))
    return table(spark, sf_dir, "orders").select(k.alias("id"), name.alias("name"), F.col("o_custkey").alias("num"), F.to_date("o_orderdate").alias("d"))


def query(sql: str | None = None, views: str = ""):
    """Registers a function of (spark, sf_dir) under its name; `views`: those that its SQL uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            terms = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
            body = sql.strip()
            if terms:
                body = f"WITH {terms}, {body[5:]}" if body.startswith("WITH ") else f"WITH {terms} {body}"
            ORACLES[f.__name__] = body
        return f

    return add
