"""Searches in whole catalogues: nearest descriptors of stated queries, and names by Indel ratio."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from ..functions.text import fuzzy_ratio

#: Queries whose vectors go to the tasks at once; more of them go in further blocks.
BLOCK = 4096
#: Names up to this length are met by what is left when characters are taken out, longer ones by their rarest pairs of characters.
SHORT = 16


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, other, dist, place): for each query (id, vector) its `k` nearest of all vectors (id, vector) by cosine distance, itself left out; the least id on ties.

    Distances are compared to nine places. Queries go to the tasks in blocks; a
    task sends its own k best for each query, so that no pair is shuffled beyond
    those. Null vectors are left out, no query gives no row; ids must be whole numbers.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vector IS NOT NULL").select("id", "vector")
    queries = queries.where("vector IS NOT NULL").select("id", "vector")
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        if not own:
            continue
        ids, matrix = np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], float).reshape(len(own), -1)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def search(batches, shared=shared):
            ids, q = shared.value
            norm = np.sqrt((q * q).sum(axis=1))
            best = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for batch in batches:
                other = batch.column(0).to_numpy()
                v = np.array(batch.column(1).to_pylist(), float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.round(1 - q @ v.T / np.sqrt((v * v).sum(axis=1))[None, :] / norm[:, None], 9)
                d = np.where((other[None, :] == ids[:, None]) | np.isnan(d), np.inf, d)
                d, o = np.hstack([best[0], d]), np.hstack([best[1], np.broadcast_to(other, d.shape)])
                order = np.lexsort((o, d), axis=1)[:, :k]
                best = np.take_along_axis(d, order, 1), np.take_along_axis(o, order, 1)
            at, place = np.nonzero(np.isfinite(best[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best[1][at, place]), pa.array(best[0][at, place])], names=["id", "other", "dist"])

        part = rows.mapInArrow(search, "id long, other long, dist double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id long, other long, dist double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def most_deleted(length: int, least: float) -> int:
    """How many characters a name of this length can lose on the way to one with a ratio of `least` or more."""
    c = least / 100
    return int(length - c * length / (2 - c) + 1e-9)


def name_keys(name: str, least: float) -> list[str]:
    """What a short name leaves when as many characters as may be go; nothing for a long one."""
    if not name or len(name) > SHORT:
        return []
    gone = range(most_deleted(len(name), least) + 1)
    return sorted({"".join(name[i] for i in range(len(name)) if i not in set(out)) for n in gone for out in combinations(range(len(name)), n)})


def fuzzy_catalogue(names: DataFrame, catalogue: DataFrame, name: str, least: float) -> DataFrame:
    """(name, best, score) for each distinct name that has one of the whole catalogue with an Indel ratio of `least` or more; the first in the alphabet on ties.

    Two names of such a ratio have a common subsequence that is left of each when
    at most most_deleted characters go, so that short names are joined on what is
    left. Names beyond SHORT characters are joined with all others that can be
    long enough on their rarest pairs of characters: of these each name lists as
    many as its deletions can spoil, and one. Empty names match nothing.
    """
    c = least / 100
    a, b = names.select(F.col(name).alias("name")).where("name <> ''").distinct(), catalogue.select(F.col(name).alias("best")).where("best <> ''").distinct()

    @F.pandas_udf(ArrayType(StringType()))
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda x: name_keys(x, least))

    short = a.withColumn("key", F.explode(keys("name"))).join(b.withColumn("key", F.explode(keys("best"))), "key").select("name", "best")
    bound = lambda col: (F.length(col) * (1 - c / (2 - c)) + F.lit(1e-9)).cast("int")
    long_enough = SHORT * c / (2 - c) - 1

    def grams(df, col):
        at = df.where(F.length(col) >= long_enough).withColumn("p", F.explode(F.sequence(F.lit(1), F.length(col) - 1))).withColumn("gram", F.substring(F.col(col), F.col("p"), F.lit(2)))
        nth = F.row_number().over(Window.partitionBy(col, "gram").orderBy("p"))
        return at.withColumn("gram", F.concat("gram", nth.cast("string"))).select(col, "gram")

    ga, gb = grams(a, "name"), grams(b, "best")
    rarity = ga.select("gram").unionByName(gb.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    first = lambda df, col: df.join(rarity, "gram").withColumn("at", F.row_number().over(Window.partitionBy(col).orderBy("df", "gram"))).where(F.col("at") <= 2 * bound(col) + 1).select(col, "gram")
    long = first(ga, "name").join(first(gb, "best"), "gram").where((F.greatest(F.length("name"), F.length("best")) > SHORT)).select("name", "best")
    fits = 2 * F.least(F.length("name"), F.length("best")) >= c * (F.length("name") + F.length("best")) - 1e-9
    pairs = short.unionByName(long).where(fits).distinct().withColumn("score", fuzzy_ratio("name", "best")).where(F.col("score") >= least - 1e-9)
    return pairs.groupBy("name").agg(F.min_by(F.struct("best", "score"), F.struct(-F.col("score"), F.col("best"))).alias("b")).select("name", "b.*")
