"""Helpers shared by the corpus operators: paths, work folders, numbering without a global sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words: space and the controls tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only with a local master, as in tests, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, kind: str, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage of a large frame with a Parquet table in the shared folder, which takes less room than a checkpoint.

    The shuffles that made it are deleted with the end of the write.
    """
    path = new_dir(df.sparkSession, kind)
    write(df, path, codec=codec)
    return stored(df.sparkSession, path, df.schema)


def write(df: DataFrame, path: str, *by: str, codec: str = "snappy") -> None:
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.partitionBy(*by).parquet(path, compression=codec)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.stored_in = path
    return out


def release(*stored: DataFrame) -> None:
    """Deletes the tables of store() that nothing reads any more."""
    for df in stored:
        delete(df.sparkSession, df.stored_in)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name` with as many underscores in front as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_bucket(h: Column, n: int) -> Column:
    """Bucket 0 to n-1 of a 64-bit hash such that bucket order is hash order."""
    return F.shiftright((F.shiftright(h, 32) + F.lit(2**31)) * F.lit(n), 32)


def number_rows(df: DataFrame, keys: list[str], h: str, ties: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """Gapless numbers from 0 within `keys`, in the order of the 64-bit hash column `h` and then `ties`.

    Rows are numbered inside (keys, hash bucket), so that a key with a third of
    all rows is spread over `buckets` tasks; only one count for each bucket is
    summed in order. Columns in `keys` must not be null. Rows equal in all of
    `h` and `ties` get numbers in any order.
    """
    b = "_b_" + name
    df = df.withColumn(b, hash_bucket(F.col(h), buckets))
    counts = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, b).orderBy(h, *ties)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, b])
        .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_off", "_rn", b)
    )
