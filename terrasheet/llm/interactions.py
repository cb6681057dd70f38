"""Audit of how filters interact: every order of the filters is replayed over all documents.

The flags of each document are crossed with all orders of the filters, a
broadcast table of n! rows for n filters; each order's steps are exploded, the
first failing step decides what every step does to the document, and the counts
are combined in the tasks before anything is shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import words_of

#: More filters than this have over 5,040 orders: not a table to broadcast.
MOST_FILTERS = 7


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that isn't null."""
    words = words_of(text)
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): one row for each document.

    E: a smaller id has the same text, anywhere in the table; a null id is neither
    smaller nor larger than another, rows that repeat an id don't fail for it. Null
    texts count as empty ones and null parts as the empty string. good and toxic are
    true if any label row of the id has a 1. Texts are compared by their SHA-256.
    Copies of one text are joined with their least id only, and rows without an id
    are spread over the tasks in the join with the labels.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    texts = docs.select(F.col(id_col).alias("_id"), digest.alias("_digest"))
    first = texts.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").select("_digest", "_first")
    flags = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), digest.alias("_digest"), *[c.alias(k) for k, c in text_flags(text).items()])
    # a key of its own keeps the aggregate's partitioning out of the join: both sides get exchanges, whose large partitions Spark splits
    first = first.select(F.concat("_digest", F.lit(b"")).alias("_digest"), "_first")
    flags = flags.join(first, "_digest", "left").withColumn("E", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)))
    flags = flags.withColumn("_salt", F.when(F.col("_id").isNull(), F.xxhash64("_digest")).otherwise(F.lit(0)))
    own = labels.select(F.col(id_col).alias("_id"), F.col(quality_col).alias("_q"), F.col(toxic_col).alias("_t")).where("_id IS NOT NULL")
    own = own.groupBy("_id").agg(F.max(F.coalesce(F.col("_q") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("_t") == 1, F.lit(False))).alias("toxic")).withColumn("_salt", F.lit(0).cast("long"))
    no = F.lit(False)
    return flags.join(own, ["_id", "_salt"], "left").select("part", "A", "B", "C", "D", "E", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def filter_orders(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, one column `at_X` for each filter: its step, steps): all orders of the filters, n! rows."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have too many orders; {MOST_FILTERS} at most")
    rows = [("".join(p), *[p.index(f) + 1 for f in filters], [(k + 1, f, 1 << filters.index(f)) for k, f in enumerate(p)]) for p in permutations(filters)]
    return spark.createDataFrame(rows, f"filter_order string, {', '.join(f'at_{f} int' for f in filters)}, steps array<struct<step:int,filter:string,bit:int>>")


def replay_orders(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """The counts of every part, order and step of `filters`, from rows of (part, a flag for each filter, good, toxic).

    kept: documents of the part that no filter up to this step fails; removed: those
    that this step's filter is the first to fail; redundant: those that it fails too,
    after another; unique_fails: those that it alone fails, in any order; good_lost
    and toxic_lost: the removed ones with these labels; shapley: what its filter
    removes, summed over all orders. Every part has a row for each order and step.
    No document, no row.
    """
    spark = flags.sparkSession
    # every row becomes n! x n rows: they are dealt to all tasks, not to as few as their bytes would fill
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = sum((F.when(F.col(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    slim = flags.select("part", bits.alias("_bits"), "good", "toxic").repartition(tasks)
    crossed = slim.crossJoin(F.broadcast(filter_orders(spark, filters)))
    failing = [F.when(F.col("_bits").bitwiseAND(1 << i) != 0, F.col(f"at_{f}")) for i, f in enumerate(filters)]
    first = F.least(*failing, F.lit(len(filters) + 1)) if len(filters) > 0 else F.lit(1)
    steps = crossed.select("part", "filter_order", "_bits", "good", "toxic", first.alias("_first"), F.explode("steps").alias("_s"))
    steps = steps.select("part", "filter_order", F.col("_s.step").alias("step"), F.col("_s.filter").alias("filter"), F.col("_s.bit").alias("_bit"), "_bits", "_first", "good", "toxic")
    removed = F.col("_first") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step", "filter").agg(
        F.count_if(F.col("_first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((F.col("_first") < F.col("step")) & (F.col("_bits").bitwiseAND(F.col("_bit")) != 0)).alias("redundant"),
        F.count_if(F.col("_bits") == F.col("_bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # n! x n rows a part
    total = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return counts.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", total.alias("shapley"), "filter")


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The interactions of the filters A to E over `docs`: replay_orders of document_flags. Extra columns of either table are ignored."""
    return replay_orders(document_flags(docs, labels, **columns))
