"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage reads what the one before it kept and returns the columns of documents;
mixing adds each row's position in the mixture, by which the last places the rows in
shards: each shard is the mixture in small. run() writes each stage's rows as Parquet into the
cluster's shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasheet.llm import decontam, dedup, langid, mixing, queries, sharding
from terrasheet.llm.common import new_dir, table


SHARDS = 24


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    return langid.filter_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture and adds their position: reading the files in order gives each source its weight.

    A block has a row for every shard.
    """
    mixed = mixing.mix_sources(docs, queries.MIX_SHARES, block_rows=SHARDS, default_share=queries.OTHER_SHARE)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.write_order(mixed, partitions).select(*(c for c in docs.columns if c != "position"), "position")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in one of 24 shards, which take rows in turn along the mixture: read by slot, each gives every source its weight."""
    return sharding.shard_documents(docs, SHARDS, order_col="position")


STAGES = [("language_id", languages), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("mixing", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: The stages' models, signatures and propagation have no SQL form: tests hold them against brute force.
ORACLE_SQL = None
