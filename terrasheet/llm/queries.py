"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, interactions, langid, lm, merkle, mixing, quality, resampling, secrets, sharding, urlfilter, warc
from .common import new_dir, table
from .oracles import ORACLES  # noqa: F401

#: Target weights of query op1, in parts; all other sources together have OTHER_SHARE.
MIX_SHARES = {"src0": 12, "src1": 8, "src2": 8, "src3": 6, "src4": 6, "src5": 5, "src6": 5, "src7": 4, "src8": 4, "src9": 3, "src10": 3, "src11": 3}
OTHER_SHARE = 13


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_SHARES, default_share=OTHER_SHARE, keep=["doc_id", "source"])


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.read_archive(spark, path, payload=False, verify=True))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_pages(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_class_lm, op3_near_dedup, op4_importance_resampling, op5_warc, op6_url_filter, op7_decontamination, op8_language_id, op9_quality_rules, op10_shard, op11_secret_scan, op12_filter_audit, op13_merkle_manifest)}
