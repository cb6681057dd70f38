"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all raw
text, give each document the log ratio of its likelihoods. Documents are then drawn
without replacement with these importance weights by Gumbel top-k.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = re.compile(r"[^\W_]+|[^\w\s]")
#: Hashed n-grams (words and word pairs) fall into so many buckets.
BUCKETS = 1 << 18
#: Added to each bucket's count in both models, at the target's size.
SMOOTHING = 0.2
#: A bucket counts if the target holds it so many standard deviations more or less often than the raw text lets expect; the noise of all others would drown a few telling words.
LEAST_Z = 4.0
#: The target model is fitted on at most so many labelled documents, those with the least hashes; the raw model on all documents.
FIT_DOCUMENTS = 100_000
#: Texts that are counted together.
TOGETHER = 1000
#: Scores are compared in steps of 2^-20.
STEP = 1 << 20


def ngram_buckets(text: str | None, cache: dict[str, int]) -> np.ndarray:
    """The buckets of a text's words and word pairs, in lower case; none for a null or empty text."""
    if not text:
        return np.empty(0, np.int64)
    words = WORD.findall(text.lower())
    if len(cache) > 500_000:
        cache.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        h[i] = v
    mix = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (np.concatenate([mix(h + np.uint64(1)), mix(pairs)]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, target_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all texts and over the target's; a task sends one row for each bucket at most."""

    def count(batches):
        raw, target, cache = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):  # so that a dense count serves many texts
                part = batch.slice(lo, TOGETHER)
                found = [ngram_buckets(t, cache) for t in part.column(0).to_pylist()]
                raw += np.bincount(np.concatenate(found), minlength=BUCKETS)
                if wanted := [b for b, is_target in zip(found, part.column(1).to_pylist(), strict=True) if is_target]:
                    target += np.bincount(np.concatenate(wanted), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    sums = docs.select(text_col, target_col).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    for b, r, t in sums.collect():
        raw[b], target[b] = r, t
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the models by bucket, the raw counts scaled to the target's number of n-grams; 0 where the counts differ by chance."""
    scale = target.sum() / max(raw.sum(), 1.0)
    expected = raw * scale
    spread = np.sqrt(expected * (1 - scale))
    return np.where(np.abs(target - expected) > LEAST_Z * spread, np.log(target + SMOOTHING) - np.log(expected + SMOOTHING), 0.0)


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, log_weight) for every row. The target is the labelled text with quality 1 that isn't toxic."""
    good = labels.groupBy(F.col(id_col).alias("_l")).agg(F.min(quality_col).alias("q"), F.max(toxic_col).alias("t")).where("q = 1 AND t = 0")
    fit = good.orderBy(F.xxhash64("_l"), "_l").limit(fit_documents).select("_l", F.lit(True).alias("_target"))
    rows = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(fit), F.col(id_col) == F.col("_l"), "left").drop("_l")  # at most fit_documents ids
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio(*bucket_counts(rows, text_col, "_target")))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def score(batches):
        ratio, cache = shared.value, {}
        for batch in batches:
            w = [float(ratio[ngram_buckets(t, cache)].sum()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64())], names=["id", "log_weight"])

    return docs.select(id_col, text_col).mapInArrow(score, f"id {kind}, log_weight double").withColumnRenamed("id", id_col)


def top_k(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counting in ever narrower ranges: exact, without a sort."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return lo
    above = 0
    while lo < hi:
        width = max(1, -(-(hi - lo + 1) // 4096))
        bins = df.where((F.col(key) >= lo) & (F.col(key) <= hi)).groupBy(F.expr(f"({key} - {lo}L) div {width}L").alias("b")).count().orderBy(F.desc("b")).collect()
        for b, c in bins:
            if above + c >= k:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            above += c
    return lo


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 1, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """(doc_id, log_weight, score, selected) for every row; `k` rows are selected, by default as many as are more likely under the target's model than under the raw text's.

    score is log_weight plus Gumbel noise that the id and the seed fix, so that
    top-k is a draw without replacement in proportion to the weights. Rows tied
    with the last one drawn, such as repeated rows, are all drawn. Null and empty
    texts have log_weight 0.
    """
    u = (F.shiftright(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + F.lit(2.0**52) + 0.5) / F.lit(2.0**53)
    scored = weigh(docs, labels, id_col=id_col, **kwargs).withColumn("score", F.col("log_weight") - F.log(-F.log(u)))
    scored = cut(scored.withColumn("_key", F.round(F.col("score") * STEP).cast("long")))
    last = top_k(scored, "_key", scored.where("log_weight > 0").count() if k is None else k)
    selected = F.lit(False) if last is None else F.col("_key") >= F.lit(last)
    return scored.withColumn("selected", selected).drop("_key")
