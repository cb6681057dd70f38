"""Benchmark decontamination as a prefix-filtered set join on word shingles.

A window of a benchmark item is contained in a document only if its rarest
shingle is, so that shingle alone is its prefix: documents are joined with the
windows on it. The place of the shingle in the window bounds where the window
can start and that it ends within the text; the words there are then compared.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, release, store

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: By byte: letters A to Z to lower case; ASCII characters that belong to no word to blanks.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW, SHINGLE = 13, 3
#: Benchmark windows that go to the tasks at once: about 60 MB there. More of them are joined in further blocks.
BLOCK_WINDOWS = 50_000
MULTIPLIER = 1_000_003


def find_words(text: str | None) -> list[bytes]:
    """The words of WORDS in lower case, as UTF-8: all bytes of other characters than ASCII belong to words."""
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else []


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the distinct windows of each item; an item with fewer words is one window, one without words none."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(low, F.lit(f"({WORDS})"), F.lit(1)).alias("_w")).where("item IS NOT NULL AND size(_w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - window + 1))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, window))).alias("words")).distinct()


class Block:
    """The windows of one block as arrays: word ids, and the shingles to be looked for."""

    def __init__(self, rows: list[tuple[str, list[str]]], shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        by_window: dict[tuple[int, ...], list[str]] = {}
        for item, words in rows:
            key = tuple(self.vocabulary.setdefault(w.encode("utf-8", "surrogatepass"), len(self.vocabulary)) for w in words)
            by_window.setdefault(key, []).append(item)
        self.windows = [np.array(k, np.int64) for k in by_window]
        self.items = list(by_window.values())
        self.shingle = shingle
        #: By shingle length (short windows have shorter ones): the sorted keys, and how often documents hold them.
        self.keys = {k: np.unique(np.concatenate([shingle_keys(w, k) for w in self.windows if min(shingle, len(w)) == k])) for k in sorted({min(shingle, len(w)) for w in self.windows})}
        self.index: dict[int, tuple] = {}

    def set_rarity(self, counts: dict[int, np.ndarray]) -> None:
        """Picks each window's rarest shingle, the first on ties."""
        found: dict[int, list] = {k: [] for k in self.keys}
        for i, w in enumerate(self.windows):
            k = min(self.shingle, len(w))
            keys = shingle_keys(w, k)
            at = int(np.argmin(counts[k][np.searchsorted(self.keys[k], keys)]))
            found[k].append((keys[at], at, i))
        for k, rows in found.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.int64)
            self.index[k] = (key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def places(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where `k` words of the vocabulary stand in a row, and the keys of these shingles."""
        if len(ids) < k:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known, n = ids >= 0, len(ids) - k + 1
        every = known[:n]
        for j in range(1, k):
            every = every & known[j : n + j]
        at = np.flatnonzero(every)
        key = np.zeros(len(at), np.int64)
        for j in range(k):
            key = key * MULTIPLIER + ids[at + j] + 1
        return at, key

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
        """The spans of all windows that occur, and the items they are from."""
        spans, items = set(), set()
        for k, (key, offset, window) in self.index.items():
            at, own = self.places(ids, k)
            lo, hi = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
            for p in np.flatnonzero(hi > lo):
                for e in range(lo[p], hi[p]):
                    w = self.windows[window[e]]
                    start = at[p] - offset[e]
                    if start >= 0 and start + len(w) <= len(ids) and np.array_equal(ids[start : start + len(w)], w):
                        spans.add((int(start), int(start + len(w))))
                        items.update(self.items[window[e]])
        return sorted(spans), sorted(items)


def shingle_keys(ids: np.ndarray, k: int) -> np.ndarray:
    key = np.zeros(len(ids) - k + 1, np.int64)
    for j in range(k):
        key = key * MULTIPLIER + ids[j : len(ids) - k + 1 + j] + 1
    return key


def shingle_frequencies(docs: DataFrame, block, text_col: str) -> dict[int, np.ndarray]:
    """How often all documents hold each of a block's shingles; a task sends one row for each at most."""

    def count(batches):
        b = block.value
        total = {k: np.zeros(len(v), np.int64) for k, v in b.keys.items()}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids = b.ids(find_words(t))
                for k, keys in b.keys.items():
                    _, own = b.places(ids, k)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    total[k] += np.bincount(at[keys[at] == own], minlength=len(keys))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], names=["k", "i", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in block.value.keys.items()}
    for k, i, n in docs.select(text_col).mapInArrow(count, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n")).collect():
        out[k][i] = n
    return out


def _joined(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    fields = docs.select(id_col).schema[0].dataType.simpleString()

    def match(batches):
        b = block.value
        for batch in batches:
            n, spans, items = [], [], []
            for t in batch.column(1).to_pylist():
                words = find_words(t)
                s, i = b.match(b.ids(words)) if b is not None else ([], [])
                n.append(len(words))
                spans.append([{"start": x, "stop": y} for x, y in s])
                items.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                names=["id", "th", "n_words", "spans", "items"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("th"))
    return rows.mapInArrow(match, f"id {fields}, th long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_words, spans, items) for each row: the spans [start, stop) of words that are windows of an item, and these items.

    Windows go to the tasks in blocks of about `block_windows`, each of them
    against all documents, so that a benchmark of any size is joined whole. `th`
    is the text's 64-bit hash; rows that repeat both stay apart. A null or empty
    text has no words and no spans; an empty benchmark hits nothing.
    """
    sc = docs.sparkSession.sparkContext
    windows = store(benchmark_windows(benchmark, window), "windows")
    total = windows.count()
    blocks = max(1, -(-total // block_windows))
    parts = []
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()]
        block = None
        if rows:
            block = Block(rows, shingle)
            block.set_rarity(shingle_frequencies(docs, sc.broadcast(block), text_col))
        parts.append(_joined(docs, sc.broadcast(block), id_col, text_col))
    release(windows)
    if blocks == 1:
        return parts[0]
    every = parts[0].withColumn("_first", F.lit(1))
    for p in parts[1:]:
        every = every.unionByName(p.withColumn("_first", F.lit(0)))
    merged = every.groupBy("id", "th").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.sum("_first").alias("_rows"))
    return merged.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_", "_rows")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): contaminated if a word in twenty or more is hit."""
    found = find_contamination(docs, benchmark, id_col=id_col, **kwargs)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))))
    out = found.select(
        F.col("id").alias(id_col),
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns. Only the ids of contaminated rows are joined."""
    id_col = kwargs.get("id_col", "doc_id")
    found = find_contamination(docs, benchmark, **kwargs)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))))
    doc, th = free_name(docs, "_bad"), free_name(docs, "_th")
    bad = found.where((hit > 0) & (20 * hit >= F.col("n_words"))).select(F.col("id").alias(doc), F.col("th").alias(th)).distinct()
    text_col = kwargs.get("text_col", "text")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(th)), "left_anti")
