"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

Each shingle with weight w (its count) owns the weights 1 to w. Weight levels form
the dyadic intervals [1], [2, 3], [4..7], ...; each interval of a shingle is a
Poisson process with the interval's length as its rate, whose points carry a weight
inside the interval and a component of the signature. A shingle of weight w uses
the points whose weight is at most w, so that two texts share all points of their
common weights. A component of the signature is its earliest point: two texts agree
in it with probability equal to their weighted Jaccard similarity. Only points
before a time at which all components are filled are made.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_name, release, store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 4: a pair at similarity 0.8 shares none with probability 5e-8.
BANDS, ROWS = 32, 4
#: Rounds in which every bucket compares one of its members with all others, before the rest is compared in pairs.
PIVOT_ROUNDS = 2
#: Bits of the filter that keeps most texts without a similar one out of the second pass: 16 MB at most.
FILTER_BITS = 1 << 27
#: Texts that are signed side by side.
TOGETHER = 64

_C1, _C2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: the generator's next value for a counter."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], cache: dict[str, int]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words, in lower case; the cache is emptied when large."""
    if len(cache) > 300_000:
        cache.clear()
    out = []
    for text in texts:
        words = WORD.findall(text.lower())
        for w in set(words).difference(cache):
            cache[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return out


def shingle_keys(h: np.ndarray) -> np.ndarray:
    """A 64-bit key for each run of five words; a text with fewer words is one run."""
    n = max(1, len(h) - WORDS + 1)
    key = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(h))):
        key = mix(key + h[j : j + n] + _G)
    return key


def shingle_set(h: np.ndarray) -> np.ndarray:
    """The multiset of a text's shingles as a sorted set: the second occurrence of a shingle is a member of its own."""
    if not len(h):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        key = np.sort(shingle_keys(h))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(key))
        nth = place - np.maximum.accumulate(np.where(new, place, 0))
        return np.sort(mix(key + nth.astype(np.uint64) * _C1).view(np.int64))


def shingles(text: str) -> list[str]:
    """Runs of five words in lower case; a text with fewer words is one run, one without words none."""
    words = WORD.findall(text.lower())
    return [" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))] if words else []


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of SIMILARITY or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def bag_minhash(keys: np.ndarray, weights: np.ndarray, of: np.ndarray, texts: int, m: int) -> np.ndarray:
    """The signatures (texts, m) of several multisets: distinct 64-bit `keys` with whole `weights` of 1 or more, `of` their texts, in order.

    A text whose components aren't all filled by its time limit is done again with a longer one.
    """
    out = np.zeros((texts, m), np.uint64)
    total = np.bincount(of, weights, texts)
    limit = m * (np.log(m) + 3.0) / np.maximum(total, 1)
    todo = total > 0
    with np.errstate(over="ignore"):
        while todo.any():
            use = todo[of]
            sig, full = _points(keys[use], weights[use], of[use], limit, texts, m)
            done = todo & full
            out[done] = sig[done]
            todo &= ~full
            limit *= 2
    return out


def _points(keys, weights, of, limit, texts: int, m: int):
    """Signatures from all points up to each text's limit, and which of them are complete."""
    levels = np.frexp(weights.astype(np.float64))[1]  # 1: [1], 2: [2, 3], 3: [4..7]
    if levels.max() > 1:
        owner = np.repeat(np.arange(len(keys)), levels)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
        keys, top, of = keys[owner], weights[owner], of[owner]
    else:
        level, top = np.zeros(len(keys), np.int64), weights
    node = mix(keys + (level.astype(np.uint64) + np.uint64(1)) * _G)
    low = np.left_shift(1, level)  # first weight of the interval, and its length
    stop, time = limit[of] * low, np.zeros(len(node))
    slots, times, values, k = [], [], [], 0
    while len(node):
        k += 1
        step = np.uint64(k * int(_C2) % 2**64)
        r = mix(node + step)
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        early = np.flatnonzero(time <= stop)
        node, time, stop, low, top, of = node[early], time[early], stop[early], low[early], top[early], of[early]
        p = mix(node ^ step)
        weight = low + ((p >> np.uint64(40)).astype(np.int64) * low >> 24)
        ok = np.flatnonzero(weight <= top)
        slots.append(of[ok] * m + (p[ok] % np.uint64(m)).astype(np.int64))
        times.append(time[ok] / low[ok])
        values.append(p[ok])
    slots, times, values = map(np.concatenate, (slots, times, values))
    best = np.full(texts * m, np.inf)
    np.minimum.at(best, slots, times)
    first = times == best[slots]
    sig = np.zeros(texts * m, np.uint64)
    sig[slots[first]] = mix(values[first])
    return sig.reshape(texts, m), np.isfinite(best).reshape(texts, m).all(axis=1)


def bands_of(texts: list[str], cache: dict[str, int]) -> tuple[list[list[int] | None], list[int]]:
    """The band hashes of each text, None for one without words, and its number of shingles."""
    keys, weights, of, sizes = [], [], [], [0] * len(texts)
    with np.errstate(over="ignore"):
        for d, h in enumerate(word_hashes(texts, cache)):
            if not len(h):
                continue
            key = shingle_keys(h)
            sizes[d] = len(key)
            key, weight = np.unique(key, return_counts=True)
            keys.append(key)
            weights.append(weight)
            of.append(np.full(len(key), d))
        if not keys:
            return [None] * len(texts), sizes
        of = np.concatenate(of)
        sig = bag_minhash(np.concatenate(keys), np.concatenate(weights).astype(np.int64), of, len(texts), BANDS * ROWS).reshape(-1, BANDS, ROWS)
        out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _G, (len(texts), BANDS))
        for j in range(ROWS):
            out = mix(out + sig[:, :, j])
    there = np.zeros(len(texts), bool)
    there[of] = True
    return [row if ok else None for row, ok in zip(out.view(np.int64).tolist(), there.tolist(), strict=True)], sizes


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, id, bands, n) for each distinct non-null text: its 128-bit digest, least id, band hashes and number of shingles."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def sign(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                bands, sizes = bands_of(part.column(2).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], names=["node", "id", "bands", "n"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.unhex(F.md5(text_col)), F.col(text_col))
    signed = rows.mapInArrow(sign, f"node binary, id {kind}, bands array<long>, n int")
    return signed.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("n").alias("n"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, grams): the shingle sets of the wanted nodes' texts.

    A filter of bounded size, filled with the wanted digests, keeps other texts
    from being shuffled; what it lets through by chance goes in the join.
    """
    size = 1 << 15
    count = wanted.count()
    while size < min(64 * count, FILTER_BITS):
        size *= 2
    place = F.pmod(F.xxhash64("node"), F.lit(size))
    words = wanted.select(place.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for part, found in words.collect():
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(found, np.uint8)[: size // 8]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def gather(batches):
        cache: dict[str, int] = {}
        seen: set[bytes] = set()
        for batch in batches:
            at = batch.column(1).to_numpy()
            hits = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for lo in range(0, len(hits), TOGETHER):
                part = batch.take(pa.array(hits[lo : lo + TOGETHER]))
                nodes = part.column(0).to_pylist()
                fresh = [i for i, x in enumerate(nodes) if not (x in seen or seen.add(x))]
                sets = list(map(shingle_set, word_hashes(part.column(2).take(pa.array(fresh, pa.int64())).to_pylist(), cache)))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in fresh], pa.binary()), grams], names=["node", "grams"])

    digests = docs.where(F.col(text_col).isNotNull()).select(F.unhex(F.md5(text_col)).alias("node"), F.col(text_col).alias("_text"))
    sets = digests.select("node", place.alias("at"), "_text").mapInArrow(gather, "node binary, grams array<long>")
    return sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; sets: (node, grams)."""

    def check(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
            keep = [similar(xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ga", "gb").mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node with an edge (a, b): root is the least node of its component.

    Alternating large-star and small-star steps until they change nothing, each
    an aggregate of minima and joins, so that no node's neighbours are ever
    gathered; a node with very many of them is split by Spark's skew join.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = cut(edges), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now
        # large star: every neighbour above a node goes to the node's least neighbour or itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) with the roots merged that links (a, b) of nodes connect."""
    ra, rb = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    edges = links.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    top = components(edges).select(F.col("v").alias("root"), F.col("root").alias("top"))
    return labels.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def rest_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of `rest` (node, root) with different roots that could be similar: exact, by prefix and position.

    Only shingles that occur under several roots can count for such a pair. A
    text's are put in order of rarity; one with n shingles, s of which are such,
    shares one of its first s - ceil(0.8 n) + 1 with every text similar to it. At
    the first that a pair has in common, what follows in both must suffice for
    the overlap, which leaves out nearly all copies of one text that each have
    too many words of their own.
    """
    key = F.xxhash64("node").alias("k")
    rows = sets.join(rest, "node").select(key, F.xxhash64("root").alias("r"), F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    seen = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("gram", "df")
    place = F.row_number().over(Window.partitionBy("k").orderBy("df", "gram"))
    total = F.count(F.lit(1)).over(Window.partitionBy("k"))
    ranked = rows.join(seen, "gram").withColumn("s", total).withColumn("at", place)
    prefix = ranked.where("5 * (s - at + 1) >= 4 * n").select("gram", "k", "r", "n", (F.col("s") - F.col("at") + 1).alias("left"))
    prefix = store(prefix, "prefixes")
    side = lambda x: prefix.select("gram", *(F.col(c).alias(c + x) for c in ("k", "r", "n", "left")))
    met = side("a").join(side("b"), "gram").where("ka < kb AND ra <> rb AND 9 * least(lefta, leftb) >= 4 * (na + nb)").select("ka", "kb").distinct()
    name = lambda x: rest.select(key.alias("k" + x), F.col("node").alias(x))
    return met.join(name("a"), "ka").join(name("b"), "kb").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the least id of all documents connected to it by similarities of 0.8 or more.

    Equal texts are one node from the start, whatever their number. A bucket holds
    the nodes that share a band and whose lengths allow the similarity. In each of
    PIVOT_ROUNDS rounds every bucket that still holds several components takes its
    most central member outside those of earlier rounds, that whose bands are
    shared most, and compares all others with it. The links found merge nodes into
    components. Of buckets that then hold several components, the pairs across
    them that could be similar are found by exact bounds and compared: no link
    between different texts is passed over, and pairs within a component are never
    listed.

    A null text is a class of its own; texts without words are equal or nothing.
    Rows with a null id share the least id of their class, null if it has none.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))  # no other column can clash
    named = named_nodes(docs)
    least = named.groupBy("root").agg(F.min("id").alias("class_id"))
    of = named.join(least, "root").select("node", "class_id")
    rows = docs.select("_id", F.unhex(F.md5("_text")).alias("node"))
    return rows.join(of, "node", "left").select(F.col("_id").alias(id_col), F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, central): the members of each bucket of two or more nodes; central is the number of nodes that share a band with it, over all bands."""
    bands = nodes.where("bands IS NOT NULL").select("node", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bands = store(bands.join(shared, "band"), "bands")
    central = bands.groupBy("node").agg(F.sum("c").alias("central"))
    # lengths within a factor of 1.25 share one of two length classes
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    members = bands.join(central, "node").select("node", "n", "central", F.explode(F.array(F.xxhash64("band", step), F.xxhash64("band", step + 1))).alias("bucket"))
    members = store(members, "members")
    release(bands)
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    out = store(members.join(full, "bucket"), "buckets")
    release(members)
    return out


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their root, of the buckets that hold several roots."""
    at = members.join(labels, "node")
    several = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return at.join(several, "bucket")


def named_nodes(docs: DataFrame) -> DataFrame:
    """(node, id, root) for each distinct text of docs (_id, _text): its digest, least id and the label of its class, which no other class has."""
    nodes = store(signatures(docs, "_id", "_text"), "signatures")
    members = bucket_members(nodes)
    labels = store(members.select("node", F.col("node").alias("root")).distinct(), "labels")
    sets = store(shingle_sets(docs, labels.select("node"), "_text"), "sets")
    pivots = None
    for _ in range(PIVOT_ROUNDS):
        left = open_members(members, labels).withColumn("fresh", F.lit(True))
        if pivots is not None:  # those of earlier rounds, and what they are linked with, make way
            done = pivots.select("bucket", "p.node").join(labels, "node").select("bucket", "root", F.lit(False).alias("fresh"))
            left = left.drop("fresh").join(done.distinct(), ["bucket", "root"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
        left = store(left, "open")
        chosen = store(left.groupBy("bucket").agg(F.max_by(F.struct("node", "root", "n"), F.struct("fresh", "central", "node")).alias("p")), "pivots")
        pivots = chosen if pivots is None else pivots.unionByName(chosen)
        pairs = left.join(chosen, "bucket").where("root <> p.root AND 5 * least(n, p.n) >= 4 * greatest(n, p.n)")
        pairs = pairs.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
        links, old = store(verify(pairs, sets), "links"), labels
        labels = store(relabel(old, links), "labels")
        release(left, links, old)
    rest = store(open_members(members, labels).select("node", "root").distinct(), "rest")
    links = store(verify(rest_pairs(rest, sets), sets), "links")
    labels = store(relabel(labels, links), "labels")
    release(members, sets, rest, links)
    return nodes.select("node", "id").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all its columns: that with the least id, null being the last, and of these the least digest; of rows that repeat both one stays. Rows with a null text all stay."""
    named = named_nodes(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("s"))
    key = lambda digest, i: F.concat(digest, F.coalesce(F.concat(F.lit("v"), i.cast("string")), F.lit("n")))
    name, nth = free_name(docs, "_key"), free_name(docs, "_nth")
    keep = first.select(key(F.lower(F.hex("s.node")), F.col("s.id")).alias(name))
    # texts are shuffled once, and copies with ids of their own apart: the window finds them dealt out by the key
    rows = docs.where(F.col(text_col).isNotNull()).withColumn(name, key(F.md5(text_col), F.col(id_col))).join(keep, name)
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(name).orderBy(name))).where(F.col(nth) == 1)
    return rows.select(docs.columns).unionByName(docs.where(F.col(text_col).isNull()))
