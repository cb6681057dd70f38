"""Sharding by balanced label propagation.

Native: DataFrame joins and aggregates only. Texts that are equal are linked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, number_rows

#: Rows of one (shard, move) counter go through so many hash buckets when they are numbered.
BUCKETS = 256
#: A group with more than one in so many of all rows is large; there are fewer such groups than that.
LARGE = 1000


def _by_shard(values: dict[int, int], shard: Column, default: int = 0) -> Column:
    """A lookup in a table of one entry for each shard."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), shard), F.lit(default)) if values else F.lit(default)


def _counts(df: DataFrame, col: str) -> dict[int, int]:
    """Rows of each shard: as many entries as there are shards."""
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def propagate(rows: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """Rounds of label propagation over `rows` (_group, _large, _h, shard; singles have a null _group).

    In each round the rows of a group are counted by shard. A group's homes are the
    shards that hold most of it among those with room, one for each capacity's
    worth of rows. Rows elsewhere ask to move to a home with room, or else to the
    group's fullest shard that has room. A shard grants as many requests as it has
    room, in hash order, so that no shard passes its capacity. Singles never ask:
    they leave full shards later, when sizes are made even. Room of a shard is its
    capacity less the linked rows it holds. What large groups lean to, fewer than LARGE lines, is broadcast,
    so that their rows stay where they are.
    """
    linked = rows.where(F.col("_group").isNotNull())
    singles = rows.where(F.col("_group").isNull())
    for _ in range(rounds):
        held = _counts(linked, "shard")
        room = {s: max(0, capacity - held.get(s, 0)) for s in range(shards)}
        each = linked.groupBy("_group", "_large", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("room", _by_shard(room, F.col("shard")))
        # at most one entry for each shard
        rank = F.struct((-F.col("room") - F.col("n")).alias("fits"), (-F.col("n")).alias("n"), F.xxhash64("_group", "shard").alias("tie"), "shard", "room")
        full = F.struct(F.greatest(F.col("rank.fits"), -F.col("total")).alias("fits"), F.col("rank.n").alias("n"), F.col("rank.tie").alias("tie"), F.col("rank.shard").alias("shard"), F.col("rank.room").alias("room"))
        totals = each.groupBy("_group", "_large").agg(F.sum("n").alias("total"), F.collect_list(rank).alias("ranks"))
        lean = totals.select("_group", "_large", "total", F.explode("ranks").alias("rank")).groupBy("_group", "_large", "total").agg(F.array_sort(F.collect_list(full)).alias("c"))
        homes = F.slice("c", 1, F.ceil(F.col("total") / capacity).cast("int"))
        free = F.filter(homes, lambda x: x["room"] > 0)
        other = F.slice(F.filter("c", lambda x: x["room"] > 0), 1, 1)
        lean = lean.select("_group", "_large", F.transform(homes, lambda x: x["shard"]).alias("_homes"), F.transform(F.when(F.size(free) > 0, free).otherwise(other), lambda x: x["shard"]).alias("_open"))
        small, large = ~F.col("_large"), F.col("_large")
        asked = linked.where(small).join(lean.where(small).drop("_large"), "_group").unionByName(linked.where(large).join(F.broadcast(lean.where(large).drop("_large")), "_group"))
        away = ~F.array_contains("_homes", F.col("shard")) & (F.size("_open") > 0)
        asked = asked.withColumn("_to", F.when(away, F.get("_open", F.pmod(F.col("_h"), F.greatest(F.size("_open"), F.lit(1))).cast("int"))).otherwise(F.col("shard"))).drop("_homes", "_open")
        moving = number_rows(asked.where("shard <> _to"), ["_to"], "_h", ["_id"], "_rank", BUCKETS)
        moved = moving.withColumn("shard", F.when(F.col("_rank") < _by_shard(room, F.col("_to")), F.col("_to")).otherwise(F.col("shard"))).drop("_rank")
        linked = cut(asked.where("shard = _to").unionByName(moved).drop("_to"))
    return linked.unionByName(singles)


def balance_rows(rows: DataFrame, shards: int, n: int) -> DataFrame:
    """Moves rows from shards above their exact share to those below, single texts first; adds slot.

    Shares are n // shards, one more for the first n % shards shards.
    """
    share = {s: n // shards + (s < n % shards) for s in range(shards)}
    rows = rows.withColumn("_order", F.when(F.col("_group").isNotNull(), F.shiftright(F.col("_h"), 1) - F.lit(2**62)).otherwise(F.shiftright(F.col("_h"), 1) + F.lit(2**62)))
    ranked = cut(number_rows(rows, ["shard"], "_order", ["_id"], "slot", 2 * BUCKETS))
    held = _counts(ranked, "shard")
    stay = ranked.where(F.col("slot") < _by_shard(share, F.col("shard")))
    over = ranked.where(F.col("slot") >= _by_shard(share, F.col("shard"))).drop("slot")
    # the free places of all shards stand in one line; the rows that leave fill it in order
    places, first = [], 0
    for s in range(shards):
        free = max(0, share[s] - held.get(s, 0))
        if free:
            places.append((first, first + free, s, held.get(s, 0)))
        first += free
    line = number_rows(over.withColumn("_all", F.lit(0)), ["_all"], "_order", ["_id"], "_place", 2 * BUCKETS).drop("_all")
    at = F.col("_place")
    shard = reduce(lambda c, p: F.when((at >= p[0]) & (at < p[1]), F.lit(p[2])).otherwise(c), places, F.lit(None).cast("int"))
    slot = reduce(lambda c, p: F.when((at >= p[0]) & (at < p[1]), at - F.lit(p[0]) + F.lit(p[3])).otherwise(c), places, F.lit(None).cast("long"))
    filled = line.withColumn("shard", shard).withColumn("slot", slot.cast("long")).drop("_place")
    return stay.unionByName(filled).drop("_order")


def in_order(placed: DataFrame, order: str) -> DataFrame:
    """The slots of each shard anew, in the order of a column of numbers that no two rows share."""
    least, most = placed.agg(F.min(order), F.max(order)).first()
    # the range of the order spread over that of a hash, by which rows are dealt into buckets
    spread = (((F.col(order) - F.lit(least or 0)) / F.lit(float((most or 0) - (least or 0) + 1)) - 0.5) * 2.0**64).cast("long")
    return number_rows(placed.drop("slot").withColumn("_spread", spread), ["shard"], "_spread", [order], "slot", BUCKETS).drop("_spread")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, law `rows`.

    Shards differ by one row at most. Documents with equal texts are linked and
    gathered by label propagation; a group larger than a shard fills several.
    size: UTF-8 bytes of the text plus 8, null: 8. A null text is linked to
    nothing; empty texts are equal to each other. slot runs from 0 in each shard
    without gaps. Repeated rows get places of their own.

    order_col: a column of whole numbers, gapless and none null or twice, such as
    the position in a mixture; it is returned too. Shards then take rows in turn by it instead of
    by a hash of the id, and slots follow it: read by slot, each shard goes
    through the whole order in every `shards`-th row. Linked rows, and singles
    that make sizes even, still leave their turn, and take their slot by the order where they go.

    Only ids and digests are shuffled, never texts. The driver sees counts by
    shard alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [] if order_col is None else [F.col(order_col).cast("long").alias("_order_in")]
    turn = F.xxhash64(F.col("_id"), F.lit(11)) if order_col is None else F.col("_order_in")
    slim = docs.select(
        *order,
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.sha2(text, 256)).alias("_digest"),
    )
    slim = cut(slim)
    n = slim.count()
    groups = slim.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    large = F.col("_copies") * LARGE > n
    # rows of large groups and those without a text have a key of their own in the shuffled join, which nothing meets
    marked = slim.withColumn("_h", F.xxhash64(F.col("_id"), F.lit(7))).join(F.broadcast(groups.where(large).select("_digest", F.lit(True).alias("_large"))), "_digest", "left")
    key = F.when(F.col("_large").isNull() & F.col("_digest").isNotNull(), F.col("_digest")).otherwise(F.concat(F.lit("#"), F.col("_h").cast("string")))
    rows = (
        marked.withColumn("_key", key)
        .join(groups.where(~large).select(F.col("_digest").alias("_key"), "_copies"), "_key", "left")
        .withColumn("_large", F.coalesce("_large", F.lit(False)))
        .withColumn("_group", F.when(F.col("_large") | F.col("_copies").isNotNull(), F.col("_digest")))
        .withColumn("shard", F.pmod(turn, F.lit(shards)).cast("int"))
        .select("_id", "size", "text_crc32", "_group", "_large", "_h", "shard", *(["_order_in"] if order else []))
    )
    rows = cut(rows)
    capacity = max(1, n // shards)
    placed = balance_rows(propagate(rows, shards, capacity, rounds), shards, n)
    if order:
        placed = in_order(cut(placed), "_order_in")
    more = [F.col("_order_in").alias(order_col)] if order else []
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"), *more)


def cut_links(placed: DataFrame) -> DataFrame:
    """For each group of equal texts in several shards, the rows outside its largest shard (text_crc32 and size stand for the text)."""
    each = placed.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("text_crc32", "size").agg((F.sum("n") - F.max("n")).alias("cut"), F.count(F.lit(1)).alias("shards")).where("cut > 0")
