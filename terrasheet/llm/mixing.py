"""Mixing sources to target weights: Pfair schedules of source blocks.

Each source is a task with an integer share of Q slots, Q the sum of the shares.
Block k (from 0) of a source with share w is released at slot floor(k Q / w) and
due before slot ceil((k + 1) Q / w). In each slot the released block with the
earliest deadline goes out. Every window holds one slot of a feasible unit-job
system, so that at every slot each source is less than one block from its target.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows

OTHER = "*"


def pfair_slots(shares: dict[str, int], stop: dict[str, int] | None = None) -> list[str]:
    """The source of each slot of one period, by earliest deadline first; ties go to the name.

    `stop`: blocks that a source has left; the list ends after the slot in which one runs out.
    The list is as long as the sum of the shares: parameters bound it, not the data.
    """
    q = sum(shares.values())
    sent = dict.fromkeys(shares, 0)
    out: list[str] = []
    for slot in range(q):
        ready = [(-(-(sent[s] + 1) * q // w), s) for s, w in shares.items() if sent[s] < w and sent[s] * q // w <= slot]
        due, s = min(ready)
        assert due > slot
        out.append(s)
        sent[s] += 1
        if stop and sent[s] == stop[s]:
            break
    return out


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[dict]:
    """The schedule as one entry for each phase and source: a phase ends when a source has no block left, and the others' weights fill the line anew."""
    left, used, slot, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        own = {s: shares[s] for s in left if shares[s]} or dict.fromkeys(left, 1)
        q = sum(own.values())
        whole = min(left[s] // own[s] for s in own)
        after = {s: left[s] - whole * own[s] for s in own}
        # a whole period more may end no source; what is left then ends one within the next period
        rest = pfair_slots(own, after) if all(after.values()) else []
        line = pfair_slots(own)
        took = {s: whole * own[s] + rest.count(s) for s in own}
        for s in own:
            at = [i for i, x in enumerate(line) if x == s]
            out.append({"cls": s, "lo": used[s], "hi": used[s] + took[s], "slot0": slot, "q": q, "share": own[s], "at": at})
        slot += whole * q + len(rest)
        for s in own:
            used[s] += took[s]
        left = {s: blocks[s] - used[s] for s in left if blocks[s] > used[s]}
    return out


def mix_sources(docs: DataFrame, shares: dict[str, int], block_rows: int = 32, default_share: int = 1, id_col: str = "doc_id", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Every row of `docs` with its place in the mixture; no row is dropped or repeated.

    shares: whole target weights by source; all sources not named, a null one
    included, form one class `*` with `default_share`. Sources of weight 0 follow
    when all others are used up, with equal weights. Within a class rows go in
    a fixed pseudo-random order of the id and are cut into blocks of `block_rows`.
    While all classes last, each has sent its weight's part of all blocks to
    within less than one block, after every slot; when one is used up, the same
    holds from there for the others, whose weights then add up to one.

    Adds mix_class, block, release, deadline and slot (in blocks, counted from
    the start of the mixture) and position (gapless from 0). `keep`: input
    columns returned beside them, by default all; an input column of one of these
    names gives way. An empty table gives an empty result.

    The driver sees one row count for each named source. The schedule that is
    joined has at most (names + 1) squared rows and the sum of the shares slots
    in each phase.
    """
    made = ["mix_class", "block", "release", "deadline", "slot", "position"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    shares = {**shares, OTHER: default_share}
    if any(w < 0 or w != int(w) for w in shares.values()):
        raise ValueError("shares must be whole numbers of 0 or more")
    named = F.col(source_col).isin(*[s for s in shares if s != OTHER])
    # the input's columns ride in a struct, where no name can clash
    row = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row")] if keep else []
    rows = docs.select(*row, F.when(F.coalesce(named, F.lit(False)), F.col(source_col)).otherwise(OTHER).alias("_cls"), F.xxhash64(id_col, F.lit(3)).alias("_h"), F.col(id_col).alias("_id"))
    counts = {r[0]: r[1] for r in rows.groupBy("_cls").count().collect()}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    plan = phases(blocks, shares)
    schema = pa.schema([("_cls", pa.string()), *((c, pa.int64()) for c in ("_lo", "_hi", "_slot0", "_q", "_share")), ("_at", pa.list_(pa.int32()))])
    lookup = docs.sparkSession.createDataFrame(pa.Table.from_pylist([{f"_{k}": v for k, v in p.items()} for p in plan], schema))
    rows = number_rows(rows, ["_cls"], "_h", ["_id"], "_nr")
    block = F.floor(F.col("_nr") / block_rows)
    rows = rows.withColumn("block", block.cast("long"))
    rows = rows.join(F.broadcast(lookup), "_cls").where("block >= _lo AND block < _hi")
    k = F.col("block") - F.col("_lo")
    rows = rows.withColumns(
        {
            "release": (F.col("_slot0") + F.floor(k * F.col("_q") / F.col("_share"))).cast("long"),
            "deadline": (F.col("_slot0") + F.ceil((k + 1) * F.col("_q") / F.col("_share"))).cast("long"),
            "slot": (F.col("_slot0") + F.floor(k / F.col("_share")) * F.col("_q") + F.element_at("_at", (k % F.col("_share")).cast("int") + 1)).cast("long"),
        }
    )
    # the last block of a class may be short: later rows move up by what it lacks
    place = F.col("slot") * block_rows + F.col("_nr") % block_rows
    for s, n in counts.items():
        if n % block_rows:
            last = next(p for p in reversed(plan) if p["cls"] == s)
            j = blocks[s] - 1 - last["lo"]
            at = last["slot0"] + j // last["share"] * last["q"] + last["at"][j % last["share"]]
            place = place - F.when(F.col("slot") > at, block_rows - n % block_rows).otherwise(0)
    return rows.withColumn("position", place.cast("long")).select(*(["_row.*"] if keep else []), F.col("_cls").alias("mix_class"), *made[1:])


def write_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """The rows in files that, read in order, give the mixture."""
    return mixed.repartitionByRange(partitions, "position").sortWithinPartitions("position")
