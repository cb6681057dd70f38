"""A Merkle manifest of a table: leaves by group, subroots by group, one root, and every row's proof.

The leaves of a group are numbered without a global sort in one task, and cut
into aligned blocks of BRANCH ** BLOCK_LEVELS. The blocks' roots are the leaves
of the next tier, so that a group of any size is a few tiers of distributed
blocks; the groups' subroots are one more such tree. From the top down each block
is given the proof of its root, and a fractal traversal of the block's leaves
emits their paths one after another, to which that proof is appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

BRANCH = 3
#: Levels of a block: 729 leaves. A task holds one block's digests and two small subtrees a stack.
BLOCK_LEVELS = 6
#: Levels of a stacked subtree in the traversal of a block.
SUBTREE_LEVELS = 2


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns in their order: `-` for null, else the UTF-8 byte count, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def combine(nodes: list[bytes]) -> bytes:
    """The parent of a run of digests, which are hashed as hex text."""
    return sha256(b"".join(nodes).hex().encode()).digest()


def levels_of(n: int) -> int:
    """Levels between n leaves and the one node that remains."""
    k, most = 0, 1
    while most < n:
        k, most = k + 1, most * BRANCH
    return k


class Subtree:
    """A subtree that grows leaf by leaf and keeps its nodes of the levels low to high - 1."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.nodes: list[list[bytes]] = [[] for _ in range(high - low)]
        self.open: list[list[bytes]] = [[] for _ in range(high)]

    def add(self, digest: bytes, level: int = 0) -> None:
        """Takes the next leaf; runs that are full become their parent."""
        while level < self.high:
            if level >= self.low:
                self.nodes[level - self.low].append(digest)
            run = self.open[level]
            run.append(digest)
            if len(run) < BRANCH:
                return
            digest, level = combine(run), level + 1
            run.clear()

    def close(self) -> None:
        """No more leaves: the last run of each level, however short, becomes its parent."""
        for level in range(self.high - 1):
            run = self.open[level]
            if run:
                parent = combine(run)
                run.clear()
                self.add(parent, level + 1)

    def run(self, level: int, place: int) -> list[bytes]:
        """The run that holds the node at `place` of the subtree's nodes of this level."""
        first = place - place % BRANCH
        return self.nodes[level - self.low][first : first + BRANCH]

    def root(self) -> bytes:
        return combine(self.nodes[-1])


def block_root(leaves: Iterator[bytes] | list[bytes], levels: int) -> bytes:
    """The root of a block, holding one open run a level."""
    tree = Subtree(max(levels - 1, 0), levels)
    for leaf in leaves:
        if not levels:
            return leaf
        tree.add(leaf)
    tree.close()
    return tree.root()


def traverse(leaves: list[bytes], levels: int, height: int = SUBTREE_LEVELS) -> Iterator[tuple[bytes, str]]:
    """The siblings and shape of each leaf's path through its block, one leaf after another.

    Subtrees of `height` levels are stacked up to the block's root. On each level of
    the stack one exists, which gives its part of the path, and the desired one to
    its right grows by one leaf a step: it is whole when the existing one is used
    up, and takes its place. The siblings are joined level by level, left to right;
    the shape has two digits a level, the leaf's place in the run and the run's size.
    """
    spans = [(low, min(low + height, levels)) for low in range(0, levels, height)]

    def grown(low: int, high: int, at: int) -> Subtree:
        tree = Subtree(low, high)
        for leaf in leaves[at : at + BRANCH**high]:
            tree.add(leaf)
        tree.close()
        return tree

    exist = [grown(low, high, 0) for low, high in spans]
    desired = [Subtree(low, high) for low, high in spans]
    for i in range(len(leaves)):
        siblings, shape = [], []
        for tree in exist:
            for level in range(tree.low, tree.high):
                place = i // BRANCH**level % BRANCH ** (tree.high - level)
                run = tree.run(level, place)
                own = place % BRANCH
                siblings += run[:own] + run[own + 1 :]
                shape.append(f"{own}{len(run)}")
        yield b"".join(siblings), "".join(shape)
        for s, (low, high) in enumerate(spans):
            ahead = i + BRANCH**high
            if ahead < len(leaves):
                desired[s].add(leaves[ahead])
            if (i + 1) % BRANCH**high == 0:
                desired[s].close()
                exist[s], desired[s] = desired[s], Subtree(low, high)


def fold(leaf: bytes, path: bytes, shape: str) -> bytes:
    """The root that a leaf and a path give."""
    at = 0
    for k in range(0, len(shape), 2):
        place, n = int(shape[k]), int(shape[k + 1])
        run = [path[at + 32 * j : at + 32 * j + 32] for j in range(n - 1)]
        at += 32 * (n - 1)
        leaf = combine([*run[:place], leaf, *run[place:]])
    return leaf


def number_leaves(leaves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds `i`, the place from 0 of a row in its key by the columns of `order` (nulls first), and `n`, the key's rows; stored.

    Rows are range-partitioned, so that a large key is many tasks' work; what is
    summed in order is one count for each key and partition. Rows equal in all of
    `order` are dealt over partitions too, and come in any order.
    """
    by = [F.col(c).asc_nulls_first() for c in (key, *order)] + [F.col("_tie")]
    ranged = leaves.withColumn("_tie", F.rand(0)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    rows = store(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_r", F.monotonically_increasing_id()), "leaves")
    w = Window.partitionBy(key)
    runs = rows.groupBy(key, "_p").agg(F.min("_r").alias("_r0"), F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = store(runs.select(key, "_p", (before - F.col("_r0")).alias("_shift"), F.sum("_c").over(w).alias("n")), "runs")
    return rows.join(runs, [key, "_p"]).withColumn("i", F.col("_r") + F.col("_shift")).drop("_p", "_r", "_shift")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of each block; a block starts where `i` is a multiple of its size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = [int(s) for s in np.flatnonzero(batch.column("i").to_numpy() % size == 0)]
        at = 0
        for s in [*starts, batch.num_rows]:
            if s > at:
                held.append(batch.slice(at, s - at))
            if s < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            at = s
    if held:
        yield pa.Table.from_batches(held)


def _levels(block: pa.Table, block_levels: int) -> int:
    """A block's levels: all if its key has several blocks, else as many as its leaves need."""
    n = block.column("n")[0].as_py()
    return block_levels if n > BRANCH**block_levels else levels_of(n)


def _dealt(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes with the `block` that they lie in, a block's in one partition."""
    return nodes.withColumn("block", F.floor(F.col("i") / size)).repartition("key", "block")


def block_roots(nodes: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(key, i, n, digest): a node for each block of `nodes`, with the same columns."""
    size = BRANCH**block_levels

    def roots(batches):
        for block in _blocks(batches, size):
            n = block.column("n")[0].as_py()
            root = block_root(block.column("digest").to_pylist(), _levels(block, block_levels))
            yield pa.RecordBatch.from_arrays([pa.array([block.column("key")[0].as_py()], pa.string()), pa.array([block.column("i")[0].as_py() // size]), pa.array([-(-n // size)]), pa.array([root], pa.binary())], names=["key", "i", "n", "digest"])

    rows = _dealt(nodes.select("key", "i", "n", "digest"), size).sortWithinPartitions("key", "block", "i").drop("block")
    return rows.mapInArrow(roots, "key string, i long, n long, digest binary")


def _paths(nodes: DataFrame, above: DataFrame, block_levels: int, presented: str | None = None, paths: bool = True) -> DataFrame:
    """`nodes` with (path, shape), or (proof, folded) of the digest in `presented` without `paths`; `above` has (key, block, _path, _shape, subroot, root) of the blocks."""
    size = BRANCH**block_levels
    joined = _dealt(nodes, size).join(above, ["key", "block"]).sortWithinPartitions("key", "block", "i").drop("block")
    carried = [f for f in joined.schema if f.name not in ("_path", "_shape")]
    more = "path binary, shape string" if paths else "proof string, folded binary"

    def walk(batches):
        for block in _blocks(batches, size):
            upper, shape = block.column("_path")[0].as_py(), block.column("_shape")[0].as_py()
            digests = block.column("digest").to_pylist()
            shown = block.column(presented).to_pylist() if presented else digests
            one, two = [], []
            for leaf, (own, form) in zip(shown, traverse(digests, _levels(block, block_levels)), strict=True):
                path, form = own + upper, form + shape
                one.append(path if paths else sha256(path.hex().encode()).hexdigest())
                two.append(form if paths else fold(leaf, path, form))
            out = block.drop_columns(["_path", "_shape"])
            names = ["path", "shape"] if paths else ["proof", "folded"]
            out = out.append_column(names[0], pa.array(one, pa.binary() if paths else pa.string())).append_column(names[1], pa.array(two, pa.string() if paths else pa.binary()))
            yield from out.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return joined.mapInArrow(walk, f"{schema}, {more}")


def _tree(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """`nodes` and the tiers above them, stored: each has the blocks' roots of those keys that the tier below holds several nodes of."""
    tiers, size = [nodes], BRANCH**block_levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tiers.append(store(block_roots(tiers[-1].where("n > 1"), block_levels), "tier"))
        most = -(-most // size)
    return tiers


def _roots(tiers: list[DataFrame], *columns: Column | str) -> DataFrame:
    """The one node that remains of each key."""
    return reduce(DataFrame.unionByName, [t.where("n = 1").select(*columns) for t in tiers])


def _proofs(tiers: list[DataFrame], top: DataFrame, block_levels: int, **kwargs) -> DataFrame:
    """The rows of the lowest tier with their paths; `top` has (key, _path, _shape, subroot, root) of each key's root.

    A key ends in the first tier where it fits into one block; that block's root is
    the key's. Blocks of other keys have the path of their node in the tier above.
    """
    size = BRANCH**block_levels
    highest = max(0, len(tiers) - 2)
    for k in range(highest, -1, -1):
        # of each tier but the lowest, rows with n = 1 are the roots of keys that end below
        here = tiers[k].where("n > 1") if k else tiers[0]
        last = here.where((F.col("n") <= size) & (F.col("i") == 0)).select("key").join(top, "key").withColumn("block", F.lit(0).cast("long"))
        if k < highest:
            last = last.unionByName(above.select("key", F.col("i").alias("block"), F.col("path").alias("_path"), F.col("shape").alias("_shape"), "subroot", "root"))
        if k == 0:
            return _paths(here, last, block_levels, **kwargs)
        above = store(_paths(here, last, block_levels), "proofs")


def manifest(leaves: DataFrame, group_col: str, order: list[str], block_levels: int = BLOCK_LEVELS, presented: str | None = None, paths: bool = True) -> DataFrame:
    """The rows of `leaves` with their place, subroot, root and proof.

    `leaves` has a `digest` (binary) of each row; rows are ordered inside a group by
    `order` (nulls first) and the digest, groups by their text's bytes, null first.
    Adds i, n (place and rows in the group), subroot, root, and the proof: either
    `path` (the siblings' digests) and `shape`, or with paths=False only `proof` (the
    SHA-256 of the siblings as hex) and `folded`, the root that the digest in
    `presented` gives with that path. A group of one row is its own subroot, one
    group's subroot the root. An empty table gives no row. `leaves` may have any
    other columns, but for these names and `key`.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    nodes = number_leaves(leaves.withColumn("key", key), "key", [*order, "digest"])
    tiers = _tree(nodes, block_levels)
    groups = number_leaves(_roots(tiers, F.lit("").alias("key"), F.col("key").alias("group"), "digest"), "key", ["group"])
    upper = _tree(groups, block_levels)
    top = _roots(upper, "key", F.lit(b"").alias("_path"), F.lit("").alias("_shape"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    of_group = _proofs(upper, top, block_levels).select(F.col("group").alias("key"), F.col("path").alias("_path"), F.col("shape").alias("_shape"), F.col("digest").alias("subroot"), "root")
    of_group = store(of_group, "groups")
    return _proofs(tiers, of_group, block_levels, presented=presented, paths=paths).drop("key")


def document_leaves(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """(id, source, digest, shown): the leaf of every row, and the leaf that a tampered copy shows.

    Rows whose id's crc32 is even lose the line feeds of their text in the copy;
    rows without an id or a text, and all others, show their own leaf.
    """
    text = F.col(text_col)
    leaf = lambda t: F.unhex(leaf_digest(F.col(id_col), F.col(source_col), F.col(lang_col), F.col(chars_col), t))
    bare = F.when(F.crc32(F.col(id_col).cast("string")) % 2 == 0, F.translate(text, "\n", ""))
    out = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf(text).alias("digest"), F.when(bare != text, leaf(bare)).alias("shown"))
    return out.withColumn("shown", F.coalesce("shown", "digest"))


def verify_documents(docs: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, in lowercase hex.

    Ids that repeat are ordered by their leaves, rows without an id come first. A
    null in any column has its own mark in the leaf. Very long texts are hashed
    where they are read; only digests are shuffled.
    """
    rows = manifest(document_leaves(docs, id_col=id_col, **columns), "source", ["id"], presented="shown", paths=False)
    text = lambda c: F.lower(F.hex(c))
    out = rows.select(F.col("id").alias(id_col), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.col("proof").alias("proof_sha256"), text("folded").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
