"""Language-model scoring with Brown class-based bigrams.

A text's probability is the product over its tokens of the probability of the
token's class after the class before it, times that of the token in its class,
mixed with the unigram probability. Classes come from exchange clustering.

1. Core words, those with the largest counts, are clustered by exchange: in each
   round the words of a half of them go, one after another, to the class that
   raises the class bigrams' likelihood most. The bigrams of core words are summed over the corpus;
   their table and the classes are bounded by CORE, whatever the corpus.
2. Every other word goes to the class that its neighbours in the whole corpus make
   likeliest, given the core's classes: at first by its core neighbours, then
   TAIL_ROUNDS times by all of them, with the classes they have got.
3. All words' counts, and the counted class pairs of all training texts, make the model.

No task holds the vocabulary. Documents are dealt into chunks of bounded size and
kept as numbers of the chunk's words; a chunk sends each of its distinct words
once to be counted, with the classes it stood next to, and gets back the word's
count and class.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, new_dir, release, store, stored, write

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
IN_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
CORE, CLASSES, ROUNDS, TAIL_ROUNDS = 4096, 48, 8, 1
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 16 << 20
DELTA = 0.1
#: Weight of the class unigrams in each class's transitions, in counts, and of the class model against the word unigrams.
PRIOR, LAMBDA = 20.0, 0.9
TAIL, END = CLASSES, CLASSES + 1
CODES = CLASSES + 2
#: A neighbour's code takes SHIFT bits of its four bytes, its count at most MOST the others.
SHIFT = (2 * CODES - 1).bit_length()
MOST = (1 << 31 - SHIFT) - 1


def split_words(texts) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row and how many each text has: what lies between the blanks tab to carriage return and space, A to Z in lower case, as UTF-8. A null text has none.

    Works on the bytes of all texts at once; no word becomes a Python object.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([c.cast(pa.large_binary()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_binary())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    if data is None or not len(texts):
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    off = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside = IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's first byte starts a word and its last byte ends one, whatever stands beside them
    full = off[:-1] < off[1:]
    at = off[:-1][full]
    first[at] = inside[at]
    at = off[1:][full] - 1
    last[at] = inside[at]
    start = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) - start + 1)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(LOWER[raw[inside]].tobytes())])
    return words, np.diff(np.searchsorted(start, off))


def core_words(docs: DataFrame, core: int) -> list[bytes]:
    """The `core` words with the largest counts, ties by the word."""

    def count(batches):
        found = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in batches:
            new = pc.value_counts(split_words(batch.column(0))[0])
            found = pa.concat_tables([found, pa.table({"word": new.field(0).cast(pa.binary()), "n": new.field(1)})])
            if found.num_rows > 1_000_000:
                found = found.group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
            if found.num_rows > 500_000:  # as a partial sum; nothing is dropped
                yield from found.to_batches()
                found = found.slice(0, 0)
        yield from found.to_batches()

    top = docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(core)
    return [bytes(r[0]) for r in top.collect()]


def _among(words: pa.Array, top: list[bytes]) -> np.ndarray:
    """Each word's place in `top`, len(top) for one that isn't there."""
    return pc.fill_null(pc.index_in(words.cast(pa.binary()), value_set=pa.array(top, pa.binary())), len(top)).to_numpy(zero_copy_only=False)


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Puts `end` behind each text's values."""
    return np.insert(values, np.cumsum(lengths), end)


def core_bigrams(docs: DataFrame, top, core: int) -> DataFrame:
    """(a, b, n) over training texts; id `core` is any other word and core + 1 a text's end, which also stands before its start."""
    size = core + 2

    def count(batches):
        keys, total = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            words, lengths = split_words(batch.column(0))
            coded = words.dictionary_encode()
            ids = _among(coded.dictionary, top.value).astype(np.int64)
            ids[ids == len(top.value)] = core
            flat = np.concatenate([[core + 1], _with_ends(ids[coded.indices.to_numpy()], lengths, core + 1)])
            k, n = np.unique(flat[:-1] * size + flat[1:], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            total = np.bincount(at, np.concatenate([total, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(total)], names=["a", "b", "n"])

    return docs.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def class_matrix(bigrams: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs: CODES squared numbers."""
    shared = bigrams.sparkSession.sparkContext.broadcast(classes)

    def count(batches):
        total = np.zeros(CODES * CODES, np.int64)
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            total += np.bincount(shared.value[a] * CODES + shared.value[b], n, CODES * CODES).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(CODES * CODES)
    for k, n in bigrams.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(CODES, CODES)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_gains(c: np.ndarray, k: int, left: np.ndarray, right: np.ndarray, own: float) -> np.ndarray:
    """The likelihood, up to a constant, with a word of class `k` in each class: left and right are its counts after and before each class, own those after itself."""
    c = c.copy()
    c[:, k] -= left
    c[k, :] -= right
    c[k, k] -= own
    # wherever the word goes, its neighbours' classes keep their totals
    row, col = c.sum(axis=1) + left, c.sum(axis=0) + right
    into, out_of = _f(c + left[:, None]) - _f(c), _f(c + right[None, :]) - _f(c)
    d = np.arange(CODES)
    gain = into.sum(axis=0) - into[d, d] + out_of.sum(axis=1) - out_of[d, d]
    gain += _f(c[d, d] + left + right + own) - _f(c[d, d])
    gain -= _f(row + right.sum() + own) - _f(row) + _f(col + left.sum() + own) - _f(col)
    return gain[:CLASSES]


def exchange(bigrams: DataFrame, core: int, rounds: int) -> np.ndarray:
    """The class of each core id. At first the most frequent words have a class each and all others share the last.

    Executors sum the contexts of the core words; a round then takes a half of the
    words one after another and moves each to its best class, with the class
    matrix kept up to date. What comes to the driver are 2 * CODES numbers for
    each core word.
    """
    classes = np.concatenate([np.minimum(np.arange(core), CLASSES - 1), [TAIL, END]])
    sc = bigrams.sparkSession.sparkContext
    sided = bigrams.select(F.col("b").alias("w"), F.lit(0).alias("side"), F.col("a").alias("o"), "n").unionByName(bigrams.select(F.col("a").alias("w"), F.lit(1).alias("side"), F.col("b").alias("o"), "n")).where(F.col("w") < core)
    sided = cut(sided.repartition("w"))
    for r in range(rounds):
        c = class_matrix(bigrams, classes)
        shared = sc.broadcast(classes)

        def contexts(batches, shared=shared, half=r % 2):
            own_classes = shared.value
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                w, side, o, n = (batch.column(i).to_numpy() for i in range(4))
                use = w % 2 == half
                w, side, o, n = w[use], side[use], o[use], n[use]
                code = np.where(w == o, 2 * CODES, side * CODES + own_classes[o])
                for x in np.unique(w).tolist():
                    own = w == x
                    v = np.bincount(code[own], n[own], 2 * CODES + 1).astype(np.int64)
                    found[x] = found[x] + v if x in found else v
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["w", "v"])

        for w, raw in sorted(map(tuple, sided.mapInArrow(contexts, "w long, v binary").collect())):
            v = np.frombuffer(raw, np.int64)
            left, right, own, k = v[:CODES], v[CODES : 2 * CODES], v[-1] / 2, classes[w]
            # neighbours that have moved in this round are still counted where they were
            gain = exchange_gains(np.maximum(c, 0), k, np.minimum(left, np.maximum(c[:, k], 0)), np.minimum(right, np.maximum(c[k, :], 0)), own)
            best = int(np.argmax(gain))
            if gain[best] > gain[k] + 1e-6:
                for at, sign in ((k, -1), (best, 1)):
                    c[:, at] += sign * left
                    c[at, :] += sign * right
                    c[at, at] += sign * own
                classes[w] = best
    return classes


def _chunks(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    # rows that repeat both id and text go to chunks by the partition they are read in
    return docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(n)).cast("int")), n


def _encode(texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words; their numbers in all texts in a row, each text followed by -1 for its end; the texts' lengths with it."""
    words, lengths = split_words(texts)
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), _with_ends(coded.indices.to_numpy().astype(np.int64), lengths, -1), lengths + 1


def _core_classes(words: pa.Array, core, other: int) -> np.ndarray:
    """Each word's class if it is a core word, else `other`."""
    top, classes = core
    return np.append(classes, other)[_among(words, top)]


def _contexts(ids: np.ndarray, train: np.ndarray, code: np.ndarray, tail: np.ndarray) -> dict[str, pa.Array]:
    """By word number: its count in training texts and, for `tail` words, its neighbours as four bytes each: below the code (next words' above CODES), above it how often. The last of `code` is END."""
    words = len(code) - 1
    n = np.bincount(ids[train & (ids >= 0)], minlength=words)
    before, after = np.concatenate([[-1], ids[:-1]]), np.concatenate([ids[1:], [-1]])
    use = train & (ids >= 0)
    use[use] = tail[ids[use]]
    key = np.concatenate([ids[use] * (2 * CODES) + code[before[use]], ids[use] * (2 * CODES) + CODES + code[after[use]]])
    key, times = np.unique(key, return_counts=True)
    parts = -(-times // MOST)  # a count beyond MOST is told in several parts
    if (parts > 1).any():
        last = np.cumsum(parts) - 1
        share = np.full(parts.sum(), MOST)
        share[last] = times - (parts - 1) * MOST
        key, times = np.repeat(key, parts), share
    offsets = pa.array((4 * np.searchsorted(key, np.arange(words + 1) * (2 * CODES))).astype(np.int32))
    packed = (key % (2 * CODES) | times << SHIFT).astype(np.int32)
    context = pa.Array.from_buffers(pa.binary(), words, [None, offsets.buffers()[1], pa.py_buffer(packed.tobytes())])
    return {"n": pa.array(n.astype(np.int64)), "context": context}


WORD_ROWS = "chunk int, at int, word binary, n long, context binary"
#: The same once words have numbers, which are shorter and quicker to sort than words.
NUMBER_ROWS = WORD_ROWS.replace("word binary", "number long")


def encode_chunks(docs: DataFrame, core, kind: str) -> DataFrame:
    """Rows of two kinds: (chunk, at, word, n, context) for each distinct word of a chunk, its number there being `at`, with _contexts by the core's classes; (chunk, id, held_out, ids) for each text, as word numbers with -1 for its end."""

    def encode(table: pa.Table) -> pa.Table:
        held = np.array(table.column("held_out").to_pylist(), bool)
        words, ids, lengths = _encode(table.column("text"))
        code = np.append(_core_classes(words, core.value, TAIL), END)
        found = _contexts(ids, np.repeat(~held, lengths), code, code[:-1] == TAIL)
        chunk = table.column("chunk")[0].as_py()
        number = lambda n: pa.array(np.full(n, chunk, np.int32))
        rows = pa.table({"chunk": number(len(words)), "at": pa.array(np.arange(len(words), dtype=np.int32)), "word": words, **found})
        offsets = pa.array(np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int32))
        flat = pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets.buffers()[1], pa.py_buffer(ids.astype(np.int32).tobytes())])
        texts = pa.table({"chunk": number(len(lengths)), "id": table.column("id"), "held_out": table.column("held_out"), "ids": flat})
        return pa.concat_tables([rows, texts], promote_options="default")

    return docs.groupBy("chunk").applyInArrow(encode, f"{WORD_ROWS}, id {kind}, held_out boolean, ids binary")


def _ids(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts of a chunk in a row, and the texts' lengths."""
    parts = [np.frombuffer(x, np.int32) for x in texts.column("ids").to_pylist()]
    return (np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)), np.array(list(map(len, parts)), np.int64)


def _by_number(words: pa.Table, column: str, end: int) -> np.ndarray:
    """The column's values in the order of the word numbers, and that of an end, which -1 finds."""
    out = np.full(words.num_rows + 1, end, np.int64)
    out[words.column("at").to_numpy()] = words.column(column).to_numpy()
    return out


def word_rows(texts: DataFrame, reply: DataFrame) -> DataFrame:
    """The word rows of encode_chunks by the classes that all words have in `reply`, with the words' numbers for the words."""

    def count(own: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("at")
        ids, lengths = _ids(own)
        held = np.array(own.column("held_out").to_pylist(), bool)
        tail = words.column("number").to_numpy() >= 0
        found = _contexts(ids, np.repeat(~held, lengths), _by_number(words, "cls", END), tail)
        return pa.table({"chunk": words.column("chunk"), "at": words.column("at"), "number": words.column("number"), **found})

    return texts.groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(count, NUMBER_ROWS)


PACKED = "chunk int, k long, n long, counts binary, classes binary"


def pack_chunks(texts: DataFrame, reply: DataFrame) -> DataFrame:
    """One row for each chunk with the counts and classes of its words, in their order, so that the words themselves are shuffled once; and rows (k, n) with its counts of class pairs of training texts, ends included. An end also stands before a text's start."""

    def pack(own: pa.Table, words: pa.Table) -> pa.Table:
        ids, _ = _ids(own)
        classes = _by_number(words, "cls", END)
        code = classes[ids]
        total = np.bincount(np.concatenate([[END], code[:-1]]) * CODES + code, minlength=CODES * CODES) if len(code) else np.zeros(0, np.int64)
        at = np.flatnonzero(total)
        chunk = (words if words.num_rows else own).column("chunk")[0].as_py()
        none = pa.nulls(len(at), pa.binary())
        pairs = pa.table({"chunk": pa.array(np.full(len(at), chunk, np.int32)), "k": pa.array(at.astype(np.int64)), "n": pa.array(total[at].astype(np.int64)), "counts": none, "classes": none})
        counts = _by_number(words, "c", 0)
        row = pa.table([pa.array([chunk], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts[:-1].tobytes()], pa.binary()), pa.array([classes[:-1].astype(np.int32).tobytes()], pa.binary())], names=pairs.column_names)
        return pa.concat_tables([pairs, row])

    return texts.where("NOT held_out").groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(pack, PACKED)


def class_pairs(texts: DataFrame, reply: DataFrame) -> np.ndarray:
    return pair_counts(pack_chunks(texts, reply))


def pair_counts(packed: DataFrame) -> np.ndarray:
    """The counts of class pairs of all chunks: CODES squared numbers."""
    out = np.zeros(CODES * CODES)
    for k, n in packed.where("k IS NOT NULL").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(CODES, CODES)


def assign(rows: DataFrame, core, log_t) -> DataFrame:
    """Sends each word's count and class back to its chunks: (chunk, at, number, c, cls, to).

    `rows` tell words by themselves or by the numbers that they got here before:
    below 0 for core words, -1 for the first, and above for all others, by partition. A
    word's rows come one after another; of them only sums and the chunks'
    numbers are held. Rows with a null number and chunk -1 carry sums: c by class cls
    (to -1: words in it; -2: tokens in it).
    """
    schema = pa.schema([("chunk", pa.int32()), ("at", pa.int32()), ("number", pa.int64()), ("c", pa.int64()), ("cls", pa.int32()), ("to", pa.int32())])

    key = "word" if "word" in rows.columns else "number"
    kind = pa.binary() if key == "word" else pa.int64()

    def merge(batches):
        log = np.vstack([log_t.value, log_t.value.T])
        stats: Counter = Counter()
        first = [TaskContext.get().partitionId() << 36]
        last: tuple | None = None
        for batch in batches:
            word = batch.column(key)
            if not len(word):
                continue
            where, n = batch.column("chunk").to_numpy().astype(np.int64) << 32 | batch.column("at").to_numpy(), batch.column("n").to_numpy()
            lists = batch.column("context")
            _, ends, data = lists.buffers()
            off = np.frombuffer(ends, np.int32)[lists.offset : lists.offset + len(lists) + 1] // 4
            packed = np.frombuffer(data, np.int32, off[-1])[off[0] :] if data is not None else np.empty(0, np.int32)
            codes, times = packed & (1 << SHIFT) - 1, packed >> SHIFT
            fresh = np.append(True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))
            start, which = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            total = np.bincount(which, n, len(start)).astype(np.int64)
            ctx = np.bincount(np.repeat(which, np.diff(off)) * (2 * CODES) + codes, times, len(start) * 2 * CODES).reshape(-1, 2 * CODES)
            rows = np.diff(np.append(start, len(word)))
            if last is not None and last[0] == word[0].as_py():
                word = pa.concat_arrays([pa.repeat(pa.scalar(last[0], kind), len(last[3])), word])
                total[0] += last[1]
                ctx[0] += last[2]
                where = np.concatenate([last[3], where])
                rows[0] += len(last[3])
            elif last is not None:
                yield from _reply(pa.repeat(pa.scalar(last[0], kind), len(last[3])), np.array([len(last[3])]), np.array([last[1]]), last[2][None], last[3], core.value, log, stats, first, schema)
            end = len(word) - rows[-1]
            last = (word[-1].as_py(), total[-1], ctx[-1].copy(), where[end:].copy())
            yield from _reply(word.slice(0, end), rows[:-1], total[:-1], ctx[:-1], where[:end], core.value, log, stats, first, schema)
        if last is not None:
            yield from _reply(pa.repeat(pa.scalar(last[0], kind), len(last[3])), np.array([len(last[3])]), np.array([last[1]]), last[2][None], last[3], core.value, log, stats, first, schema)
        rows = [(a, b, int(v)) for (a, b), v in stats.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(rows), pa.int32()), pa.array([None] * len(rows), pa.int32()), pa.array([None] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())], schema=schema)

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(merge, "chunk int, at int, number long, c long, cls int, to int")


def _reply(names, rows, total, ctx, where, core, log, stats, first, schema):
    """Classes of whole words, the sums they add to, and the rows for their chunks. Of names and where, each word has as many as `rows` says, one word after another."""
    if not len(rows):
        return
    names = names.take(pa.array(np.cumsum(rows) - rows))
    top, classes = core
    if pa.types.is_integer(names.type):
        number = names.to_numpy()
    else:
        found = _among(names, top)
        number = -1 - found.astype(np.int64)
        new = np.flatnonzero(found == len(top))
        number[new] = first[0] + np.arange(len(new))
        first[0] += len(new)
    tail = number >= 0
    cls = np.append(classes, -1)[np.where(tail, len(top), -1 - number)]
    # log probability of the neighbours with the word in each class; unknown neighbours say nothing
    cls[tail] = np.argmax((ctx[tail] @ log)[:, :CLASSES], axis=1)
    seen = total > 0
    for k in np.unique(cls[seen]):
        stats[(int(k), -1)] += int((cls[seen] == k).sum())
        stats[(int(k), -2)] += int(total[seen & (cls == k)].sum())
    total, cls, number = np.repeat(total, rows), np.repeat(cls, rows), np.repeat(number, rows)
    for lo in range(0, len(where), 50_000):
        part = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array((where[part] >> 32).astype(np.int32)), pa.array((where[part] & 0xFFFFFFFF).astype(np.int32)), pa.array(number[part], pa.int64()), pa.array(total[part], pa.int64()), pa.array(cls[part], pa.int32()), pa.array(np.zeros(len(where[part]), np.int32))], schema=schema)


class Model:
    """Numbers of the fitted model; its size depends on CLASSES alone."""

    def __init__(self, counts: np.ndarray, sums: list[tuple[int, int, int]], texts: int):
        words, size = np.zeros(CLASSES), np.zeros(CLASSES)
        for cls, to, c in sums:
            (words if to == -1 else size)[cls] += c
        self.tokens = int(size.sum()) + texts
        self.words = int(words.sum()) + (texts > 0)
        keep = [*range(CLASSES), END]
        t = counts[np.ix_(keep, keep)]
        mass = np.append(size, texts)
        share = mass / max(mass.sum(), 1)
        move = (t + PRIOR * share) / (t.sum(axis=1, keepdims=True) + PRIOR)
        #: Rows: class before, CLASSES for an end, CLASSES + 1 for an unknown word.
        self.move = np.vstack([move, share])
        self.size, self.kinds = size, words
        self.rest = np.append(DELTA / (size + DELTA * (words + 1)), 0.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + DELTA) / (self.tokens + DELTA * (self.words + 1))

    def score(self, c: np.ndarray, cls: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Probabilities of tokens with counts c and classes cls (CLASSES: an end, CLASSES + 1: unknown) after classes `before`."""
        uni = self.base(c)
        if not self.tokens:
            return uni
        known = cls <= CLASSES
        k = np.minimum(cls, CLASSES)
        emit = np.append((1.0 / (self.size + DELTA * (self.kinds + 1))), 0.0)[k] * (c + DELTA)
        emit[k == CLASSES] = 1.0
        p = np.where(known, self.move[before, k] * emit, (self.move @ self.rest)[before])
        return LAMBDA * p + (1 - LAMBDA) * uni


def score_chunks(docs: DataFrame, packed: DataFrame, model, texts: int, kind: str) -> DataFrame:
    def score(own: pa.Table, words: pa.Table) -> pa.Table:
        m: Model = model.value
        # a chunk of held-out texts without a word has no row
        own_counts, own_classes = (b"".join(words.column(c).to_pylist()) for c in ("counts", "classes"))
        count = np.append(np.frombuffer(own_counts, np.int64), texts)
        cls = np.append(np.frombuffer(own_classes, np.int32), CLASSES).astype(np.int64)
        cls[:-1][count[:-1] == 0] = CLASSES + 1
        ids, lengths = _ids(own)
        c, k = count[ids], cls[ids]
        before = np.concatenate([[CLASSES], k[:-1]])
        ends = np.cumsum(lengths)
        base, p = np.log10(m.base(c)), np.log10(m.score(c, k, before))
        by_text = lambda x: np.add.reduceat(x, ends - lengths) if len(ends) else x
        return pa.table(
            {
                "id": own.column("id"),
                "held_out": own.column("held_out"),
                "n_tokens": pa.array(lengths),
                "n_known": pa.array(by_text((c > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(lengths), m.tokens, np.int64)),
                "base_score": pa.array(by_text(base)),
                "score": pa.array(by_text(p)),
            }
        )

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("chunk").cogroup(packed.groupBy("chunk")).applyInArrow(score, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows whose crc32 of the id, as text, modulo 10 isn't 0 (not
    from a null id). Scores are log10 probabilities of whole texts with their
    ends, over the training vocabulary and one unknown word. A null text is
    empty: its end is its one token. Repeated rows are learnt from and scored
    one by one.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 10 == 0, F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), out.alias("held_out"))
    train = rows.where("NOT held_out").select("text")
    texts = train.count()
    top = core_words(train, core)
    bigrams = cut(core_bigrams(train, sc.broadcast(top), core))
    classes = exchange(bigrams, core, rounds)
    counts = class_matrix(bigrams, classes)
    own = sc.broadcast((top, classes[: len(top)]))
    # transitions that a word's one move is judged by; the class's own size counts against it
    t = counts + 0.1
    log_t = np.log(t / t.sum(axis=1, keepdims=True)) - 0.5 * np.log(t.sum(axis=0) / t.sum())[None, :]
    log_t[TAIL, :] = log_t[:, TAIL] = 0.0
    chunked, _ = _chunks(rows, chunk_bytes)
    chunked = encode_chunks(chunked, own, kind).withColumn("kind", F.when(F.col("at").isNull(), "text").otherwise("word"))
    path = new_dir(docs.sparkSession, "chunks")
    write(chunked, path, "kind", codec="zstd")
    words = stored(docs.sparkSession, path, f"{WORD_ROWS}, kind string").where("kind = 'word'").drop("kind")
    encoded = stored(docs.sparkSession, path, f"chunk int, id {kind}, held_out boolean, ids binary, kind string").where("kind = 'text'").drop("kind")
    log_t = sc.broadcast(log_t)
    reply = store(assign(words, own, log_t), "words", "zstd")
    delete(docs.sparkSession, f"{path}/kind=word")
    for r in range(TAIL_ROUNDS):
        found = word_rows(encoded, reply.where("chunk >= 0").select("chunk", "at", "number", "cls"))
        answers = assign(found, own, log_t)
        reply, old = store(answers.drop("number") if r == TAIL_ROUNDS - 1 else answers, "words", "zstd"), reply
        release(old)
    sums = [(r[0], r[1], r[2]) for r in reply.where("chunk = -1").groupBy("cls", "to").agg(F.sum("c")).collect()]
    packed = store(pack_chunks(encoded, reply.where("chunk >= 0").select("chunk", "at", "c", "cls")), "packed", "zstd")
    release(reply)
    model = sc.broadcast(Model(pair_counts(packed), sums, texts))
    scored = score_chunks(encoded, packed.where("k IS NULL").select("chunk", "counts", "classes"), model, texts, kind)
    return scored.withColumnRenamed("id", id_col)
