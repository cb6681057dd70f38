"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
likelihood of a word is the sum over all its segmentations into pieces, by the
forward algorithm; a text is the product over its words, so that the forward sum
over the whole text splits at white space, where pieces of this vocabulary begin.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, release, store

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
#: Added to each piece's count in each language.
SMOOTHING = 0.05
#: More languages than this would make the model too large to send to every task: MAX_LANGUAGES * 32,000 * 8 bytes.
MAX_LANGUAGES = 256
#: Words whose counts or likelihoods a Python worker holds before it makes room; with more than FEW_LANGUAGES, as many less likelihoods.
WORDS_HELD = 100_000
#: Texts whose words are looked up together, and their bytes if there are several; fewer bytes with more than FEW_LANGUAGES.
ROWS_TOGETHER, BYTES_TOGETHER = 1000, 4 << 20
#: Words that the vocabulary segments together.
WORDS_TOGETHER = 10_000
#: Up to so many, the sums over languages are small beside the words.
FEW_LANGUAGES = 8
#: Words up to this length are summed side by side.
TOGETHER = 40
#: Letters of any script: Unicode categories L*, and no digits, fractions or numerals.
LETTER = regex.compile(r"\p{L}")
MARK = "▁"
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
POWERS = np.array([pow(int(BASE), n, 1 << 64) for n in range(256)], np.uint64)


def split_words(text: str) -> list[str]:
    """Words between white space, in lower case: a language has the same pieces in headlines."""
    return text.lower().split()


@lru_cache(maxsize=2)
def pieces(path: str):
    """The processor of the fixed vocabulary and, by piece, its id; loaded once in each worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    return sp, table, bytes_, max(map(len, table)), Lookup(table)


def share(size: int, languages: int) -> int:
    """What is left of a size if it shrinks with the number of languages above FEW_LANGUAGES."""
    return max(1, size * FEW_LANGUAGES // max(FEW_LANGUAGES, languages))


def stretches(batch: pa.RecordBatch, text_at: int, most: int = BYTES_TOGETHER):
    """The rows of a batch in runs of ROWS_TOGETHER or fewer, whose texts have `most` bytes or less unless a run is one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(), dtype=np.int64)
    lo = before = 0
    while lo < batch.num_rows:
        hi = min(lo + ROWS_TOGETHER, max(lo + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(lo, hi - lo)
        lo, before = hi, int(ends[hi - 1])


def piece_counts(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): how often the vocabulary's own segmentation of the words uses each piece. Partial sums leave each task."""

    def count(batches):
        sp = pieces(path)[0]
        total: dict[str, np.ndarray] = {}
        found: dict[str, Counter] = {}

        def segment():
            for lang, words in found.items():
                left = iter(words.items())
                while part := list(islice(left, WORDS_TOGETHER)):
                    ids = sp.encode([w for w, _ in part], num_threads=1)
                    weight = np.repeat(np.array([k for _, k in part], np.float64), np.fromiter(map(len, ids), np.int64, len(ids)))
                    n = np.bincount(np.fromiter(chain.from_iterable(ids), np.int64, len(weight)), weight, sp.get_piece_size())
                    total[lang] = total[lang] + n if lang in total else n
                if len(total) > MAX_LANGUAGES:
                    yield from sums()
            found.clear()

        def sums():
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], names=["lang", "piece", "n"])
            total.clear()

        for whole in batches:
            for batch in stretches(whole, 1):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found.setdefault(lang, Counter()).update(split_words(text))
                if sum(map(len, found.values())) > WORDS_HELD or len(found) > MAX_LANGUAGES:
                    yield from segment()
        yield from segment()
        yield from sums()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and log probabilities (piece, language). The size is bounded by the vocabulary and MAX_LANGUAGES, which is checked before anything comes to the driver."""
    counts = store(piece_counts(docs, path, text_col, lang_col), "pieces")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = counts.toPandas()
    release(counts)
    size = pieces(path)[0].get_piece_size()
    n = np.zeros((size, len(langs)))
    n[found["piece"], [langs.index(x) for x in found["lang"]]] = found["n"]
    n += SMOOTHING
    return langs, np.log(n / n.sum(axis=0))


def word_likelihood(word: str, prob: np.ndarray, table: dict[str, int], bytes_: dict[int, int], most: int) -> np.ndarray:
    """log of the summed probability of all segmentations of a word, for each language.

    A character that no piece covers is read as its UTF-8 bytes. The sums are
    rescaled as they go, so that a word of any length neither underflows nor
    needs more than `most` sums at a time.
    """
    text = MARK + word
    langs = prob.shape[1]
    ring = [None] * (most + 1)
    ring[0] = np.ones(langs)
    scale = np.zeros(langs)
    for end in range(1, len(text) + 1):
        total = np.zeros(langs)
        for n in range(1, min(most, end) + 1):
            i = table.get(text[end - n : end])
            if i is not None:
                total += ring[(end - n) % (most + 1)] * prob[i]
        if text[end - 1] not in table:
            p = ring[(end - 1) % (most + 1)].copy()
            for b in text[end - 1].encode("utf-8", "surrogatepass"):
                p = p * prob[bytes_[b]]
            total += p
        ring[end % (most + 1)] = total
        if total.max() < 1e-100 or total.min() < 1e-200:
            with np.errstate(divide="ignore"):
                s = np.where(total > 0, total, 1.0)
            scale += np.log(s)
            ring = [None if r is None else r / s for r in ring]
    return scale + np.log(ring[len(text) % (most + 1)])


def _prefix_hashes(texts: list[str]) -> np.ndarray:
    """Running 64-bit hashes (texts, length + 1) of texts of one length."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1).astype(np.uint64)
    out = np.zeros((len(texts), codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i] + np.uint64(1)
    return out


class Lookup:
    """Finds pieces by the hashes of stretches of many words at once: a bitmap passes few others on to a search."""

    def __init__(self, table: dict[str, int]):
        by_length: dict[int, list[str]] = {}
        for t in table:
            by_length.setdefault(len(t), []).append(t)
        found = [(_prefix_hashes(ts)[:, -1], [table[t] for t in ts]) for ts in by_length.values()]
        keys, ids = np.concatenate([k for k, _ in found]), np.concatenate([np.array(i) for _, i in found])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.some = np.zeros(1 << 22, bool)
        self.some[self._at(keys)] = True
        self.lengths = set(by_length)

    @staticmethod
    def _at(h: np.ndarray) -> np.ndarray:
        return ((h * MIX) >> np.uint64(42)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their ids."""
        maybe = np.flatnonzero(self.some[self._at(h)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == h[maybe]
        return maybe[ok], self.ids[at[ok]]


def likelihoods(words: list[str], prob: np.ndarray, table: dict[str, int], bytes_: dict[int, int], most: int, lookup: Lookup | None = None) -> np.ndarray:
    """word_likelihood of many words; those of one length are summed together."""
    lookup = lookup or Lookup(table)
    out = np.empty((len(words), prob.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, at in by_length.items():
        if length > TOGETHER:
            for k in at:
                out[k] = word_likelihood(words[k], prob, table, bytes_, most)
            continue
        step = share(4096, prob.shape[1])
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            texts = [MARK + words[k] for k in part]
            h = _prefix_hashes(texts)
            sums = np.zeros((length + 2, len(part), prob.shape[1]))
            sums[0] = 1
            scale = np.zeros(sums.shape[1:])
            for end in range(1, length + 2):
                total = sums[end]
                for n in range(1, min(most, end) + 1):
                    if n not in lookup.lengths:
                        continue
                    rows, ids = lookup.find(h[:, end] - h[:, end - n] * POWERS[n])
                    if n == 1 and len(rows) < len(part):
                        for j in np.setdiff1d(np.arange(len(part)), rows):
                            p = sums[end - 1][j]
                            for byte in texts[j][end - 1].encode("utf-8", "surrogatepass"):
                                p = p * prob[bytes_[byte]]
                            total[j] += p
                    total[rows] += sums[end - n][rows] * prob[ids]
                low = np.flatnonzero(total.min(axis=1) < 1e-100)
                if len(low):  # the sums that later ones are made of, as in word_likelihood
                    s = total[low]
                    scale[low] += np.log(s)
                    sums[max(0, end - most + 1) : end + 1, low] /= s
            out[part] = scale + np.log(sums[-1])
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str = VOCABULARY, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the most likely language and its posterior probability (0 to 1) to every row; input columns of these names give way.

    A text that is null, empty or without a letter is `und` with score 0. Whole
    texts are scored. Equal likelihoods go to the language first in the alphabet.
    """
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.exp(logp)))
    keep = [c for c in docs.columns if c not in out]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema)
    schema = f"{fields}{', ' if fields else ''}{out[0]} string, {out[1]} double"

    def score(batches):
        names, prob = shared.value
        _, table, bytes_, most, lookup = pieces(path)
        seen: dict[str, int] = {}
        held, uses = np.zeros((0, len(names))), np.zeros(0, np.int64)
        for whole in batches:
            text_at = whole.schema.get_field_index(text_col)
            for batch in stretches(whole, text_at, share(BYTES_TOGETHER, len(names))):
                if len(seen) > share(WORDS_HELD, len(names)):  # what was found once makes way, or everything if that is little
                    again = uses > 1
                    if 2 * again.sum() > len(again):
                        again[:] = False
                    seen = {w: k for k, w in enumerate(compress(seen, again.tolist()))}
                    held, uses = held[again], np.zeros(len(seen), np.int64)
                known, ids = len(seen), []
                for t in batch.column(text_at).to_pylist():
                    words = split_words(t) if names and t is not None and LETTER.search(t) else None
                    ids.append(words and np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
                if len(seen) > known:
                    held = np.vstack([held, likelihoods(list(islice(seen, known, None)), prob, table, bytes_, most, lookup)])
                    uses = np.concatenate([uses, np.zeros(len(seen) - known, np.int64)])
                if there := [at for at in ids if at is not None]:
                    uses += np.bincount(np.concatenate(there), minlength=len(uses))
                labels, scores = [], []
                for at in ids:
                    if at is None:
                        labels.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = held[at].sum(axis=0)
                    best = int(np.argmax(total))
                    labels.append(names[best])
                    scores.append(float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *out])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(score, schema)


def held_out(id_col: str, folds: int, rest: int):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == rest


def identify(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows with a lang that aren't held out (crc32 of the id modulo 3 is 1), predicts all."""
    out = F.coalesce(held_out(id_col, 3, 1), F.lit(False))
    model = train(docs.where(~out), path)
    rows = docs.select(id_col, out.alias("held_out"), "text")
    return predict(rows, model, path).select(id_col, "held_out", "lang_pred", "score")


def filter_languages(docs: DataFrame, path: str = VOCABULARY, least_score: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The rows whose language can be told: not `und`, and with a posterior of at least `least_score`. All input columns stay as they are."""
    model = train(docs.where(~F.coalesce(held_out(id_col, 3, 1), F.lit(False))), path)
    lang, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    judged = predict(docs, model, path, out=(lang, score))
    return judged.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least_score)).select(docs.columns)
