"""Secrets in text: fixed patterns, and a character convolutional network that judges every candidate in its context.

The network is trained in numpy on labelled findings, its scores are calibrated on
findings kept apart, and each shape of candidate has the highest threshold that
still finds a given share of those. Documents are scored where they are read.
"""

from __future__ import annotations

import math
import re
import random
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, release, store

# The patterns of the base findings and their least lengths.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: A text that holds none of these in lower case has no finding of ASSIGN.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")

#: A candidate is a run of these characters of CANDIDATE or more that holds a digit, or of LONG or more.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
DIGIT = re.compile("[0-9]")
LONG = 20
LEFT, RIGHT = 24, 8

#: The classifier is fitted on the candidates of at most so many documents, and at most so many distinct ones of either label, those with the least hashes.
FIT_DOCUMENTS, FIT_FINDINGS = 2_000_000, 4_000
#: Of the true findings kept apart, the share that each threshold must find.
RECALL = 0.98
#: Shapes of candidates with fewer true findings kept apart share one threshold.
LEAST_OF_SHAPE = 40

PIECE, WIDTH, CODES, EMBEDDING, FILTERS, CONTEXT_FILTERS, HIDDEN = 64, 5, 129, 12, 48, 24, 24
EPOCHS, BATCH, RATE = 6, 128, 4e-3


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The fixed patterns' findings as (start, stop, place of the kind in KINDS), and the candidates, both in order."""
    runs = [m.span() for m in RUN.finditer(text) if m.end() - m.start() >= ACCESS_LEAST or DIGIT.search(text, *m.span())]
    base = []
    low = text.lower()
    if any(w in low for w in HINTS):
        base += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    for start, stop in runs:
        # findings of these two kinds lie in one run each; what is too short can't hold a longer one
        if stop - start >= ACCESS_LEAST:
            base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text, start, stop)]
        if stop - start >= HEX_LEAST:
            base += [(m.start(), m.end(), 2) for m in HEX.finditer(text, start, stop)]
    return sorted(base, key=lambda s: (s[0], s[2])), [s for s in runs if s[1] - s[0] >= LONG or DIGIT.search(text, *s)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return scan(text)[0]


def candidates(text: str) -> list[tuple[int, int]]:
    return scan(text)[1]


def unknown(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The fixed patterns' findings, and the candidates that share no character with them."""
    base, own = scan(text)
    return base, [s for s, met in zip(own, overlapping(own, base), strict=True) if not met]


def overlapping(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Which of the spans, given in order, share a character with one of `base`."""
    out, k, reach, ends = [], 0, -1, sorted((b[0], b[1]) for b in base)
    for start, stop in spans:
        while k < len(ends) and ends[k][0] < stop:
            reach = max(reach, ends[k][1])
            k += 1
        out.append(reach > start)
    return out


def in_context(text: str, start: int, stop: int) -> tuple[str, str, str]:
    return text[max(0, start - LEFT) : start], text[start:stop], text[stop : stop + RIGHT]


def shape(value: str) -> str:
    if not DIGIT.search(value):
        return "letters"
    if re.fullmatch(r"[0-9+/_.=-]+", value):
        return "digits"
    return "hex" if re.fullmatch(r"[0-9A-Fa-f]+", value) else "mixed"


# Words before secrets that the patterns don't know, what stands between, and ordinary tokens that look like secrets.
KEYWORDS = "secret token password passwd pwd apikey api-key auth authorization bearer access_key private_key client_secret credential credentials session cookie signature webhook passphrase key login".split()
BETWEEN = ["=", ": ", " = ", '": "', " is ", " => ", " ", ": '", '="', " -> "]
PREFIXES = ["", "", "", "", "ghp_", "sk-", "xoxb-", "key-", "eyJ", "glpat-", "AIza"]
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]
ALPHABETS += [ALPHABETS[2][:26] + ALPHABETS[3], ALPHABETS[2][:26] + ALPHABETS[3] + "+/", ALPHABETS[2][:26] + ALPHABETS[3] + "-_"]


def made_secret(rng: random.Random, surroundings: list[tuple[str, str, str]]) -> tuple[str, str, str]:
    """A finding like the labelled ones with other characters, and another word before it or, if it is long, none."""
    n = rng.choice([12, 16, 20, 24, 32, 36, 40, 48, 64])
    value = (rng.choice(PREFIXES) + "".join(rng.choices(rng.choice(ALPHABETS), k=n)))[:PIECE]
    left, _, right = rng.choice(surroundings)
    if n < 32 or rng.random() < 0.6:
        word = rng.choice(KEYWORDS)
        word = rng.choice([word, word, word.upper(), word.capitalize()])
        between = rng.choice(BETWEEN)
        left = (left + " " + word + between)[-LEFT:]
        if between[-1] in "'\"":
            right = (between[-1] + right)[:RIGHT]
    return left, value if DIGIT.search(value) else value[:-1] + "7", right


def made_ordinary(rng: random.Random, surroundings: list[tuple[str, str, str]]) -> tuple[str, str, str]:
    """A date, number, address, version, file name or long word, in some cases after a word such as token."""
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    syllables = ["ter", "in", "on", "sta", "re", "con", "ment", "ver", "li", "ga", "pro", "tion", "al", "de", "is", "the", "ka", "mo"]
    w = lambda k: "".join(rng.choices(syllables, k=k))
    make = [
        lambda: f"20{d(2)}-0{rng.randint(1, 9)}-{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}", lambda: ".".join(d(rng.randint(1, 3)) for _ in range(4)), lambda: f"{d(4)}.{d(5)}", lambda: d(rng.randint(8, 19)), lambda: f"{d(3)}-{d(3)}-{d(4)}",
        lambda: f"{w(2)}{d(1)}.{w(2)}.com", lambda: f"{w(2)}.{d(2)}.{w(3)}.org", lambda: f"www.{w(3)}{d(2)}.net/{w(2)}", lambda: f"{w(2)}/{w(3)}/{w(2)}_{d(2)}", lambda: f"IMG_{d(8)}.jpg", lambda: f"{w(2)}_{d(3)}.tar.gz", lambda: f"v{d(1)}.{d(2)}.{d(1)}-rc{d(1)}", lambda: f"{w(3)}-{d(4)}", lambda: f"{w(2)}_{w(2)}_{d(1)}",
        lambda: w(8), lambda: w(10).upper(), lambda: f"{w(3)}-{w(3)}-{w(2)}-{w(2)}", lambda: f"chapter{d(1)}-section{d(2)}", lambda: f"{d(2)}:{d(2)}"[:2] + f"000.000.00{d(1)}", lambda: "x" * rng.randint(20, 60), lambda: "=" * rng.randint(20, 60), lambda: "-" * rng.randint(20, 60), lambda: d(1) * rng.randint(8, 30),
    ]
    left, _, right = rng.choice(surroundings)
    if rng.random() < 0.25:
        left = (left + " " + rng.choice(KEYWORDS) + rng.choice(BETWEEN[:2] + [" ", " of ", " in "]))[-LEFT:]
    return left, rng.choice(make)()[:PIECE], right


def codes(texts: Iterable[str], width: int, right: bool = False) -> np.ndarray:
    """Character codes of `width` columns, 0 where a text is short: on its left, or with `right` on its right."""
    joined = "".join(t.ljust(width, "\0") if right else t.rjust(width, "\0") for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(c, CODES - 1).astype(np.int64).reshape(-1, width)


class Network:
    """Embedded characters; one convolution over the value, pooled by maximum and mean over all its pieces, one over the context's two sides; a hidden layer."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = lambda *s, fan: (rng.standard_normal(s) * math.sqrt(2 / fan)).astype(np.float32)
        features = 2 * FILTERS + 2 * CONTEXT_FILTERS + 1
        self.p = {
            "e": n(CODES, EMBEDDING, fan=EMBEDDING), "v": n(WIDTH * EMBEDDING, FILTERS, fan=WIDTH * EMBEDDING), "vb": np.zeros(FILTERS, np.float32), "c": n(WIDTH * EMBEDDING, CONTEXT_FILTERS, fan=WIDTH * EMBEDDING), "cb": np.zeros(CONTEXT_FILTERS, np.float32),
            "h": n(features, HIDDEN, fan=features), "hb": np.zeros(HIDDEN, np.float32), "o": n(HIDDEN, fan=HIDDEN), "ob": np.zeros(1, np.float32),
        }
        self.slope, self.offset, self.thresholds = 1.0, 0.0, {}

    @staticmethod
    def encode(found: list[tuple[str, str, str]]) -> tuple:
        """Pieces of the values with WIDTH - 1 characters in common, the candidate of each piece, valid places, lengths, contexts."""
        half = WIDTH // 2
        owner, parts, valid = [], [], []
        for k, (_, value, _) in enumerate(found):
            padded = "\0" * half + value + "\0" * half
            for at in range(0, len(value), PIECE):
                owner.append(k)
                parts.append(padded[at : at + PIECE + WIDTH - 1])
                valid.append(min(PIECE, len(value) - at))
        length = np.array([len(f[1]) for f in found], np.float32)
        return codes(parts, PIECE + WIDTH - 1, True), np.array(owner), np.arange(PIECE)[None, :] < np.array(valid)[:, None], length, codes((f[0] for f in found), LEFT), codes((f[2] for f in found), RIGHT, True)

    def _convolve(self, c: np.ndarray, w: str) -> tuple[np.ndarray, np.ndarray]:
        places = c.shape[1] - WIDTH + 1
        x = self.p["e"][c]
        windows = np.concatenate([x[:, k : k + places] for k in range(WIDTH)], axis=2)
        return windows, np.maximum(windows @ self.p[w] + self.p[w + "b"], 0)

    def forward(self, encoded: tuple) -> tuple[np.ndarray, dict]:
        pieces, owner, valid, length, left, right = encoded
        k = {}
        k["wv"], a = self._convolve(pieces, "v")
        k["a"] = a = a * valid[:, :, None]
        k["wl"], k["l"] = self._convolve(left, "c")
        k["wr"], k["r"] = self._convolve(right, "c")
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        most, mean = np.maximum.reduceat(a.max(axis=1), first), np.add.reduceat(a.sum(axis=1), first) / length[:, None]
        k["f"] = np.concatenate([most, mean, k["l"].max(axis=1), k["r"].max(axis=1), np.log(length)[:, None] / 4], axis=1).astype(np.float32)
        k["z"] = np.maximum(k["f"] @ self.p["h"] + self.p["hb"], 0)
        return k["z"] @ self.p["o"] + self.p["ob"][0], k

    def gradient(self, encoded: tuple, y: np.ndarray) -> dict:
        """Of the mean log loss; every value in one piece."""
        pieces, _, valid, length, left, right = encoded
        out, k = self.forward(encoded)
        g, p, n = {}, self.p, len(y)
        d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / n).astype(np.float32)
        g["o"], g["ob"] = k["z"].T @ d, np.array([d.sum()], np.float32)
        dz = np.outer(d, p["o"]) * (k["z"] > 0)
        g["h"], g["hb"] = k["f"].T @ dz, dz.sum(axis=0)
        df = dz @ p["h"].T
        g["e"] = np.zeros_like(p["e"])
        g["c"], g["cb"] = np.zeros_like(p["c"]), np.zeros_like(p["cb"])

        def back(windows, act, c, dact, w):
            dact = dact * (act > 0)
            flat = dact.reshape(-1, dact.shape[2])
            g[w] = g.get(w, 0) + windows.reshape(len(flat), -1).T @ flat
            g[w + "b"] = g.get(w + "b", 0) + flat.sum(axis=0)
            dwin = (flat @ p[w].T).reshape(windows.shape)
            places = windows.shape[1]
            for j in range(WIDTH):
                part, at = dwin[:, :, j * EMBEDDING : (j + 1) * EMBEDDING].reshape(-1, EMBEDDING), c[:, j : j + places].ravel()
                for m in range(EMBEDDING):
                    g["e"][:, m] += np.bincount(at, part[:, m], CODES)

        def at_most(act, dmost):
            out = np.zeros_like(act)
            np.put_along_axis(out, act.argmax(axis=1)[:, None, :], dmost[:, None, :], axis=1)
            return out

        a, f, c = k["a"], FILTERS, CONTEXT_FILTERS
        da = at_most(a, df[:, :f]) + (df[:, f : 2 * f] / length[:, None])[:, None, :] * valid[:, :, None]
        back(k["wv"], a, pieces, da, "v")
        back(k["wl"], k["l"], left, at_most(k["l"], df[:, 2 * f : 2 * f + c]), "c")
        back(k["wr"], k["r"], right, at_most(k["r"], df[:, 2 * f + c : 2 * f + 2 * c]), "c")
        return g

    def fit(self, found: list[tuple[str, str, str]], y: np.ndarray, seed: int = 0) -> None:
        rng, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(found))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                g, t = self.gradient(self.encode([found[i] for i in own]), y[own]), t + 1
                for k in self.p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def outputs(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        """In batches of bounded size: long values fill many pieces."""
        out, at = [], 0
        while at < len(found):
            stop, size = at, 0
            while stop < len(found) and (stop == at or size + len(found[stop][1]) <= 64 * PIECE):
                size += max(PIECE, len(found[stop][1]))
                stop += 1
            out.append(self._long(found[at]) if size > 1024 * PIECE else self.forward(self.encode(found[at:stop]))[0])
            at = stop
        return np.concatenate(out) if out else np.empty(0)

    def _long(self, one: tuple[str, str, str]) -> np.ndarray:
        """The output of a candidate of any length: its pieces are pooled a few hundred at a time."""
        left, value, right = one
        most, total, half, step = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), WIDTH // 2, 512 * PIECE
        padded = "\0" * half + value + "\0" * half
        for at in range(0, len(value), step):
            part = codes([padded[at : at + step + WIDTH - 1]], min(step, len(value) - at) + WIDTH - 1, True)
            _, a = self._convolve(part, "v")
            most, total = np.maximum(most, a[0].max(axis=0)), total + a[0].sum(axis=0)
        _, k = self.forward(self.encode([(left, "0", right)]))
        f = k["f"].copy()
        f[0, : 2 * FILTERS], f[0, -1] = np.concatenate([most, total / len(value)]), math.log(len(value)) / 4
        z = np.maximum(f @ self.p["h"] + self.p["hb"], 0)
        return z @ self.p["o"] + self.p["ob"][0]

    def calibrate(self, found: list[tuple[str, str, str]], y: np.ndarray, recall: float) -> None:
        """A logistic curve through the outputs' labels, and for each shape the highest threshold that finds `recall` of its true findings."""
        x = self.outputs(found).astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w, r = q * (1 - q) + 1e-9, q - y
            hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            move = np.linalg.solve(hess, [(r * x).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        self.slope, self.offset = float(a), float(b)
        q, shapes = self.probability(x), np.array([shape(f[1]) for f in found])
        least = lambda own: float(np.sort(own)[int((1 - recall) * len(own))])
        true = y == 1
        self.thresholds = {"": least(q[true])} | {s: least(q[true & (shapes == s)]) for s in map(str, sorted(set(shapes))) if (true & (shapes == s)).sum() >= LEAST_OF_SHAPE}

    def probability(self, outputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * outputs + self.offset, -30, 30)))

    def verdicts(self, found: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each candidate, and whether it reaches its shape's threshold."""
        q = self.probability(self.outputs(found))
        return q, q >= np.array([self.thresholds.get(shape(f[1]), self.thresholds[""]) for f in found]) if len(found) else np.zeros(0, bool)


def train(true: list[tuple[str, str, str]], false: list[tuple[str, str, str]], recall: float = RECALL, made: int = 4_000, seed: int = 0) -> Network | None:
    """A network from labelled findings (left, value, right), and `made` examples of either label in surroundings of theirs; None without any true finding.

    A third of all, by place, is kept apart for the calibration. Values of more
    than PIECE characters are judged whole, but not learnt from.
    """
    if not true:
        return None
    rng = random.Random(seed)
    around = (true + false)[:]
    true = [f for f in true if len(f[1]) <= PIECE] + [made_secret(rng, around) for _ in range(made)]
    false = [f for f in false if len(f[1]) <= PIECE] + [made_ordinary(rng, around) for _ in range(made)]
    found, y = true + false, np.array([1.0] * len(true) + [0.0] * len(false), np.float32)
    apart = np.arange(len(found)) % 3 == 2
    net = Network(seed)
    pick = lambda keep: [f for f, k in zip(found, keep, strict=True) if k]
    net.fit(pick(~apart), y[~apart], seed)
    net.calibrate(pick(apart), y[apart], recall)
    return net


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(label, h, left, value, right): the candidates of at most about `documents` documents, label 1 for those that the fixed patterns find; h is their hash."""

    def find(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                known, spans = scan(t or "")
                for (start, stop), base in zip(spans, overlapping(spans, known), strict=True):
                    left, value, right = in_context(t, start, stop)
                    rows.append((int(base), left, value[: PIECE + 1], right))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=["label", "left", "value", "right"])

    n = docs.count()
    if n > documents:
        docs = docs.where(F.pmod(F.xxhash64(id_col), F.lit(n)) < documents)
    found = docs.select(text_col).mapInArrow(find, "label int, left string, value string, right string")
    return found.withColumn("h", F.xxhash64("left", "value", "right"))


def fit_network(docs: DataFrame, findings: DataFrame | None = None, most: int = FIT_FINDINGS, recall: float = RECALL, **columns: str) -> Network | None:
    """The network for `docs`, from findings (label, left, value, right) given or those of the fixed patterns: at most `most` distinct ones of either label, with the least hashes."""
    rows = labelled_findings(docs, **columns) if findings is None else findings.withColumn("h", F.xxhash64("left", "value", "right"))
    # both labels are taken from one scan of the texts
    rows = store(rows.where("value <> ''").select("label", "h", "left", "value", "right").distinct(), "findings")
    of = lambda label: [(r[1] or "", r[2], r[3] or "") for r in rows.where(F.col("label") == label).orderBy("h", "left", "value", "right").limit(most).select("h", "left", "value", "right").collect()]
    true, false = of(1), of(0)
    release(rows)
    return train(true, false, recall)


def find_secrets(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: spans of (kind, start, stop, score), by start and kind, in code points; stop is exclusive.

    Spans of the fixed patterns stay whatever the network says (score null); the
    network judges every candidate that shares no character with them and adds
    those that reach the threshold. A null or empty text has no spans; without a
    network only the fixed patterns count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def judge(batches):
        net = shared.value
        for batch in batches:
            spans, asked, where = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                base, new = unknown(t or "")
                spans.append([(s, KINDS[j], e, None) for s, e, j in base])
                if net is not None:
                    asked += [in_context(t, *s) for s in new]
                    where += [(k, *s) for s in new]
            if asked:
                q, good = net.verdicts(asked)
                for i in np.flatnonzero(good):
                    k, start, stop = where[i]
                    spans[k].append((start, KINDS[3], stop, float(q[i])))
            out = [[{"kind": j, "start": s, "stop": e, "score": q} for s, j, e, q in sorted(own, key=lambda x: (x[0], KINDS.index(x[1])))] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], names=["id", "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, f"id {kind}, spans array<struct<kind:string,start:int,stop:int,score:double>>")


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): the findings of every row, with a network fitted on these documents or on `findings`.

    Null and empty texts have none; rows that repeat are judged alike, one row each;
    candidates of any length are judged whole. An empty table gives no row.
    """
    found = find_secrets(docs, fit_network(docs, findings, recall=recall, id_col=id_col, text_col=text_col), id_col, text_col)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(F.col("id").alias(id_col), count("assign"), count("access"), count("hex"), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), count("model"))


def mask_secrets(docs: DataFrame, network: Network | None, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of find_secrets replaced by `mask`; spans that overlap are one. All columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    masked = free_name(docs, "_masked")
    place = docs.columns.index(text_col)

    def cover(batches):
        net = shared.value
        for batch in batches:
            out = []
            for t in batch.column(place).to_pylist():
                if not t:
                    out.append(t)
                    continue
                base, new = unknown(t)
                good = net.verdicts([in_context(t, *s) for s in new])[1] if net is not None else [False] * len(new)
                spans = sorted([(s, e) for s, e, _ in base] + [s for s, g in zip(new, good, strict=True) if g])
                parts, at = [], 0
                for s, e in spans:
                    if s >= at:
                        parts += [t[at:s], mask]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]))
            yield batch.append_column(masked, pa.array(out, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(cover, f"{schema}, `{masked}` string").withColumn(text_col, F.col(masked)).drop(masked)
