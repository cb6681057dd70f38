"""Projective transforms: least squares from sums, RANSAC over four-point samples, and ICP steps with shear, rotation and perspective.

A transform is nine numbers, a 3 x 3 matrix by rows with 1 in the last place. Fits
add up products in one aggregate; each group's small system is solved where its row is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .cells import build_cells
from .fits import fit_affine, fit_scale, fit_similarity
from .lineage import cut
from .spatial import nearest_join

#: Rows that a group's samples are drawn from, about, and rows that are tested against them together.
POOL, CHUNK = 4096, 16_384
TERMS = 9


def apply_matrix(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    w = F.nullif(m[6] * x + m[7] * y + m[8], F.lit(0.0))
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def _frame(cx, cy, s) -> np.ndarray:
    """Centred on (cx, cy) and divided by s."""
    return np.array([[1 / s, 0, -cx / s], [0, 1 / s, -cy / s], [0, 0, 1]])


def _unframed(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[float] | None:
    """The transform between the plain coordinates of one between framed ones."""
    m = np.linalg.inv(b) @ h @ a
    return None if not np.isfinite(m).all() or abs(m[2, 2]) < 1e-300 else (m / m[2, 2]).ravel().tolist()


def fit_homography(matches: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, n, m): the projective transform of each group's matches (x, y, tx, ty) by linear least squares; m is null for fewer than four, or if the points don't fix it.

    Coordinates are centred and scaled by the group's means and deviations first.
    The sums of products of (x, y, 1, tx x, tx y, tx, ty x, ty y, ty) are all that
    leaves the tasks; weights count as often as they say.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = matches.where("x IS NOT NULL AND y IS NOT NULL AND tx IS NOT NULL AND ty IS NOT NULL")
    mean = [F.avg(c).alias(f"_m{c}") for c in ("x", "y", "tx", "ty")] + [F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("_s"), F.sqrt(F.var_pop("tx") + F.var_pop("ty")).alias("_st")]
    frame = rows.groupBy(*keys).agg(*mean)
    both = rows.join(frame, keys) if keys else rows.crossJoin(F.broadcast(frame))
    scaled = lambda c, s: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(s) > 0, F.col(s)).otherwise(1.0)
    x, y, u, v = scaled("x", "_s"), scaled("y", "_s"), scaled("tx", "_st"), scaled("ty", "_st")
    own = both.withColumns({"_x": x, "_y": y, "_u": u, "_v": v, "_w": w})
    x, y, u, v, one = F.col("_x"), F.col("_y"), F.col("_u"), F.col("_v"), F.lit(1.0)
    # u (g x + h y + 1) = a x + b y + c, and so for v: the products that their normal equations need
    base = [x, y, one]
    products = [p * q * t for i, p in enumerate(base) for q in base[i:] for t in (one, u, v, u * u + v * v)]
    sums = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("_w") * p) for p in products]).alias("_sums"), *[F.first(c).alias(c) for c in ("_mx", "_my", "_mtx", "_mty", "_s", "_st")])

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(n: pd.Series, sums: pd.Series, mx: pd.Series, my: pd.Series, mtx: pd.Series, mty: pd.Series, s: pd.Series, st: pd.Series) -> pd.Series:
        out = []
        for k, q, *f in zip(n, sums, mx, my, mtx, mty, s, st, strict=True):
            out.append(None if k < 4 or not f[4] > 0 or not f[5] > 0 else _solved(np.array(q).reshape(6, 4), f))
        return pd.Series(out)

    return sums.select(*keys, "n", solve("n", "_sums", "_mx", "_my", "_mtx", "_mty", "_s", "_st").alias("m"))


def _solved(q: np.ndarray, f: list[float]) -> list[float] | None:
    """The normal equations of the eight unknowns from the sums of products."""
    sym = {}
    at = 0
    for i in range(3):
        for j in range(i, 3):
            sym[i, j] = sym[j, i] = q[at]
            at += 1
    a, b = np.zeros((8, 8)), np.zeros(8)
    for i in range(3):
        for j in range(3):
            a[i, j] = a[3 + i, 3 + j] = sym[i, j][0]
            if j < 2:
                a[i, 6 + j] = a[6 + j, i] = -sym[i, j][1]
                a[3 + i, 6 + j] = a[6 + j, 3 + i] = -sym[i, j][2]
            if i < 2 and j < 2:
                a[6 + i, 6 + j] = sym[i, j][3]
        b[i], b[3 + i] = sym[i, 2][1], sym[i, 2][2]
        if i < 2:
            b[6 + i] = -sym[i, 2][3]
    if np.linalg.cond(a) > 1e13:
        return None
    h = np.r_[np.linalg.solve(a, b), 1.0].reshape(3, 3)
    return _unframed(h, _frame(f[0], f[1], f[4]), _frame(f[2], f[3], f[5]))


def four_points(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The transforms (k, 3, 3) that take four points p (k, 4, 2) to t exactly; NaN where three lie on a line."""
    x, y, u, v = p[..., 0], p[..., 1], t[..., 0], t[..., 1]
    o, i = np.zeros_like(x), np.ones_like(x)
    a = np.concatenate([np.stack([x, y, i, o, o, o, -u * x, -u * y], -1), np.stack([o, o, o, x, y, i, -v * x, -v * y], -1)], 1)
    b = np.concatenate([u, v], 1)
    out = np.full((len(p), 9), np.nan)
    good = np.abs(np.linalg.det(a)) > 1e-12
    if good.any():
        out[good] = np.hstack([np.linalg.solve(a[good], b[good][..., None])[..., 0], np.ones((good.sum(), 1))])
    return out.reshape(-1, 3, 3)


def hypotheses(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """`n` transforms (n, 9) through four rows (x, y, tx, ty) each, drawn from `rows` in their order; those of degenerate samples are NaN."""
    rng = np.random.default_rng(seed)
    pick = np.array([rng.choice(len(rows), 4, replace=False) for _ in range(n)])
    (cx, cy, ctx, cty), (s, st) = rows.mean(axis=0), (np.sqrt(rows[:, k : k + 2].var(axis=0).sum()) or 1.0 for k in (0, 2))
    a, b = _frame(cx, cy, s), _frame(ctx, cty, st)
    four = (rows[pick] - (cx, cy, ctx, cty)) / (s, s, st, st)
    m = np.linalg.inv(b) @ four_points(four[..., :2], four[..., 2:]) @ a
    with np.errstate(divide="ignore", invalid="ignore"):
        return (m / m[:, 2:, 2:]).reshape(-1, 9)


def agreeing(rows: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """How many rows each transform takes nearer to their targets than the threshold."""
    out, ones = np.zeros(len(m), np.int64), np.ones(len(rows))
    at = np.stack([rows[:, 0], rows[:, 1], ones])
    for k in range(0, len(m), 64):
        x, y, w = np.moveaxis(m[k : k + 64].reshape(-1, 3, 3) @ at, 1, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k : k + 64] = (np.hypot(x / w - rows[:, 2], y / w - rows[:, 3]) < threshold).sum(axis=1)
    return out


def ransac_homography(matches: DataFrame, keys: list[str], n: int = 1000, threshold: float = 5.0, seed: int = 0, pool: int = POOL) -> DataFrame:
    """(keys, hypothesis, inliers, rows, sample, m): for each group the four-point transform that most matches (id, x, y, tx, ty) agree with, and m, fitted anew on these.

    Samples are drawn from about `pool` of a group's matches, all of a smaller
    group's, in the order of a hash. A group's matches are tested in chunks against
    all hypotheses at once; a chunk sends one count for each hypothesis. The first
    hypothesis on ties. A group with fewer than four matches, or none that agrees with
    more than nothing, gives no row; m is null if the inliers don't fix it.
    """
    rows = matches.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "tx", "ty")]).dropna(subset=["x", "y", "tx", "ty"])
    h = F.xxhash64("id", "x", "y", "tx", "ty", F.lit(seed))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = cut(rows.join(counts, keys).where("_n >= 4").withColumn("_h", h))
    drawn = sized.where((F.col("_n") <= pool) | (F.pmod(F.col("_h"), F.lit(1 << 30)) < F.lit(float(pool) * (1 << 30)) / F.col("_n")))
    pools = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_h", "id", "x", "y", "tx", "ty"))).alias("_pool")).where("size(_pool) >= 4")

    @F.pandas_udf(ArrayType(DoubleType()))
    def make(pools: pd.Series) -> pd.Series:
        return pools.map(lambda p: hypotheses(np.array([(r["x"], r["y"], r["tx"], r["ty"]) for r in p]), n, seed).ravel())

    made = cut(pools.select(*keys, make("_pool").alias("_all")))
    chunks = F.ceil(F.col("_n") / CHUNK).cast("int")
    chunked = sized.withColumn("_c", F.pmod(F.col("_h"), chunks).cast("int"))
    sent = made.join(counts, keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_all", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_c")).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"_h": pa.array([], pa.int32()), "_n": pa.array([], pa.int64())} | {k: pa.array([], kinds[k]) for k in keys}).select([*keys, "_h", "_n"])
        own = np.stack([left.column(c).to_numpy() for c in ("x", "y", "tx", "ty")], 1)
        got = agreeing(own, np.array(right.column("_all")[0].as_py(), float).reshape(-1, TERMS), threshold)
        return pa.table([*[pa.array([left.column(k)[0].as_py()] * len(got), kinds[k]) for k in keys], pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], names=[*keys, "_h", "_n"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {k: to_arrow_type(rows.schema[k].dataType) for k in keys}
    fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    votes = chunked.groupBy(*keys, "_c").cogroup(sent.groupBy(*keys, "_c")).applyInArrow(test, f"{fields}_h int, _n long")
    best = votes.groupBy(*keys, "_h").agg(F.sum("_n").alias("_n")).where("_n > 0").groupBy(*keys).agg(F.min_by(F.struct("_h", "_n"), F.struct(-F.col("_n"), F.col("_h"))).alias("b"))
    best = cut(best.join(made, keys).join(counts.withColumnRenamed("_n", "rows"), keys).select(*keys, F.col("b._h").alias("hypothesis"), F.col("b._n").alias("inliers"), "rows", F.slice("_all", F.col("b._h") * TERMS + 1, TERMS).alias("sample")))
    x, y = apply_matrix(F.col("sample"), F.col("x"), F.col("y"))
    agreed = sized.join(best.select(*keys, "sample"), keys).where(F.hypot(x - F.col("tx"), y - F.col("ty")) < threshold)
    return best.join(fit_homography(agreed, keys).select(*keys, "m"), keys, "left")


IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def adjust(match: DataFrame, shear: bool = True, rotation: bool = True, perspective: bool = True, weight: Column | None = None, rotation_limit: float | None = None) -> tuple | None:
    """The least-squares transform of matches (x, y, tx, ty) that the switches allow, as nine numbers; None if the points don't fix it.

    With perspective a projective one, else with shear and rotation an affine one,
    with rotation alone a similarity (by `rotation_limit` degrees at most), with
    shear alone a scale for each axis, with neither one scale; all with a shift.
    """
    if perspective:
        f = fit_homography(match, [], weight).first()
        return None if f is None or f["m"] is None else tuple(f["m"])
    if shear and rotation:
        f = fit_affine(match, [], weight).first()
        return None if f is None or f["a"] is None else (f["a"], f["b"], f["c"], f["d"], f["e"], f["f"], 0.0, 0.0, 1.0)
    if rotation:
        f = fit_similarity(match, [], weight, rotation_limit=rotation_limit).first()
        return None if f is None or f["a"] is None else (f["a"], -f["b"], f["tx0"], f["b"], f["a"], f["ty0"], 0.0, 0.0, 1.0)
    if shear:
        w = F.lit(1.0) if weight is None else weight
        s = lambda c: F.sum(w * c)
        r = match.agg(s(F.lit(1.0)), *[f for p, t in (("x", "tx"), ("y", "ty")) for f in (s(F.col(p)), s(F.col(t)), s(F.col(p) * F.col(p)), s(F.col(p) * F.col(t)))]).first()
        n, axes = r[0], []
        for p, t, pp, pt in (r[1:5], r[5:9]):
            if not n or not pp * n - p * p > 0:
                return None
            k = (pt * n - p * t) / (pp * n - p * p)
            axes.append((k, (t - k * p) / n))
        return (axes[0][0], 0.0, axes[0][1], 0.0, axes[1][0], axes[1][1], 0.0, 0.0, 1.0)
    f = fit_scale(match, []).first()
    return None if f is None or f["a"] is None else (f["a"], 0.0, f["tx0"], 0.0, f["a"], f["ty0"], 0.0, 0.0, 1.0)


def matrix_icp(points: DataFrame, reference: DataFrame, rounds: int, converged: float = 1e-6, cell: float | None = None, **switches) -> DataFrame:
    """The log of an iterative closest point fit with steps of `adjust`: (round, rms, m), m from the first places to those of the round."""
    tree, total, log, before = build_cells(reference, cell), np.array(IDENTITY).reshape(3, 3), [], None
    now = points.select("id", "x", "y")
    for r in range(rounds):
        match = cut(nearest_join(now, tree).join(now, "id").select("id", "x", "y", F.col("r_x").alias("tx"), F.col("r_y").alias("ty"), "dist"))
        rms = match.agg(F.sqrt(F.avg(F.col("dist") * F.col("dist")))).first()[0]
        log.append((r, rms, (total / total[2, 2]).ravel().tolist()))
        if rms is None or (before is not None and abs(before - rms) < converged):
            break
        before, m = rms, adjust(match, **switches)
        if m is None:
            break
        x, y = apply_matrix(F.array(*map(F.lit, m)), F.col("x"), F.col("y"))
        now, total = match.select("id", x.alias("x"), y.alias("y")), np.array(m).reshape(3, 3) @ total
    return points.sparkSession.createDataFrame(log, "round int, rms double, m array<double>")
