"""Adaptive cells: points in a quadtree that is split by repeated counts, and nearest points by descending it.

The cells of a base level hold a few points on average; those that hold more than
`per_cell` are counted again in sixteen smaller ones each, until none is crowded.
Only crowded cells' points are read again, so that even points take one round and
a dense spot costs rounds of its own rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

PER_CELL = 16
CELL = ["x1", "x2", "y1", "y2", "n", "cx", "cy"]
#: A cell is never split into cells of less than the extent by 4 ** DEEPEST: its points differ in their last digits only.
DEEPEST = 24


@dataclass
class Cells:
    """A tree over right points (r_id, r_x, r_y): `levels[k]` has the cells of width size / 4^k that lie in crowded ones, with the bounds of their points; `leaves` the points with the level and cell of their leaf; `around` for each base cell those of the nine around it that have points."""

    x0: float = 0.0
    y0: float = 0.0
    size: float = 1.0
    width: float = 0.0
    levels: list[DataFrame] = field(default_factory=list)
    leaves: DataFrame | None = None
    around: DataFrame | None = None

    def at(self, x: Column, y: Column, level: int = 0) -> tuple[Column, Column]:
        """The cell of a point: a finer level's cells lie in one coarser cell each, since 4^level scales without rounding."""
        return F.floor((x - self.x0) / self.size * 4.0**level), F.floor((y - self.y0) / self.size * 4.0**level)


def crowded(per_cell: int) -> Column:
    """Cells to be split: one that holds a single place, however often, is not."""
    return (F.col("n") > per_cell) & ((F.col("x1") < F.col("x2")) | (F.col("y1") < F.col("y2")))


def build_cells(points: DataFrame, size: float | None = None, per_cell: int = PER_CELL, id_col: str = "id") -> Cells:
    """The tree of points (id, x, y); rows without both coordinates are left out.

    By default a base cell is as wide as two points need in the middle nine tenths
    of the points' extent, so that a few far points don't make it coarse.
    """
    r = points.select(F.col(id_col).alias("r_id"), F.col("x").cast("double").alias("r_x"), F.col("y").cast("double").alias("r_y")).where("r_x IS NOT NULL AND r_y IS NOT NULL AND NOT isnan(r_x) AND NOT isnan(r_y)")
    middle = lambda c: F.percentile_approx(c, [0.05, 0.95], 1000)
    x1, x2, y1, y2, n, mx, my = r.agg(F.min("r_x"), F.max("r_x"), F.min("r_y"), F.max("r_y"), F.count(F.lit(1)), middle("r_x"), middle("r_y")).first()
    if not n:
        return Cells()
    width, (w, h) = max(x2 - x1, y2 - y1), (mx[1] - mx[0], my[1] - my[0])
    size = float(size or max((2 * w * h / n) ** 0.5, 2 * max(w, h) / n) or width or 1.0)
    tree = Cells(x1, y1, max(size, width / 4.0**DEEPEST), width)
    bounds = [F.min("r_x").alias("x1"), F.max("r_x").alias("x2"), F.min("r_y").alias("y1"), F.max("r_y").alias("y2"), F.count(F.lit(1)).alias("n"), F.min("r_id").alias("first")]
    parts, level = [], 0
    while True:
        cx, cy = tree.at(F.col("r_x"), F.col("r_y"), level)
        here = r.select("r_id", "r_x", "r_y", cx.alias("cx"), cy.alias("cy"))
        cells = cut(here.groupBy("cx", "cy").agg(*bounds))
        tree.levels.append(cells)
        full = cells.where(crowded(per_cell)).select("cx", "cy")
        last = tree.size / 4.0 ** (level + 1) < width / 4.0**DEEPEST or full.isEmpty()
        one_place = (F.col("n") > per_cell) & (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
        kept = here if last else here.join(full, ["cx", "cy"], "left_anti")
        kept = kept.join(cells.where(one_place).select("cx", "cy"), ["cx", "cy"], "left_anti").select("cx", "cy", "r_id", "r_x", "r_y")
        same = cells.where(one_place).select("cx", "cy", F.col("first").alias("r_id"), F.col("x1").alias("r_x"), F.col("y1").alias("r_y"))
        parts.append(kept.unionByName(same).withColumn("level", F.lit(level)))
        if last:
            break
        r = cut(here.join(full, ["cx", "cy"], "left_semi").select("r_id", "r_x", "r_y"))
        level += 1
    tree.leaves = cut(reduce(DataFrame.unionByName, parts))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    met = tree.levels[0].select(F.struct(*CELL).alias("c"), F.explode(steps).alias("s")).groupBy((F.col("c.cx") + F.col("s.i")).alias("cx"), (F.col("c.cy") + F.col("s.j")).alias("cy"))
    tree.around = cut(met.agg(F.collect_list("c").alias("near")))
    return tree


def _least(c, x: Column, y: Column) -> Column:
    """No point of the cell `c` is nearer to (x, y)."""
    gap = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    return F.hypot(gap(x, c("x1"), c("x2")), gap(y, c("y1"), c("y2")))


def _most(c, x: Column, y: Column) -> Column:
    """One point of the cell `c` is no further from (x, y).

    The bounds touch a point on each side: the one on the nearer side of an axis is
    no further away on the other axis than the farther end.
    """
    ends = lambda v, lo, hi: (F.abs(v - lo), F.abs(v - hi))
    (a, b), (p, q) = ends(x, c("x1"), c("x2")), ends(y, c("y1"), c("y2"))
    return F.least(F.hypot(F.least(a, b), F.greatest(p, q)), F.hypot(F.greatest(a, b), F.least(p, q)))


#: What is compared with a bound that was reached by another way round.
SLACK = 1 + 1e-9


def _pruned(df: DataFrame) -> DataFrame:
    """Of each id's cells those that can hold its nearest point, with the `bound` of its distance."""
    bound = F.min(F.least(_most(F.col, F.col("x"), F.col("y")), "bound")).over(Window.partitionBy("id"))
    return df.withColumn("bound", bound).where(_least(F.col, F.col("x"), F.col("y")) <= F.col("bound") * SLACK)


def _descend(tree: Cells, far: DataFrame) -> DataFrame:
    """The base cells that can hold the nearest points of `far` (id, x, y), by coarser and coarser cells from the top down."""
    base, levels = tree.levels[0], 0
    while tree.size * 4**levels < tree.width:
        levels += 1
    up = lambda c, k: F.floor(F.col(c) / 4**k)
    extent = [F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2")]
    # the top level's cells are as wide as all points: there are four of them at most
    top = base.groupBy(up("cx", levels).alias("px"), up("cy", levels).alias("py")).agg(F.count(F.lit(1))).collect()
    asked = far.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(t[0]).alias("px"), F.lit(t[1]).alias("py")) for t in top]))).select("id", "x", "y", F.lit(float("inf")).alias("bound"), "_p.*")
    if not levels:
        return _pruned(asked.join(base.withColumns({"px": F.col("cx"), "py": F.col("cy")}), ["px", "py"]))
    for level in reversed(range(levels)):
        cells = base if level == 0 else base.groupBy(up("cx", level).alias("cx"), up("cy", level).alias("cy")).agg(*extent, F.sum("n").alias("n"))
        found = _pruned(asked.join(cells.withColumns({"px": up("cx", 1), "py": up("cy", 1)}), ["px", "py"]))
        if level:
            asked = found.select("id", "x", "y", "bound", F.col("cx").alias("px"), F.col("cy").alias("py"))
    return found


def candidates(left: DataFrame, tree: Cells, per_cell: int = PER_CELL) -> DataFrame:
    """(id, x, y, r_id, r_x, r_y): each left point (id, x, y) with the points of the leaves that can hold its nearest one.

    The cells around its own settle most points; those whose bound reaches beyond
    them come down from the top. Crowded cells are then followed into their leaves.
    """
    todo = left.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    cx, cy = tree.at(F.col("x"), F.col("y"))
    x, y = F.col("x"), F.col("y")
    own = todo.withColumns({"cx": cx, "cy": cy}).join(tree.around, ["cx", "cy"], "left").select("id", "x", "y", "near")
    own = own.withColumn("bound", F.array_min(F.transform("near", lambda c: _most(c.__getitem__, x, y))))
    # no point outside the nine cells is nearer than a cell is wide
    can = F.when(F.col("bound") <= tree.size, F.filter("near", lambda c: _least(c.__getitem__, x, y) <= F.col("bound") * SLACK))
    own = cut(own.select("id", "x", "y", "bound", can.alias("can")))
    found = own.select("id", "x", "y", "bound", F.inline("can"))
    far = own.where("can IS NULL").select("id", "x", "y")
    if not far.isEmpty():
        found = found.unionByName(_descend(tree, far).select("id", "x", "y", "bound", *CELL))
    parts, deepest = [], len(tree.levels) - 1
    if deepest:
        found = cut(found)
    for level in range(deepest + 1):
        go_on = crowded(per_cell) if level < deepest else F.lit(False)
        parts.append(found.where(~go_on).select("id", "x", "y", F.lit(level).alias("level"), "cx", "cy"))
        if level < deepest:
            inside = tree.levels[level + 1].withColumns({"px": F.floor(F.col("cx") / 4), "py": F.floor(F.col("cy") / 4)})
            asked = found.where(go_on).select("id", "x", "y", "bound", F.col("cx").alias("px"), F.col("cy").alias("py"))
            found = cut(_pruned(asked.join(inside, ["px", "py"])).select("id", "x", "y", "bound", *CELL))
    return reduce(DataFrame.unionByName, parts).join(tree.leaves, ["level", "cx", "cy"]).select("id", "x", "y", "r_id", "r_x", "r_y")


def nearest(left: DataFrame, tree: Cells, per_cell: int = PER_CELL) -> DataFrame:
    """(id, r_id, r_x, r_y, dist): each left point's nearest point of the tree, the least r_id on ties."""
    if tree.leaves is None:
        return left.sparkSession.createDataFrame([], f"id {left.schema['id'].dataType.simpleString()}, r_id long, r_x double, r_y double, dist double")
    dist = F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y"))
    best = candidates(left, tree, per_cell).withColumn("dist", dist).groupBy("id").agg(F.min(F.struct("dist", "r_id", "r_x", "r_y")).alias("b"))
    return best.select("id", "b.r_id", "b.r_x", "b.r_y", "b.dist")
