"""Points at any size: a grid of pixels by legend key, as large as what is drawn.

A cell says how many points it has, its first and last point by a given order,
and the extremes of both coordinates, all of which merge: partial cells of
partitions into cells, cells of parts of the data into those of the whole, and
cells of one level into the next coarser one, whose pixels are twice as wide.

Points without a coordinate, or with one that isn't a number or infinite, are
not drawn. Where all points share a coordinate they share its first pixel. No
points make no cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extent:
    x_min: float
    x_max: float
    y_min: float
    y_max: float


def _drawn(points: DataFrame) -> DataFrame:
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return points.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double")).filter(whole("x") & whole("y"))


def extent(points: DataFrame) -> Extent | None:
    """What the coordinates span: one row of sums that combine before the shuffle."""
    r = _drawn(points).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return None if r[0] is None else Extent(*map(float, r))


def _pixel(c: str, low: float, high: float, size: int) -> Column:
    if high == low:
        return F.lit(0)
    return F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(high - low) * size), F.lit(size - 1)).cast("int")


def _gathered(cells: DataFrame) -> DataFrame:
    least, most = ("first", "x_min", "y_min"), ("last", "x_max", "y_max")
    return cells.groupBy("key", "px", "py").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most))


def grid(points: DataFrame, order: str, width: int, height: int, within: Extent | None = None) -> DataFrame:
    """key, px, py, n, first, last (structs of order, x, y), x_min, x_max, y_min, y_max of points (key, x, y, and the column that orders them). Points outside `within` aren't drawn."""
    e = within or extent(points) or Extent(0.0, 0.0, 0.0, 0.0)
    drawn = _drawn(points).filter(F.col("x").between(e.x_min, e.x_max) & F.col("y").between(e.y_min, e.y_max))
    placed = drawn.select("key", _pixel("x", e.x_min, e.x_max, width).alias("px"), _pixel("y", e.y_min, e.y_max, height).alias("py"), F.col(order).alias("at"), "x", "y")
    # numbers first, which hash tables of the cells' size hold (structs would have all points sorted); then the points at a cell's ends
    ends = {"first_at": F.when(~F.bool_or(F.col("at").isNull()), F.min("at")), "last_at": F.max("at")}
    cells = placed.groupBy("key", "px", "py").agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in ends.items()), *(f(c).alias(f"{c}_{k}") for c in "xy" for k, f in (("min", F.min), ("max", F.max))))
    same = reduce(lambda a, b: a & b, (F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("key", "px", "py")))
    is_first, is_last = (F.col("p.at").eqNullSafe(F.col(f"c.{k}")) for k in ends)
    one = F.struct("p.at", "p.x", "p.y")
    at_ends = placed.alias("p").join(cells.alias("c"), same & (is_first | is_last)).select("p.key", "p.px", "p.py", F.when(is_first, one).alias("first"), F.when(is_last, one).alias("last"))
    found = at_ends.groupBy("key", "px", "py").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    same = reduce(lambda a, b: a & b, (F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("key", "px", "py")))
    return cells.alias("c").join(found.alias("f"), same).select("c.key", "c.px", "c.py", "n", "first", "last", "x_min", "x_max", "y_min", "y_max")


def merged(*grids: DataFrame) -> DataFrame:
    """One grid of grids over the same extent and size."""
    return _gathered(reduce(DataFrame.unionByName, grids))


def coarser(cells: DataFrame, steps: int = 1) -> DataFrame:
    """The grid with pixels 2**steps times as wide and high."""
    return _gathered(cells.withColumn("px", F.shiftright("px", steps)).withColumn("py", F.shiftright("py", steps)))
