"""The best under every threshold: fronts of two measures by key, and what they say for given thresholds.

A row stands in its key's front where no other row is as good in both measures
and better in one. Each partition drops what its own rows dominate, in Arrow
batches and without a shuffle; what is left meets by key in a running maximum,
which needs one row of memory a key. Rows that tie in both measures all stay.
Rows where a measure is null or not a number take no part; a null key is a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a partition's front that are held; more go on to the merge.
HELD = 500_000


def _undominated(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of rows that no row of their key dominates (small x and large y are good)."""
    order = np.lexsort((-y, x, key))
    key, x, rank = key[order], x[order], np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    fresh = np.ones(len(x), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1])  # the best y of an x comes first
    # a running maximum that begins anew with each key, which lifts it above all before
    lifted = rank + key * (len(rank) + 1)
    best = np.maximum.accumulate(lifted)
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    before = np.full(len(first), -1, dtype=np.int64)
    before[1:] = best[first[1:] - 1]
    floor = np.maximum(before, key[first] * (len(rank) + 1) - 1)
    stands = (lifted > floor[group]) & (lifted == lifted[first][group])
    return order[stands]


def _value(c: str, lower: bool) -> Column:
    v = F.col(c).cast("double")
    return v if lower else -v


def front(rows: DataFrame, key: str, x: str, y: str, x_lower: bool = True, y_lower: bool = False) -> DataFrame:
    """The rows of each key that no other one dominates, with all their columns."""
    names = rows.columns
    plain = rows.toDF(*(f"c{i}" for i in range(len(names))))
    k, cx, cy = (f"c{names.index(c)}" for c in (key, x, y))
    measured = plain.withColumn("x", _value(cx, x_lower)).withColumn("y", _value(cy, not y_lower))
    measured = measured.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            code = pc.fill_null(t.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            held = t.take(pa.array(_undominated(code, t.column("x").to_numpy(), t.column("y").to_numpy()))).combine_chunks()
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    local = measured.mapInArrow(run, measured.schema)
    tops = local.groupBy(k, "x").agg(F.max("y").alias("top"))
    before = Window.partitionBy(k).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    stand = tops.withColumn("before", F.max("top").over(before)).filter(F.col("before").isNull() | (F.col("top") > F.col("before"))).select(F.col(k).alias("sk"), F.col("x").alias("sx"), "top")
    on = F.col(k).eqNullSafe(F.col("sk")) & (F.col("x") == F.col("sx")) & (F.col("y") == F.col("top"))
    return local.join(stand, on, "left_semi").select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def best_within(fronts: DataFrame, key: str, x: str, y: str, bounds: Sequence[float], x_lower: bool = True, y_lower: bool = False) -> DataFrame:
    """key, bound, best: for each bound on x the best y of each key's front within it (null where nothing is)."""
    sign = 1.0 if x_lower else -1.0
    points = fronts.select(F.col(key).alias("key"), _value(x, x_lower).alias("x"), F.lit(None).cast("double").alias("bound"), F.col(y).cast("double").alias("y"))
    asked = points.select("key").distinct().select("key", F.explode(F.array(*(F.lit(float(b)) for b in bounds))).alias("bound"))
    both = points.unionByName(asked.select("key", (sign * F.col("bound")).alias("x"), "bound", F.lit(None).cast("double").alias("y")))
    upto = Window.partitionBy("key").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = (F.min if y_lower else F.max)("y").over(upto)
    return both.withColumn("best", best).filter("bound IS NOT NULL").select("key", "bound", "best")
