"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time 0..1, linear between its
knots; its integral is the source's weight. Targets share `epochs` times all
words by weight, none above `repeat` times its source's words (the excess is
shared again by weight until none is above). A source's token demand up to
time t is its target times the share of its schedule's integral up to t. Its
documents, dealt in the order of a hash and again from the start where the
target passes the source's size, follow one another along that demand: the
inverse of the integral at the middle of a document's words is its training
position. The rows are range-sorted by position; passes() has a row for each
time that a document is read.

The running sums are taken in two levels, since one source may hold a third of
all rows: inside about sqrt(n) hash buckets of a source, then over its buckets.

Null texts have no words; they, empty texts and texts that the mix doesn't
reach have taken = 0 and no position (they come last). A null source is a
source of its own, after all others. Rows that repeat are rows of their own;
equal ids are ordered by size, and alike rows share the words between them. An
empty table gives an empty result. A text counts by its words, however long.
Other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

WEIGHTS, EPOCHS, REPEAT = (5.0, 2.0, 1.0), 1.5, 2.0
#: By weight class: the schedule at times 0, 1/2 and 1, as multiples of the weight; each integrates to 1.
SCHEDULES = ((1.4, 1.0, 0.6), (1.0, 1.0, 1.0), (0.4, 1.0, 1.6))


def _area(k: list[Column], t: Column) -> Column:
    """Integral up to t of the line through (0, k0), (1/2, k1), (1, k2)."""
    first = k[0] * t + (k[1] - k[0]) * t * t
    u = t - 0.5
    return F.when(t <= 0.5, first).otherwise((k[0] + k[1]) / 4 + k[1] * u + (k[2] - k[1]) * u * u)


def _inverse(k: list[Column], a: Column) -> Column:
    """The time at which _area() is a."""

    def solve(c, base, slope):  # slope * x**2 + base * x = c, in the form that is stable for small slopes
        return 2 * c / F.greatest(base + F.sqrt(F.greatest(base * base + 4 * slope * c, F.lit(0.0))), F.lit(1e-300))

    half = (k[0] + k[1]) / 4
    return F.when(a <= half, solve(a, k[0], k[1] - k[0])).otherwise(0.5 + solve(a - half, k[1], k[2] - k[1]))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, repeat: float = REPEAT) -> DataFrame:
    """sizes (source, source_size, source_rows; a row a source) with klass, weight and target.

    Water filling in closed form: in the order of size by weight, a source is
    capped if its cap is below its share of what the sources before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("klass", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("klass") + 1)).withColumn("cap", repeat * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = epochs * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    s = s.withColumn("free", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    # the first source that isn't capped has the level of all that aren't
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("free"))))
    return s.select("source", "source_size", "source_rows", "klass", "weight", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, repeat: float = REPEAT, schedules=SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and positions (of each pass over the document)."""
    # words are counted once; everything after reads three narrow columns
    d = cut(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")))
    d = d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), weights, epochs, repeat)
    d = d.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    t = t.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    d = d.join(t, "source_key").withColumn("buckets", F.ceil(F.sqrt("source_rows")))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.col("buckets")))
    # dealt by bucket once, for both levels: only the buckets' sums meet by source
    d = d.repartition("source_key", "bucket")
    inside = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    over = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("bucket_start"))
    d = d.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source_key", "bucket"])
    start, size, goal = F.col("start") + F.col("bucket_start"), F.col("size"), F.round("target").cast("long")
    knots = [F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), F.pmod("klass", F.lit(len(schedules))) + 1) for i in range(3)]
    passes = int(-(-repeat // 1))

    def part(p):
        return F.greatest(F.lit(0), F.least(size, goal - F.lit(p) * F.col("source_size") - start))

    def position(p):
        middle = (F.lit(p) * F.col("source_size") + start + part(p) / 2) / F.greatest(goal, F.lit(1))
        return F.when(part(p) > 0, _inverse(knots, middle * _area(knots, F.lit(1.0))))

    taken = sum((part(p) for p in range(1, passes)), part(0)).cast("long")
    at = F.filter(F.array(*[position(p) for p in range(passes)]), lambda x: x.isNotNull())
    return d.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), taken.alias("taken"), at.alias("positions")).withColumn("copies", F.size("positions")).withColumn("position", F.when(F.col("copies") > 0, F.col("positions")[0]))


def ordered(mixed: DataFrame) -> DataFrame:
    """Range-sorted by the training position, untaken rows last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def passes(mixed: DataFrame) -> DataFrame:
    """A row a pass over a document (doc_id, source, pass from 0, position), range-sorted by position: the order in which training reads them."""
    each = mixed.select("doc_id", "source", F.posexplode("positions").alias("pass", "position"))
    return each.orderBy("position", "doc_id", "pass")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ordered(mix(table(spark, sf_dir, "documents")))
    rounded = F.transform("positions", lambda x: F.round(x, 6)).alias("positions")
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("position"), rounded)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS klass FROM d GROUP BY source),
w AS (SELECT *, CASE klass WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap <= weight * level THEN cap ELSE least(cap, weight * max(CASE WHEN cap > weight * level THEN level END) OVER ()) END AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, klass, CAST(round(target) AS BIGINT) AS goal,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(greatest(0, least(size, goal - start)) AS BIGINT) AS p0, CAST(greatest(0, least(size, goal - source_size - start)) AS BIGINT) AS p1,
             CASE klass WHEN 0 THEN 1.4::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS k0, 1.0::DOUBLE AS k1, CASE klass WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.6::DOUBLE END AS k2 FROM r),
a AS (SELECT *, (k0 + k1) / 4 AS half, (k0 + k1) / 4 + k1 * 0.5::DOUBLE + (k2 - k1) * 0.25::DOUBLE AS whole FROM p),
m AS (SELECT *, (start + p0::DOUBLE / 2) / greatest(goal, 1) * whole AS a0, (source_size + start + p1::DOUBLE / 2) / greatest(goal, 1) * whole AS a1 FROM a),
t2 AS (SELECT *, CASE WHEN p0 > 0 THEN round(CASE WHEN a0 <= half THEN 2 * a0 / (k0 + sqrt(greatest(k0 * k0 + 4 * (k1 - k0) * a0, 0))) ELSE 0.5::DOUBLE + 2 * (a0 - half) / (k1 + sqrt(greatest(k1 * k1 + 4 * (k2 - k1) * (a0 - half), 0))) END, 6) END AS t0,
              CASE WHEN p1 > 0 THEN round(CASE WHEN a1 <= half THEN 2 * a1 / (k0 + sqrt(greatest(k0 * k0 + 4 * (k1 - k0) * a1, 0))) ELSE 0.5::DOUBLE + 2 * (a1 - half) / (k1 + sqrt(greatest(k1 * k1 + 4 * (k2 - k1) * (a1 - half), 0))) END, 6) END AS t1 FROM m)
SELECT doc_id, size, source_size, target, p0 + p1 AS taken, CAST((p0 > 0) AS INTEGER) + CAST((p1 > 0) AS INTEGER) AS copies, coalesce(t0, t1) AS position, list_filter([t0, t1], lambda x: x IS NOT NULL) AS positions
FROM t2
"""
