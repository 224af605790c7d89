"""Choices with counts: which entities have a value, as bitmaps that filters combine.

One pass over the facts makes the index: for each field and value, and each
block of 32,768 ids, a bitmap of the ids that have it. Everything a form shows
comes from the index: values chosen in one field are ORed, fields are ANDed, and
a choice is counted under the choices of all *other* fields, so that it says what
picking it would leave. Ids that have a value many times count once.

Rows are dealt by field, value and block before bitmaps are made, so a frequent
value is many blocks and no task makes all of them. Bitmaps suit fields that many
ids share values of (a form's); a field of which every id has its own value costs
4 KB an id. Null values are no choice, null ids nobody; choices that nothing has
leave nothing. An empty table has no choices.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(rows: DataFrame, id_: str, fields: Sequence[str]) -> DataFrame:
    """field, value, block, bits of rows: ids are integers."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    each = rows.filter(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.inline(pairs)).filter("value IS NOT NULL")
    dealt = each.withColumn("block", F.bitmap_bucket_number("id")).select("field", "value", "block", F.bitmap_bit_position("id").alias("bit"))
    # 64 bits at a time by a hash table, which sorts nothing and has an entry for all ids that share one; their bytes in the order of a bitmap's
    part = (F.lit(56) - F.floor(F.col("bit") % 64 / 8) * 8 + F.col("bit") % 8).cast("int")
    word = dealt.repartition("field", "value", "block").select("field", "value", "block", F.floor(F.col("bit") / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), part).alias("one"))
    words = word.groupBy("field", "value", "block", "w").agg(F.bit_or("one").alias("ones"))
    listed = words.groupBy("field", "value", "block").agg(F.sort_array(F.collect_list(F.struct("w", "ones"))).alias("a"))
    # words that nobody is in are zeros between the others
    before = lambda i: F.coalesce(F.when(i > 0, F.get("a", i - 1)["w"]), F.lit(-1))
    text = F.transform("a", lambda x, i: F.concat(F.repeat(F.lit("0"), (x["w"] - before(i) - 1) * 16), F.lpad(F.hex(x["ones"]), 16, "0")))
    return listed.select("field", "value", "block", F.unhex(F.rpad(F.array_join(text, ""), 8192, "0")).alias("bits"))


def merged(*indexes: DataFrame) -> DataFrame:
    """One index of the indexes of parts of the rows."""
    return reduce(DataFrame.unionByName, indexes).groupBy("field", "value", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _chosen(indexed: DataFrame, choices: Mapping[str, Collection[str]]) -> DataFrame:
    """by, block, bits: who has one of a field's chosen values."""
    among = reduce(lambda a, b: a | b, ((F.col("field") == f) & F.col("value").isin(list(v)) for f, v in choices.items()))
    return indexed.filter(among).groupBy(F.col("field").alias("by"), "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(indexed: DataFrame, choices: Mapping[str, Collection[str]] | None = None) -> DataFrame:
    """field, value, n: how many ids each choice would leave beside the choices (field: values) of the other fields."""
    choices = {f: v for f, v in (choices or {}).items() if v}
    if not choices:
        return indexed.groupBy("field", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    chosen = _chosen(indexed, choices)
    others = indexed.select("field", "value", "block").join(chosen, "block").filter("by <> field").select("field", "value", "block", "bits")
    both = indexed.unionByName(others).groupBy("field", "value", "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("parts"))
    # a block in which a chosen field has nobody is empty
    need = F.lit(1 + len(choices)) - F.col("field").isin(list(choices)).cast("int")
    return both.groupBy("field", "value").agg(F.coalesce(F.sum(F.when(F.col("parts") == need, F.bitmap_count("bits"))), F.lit(0)).alias("n"))


def matching(indexed: DataFrame, choices: Mapping[str, Collection[str]]) -> DataFrame:
    """block, bits of the ids that all choices leave."""
    chosen = _chosen(indexed, choices)
    both = chosen.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("parts"))
    return both.filter((F.col("parts") == len(choices)) & (F.bitmap_count("bits") > 0)).select("block", "bits")
