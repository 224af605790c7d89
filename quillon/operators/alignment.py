"""Aligned line differences of documents: a longest common subsequence of lines for each pair.

Documents are rendered to lines by columns; pairs meet by one join of their
keys. A pair is a row, so its size is that of a document, and it is aligned
where it is: by bit vectors over the old lines, one addition of long integers a
new line, in memory of the square root of the full table.

Of several longest common subsequences one is chosen, from the top: equal
lines match; else the old line goes if what follows can still match as much as
without the new one; else the new line comes. A line that moves is taken away
in one place and added in another.

A null line is an empty one, a null array of lines a document without lines. Documents of one side only
are all lines of that side. Documents that share a key are paired in the order
of their lines. Null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of pairs that leave Python in one batch.
_BATCH_LINES = 10_000
_EDITS = "array<struct<sign:string,number:int,line:string>>"


def _field_lines(c: Column, kind: T.StructType) -> Column:
    """Lines of a struct's fields; nothing for a struct that is null."""
    return F.coalesce(F.flatten(F.array(*(_named(f.name, c[f.name], f.dataType) for f in kind.fields))), F.array().cast("array<string>"))


def _scalar(c: Column) -> Column:
    return F.coalesce(F.replace(c.cast("string"), F.lit("\n"), F.lit("\\n")), F.lit("null"))


def _named(name: str, c: Column, kind: T.DataType) -> Column:
    """Lines of one field: name and value, or the name and what is in it."""
    head = F.lit(f"{name}:")
    if isinstance(kind, T.StructType):
        inner = F.transform(_field_lines(c, kind), lambda x: F.concat(F.lit("  "), x))
        return F.when(c.isNull(), F.array(F.lit(f"{name}: null"))).otherwise(F.concat(F.array(head), inner))
    if isinstance(kind, T.ArrayType):
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.array(F.lit(f"{name}: []"))).otherwise(F.concat(F.array(head), _elements(c, kind)))
    value = F.to_json(c) if isinstance(kind, (T.MapType, T.VariantType)) else c
    return F.array(F.concat(head, F.lit(" "), _scalar(value)))


def _elements(c: Column, kind: T.ArrayType) -> Column:
    """Lines of a list: each element's first begins with a dash."""

    def one(e: Column) -> Column:
        own = kind.elementType
        if isinstance(own, T.StructType):
            inner = F.when(e.isNull(), F.array(F.lit("null"))).otherwise(_field_lines(e, own))
        elif isinstance(own, T.ArrayType):
            inner = _elements(e, own)
        else:
            inner = F.array(_scalar(e))
        return F.transform(inner, lambda x, i: F.concat(F.when(i == 0, "- ").otherwise("  "), x))

    return F.flatten(F.transform(c, one))


def rendered(docs: DataFrame, key: str) -> DataFrame:
    """key and the lines (an array) of each document: a line a value, fields and list elements in their order."""
    return docs.select(F.col(key).alias("key"), _field_lines(F.struct(*docs.columns), docs.schema).alias("lines"))


def align(old: Sequence[Hashable], new: Sequence[Hashable]) -> Iterator[tuple[str, int]]:
    """(sign, place from 0): -, + and blank for lines taken away, added and kept (the place is the new line's)."""
    begin = 0
    while begin < min(len(old), len(new)) and old[begin] == new[begin]:
        yield " ", begin
        begin += 1
    a, b = old[begin:], new[begin:]
    n, m = len(a), len(b)
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << n - 1 - i
    full = (1 << n) - 1

    def after(row: int, x: Hashable) -> int:
        # bit t of a row is 0 where one more old line from the end matches one more line
        hit = row & where.get(x, 0)
        return (row + hit | row - hit) & full

    step = isqrt(m) + 1
    kept, row = [full], full
    for k in range(1, m + 1):
        row = after(row, b[m - k])
        if k % step == 0:
            kept.append(row)
    block, rows = -1, []
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            yield " ", begin + j
            i, j = i + 1, j + 1
            continue
        k = m - j
        if k // step != block:
            block = k // step
            rows = [kept[block]]
            for q in range(block * step + 1, min((block + 1) * step, m + 1)):
                rows.append(after(rows[-1], b[m - q]))
        if rows[k - block * step] >> n - 1 - i & 1:
            yield "-", begin + i
            i += 1
        else:
            yield "+", begin + j
            j += 1
    yield from (("-", begin + x) for x in range(i, n))
    yield from (("+", begin + x) for x in range(j, m))


def _differences(batches, names: Sequence[str], context: bool) -> Iterator[pa.RecordBatch]:
    """Edits of batches of pairs (key, old, new)."""
    kind = pa.list_(pa.struct([("sign", pa.string()), ("number", pa.int32()), ("line", pa.string())]))
    for batch in batches:
        done, sizes, edits, lines = 0, ([], []), [], 0
        for i in range(batch.num_rows):
            a, b = ([x or "" for x in batch.column(c)[i].as_py() or []] for c in ("old", "new"))
            edits.append([(s, k + 1, (a if s == "-" else b)[k]) for s, k in align(a, b) if context or s != " "])
            sizes[0].append(len(a))
            sizes[1].append(len(b))
            lines += len(a) + len(b)
            if lines > _BATCH_LINES or i == batch.num_rows - 1:  # pairs together as long as they are short
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(done, i + 1 - done), *(pa.array(x, pa.int32()) for x in sizes), pa.array(edits, kind)], names=list(names))
                done, sizes, edits, lines = i + 1, ([], []), [], 0


def aligned(old: DataFrame, new: DataFrame, context: bool = False) -> DataFrame:
    """key, n_old, n_new and edits (sign, number from 1, line; with context also the lines that stay) of each pair of documents (key, lines)."""
    among = Window.partitionBy("key").orderBy("lines")
    number = lambda d, name: d.select("key", F.row_number().over(among).alias("nth"), F.coalesce("lines", F.array().cast("array<string>")).alias(name)).alias(name)
    o, n = number(old, "old"), number(new, "new")
    on = F.col("old.key").eqNullSafe(F.col("new.key")) & (F.col("old.nth") == F.col("new.nth"))
    pairs = o.join(n, on, "full_outer").select(F.coalesce("old.key", "new.key").alias("key"), "old.old", "new.new")
    schema = T.StructType([T.StructField("key", pairs.schema["key"].dataType), *T._parse_datatype_string(f"n_old int, n_new int, edits {_EDITS}").fields])

    def run(batches):
        yield from _differences(batches, schema.names, context)

    return pairs.mapInArrow(run, schema)


def edits(pairs: DataFrame) -> DataFrame:
    """key, sign, number, line: a row a line that isn't the same."""
    return pairs.select("key", F.inline("edits"))


def figures(pairs: DataFrame, *by: str) -> DataFrame:
    """changed lines, lines (of the longer side of each pair) and percent of them, over all pairs or by key; percent may exceed 100, and is 0 of nothing."""
    change = F.size(F.filter("edits", lambda e: e["sign"] != " "))
    sums = pairs.groupBy(*by).agg(F.coalesce(F.sum(change), F.lit(0)).cast("long").alias("changed"), F.coalesce(F.sum(F.greatest("n_old", "n_new")), F.lit(0)).cast("long").alias("lines"))
    return sums.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("changed"), F.col("lines")), F.lit(0.0)))
