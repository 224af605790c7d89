"""Reports: pivots, tables by dataset and head, lists with counts and dates, modes, sorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import Catalogue
from ..functions.text import display_name, first_link, pair_cell, truthy
from ..sources.written import kept


def pivot(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence[str] | None, cell: Column, order: Column, missing: str) -> DataFrame:
    """A column for each of values; of several cells the one of the greatest order. Without values those that rows have, sorted: cells are written once and say them."""
    value = F.max_by(cell, order)
    if values is None:
        rows, value = kept(rows.groupBy(*keys, column).agg(value.alias("cell"))), F.first("cell")
        values = [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    out = rows.groupBy(*keys).pivot(column, list(values)).agg(value)
    return out.fillna(missing, subset=list(values)) if values else out


def classification_pivot(rows: DataFrame, keys: Sequence[str], datasets: Sequence[str] | None, first: str, second: str, order: Column, names=display_name) -> DataFrame:
    """Cells `first/second` by dataset, of the greatest order (resolution first); datasets nothing was measured on show dashes."""
    out = pivot(rows, keys, "dataset", datasets, pair_cell(first, second), order, "&mdash;/&mdash;")
    return out.withColumnsRenamed({d: names(d) for d in (datasets if datasets is not None else [c for c in out.columns if c not in keys])})


def distinct_values(rows: DataFrame, *columns: str) -> DataFrame:
    """Each column's distinct values, as rows (name, value)."""
    parts = [rows.select(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")).distinct() for c in columns]
    return reduce(DataFrame.unionByName, parts)


def catalogue_names(rows: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the sorted names of each dimension. Dimensions are small by nature."""
    parts = [d.select("name").distinct().agg(F.sort_array(F.collect_list("name")).alias(k)).withColumn("__k", F.lit(1)) for k, d in rows.items()]
    return reduce(lambda a, b: a.join(b, "__k"), parts).drop("__k")


def usage(facts: DataFrame, entity: str, kinds: Mapping[str, Column], date: str = "pub_date") -> DataFrame:
    """entity, task, n, last: facts by kind of an entity, counted once over all facts and unpivoted.

    Each fact table is aggregated by itself, so counts don't multiply where an
    entity has facts in several.
    """
    aggregates = [x for k, c in kinds.items() for x in (F.count_if(c).alias(f"n_{k}"), F.max(F.when(c, F.col(date))).alias(f"last_{k}"))]
    wide = facts.groupBy(entity).agg(*aggregates)
    parts = ", ".join(f"'{k}', n_{k}, last_{k}" for k in kinds)
    return wide.select(entity, F.expr(f"stack({len(kinds)}, {parts}) AS (task, n, last)"))


def evaluated(rows: DataFrame, cat: Catalogue) -> DataFrame:
    """Rows of datasets that are there to be measured on."""
    return rows.join(cat.dimensions["dataset"].filter("eval").select(F.col("name").alias("dataset")), "dataset", "left_semi")


def used(rows: DataFrame) -> DataFrame:
    """Without what has no results."""
    return rows.filter(F.col("n") > 0)


def mode(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key; of several the greatest."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("n"))


def downstream_rows(cat: Catalogue, kind: str, family: str | None = None, **wanted) -> DataFrame:
    """Facts of a kind with their pb's columns."""
    from ..plans.comparison import where_set

    return where_set(cat.pbs, {"family": family}).join(where_set(cat.fact(kind), wanted), "pb_id")


def shown_metrics(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics as cells: missing and zero are dashes."""
    return rows.withColumns({m: truthy(m) for m in metrics})


def paper_link(prefixes: Sequence[tuple[str, str]]) -> Column:
    """Of (paper, github) columns from the result outwards, the first link that isn't blank."""
    return first_link(*(c for pair in prefixes for c in pair if c))


def sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    """`-key` sorts down; what is missing comes last either way."""
    return rows.orderBy(*(F.col(f"`{k[1:]}`").desc_nulls_last() if k.startswith("-") else F.col(f"`{k}`").asc_nulls_last() for k in keys))


#: Default orders of the report tables, by header; `metric n` is the n-th metric of the table's kind, the ones that are meant.
ORDERS = {
    "classification_family": ("pretrain", "params (m)", "finetune"),
    "classification_dataset": ("-metric 1", "-metric 2"),
    "instance_family": ("head", "pretrain", "gflops", "train"),
    "instance_dataset": ("-metric 1", "-metric 2"),
    "instance_head": ("-metric 1", "-metric 2"),
    "semantic_family": ("head", "pretrain", "gflops", "train"),
    "semantic_dataset": ("-metric 1", "-metric 4"),
    "semantic_head": ("-metric 1", "-metric 4"),
    "usage": ("-n",),
    "family": ("-pub_date",),
}


def in_order(rows: DataFrame, table: str, metrics: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """rows in a table's default order, ties by further columns. A plot's table goes by its last column that isn't a link, downwards."""
    if table == "plot":
        return sorted_by(rows, "-" + [c for c in rows.columns if not c.endswith(" link")][-1], *ties)

    def header(key):
        name = key.removeprefix("-")
        if not name.startswith("metric "):
            return key
        at = min(int(name.split()[1]), len(metrics)) - 1
        return f"-{metrics[at]}"

    return sorted_by(rows, *dict.fromkeys(map(header, ORDERS[table])), *ties)


def one(rows: DataFrame):
    """The only row; an error if there is none or are several."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise LookupError("no row" if not found else "several rows")
    return found[0]


def family_of(cat: Catalogue, name: str) -> str:
    """A family by its name, else that of the backbone with this name."""
    p = cat.pbs
    found = p.filter(F.col("family") == name).select(F.lit(0).alias("o"), "family").unionByName(p.filter(F.col("backbone") == name).select(F.lit(1).alias("o"), "family"))
    row = found.orderBy("o", "family").limit(1).collect()
    if not row:
        raise LookupError(name)
    return row[0]["family"]


def rendered(rows: DataFrame, headers: Sequence[str], links: Mapping[str, str] | None = None) -> DataFrame:
    """The columns of a table in the order of its headers: missing cells blank, linked ones (value, url)."""
    have = set(rows.columns)

    def cell(h):
        text = F.coalesce(F.col(h).cast("string"), F.lit("")) if h in have else F.lit("")
        url = (links or {}).get(h)
        return (F.struct(text.alias("value"), F.col(url).alias("url")) if url else text).alias(h)

    return rows.select(*map(cell, headers))
