"""Tables in a relational database: written and read in parts, filters and columns pushed down.

Strings are VARCHAR, so that the database can compare them. A read in parts
splits the range of a key column, whose bounds the database says; an empty table
or one without a key is one part. A table is replaced whole or appended to; the
parts of a write are transactions of their own, so a reader that must not see
half a write reads after it. Names of columns keep their case.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PARTS, STRING = 8, 4000


def write_table(rows: DataFrame, url: str, table: str, mode: str = "overwrite", parts: int = PARTS, string: int = STRING, **properties: str) -> None:
    """One table; strings longer than `string` are an error of the database, not cut."""
    text = [f"`{f.name}` VARCHAR({string})" for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    out = rows.write.format("jdbc").mode(mode).options(url=url, dbtable=table, numPartitions=str(parts), batchsize="10000", **properties)
    (out.option("createTableColumnTypes", ", ".join(text)) if text else out).save()


def write_tables(t: Mapping[str, DataFrame], url: str, prefix: str = "", **options: str) -> None:
    for name, rows in t.items():
        write_table(rows, url, f"{prefix}{name}", **options)


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = PARTS, **properties: str) -> DataFrame:
    """A table, by a numeric key in parts."""
    source = spark.read.format("jdbc").options(url=url, **properties)
    if key is not None and parts > 1:
        low, high = source.option("dbtable", f'(SELECT MIN("{key}") AS "low", MAX("{key}") AS "high" FROM {table}) bounds').load().first()
        if low is not None and high > low:
            source = source.options(partitionColumn=f'"{key}"' if key != key.upper() else key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return source.option("dbtable", table).load()


def read_tables(spark: SparkSession, url: str, keys: Mapping[str, str | None], prefix: str = "", **options: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, url, f"{prefix}{name}", key, **options) for name, key in keys.items()}
