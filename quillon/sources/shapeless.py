"""Documents of unknown shape: JSON texts as VARIANT, and every leaf with its path.

A path is written as JSONPath ($.a.b[0]) or, by name, with list elements called
by what names them (their name; gpu, precision and resolution; dataset, head and
mAP; dataset, resolution, fine-tuning dataset and top_1), so that an element that
moves keeps its path. Objects and lists without content are leaves, as is null.
Levels are taken off one after another without a shuffle, as many as the deepest
document has, and each is written before the next begins.

A text that isn't JSON has no variant: see rejected(). Fields of any name are
taken; a document that is a scalar is the leaf $. Repeated documents and keys
give repeated rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .written import kept

#: What names an element, by the field that tells of which kind it is.
NAMES = {"name": ("name",), "gpu": ("gpu", "precision", "resolution"), "mAP": ("dataset", "head", "mAP"), "top_1": ("dataset", "resolution", "fine_tune_dataset", "top_1")}


def variants(texts: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, v: v null where the text isn't JSON."""
    return texts.select(F.col(key).alias("key"), F.try_parse_json(value).alias("v"))


def rejected(texts: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key of texts that aren't JSON."""
    return variants(texts, key, value).filter("v IS NULL").select("key")


def _element_name(e: Column, place: Column) -> Column:
    """What an element is called in its list; its place, if nothing names it."""
    field = lambda c: F.try_variant_get(e, f"$.{c}", "string")
    named = [F.when(field(tell).isNotNull(), F.concat_ws("+", *(F.coalesce(field(c), F.lit("None")) for c in columns))) for tell, columns in NAMES.items()]
    return F.coalesce(*named, place.cast("string"))


def _field_path(path: Column, name: Column) -> Column:
    plain = F.rlike(name, F.lit("^[A-Za-z_][A-Za-z0-9_]*$"))
    return F.concat(path, F.lit("."), F.when(plain, name).otherwise(F.concat(F.lit('"'), name, F.lit('"'))))


def leaves(docs: DataFrame, by_name: bool = False) -> DataFrame:
    """key, path, kind and value (text; null of null) of every leaf of documents (key, v)."""
    level = docs.filter("v IS NOT NULL").select("key", F.lit("$").alias("path"), "v")
    out = []
    while True:
        level = level.withColumn("fields", F.try_variant_get("v", "$", "map<string,variant>")).withColumn("items", F.try_variant_get("v", "$", "array<variant>"))
        level = kept(level.withColumn("size", F.coalesce(F.when(F.col("fields").isNotNull(), F.size("fields")), F.when(F.col("items").isNotNull(), F.size("items")))).select("key", "path", "v", "size", F.col("fields").isNotNull().alias("object")))
        own = level.filter("size IS NULL OR size = 0")
        kind = F.when(F.col("size").isNull(), F.schema_of_variant("v")).when(F.col("object"), "OBJECT").otherwise("ARRAY")
        value = F.when(F.col("size").isNull(), F.try_variant_get("v", "$", "string")).when(F.col("object"), "{}").otherwise("[]")
        out.append(own.select("key", "path", kind.alias("kind"), value.alias("value")))
        inner = level.filter("size > 0")
        if not inner.limit(1).count():
            return reduce(DataFrame.unionByName, out)
        fields = inner.filter("object").select("key", "path", F.explode(F.variant_get("v", "$", "map<string,variant>")).alias("name", "e"))
        items = inner.filter("NOT object").select("key", "path", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("at", "e"))
        place = _element_name(F.col("e"), F.col("at")) if by_name else F.col("at").cast("string")
        level = fields.select("key", _field_path(F.col("path"), F.col("name")).alias("path"), F.col("e").alias("v")).unionByName(items.select("key", F.concat("path", F.lit("["), place, F.lit("]")).alias("path"), F.col("e").alias("v")))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """sign, key, path, value: leaves taken away (-) and added (+), as bags, of documents (key, v) of any shape."""
    a, b = (leaves(d, by_name=True).select("key", "path", "value") for d in (old, new))
    sign = lambda s, d: d.select(F.lit(s).alias("sign"), "key", "path", "value")
    return sign("-", a.exceptAll(b)).unionByName(sign("+", b.exceptAll(a)))
