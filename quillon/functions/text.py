"""Formatting expressions whose output strings are query results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH, ARROW = "&mdash;", "&rarr;"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shown(c: str | Column, missing: str = DASH) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(missing))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(_c(c), F.lit(""))


def short_dataset(c: str | Column) -> Column:
    return F.replace(_c(c), F.lit("ImageNet"), F.lit("IN"))


def train_string(dataset, epochs, crop=None, intermediate_dataset=None, intermediate_epochs=None) -> Column:
    """`dataset : epochs[ : crop]`, after `intermediate : epochs &rarr; ` where there is one."""
    parts = [shown(dataset), shown(epochs), *([shown(crop)] if crop is not None else [])]
    main = F.concat_ws(" : ", *parts)
    if intermediate_dataset is None:
        return main
    before = F.concat(_c(intermediate_dataset), F.lit(" : "), shown(intermediate_epochs), F.lit(f" {ARROW} "))
    return F.concat(F.when(_c(intermediate_dataset).isNotNull(), before).otherwise(F.lit("")), main)


def finetune_string(dataset, epochs, resolution, intermediate_dataset=None, intermediate_epochs=None, intermediate_resolution=None) -> Column:
    """Always three parts; ImageNet is IN."""
    main = F.concat_ws(" : ", shown(short_dataset(dataset)), shown(epochs), shown(resolution))
    if intermediate_dataset is None:
        return main
    before = F.concat(F.concat_ws(" : ", short_dataset(intermediate_dataset), shown(intermediate_epochs), shown(intermediate_resolution)), F.lit(f" {ARROW} "))
    return F.concat(F.when(_c(intermediate_dataset).isNotNull(), before).otherwise(F.lit("")), main)


def pretrain_string(dataset, method, epochs, plain: str = "Supervised", short: str = "Sup.") -> Column:
    m = F.when(_c(method) == plain, F.lit(short)).otherwise(_c(method))
    return F.concat_ws(" : ", short_dataset(dataset), m, shown(epochs))


def pair_cell(first, second) -> Column:
    """`first/second`; missing and zero show as a dash."""
    return F.concat_ws("/", truthy(first), truthy(second))


def truthy(c) -> Column:
    return F.when(_c(c).isNull() | (_c(c) == 0), F.lit(DASH)).otherwise(_c(c).cast("string"))


def first_link(*links) -> Column:
    """The first link that isn't blank, else ''."""
    return F.coalesce(*map(blank_to_null, links), F.lit(""))


def legend(first: Column, second: Column | None = None) -> Column:
    keys = [F.coalesce(k.cast("string"), F.lit("None")) for k in (first, second) if k is not None]
    return F.concat_ws(" / ", *keys) if keys else F.lit("all")


def hover(*lines) -> Column:
    text = F.concat_ws("<br>", *(shown(x) for x in lines))
    return F.replace(F.replace(text, F.lit(DASH), F.lit("---")), F.lit(ARROW), F.lit("→"))


def until_entity(c) -> Column:
    return F.substring_index(_c(c), "&", 1)


def page_url(base: str, name, **query: Column) -> Column:
    parts = [F.lit(f"{base}/"), F.url_encode(_c(name))]
    for i, (k, v) in enumerate(query.items()):
        parts += [F.lit(f"{'&' if i else '?'}{k}="), F.url_encode(v)]
    return F.concat(*parts)


def slug(c) -> Column:
    return F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "-")


def entity_label(*parts) -> Column:
    """Parts that aren't null, each followed by a slash."""
    return F.concat(F.concat_ws("/", *(_c(p).cast("string") for p in parts)), F.lit("/"))


def fenced(c, language: str = "yaml") -> Column:
    """What stands between a fence that opens with the language and the next fence; null where there is none."""
    found = F.regexp_extract(_c(c), rf"(?s)```{language}(.*?)(```|$)", 1)
    return F.when(F.contains(_c(c), F.lit(f"```{language}")), found)


def without_glyphs(pages: Column) -> Column:
    """Pages joined by newlines, without the glyph names that a text extractor leaves."""
    return F.trim(F.regexp_replace(F.array_join(pages, "\n"), r"/uni\d+/uni\d+[^\s]*", ""))


def display_name(dataset: str) -> str:
    """A pivot column's name: ImageNet is IN; counts of errors point down."""
    return dataset.replace("ImageNet", "IN") + ("&darr;" if "-C" in dataset else "")
