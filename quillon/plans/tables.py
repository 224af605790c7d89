"""Tables beside plots and on pages: base columns, axis values, a table a dataset, links.

A linked cell's address is in the column `<header> link`. Cells keep their
types until shown(), so that tables are sorted by value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import Catalogue, axis_title
from ..functions import text as tx
from ..operators import reports as rp
from ..request import KINDS, QueryType, Request, table_titles
from . import comparison as cp

#: A page leaves out the column that it is about.
PAGES = {"family": "family", "head": "head"}


def _links(columns: list[str], *names: str) -> list[Column]:
    return [F.col(n) if n in columns else F.lit(None).cast("string") for n in names]


def paper(columns: list[str]) -> Column:
    """The result's paper, else the links of what it was made with, from the inside out."""
    return tx.first_link(*_links(columns, "paper", "pb_paper", "pb_github", "backbone_paper", "backbone_github", "family_paper"))


def github(columns: list[str]) -> Column:
    return tx.first_link(*_links(columns, "pb_github", "backbone_github", "family_github"))


def base_columns(cat: Catalogue, columns: list[str], page: str = "", task: str | None = None, parameters: bool = True) -> list[Column]:
    """Family, model, parameters (where they are wanted) and pretraining of a row, with links."""
    pretrain = tx.pretrain_string("pretrain_dataset", "pretrain_method", "pretrain_epochs", plain=cat.plain_method)
    row = [F.col("backbone").alias("model"), *([F.col("m_parameters").alias("params (m)")] if parameters else []), pretrain.alias("pretrain")]
    if page == "family":
        return [*row, github(columns).alias("model link")]
    query = {} if task is None else {"task": F.lit(task)}
    return [F.col("family"), *row, tx.page_url("/families", "family", **query).alias("family link")]


def head_columns(column: str, header: str, page: str = "", task: str | None = None) -> list[Column]:
    """A head's name with a link to its page; on a head's own page without one."""
    query = {} if task is None else {"task": F.lit(task)}
    link = F.lit("") if page == "head" else tx.page_url("/heads", column, **query)
    return [F.col(column).alias(header), link.alias(f"{header} link")]


def value_columns(attribute: str, header: str, value: str, columns: list[str]) -> list[Column]:
    """An axis' value and its paper; parameters are in the base columns already."""
    return [] if attribute == "m_parameters" else [F.col(value).alias(header), paper(columns).alias(f"{header} link")]


def titles(request: Request) -> tuple[str, str]:
    """The headers of both axes, distinct."""
    args = request.args
    if request.query_type is QueryType.MULTI:
        x, y = (axis_title(axis.attribute, a.task, a.dataset) for axis, a in ((request.x, request.x_args), (request.y, request.y_args)))
    else:
        x, y = (axis_title(axis.attribute, args.task, request.title_dataset) for axis in (request.x, request.y))
    return table_titles(x, y, request)


def plot_table(cat: Catalogue, request: Request, page: str = "", instance_types: Mapping[str, str] | None = None) -> DataFrame:
    """The rows that a plot's points are made of. Missing parameters don't keep a row out."""
    x, y = titles(request)
    kind = request.query_type
    task = request.y_args.task or request.x_args.task
    if kind is QueryType.MULTI:
        return _multi(cat, request, x, y, page, task, instance_types)
    rows = cp.none(cat, request, any_parameters=True) if kind is QueryType.NONE else cp.single(cat, request, instance_types, any_parameters=True)
    have = rows.columns
    middle: list[Column] = []
    if kind is QueryType.SINGLE:
        if KINDS[request.args.task] == "classification":
            middle = [finetune(have).alias("finetune")]
        else:
            middle = [*head_columns("head", "head", page), train(have).alias("train")]
    base = base_columns(cat, have, page, task if kind is QueryType.SINGLE else None)
    return rows.select(*base, *middle, *value_columns(request.x.attribute, x, "x", have), *value_columns(request.y.attribute, y, "y", have))


def _multi(cat, request, x, y, page, task, instance_types) -> DataFrame:
    """Attributes are read from the facts only: where one has no such attribute there is no row."""
    kinds = [KINDS[a.task] for a in (request.x_args, request.y_args)]
    known = [axis.attribute in (*cat.fact(k).columns, *(["fps"] if a.fps else [])) for axis, k, a in zip((request.x, request.y), kinds, (request.x_args, request.y_args))]
    if not all(known):
        have = cat.pbs.columns
        return cat.pbs.select(*base_columns(cat, have, page, task), F.lit(None).cast("double").alias(x), F.lit(None).cast("double").alias(y)).limit(0)
    rows = cp.multi(cat, request, instance_types)
    headed = [k != "classification" for k in kinds]
    out = base_columns(cat, rows.columns, page, task)
    for p, title, has, other in (("x", x, *headed), ("y", y, *headed[::-1])):
        if has:
            out += head_columns(f"{p}_head", f"{p} head" if other else "head", page)
        have = [c for c in rows.columns if c != "paper"]
        own = tx.first_link(*_links(rows.columns, f"{p}_paper"), F.nullif(paper(have), F.lit("")))
        out += [F.col(p).alias(title), own.alias(f"{title} link")]
    return rows.select(*out)


def train(columns: list[str], prefix: str = "") -> Column:
    has = lambda c: f"{prefix}{c}" if f"{prefix}{c}" in columns else None
    return tx.train_string(f"{prefix}train_dataset", f"{prefix}train_epochs", has("crop_size"), has("intermediate_train_dataset"), has("intermediate_train_epochs"))


def finetune(columns: list[str]) -> Column:
    """Of a catalogue's columns; where it has no fine-tuning of its own, of its training."""
    if "fine_tune_dataset" not in columns:
        return tx.finetune_string("train_dataset", "train_epochs", "resolution")
    more = [f"intermediate_fine_tune_{x}" for x in ("dataset", "epochs", "resolution")]
    return tx.finetune_string("fine_tune_dataset", "fine_tune_epochs", "fine_tune_resolution", *(more if more[0] in columns else ()))


def downstream(cat: Catalogue, task: str, page: str = "", instance_types: Mapping[str, str] | None = None, **wanted) -> DataFrame:
    """Results of a task (wanted: family, head, dataset) with the columns of its page. A row's dataset says whose table it is in."""
    kind = KINDS[task]
    family = wanted.pop("family", None)
    if kind == "instance":
        wanted["instance_type"] = (instance_types or {}).get(task, task)
    rows = rp.downstream_rows(cat, kind, family=family, **wanted)
    have = rows.columns
    base = base_columns(cat, have, page, task, parameters=False)
    head = [] if page == "head" else head_columns("head", "head", page, task)
    address = tx.page_url("/datasets", "dataset", task=F.lit(task)).alias("dataset link")
    values = []
    for m in metrics_of(cat, kind):
        header = axis_title(m, task)
        values += [F.col(m).alias(header), F.when(F.col(m).isNotNull(), paper(have)).alias(f"{header} link")]
    return rows.select("dataset", address, *base, *head, train(have).alias("train"), "gflops", *values)


def metrics_of(cat: Catalogue, kind: str) -> tuple[str, ...]:
    return cat.metrics[kind]


def classification(cat: Catalogue, dataset: str) -> DataFrame:
    """A dataset's classification results; measures of error say so in their headers."""
    rows = rp.downstream_rows(cat, "classification", dataset=dataset)
    have, down = rows.columns, "&darr;" if "ImageNet-C" in dataset else ""
    values = []
    for m, header in zip(metrics_of(cat, "classification"), (f"top-1{down}", f"top-5{down}")):
        values += [F.col(m).alias(header), F.when(F.coalesce(F.col(m), F.lit(0.0)) != 0, paper(have)).alias(f"{header} link")]
    return rows.select(*base_columns(cat, have, "dataset"), finetune(have).alias("finetune"), "gflops", *values)


def shown(rows: DataFrame, headers: list[str], zero: bool = False) -> DataFrame:
    """Cells of these columns as text: what is missing is a dash, and with zero what is zero."""
    return rows.withColumns({h: tx.truthy(F.col(f"`{h}`")) if zero else tx.shown(F.col(f"`{h}`")) for h in headers})


def write_by_dataset(rows: DataFrame, path: str) -> None:
    """A folder a dataset; the rows of a dataset are sorted out by one shuffle, not by a query for each."""
    rows.repartition("dataset").write.mode("errorifexists").partitionBy("dataset").parquet(path)
