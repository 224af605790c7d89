"""What a form may offer next: axes, tasks, datasets, metrics, heads, resolutions, measurements, legends."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import AXIS_TITLES, METRIC_TITLES, RESOLUTIONS, Catalogue, axis_title
from ..request import AXES, KINDS, AxisArgs, DataArgs, Request
from ..sources.documents import ENUMS
from .reports import mode


def _fixed(spark: SparkSession, field: str, values: Mapping[object, str]) -> DataFrame:
    return spark.createDataFrame([(field, str(k), v) for k, v in values.items()], "field string, value string, label string")


def _found(field: str, rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).select(F.lit(field).alias("field"), F.col(column).cast("string").alias("value"), F.col(column).cast("string").alias("label")).distinct()


def metrics(cat: Catalogue, task: str, dataset: str | None = None) -> dict[str, str]:
    """A task's metrics, as its dataset calls them; a dataset of errors has one."""
    names = cat.metrics[KINDS[task]]
    errors = dataset is not None and dataset.endswith(("-C", "-C-bar"))
    own = [m for m in names if not (errors and m in METRIC_TITLES and m != names[0])]
    return {m: axis_title(m, None, dataset) for m in (*own, "gflops")}


def axes(other: str) -> dict[str, str]:
    """Cost is offered where the other axis has results."""
    return {a: AXIS_TITLES[a] for a in AXES if a != "gflops" or other == "results"}


def options(cat: Catalogue, request: Request, head: str | None = None, dataset: str | None = None, enums: Mapping[str, Iterable[str]] = ENUMS) -> DataFrame:
    """field, value, label: all that the form of a request may offer, on the page of a head or a dataset what this allows."""
    spark = cat.pbs.sparkSession
    fixed = lambda field, values: _fixed(spark, field, values)
    d, parts = cat.dimensions, []
    for p, own, other, args in (("x", request.x, request.y, request.x_args), ("y", request.y, request.x, request.y_args)):
        parts.append(fixed(f"{p}_axis", axes(other.axis)))
        if own.axis == "fps":
            parts += [fixed(f"{p}_{x}", {v: v for v in enums[x]}) for x in ("gpu", "precision")]
        if own.axis != "results":
            continue
        tasks = d["head_task"].filter(F.col("head") == head) if head else d["dataset_task"].filter(F.col("dataset") == dataset) if dataset else d["task"].withColumnRenamed("name", "task")
        parts.append(_found(f"{p}_task", tasks, "task"))
        if not args.task:
            continue
        served = lambda x: d[f"{x}_task"].filter(F.col("task") == args.task)  # noqa: B023, E731
        kind = KINDS[args.task]
        if not dataset:
            measured = d["dataset"].filter("eval").select(F.col("name").alias("dataset"))
            parts.append(_found(f"{p}_dataset", served("dataset").join(measured, "dataset", "left_semi"), "dataset"))
        parts.append(fixed(f"{p}_metric", metrics(cat, args.task, args.dataset or dataset)))
        if kind in RESOLUTIONS:
            parts.append(fixed(f"{p}_resolution", RESOLUTIONS[kind]))
        if kind != "classification" and not head:
            parts.append(_found(f"{p}_head", served("head"), "head"))
    parts.append(_found("pretrain_dataset", cat.pbs, "pretrain_dataset"))
    parts.append(fixed("pretrain_method", {v: v for v in enums["pretrain_method"]}))
    legends = request.legends()
    parts.append(fixed("legend", {k: v for k, v in legends.items() if k != request.group_by_second}))
    if request.group_by:
        parts.append(fixed("legend_second", {k: v for k, v in legends.items() if k != request.group_by}))
    return reduce(DataFrame.unionByName, parts)


def page_defaults(facts: DataFrame, entity: str) -> DataFrame:
    """entity, task, dataset: the task that an entity has most results of, and the dataset that it has most of for this task (facts: entity, task, dataset)."""
    first = mode(facts, [entity], "task").select(entity, "task")
    return mode(facts.join(first, [entity, "task"]), [entity, "task"], "dataset").select(entity, "task", "dataset")


def task_defaults(facts: DataFrame, entity: str) -> DataFrame:
    """entity, task, dataset: the dataset that an entity has most results on, for each task."""
    return mode(facts, [entity, "task"], "dataset").select(entity, "task", "dataset")


def default_request(cat: Catalogue, task: str, dataset: str, family: str | None = None, head: str | None = None) -> Request:
    """What a page asks first: its task's first metric on its dataset against cost; a family by pretraining, else by family."""
    y = DataArgs(dataset, task, head)
    keys = ("pretrain_dataset", "pretrain_method") if family else ("family", None)
    return Request(AxisArgs("gflops"), AxisArgs("results", cat.metrics[KINDS[task]][0]), DataArgs(), y, family=family, group_by=keys[0], group_by_second=keys[1])
