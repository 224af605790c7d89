"""Comparison queries: points of one attribute against another, by legend keys."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import Catalogue
from ..functions.text import hover, legend
from ..request import KINDS, DataArgs, QueryType, Request

PB_ATTRIBUTES = ("m_parameters", "pub_date")


def where_set(rows: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Equality with each condition whose value isn't None."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])) if kv[1] is not None else d, conditions.items(), rows)


def pbs_of(cat: Catalogue, request: Request) -> DataFrame:
    """Trained versions under the request's family and pretraining filters; empty ones filter nothing."""
    return where_set(cat.pbs, {"family": request.family or None, "pretrain_dataset": request.pretrain_dataset or None, "pretrain_method": request.pretrain_method or None})


def facts_of(cat: Catalogue, args: DataArgs, instance_types: Mapping[str, str] | None = None) -> DataFrame:
    """Facts of the arguments' kind, restricted to what is set."""
    kind = KINDS[args.task]
    wanted: dict[str, object] = {"dataset": args.dataset}
    if kind == "classification":
        wanted["resolution"] = args.resolution
    else:
        wanted["head"] = args.head
    if kind == "instance":
        wanted["instance_type"] = (instance_types or {}).get(args.task, args.task)
    return where_set(cat.fact(kind), wanted)


def with_fps(cat: Catalogue, rows: DataFrame, kind: str, gpu: str, precision) -> DataFrame:
    """Rows (facts with their pb's columns) once for each matching measurement, each time with the first one's fps.

    The first is the one of the smallest id.
    """
    m = cat.measurements[kind]
    keys = [m.owner, *(["resolution"] if m.by_resolution else [])]
    found = where_set(m.rows, {"gpu": gpu, "precision": precision}).withColumnRenamed("owner", m.owner)
    first = found.groupBy(*keys).agg(F.min_by("fps", "fps_id").alias("fps"), F.count(F.lit(1)).alias("__n"))
    joined = rows.drop("fps").join(first, keys)
    return joined.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__i", "__n")


def with_results(cat: Catalogue, request: Request, instance_types=None) -> DataFrame:
    """Trained versions that have a fact under the request's restrictions: one fact must meet them all."""
    pbs, args = pbs_of(cat, request), request.args
    if args.task is None:
        return pbs
    facts = facts_of(cat, args, instance_types)
    if args.fps:
        facts = fast_facts(cat, facts, KINDS[args.task], args.gpu, args.precision)
    return pbs.join(facts.select("pb_id"), "pb_id", "left_semi")


def fast_facts(cat: Catalogue, facts: DataFrame, kind: str, gpu: str | None, precision) -> DataFrame:
    """Facts of which one and the same measurement has the gpu and the precision."""
    m = cat.measurements[kind]
    if m.owner not in facts.columns:
        facts = facts.join(cat.pbs.select("pb_id", m.owner), "pb_id")
    found = where_set(m.rows, {"gpu": gpu, "precision": precision}).select(F.col("owner").alias(m.owner), *(["resolution"] if m.by_resolution else []))
    return facts.join(found, [m.owner, *(["resolution"] if m.by_resolution else [])], "left_semi")


def without_results(cat: Catalogue) -> DataFrame:
    """Trained versions that have no fact at all."""
    return reduce(lambda d, f: d.join(f.select("pb_id"), "pb_id", "left_anti"), cat.facts.values(), cat.pbs)


def _legend_key(path: str | None, columns: list[str], kinds: Mapping[str, str]) -> Column | None:
    """A key's column: `kind.column` of the x fact if that is of the kind, else of the y fact; else of the pb."""
    if not path:
        return None
    kind, _, name = path.rpartition(".")
    if kind and kind in kinds.values():
        prefix = next(p for p, k in kinds.items() if k == kind)
        return F.col(f"{prefix}{name}")
    return F.col(name) if name in columns else F.col(path)


def _present(request: Request, any_parameters: bool) -> Column:
    """Both axes have a value; with any_parameters, parameters may be missing."""
    parts = [F.col(p).isNotNull() for p, axis in (("x", request.x), ("y", request.y)) if not (any_parameters and axis.attribute == "m_parameters")]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def single(cat: Catalogue, request: Request, instance_types=None, any_parameters: bool = False) -> DataFrame:
    """pb columns, fact columns, x, y and key of each fact that has both axes.

    The inner join implies the pbs' semi join, so there is none.
    """
    args = request.args
    kind = KINDS[args.task]
    facts = facts_of(cat, args, instance_types)
    rows = pbs_of(cat, request).join(facts, "pb_id")
    if args.fps:
        rows = with_fps(cat, rows, kind, args.gpu, args.precision)
    x, y = (F.col(a.attribute) for a in (request.x, request.y))
    rows = rows.withColumn("x", x).withColumn("y", y).filter(_present(request, any_parameters))
    keys = [_legend_key(k, rows.columns, {"": kind}) for k in (request.group_by, request.group_by_second)]
    return rows.withColumn("key", legend(*keys) if keys[0] is not None else F.lit("all"))


def multi(cat: Catalogue, request: Request, instance_types=None) -> DataFrame:
    """Each pb's x facts with each of its y facts; fact columns have the prefixes x_ and y_."""
    parts, kinds = [], {}
    for p, args in (("x_", request.x_args), ("y_", request.y_args)):
        facts = facts_of(cat, args, instance_types)
        kinds[p] = KINDS[args.task]
        if args.fps:
            m = cat.measurements[kinds[p]]
            need = facts if m.owner in facts.columns else facts.join(cat.pbs.select("pb_id", m.owner), "pb_id")
            facts = with_fps(cat, need, kinds[p], args.gpu, args.precision)
            facts = facts.drop(m.owner) if m.owner in cat.pbs.columns else facts
        parts.append(facts.select("pb_id", *(F.col(c).alias(p + c) for c in facts.columns if c != "pb_id")))
    rows = pbs_of(cat, request).join(parts[0], "pb_id").join(parts[1], "pb_id")
    for p, axis in (("x", request.x), ("y", request.y)):
        rows = rows.withColumn(p, F.col(axis.attribute if axis.attribute in PB_ATTRIBUTES else f"{p}_{axis.attribute}"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    keys = [_legend_key(k, rows.columns, kinds) for k in (request.group_by, request.group_by_second)]
    return rows.withColumn("key", legend(*keys) if keys[0] is not None else F.lit("all"))


def none(cat: Catalogue, request: Request, any_parameters: bool = False) -> DataFrame:
    """A point for each instance and classification fact, as a bag; semantic facts aren't plotted.

    Only the instance part is restricted to a head.
    """
    pbs = pbs_of(cat, request)
    own = ["pb_id", "gflops", *(["paper"] if "paper" in cat.fact("instance").columns else [])]
    instance = where_set(cat.fact("instance"), {"head": request.args.head}).select(*own)
    rows = pbs.join(instance.unionByName(cat.fact("classification").select(*own)), "pb_id")
    rows = rows.withColumn("x", F.col(request.x.attribute)).withColumn("y", F.col(request.y.attribute)).filter(_present(request, any_parameters))
    keys = [_legend_key(k, rows.columns, {}) for k in (request.group_by, request.group_by_second)]
    return rows.withColumn("key", legend(*keys) if keys[0] is not None else F.lit("all"))


def points(cat: Catalogue, request: Request, instance_types=None) -> DataFrame:
    kind = request.query_type
    if kind is QueryType.SINGLE:
        return single(cat, request, instance_types)
    return multi(cat, request, instance_types) if kind is QueryType.MULTI else none(cat, request)


def with_hover(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumn("hover", hover(*columns))


def by_legend(rows: DataFrame) -> DataFrame:
    """A row a legend key: its points, sorted, as lists. What a plot draws; large results stay tidy instead."""
    order = F.sort_array(F.collect_list(F.struct("x", "y")))
    return rows.groupBy("key").agg(order.alias("points")).select("key", F.transform("points", lambda p: p["x"]).alias("x"), F.transform("points", lambda p: p["y"]).alias("y"))


def best_under(rows: DataFrame, value: str, above: Mapping[str, float], k: int, ties: list[str]) -> DataFrame:
    """The k best values whose other columns exceed the bounds, ties in full."""
    kept = reduce(lambda d, kv: d.filter(F.col(kv[0]) > kv[1]), above.items(), rows)
    return kept.orderBy(F.col(value).desc_nulls_last(), *ties).limit(k)


def text_filter(rows: DataFrame, words: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose columns, taken together, contain every word, in either case."""
    line = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns or rows.columns)))
    return reduce(lambda d, w: d.filter(F.contains(line, F.lit(w.lower()))), words.split(), rows)
