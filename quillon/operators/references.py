"""Deleting and replacing rows over a graph of references: cascades to a fixpoint, restrictions, links, and no orphans.

A graph is a list of Edges: column `column` of `table` refers to `to` (`to_key`).
When a row that is referred to goes:

- CASCADE: the rows that refer to it go too, and what refers to them;
- RESTRICT: nothing may go, unless the row that refers goes as well;
- LINK: rows of a bridge go (a bridge's row goes with either side);
- OWNED: as LINK, and a row of `to` that bridges have linked goes with its last link.

Deletions are tombstones, a table of keys for each table, which applied()
takes off on reading. A round follows every edge from the keys that went in the
round before, by semi joins, and is written; as many rounds run as the longest
chain of references has edges, also where references form a circle. Null refers
to nothing. Keys that aren't there delete nothing, keys may repeat, and empty
tables have no rows to go.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import kept


@dataclass(frozen=True)
class Edge:
    table: str
    column: str
    to: str
    to_key: str
    rule: str


def _edges(rule: str, to: str, to_key: str, **columns: tuple[str, ...]) -> list[Edge]:
    return [Edge(t, c, to, to_key, rule) for t, names in columns.items() for c in names]


_TRAINED = ("dataset_id", "train_dataset_id", "intermediate_train_dataset_id")
#: The graph of shredded documents; keys of the tables that anything refers to.
KEYS = {"family": "family_id", "backbone": "backbone_id", "pretrained_backbone": "pb_id", "classification_result": "result_id", "instance_result": "result_id", "semantic_result": "result_id", "fps_measurement": "fps_id", "dataset": "dataset_id", "head": "head_id", "task": "task_id"}
GRAPH = [
    *_edges("CASCADE", "family", "family_id", backbone=("family_id",), pretrained_backbone=("family_id",)),
    *_edges("CASCADE", "backbone", "backbone_id", pretrained_backbone=("backbone_id",)),
    *_edges("CASCADE", "pretrained_backbone", "pb_id", classification_result=("pb_id",), instance_result=("pb_id",), semantic_result=("pb_id",)),
    *_edges("RESTRICT", "dataset", "dataset_id", pretrained_backbone=("pretrain_dataset_id",), classification_result=("dataset_id", "fine_tune_dataset_id", "intermediate_fine_tune_dataset_id"), instance_result=_TRAINED, semantic_result=_TRAINED),
    *_edges("RESTRICT", "head", "head_id", instance_result=("head_id",), semantic_result=("head_id",)),
    *_edges("RESTRICT", "task", "task_id", instance_result=("instance_type_id",)),
    *_edges("LINK", "dataset", "dataset_id", dataset_task=("dataset_id",)),
    *_edges("LINK", "head", "head_id", head_task=("head_id",)),
    *_edges("LINK", "task", "task_id", dataset_task=("task_id",), head_task=("task_id",)),
    *_edges("LINK", "backbone", "backbone_id", backbone_fps=("backbone_id",)),
    *_edges("LINK", "instance_result", "result_id", instance_fps=("result_id",)),
    *_edges("LINK", "semantic_result", "result_id", semantic_fps=("result_id",)),
    *_edges("OWNED", "fps_measurement", "fps_id", backbone_fps=("fps_id",), instance_fps=("fps_id",), semantic_fps=("fps_id",)),
]


class Restricted(Exception):
    """Rows that stay refer to rows that were to go."""


def cascade(t: Mapping[str, DataFrame], seeds: Mapping[str, DataFrame], graph: Sequence[Edge] = GRAPH, keys: Mapping[str, str] = KEYS) -> dict[str, DataFrame]:
    """Tombstones: the keys (one column, as the table's) of all rows that go when the seeds (table: keys) go; bridges' rows follow from them."""
    gone: dict[str, DataFrame] = {}
    frontier = {n: t[n].join(ids.select(keys[n]).distinct(), keys[n], "left_semi").select(keys[n]).distinct() for n, ids in seeds.items()}
    while frontier:
        written = {}
        for n, ids in frontier.items():
            ids = kept(ids.join(gone[n], keys[n], "left_anti") if n in gone else ids)
            if ids.limit(1).count():
                written[n] = ids
                gone[n] = gone[n].unionByName(ids) if n in gone else ids
        frontier = {}
        for e in graph:
            if e.rule == "CASCADE" and e.to in written:
                hit = t[e.table].join(written[e.to].select(F.col(e.to_key).alias(e.column)), e.column, "left_semi").select(keys[e.table])
                frontier[e.table] = frontier[e.table].unionByName(hit).distinct() if e.table in frontier else hit.distinct()
    return gone | _unlinked(t, gone, graph)


def _bridges(graph: Sequence[Edge]) -> list[str]:
    return sorted({e.table for e in graph if e.rule in ("LINK", "OWNED")})


def _left(rows: DataFrame, table: str, gone: Mapping[str, DataFrame], graph: Sequence[Edge]) -> DataFrame:
    """A bridge's rows whose sides are all there."""
    for e in graph:
        if e.table == table and e.rule in ("LINK", "OWNED") and e.to in gone:
            rows = rows.join(gone[e.to].select(F.col(e.to_key).alias(e.column)), e.column, "left_anti")
    return rows


def _unlinked(t: Mapping[str, DataFrame], gone: Mapping[str, DataFrame], graph: Sequence[Edge]) -> dict[str, DataFrame]:
    """Keys of owned rows that had links and have none left."""
    out = {}
    for to in sorted({e.to for e in graph if e.rule == "OWNED"}):
        own = [e for e in graph if e.rule == "OWNED" and e.to == to]
        touched = [e for e in own if any(x.to in gone for x in graph if x.table == e.table and x.rule == "LINK")]
        if not touched and to not in gone:
            continue
        key = own[0].to_key
        links = lambda rows, e: rows.select(F.col(e.column).alias(key))
        lost = [links(t[e.table], e).join(links(_left(t[e.table], e.table, gone, graph), e), key, "left_anti") for e in touched]
        lost = reduce(DataFrame.unionByName, lost).distinct() if lost else gone[to]
        for e in own:
            lost = lost.join(links(_left(t[e.table], e.table, gone, graph), e), key, "left_anti")
        lost = lost.unionByName(gone[to]) if to in gone else lost
        out[to] = kept(t[to].select(key).join(lost, key, "left_semi").distinct())
    return out


def restrictions(t: Mapping[str, DataFrame], gone: Mapping[str, DataFrame], graph: Sequence[Edge] = GRAPH, keys: Mapping[str, str] = KEYS) -> DataFrame:
    """table, key, column, to, to_key: rows that stay and refer, by an edge that restricts, to rows that go."""
    out = []
    for e in graph:
        if e.rule == "RESTRICT" and e.to in gone:
            rows = t[e.table].join(gone[e.table], keys[e.table], "left_anti") if e.table in gone else t[e.table]
            rows = rows.join(gone[e.to].select(F.col(e.to_key).alias(e.column)), e.column, "left_semi")
            out.append(rows.select(F.lit(e.table).alias("table"), F.col(keys[e.table]).cast("string").alias("key"), F.lit(e.column).alias("column"), F.lit(e.to).alias("to"), F.col(e.column).cast("string").alias("to_key")))
    if not out:
        return next(iter(t.values())).sparkSession.createDataFrame([], "table string, key string, column string, to string, to_key string")
    return reduce(DataFrame.unionByName, out)


def applied(t: Mapping[str, DataFrame], gone: Mapping[str, DataFrame], graph: Sequence[Edge] = GRAPH, keys: Mapping[str, str] = KEYS) -> dict[str, DataFrame]:
    """Tables without what tombstones name, and without bridges' rows to it."""
    out = {n: rows.join(gone[n], keys[n], "left_anti") if n in gone else rows for n, rows in t.items()}
    return out | {n: _left(t[n], n, gone, graph) for n in _bridges(graph)}


def deleted(t: Mapping[str, DataFrame], seeds: Mapping[str, DataFrame], graph: Sequence[Edge] = GRAPH, keys: Mapping[str, str] = KEYS) -> dict[str, DataFrame]:
    """Tables without the seeds and all that goes with them; Restricted, with the first rows that keep them, if something that stays refers to them."""
    gone = cascade(t, seeds, graph, keys)
    held = restrictions(t, gone, graph, keys).orderBy("table", "key", "column").limit(20).collect()
    if held:
        raise Restricted("; ".join(f"{r['table']} {r['key']} ({r['column']}) refers to {r['to']} {r['to_key']}" for r in held))
    return applied(t, gone, graph, keys)


def replaced(t: Mapping[str, DataFrame], rows: Mapping[str, DataFrame], keys: Mapping[str, str] = KEYS) -> dict[str, DataFrame]:
    """Tables with rows put in the place of those of the same key, or added (a table without a key, a bridge: added where they aren't there yet). Of rows that repeat a key one is taken, the greatest."""
    out = dict(t)
    for n, new in rows.items():
        new = new.select(*t[n].columns)
        if n in keys:
            k = keys[n]
            one = new.groupBy(k).agg(F.max(F.struct(*new.columns)).alias("r")).select("r.*")
            out[n] = t[n].join(one, k, "left_anti").select(*new.columns).unionByName(one)
        else:
            out[n] = t[n].unionByName(new).distinct()
    return out


def orphans(t: Mapping[str, DataFrame], graph: Sequence[Edge] = GRAPH) -> DataFrame:
    """table, column, key: references that nothing answers to, and owned rows that nothing links (column null)."""
    out = []
    for e in graph:
        there = t[e.to].select(F.col(e.to_key).alias(e.column))
        lost = t[e.table].select(e.column).filter(F.col(e.column).isNotNull()).join(there, e.column, "left_anti").distinct()
        out.append(lost.select(F.lit(e.table).alias("table"), F.lit(e.column).alias("column"), F.col(e.column).cast("string").alias("key")))
    for to in sorted({e.to for e in graph if e.rule == "OWNED"}):
        own = [e for e in graph if e.rule == "OWNED" and e.to == to]
        linked = reduce(DataFrame.unionByName, (t[e.table].select(F.col(e.column).alias(own[0].to_key)) for e in own))
        free = t[to].select(own[0].to_key).join(linked, own[0].to_key, "left_anti").distinct()
        out.append(free.select(F.lit(to).alias("table"), F.lit(None).cast("string").alias("column"), F.col(own[0].to_key).cast("string").alias("key")))
    return reduce(DataFrame.unionByName, out)
