"""A store of families: tables in versions, and an append-only log that says which count.

    store = Store(spark, path)
    change = store.begin()
    change.put(docs)             # nested documents; replaces families of the same name
    change.delete(names)         # column name
    change.commit()
    store.tables()               # as shred() gives them; tables(at=3) as they were

A commit is one write of all families and tables (data/version=<id>/table=<t>)
and one file of the log (log/<number>.json), which makes it visible. Numbers
have no gaps, and a number is taken once: a writer whose number is taken looks
at what came between. If that changed a family it changes too, it fails and
nothing of it shows; else it takes the next number. So of two writers of one
family one wins. What no log entry names is never read.

What a family's newest entry wrote is the family; a delete is an entry without
rows. Names of families, backbones and trained versions are unique over all
that is stored (K1), which every attempt to commit checks by a join of names.

Documents that can't be shredded or break a rule fail the commit with their
reasons; names that are deleted but aren't there are no error; no documents and
no names commit an entry without families. Dimensions (datasets, heads, tasks
and what they serve) stay when the families that named them go.

The log is read by the driver: its size is that of the commits, not of the
data. The rename of a log file must not replace one (HDFS and local paths).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import documents as ds
from .written import create_once, delete, exists, kept

_FAMILIES = "_families"
_NAMED = {"family": "family_id", "backbone": "backbone_id", "pretrained_backbone": "pb_id"}
_SHARED = ("dataset", "head", "task", "dataset_task", "head_task")


class Conflict(Exception):
    """Another commit changed a family after this change began."""


@dataclass(frozen=True)
class Entry:
    number: int
    version: str
    token: str | None


def _schemas(spark: SparkSession) -> dict[str, T.StructType]:
    none = spark.createDataFrame([], T.StructType([T.StructField("value", T.StringType())]))
    out = {n: rows.schema for n, rows in ds.shred(ds.read_json(spark, none), owners=True).items()}
    return out | {_FAMILIES: T._parse_datatype_string("family_id long, name string, removed boolean")}


def _union(schemas: Mapping[str, T.StructType]) -> T.StructType:
    fields: dict[str, T.StructField] = {}
    for s in schemas.values():
        for f in s.fields:
            fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType([*fields.values(), T.StructField("version", T.StringType()), T.StructField("table", T.StringType())])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = _schemas(spark)

    def log(self, at: int | None = None) -> list[Entry]:
        """Committed entries, oldest first."""
        if not exists(self.spark, f"{self.path}/log"):
            return []
        texts = self.spark.read.text(f"{self.path}/log", wholetext=True).collect()
        entries = sorted((Entry(**json.loads(r["value"])) for r in texts), key=lambda e: e.number)
        return [e for e in entries if at is None or e.number <= at]

    def rows(self, table: str, entries: Iterable[Entry]) -> DataFrame:
        """Everything that some entries wrote to a table, with version."""
        names = [f"{self.path}/data/version={e.version}" for e in entries]
        schema = _union(self.schemas)
        if not names:
            found = self.spark.createDataFrame([], schema)
        else:
            found = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*names)
        return found.filter(F.col("table") == table).select(*self.schemas[table].names, "version")

    def live(self, at: int | None = None, entries: list[Entry] | None = None) -> DataFrame:
        """family_id, name, version: where each family that is there now was last written."""
        entries = self.log(at) if entries is None else entries
        order = F.broadcast(self.spark.createDataFrame([(e.version, e.number) for e in entries], "version string, number int"))
        last = self.rows(_FAMILIES, entries).join(order, "version").groupBy("family_id").agg(F.max_by(F.struct("name", "version", "removed"), "number").alias("last"))
        return last.filter("NOT last.removed").select("family_id", "last.name", "last.version")

    def tables(self, at: int | None = None) -> dict[str, DataFrame]:
        """The tables of all families, now or after entry `at`."""
        entries = self.log(at)
        live = self.live(entries=entries).select("family_id", "version")
        plain = ds.columns_without_owner(self.schemas)
        out = {n: self.rows(n, entries).join(live, ["family_id", "version"], "left_semi").select(*plain[n]) for n in self.schemas if n not in (*_SHARED, _FAMILIES)}
        out |= {n: self.rows(n, entries).select(*plain[n]).distinct() for n in _SHARED if n != "dataset"}
        out["dataset"] = self.rows("dataset", entries).groupBy("dataset_id", "name").agg(F.max("eval").alias("eval"), F.max("website").alias("website"))
        return ds.with_references(out)

    def begin(self) -> Change:
        return Change(self, self.log())

    def names(self, entries: list[Entry], live: DataFrame) -> DataFrame:
        """table, id, name, family_id of what must have a name of its own."""
        of = lambda t, k: self.rows(t, entries).join(live.select("family_id", "version"), ["family_id", "version"], "left_semi").select(F.lit(t).alias("kind"), F.col(k).alias("id"), "name", "family_id")
        return reduce(DataFrame.unionByName, (of(t, k) for t, k in _NAMED.items()))

    def taken(self, docs: DataFrame, permissive: bool = False) -> DataFrame:
        """family, key: names in documents that other families have already."""
        t = ds.shred(docs, permissive)
        entries = self.log()
        own = reduce(DataFrame.unionByName, (t[n].select(F.lit(n).alias("kind"), F.col(k).alias("id"), "name", "family_id") for n, k in _NAMED.items()))
        clash = _clashes(own, self.names(entries, self.live(entries=entries)))
        return clash.join(t["family"].select("family_id", F.col("name").alias("family")), "family_id").select("family", F.col("name").alias("key"))


def _clashes(own: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of own whose name another family has. A family that own has isn't another one: it is replaced."""
    replaced = own.filter("kind = 'family'").select("family_id").distinct()
    others = stored.join(replaced, "family_id", "left_anti").select("kind", "id", F.col("name").alias("theirs"))
    return own.join(others, ["kind", "id"], "left_semi")


class Change:
    """What one commit does. It sees the store as it was when it began."""

    def __init__(self, store: Store, entries: list[Entry]):
        self.store, self.entries, self.docs, self.gone = store, entries, [], []

    def put(self, docs: DataFrame, permissive: bool = False, dimensions: Mapping[str, DataFrame] | None = None, replace: bool = True) -> Change:
        """Families, in the place of those of the same name; without replace these are an error."""
        self.docs.append((docs, permissive, dimensions, replace))
        return self

    def delete(self, names: DataFrame) -> Change:
        self.gone.append(names.select("name"))
        return self

    def _written(self, version: str) -> None:
        """All rows of all families in one job."""
        spark, store = self.store.spark, self.store
        place = f"{store.path}/pending/{version}"
        parts, families = [], [spark.createDataFrame([], store.schemas[_FAMILIES])]
        for k, (docs, permissive, dimensions, replace) in enumerate(self.docs):
            docs = kept(docs, f"{place}/{k}")
            if not ds.flawless(docs, permissive, dimensions):
                rejects = ds.rejected(docs, permissive, dimensions).orderBy("family", "reason").limit(20).collect()
                raise ValueError("; ".join(f"{r['family']}: {r['reason']}" for r in rejects))
            t = ds.shred(docs, permissive, owners=True)
            there = [] if replace or not self.entries else t["family"].join(store.live(entries=self.entries).select("family_id"), "family_id", "left_semi").limit(20).collect()
            if there:
                raise ValueError("K1: there already: " + ", ".join(r["name"] for r in there))
            parts += [rows.select(F.lit(n).alias("table"), "*") for n, rows in t.items()]
            families.append(t["family"].select("family_id", "name", F.lit(False).alias("removed")))
        for names in self.gone:
            families.append(names.distinct().select(ds.key("name").alias("family_id"), "name", F.lit(True).alias("removed")))
        parts.append(reduce(DataFrame.unionByName, families).select(F.lit(_FAMILIES).alias("table"), "*"))
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        every.write.partitionBy("table").parquet(f"{store.path}/data/version={version}")
        delete(spark, place)

    def _check(self, own: Entry, since: list[Entry], entries: list[Entry]) -> None:
        store = self.store
        ours = store.rows(_FAMILIES, [own])
        twice = ours.groupBy("family_id", "name").count().filter("count > 1").limit(20).collect()
        if twice:
            raise ValueError("named twice in one change: " + ", ".join(r["name"] for r in twice))
        if since:
            both = ours.join(store.rows(_FAMILIES, since).select("family_id"), "family_id", "left_semi").limit(20).collect()
            if both:
                raise Conflict("changed meanwhile: " + ", ".join(r["name"] for r in both))
        if not entries:
            return
        fresh = store.names([own], ours.filter("NOT removed"))
        stored = store.names(entries, store.live(entries=entries)).join(ours.filter("removed").select("family_id"), "family_id", "left_anti")
        clash = _clashes(fresh, stored).limit(20).collect()
        if clash:
            raise ValueError("K1: another family has " + ", ".join(f"{r['kind']} {r['name']}" for r in clash))

    def commit(self, token: str | None = None) -> int:
        """The number of the log entry that made the change visible. A token is committed once: again, it gives the first one's number."""
        store, version = self.store, uuid.uuid4().hex
        done = [e.number for e in store.log() if token is not None and e.token == token]
        if done:
            return done[0]
        try:
            self._written(version)
            base = self.entries[-1].number if self.entries else 0
            while True:
                entries = store.log()
                done = [e.number for e in entries if token is not None and e.token == token]
                if done:
                    delete(store.spark, f"{store.path}/data/version={version}")
                    return done[0]
                number = (entries[-1].number if entries else 0) + 1
                own = Entry(number, version, token)
                self._check(own, [e for e in entries if e.number > base], entries)
                if create_once(store.spark, f"{store.path}/log/{number:020d}.json", json.dumps(own.__dict__)):
                    return number
        except Exception:
            for place in (f"pending/{version}", f"data/version={version}"):
                delete(store.spark, f"{store.path}/{place}")
            raise
