"""Nested documents: reading, shredding to relations, validation, nesting again, differences.

Only reading YAML is Python (Arrow-free, one document a row, by mapInPandas);
everything after it is columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import parsed, read_files
from .written import kept

_FPS = "array<struct<resolution:int,gpu:string,precision:string,fps:double,source:string>>"
_LINKS = "paper:string,github:string"
_CLASSIFICATION = f"array<struct<dataset:string,resolution:int,top_1:double,top_5:double,gflops:double,fine_tune_dataset:string,fine_tune_epochs:int,fine_tune_resolution:int,intermediate_fine_tune_dataset:string,intermediate_fine_tune_epochs:int,intermediate_fine_tune_resolution:int,{_LINKS}>>"
_TRAIN = "head:string,dataset:string,train_dataset:string,train_epochs:int,intermediate_train_dataset:string,intermediate_train_epochs:int,gflops:double"
_INSTANCE = f"array<struct<{_TRAIN},instance_type:string,mAP:double,AP50:double,AP75:double,mAPs:double,mAPm:double,mAPl:double,fps_measurements:{_FPS},{_LINKS}>>"
_SEMANTIC = f"array<struct<{_TRAIN},crop_size:int,train_resolution:int,ms_m_iou:double,ms_pixel_accuracy:double,ms_mean_accuracy:double,ss_m_iou:double,ss_pixel_accuracy:double,ss_mean_accuracy:double,flip_test:boolean,fps_measurements:{_FPS},{_LINKS}>>"
_PB = f"array<struct<name:string,pretrain_dataset:string,pretrain_method:string,pretrain_resolution:int,pretrain_epochs:int,{_LINKS},classification_results:{_CLASSIFICATION},instance_results:{_INSTANCE},semantic_seg_results:{_SEMANTIC}>>"
_BACKBONE = f"array<struct<name:string,m_parameters:double,{_LINKS},fps_measurements:{_FPS},pretrained_backbones:{_PB}>>"
DOCUMENT = f"struct<name:string,model_type:string,hierarchical:boolean,pretrain_method:string,pub_date:string,{_LINKS},backbones:{_BACKBONE}>"

_MENTIONS = "array<struct<kind:string,name:string,task:string,used:boolean>>"

#: Fixed values.
ENUMS = {
    "pretrain_method": ("Supervised", "Sup. + TL", "FCMAE", "MAE", "CL", "MAP"),
    "model_type": ("Attention", "Convolution", "LSTM", "State Space Model", "Attn + Conv", "Conv + SSM", "Random", "Identity"),
    "gpu": ("V100", "A100", "H100", "T4", "2080Ti", "3080", "3090", "4090", "L40S"),
    "precision": ("FP16", "FP32", "INT8", "AMP", "TF32", "BF16"),
}
TASKS = ("Classification", "Object Detection", "Instance Segmentation", "Semantic Segmentation", "Panoptic Segmentation")


def document_path(name: str) -> str:
    """With or without its suffix."""
    return name if ".yml" in name else f"{name}.yml"


def read_json(spark: SparkSession, texts: DataFrame, column: str = "value", keep: bool = False) -> DataFrame:
    """One nested document a row, from JSON texts, and with keep its text. What doesn't parse has a null name (see malformed)."""
    parsed = texts.select(column, F.from_json(column, DOCUMENT, {"allowNonNumericNumbers": "true"}).alias("d"))
    return parsed.select("d.*", *([column] if keep else []))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """The documents of YAML files that have one, read whole by Spark; numbers and dates become what the schema says."""

    def run(batches):
        for pdf in batches:
            yield pdf[["value"]].assign(value=[parsed(x.encode(), True)[0] for x in pdf["value"]])

    return read_json(spark, spark.read.text(path, wholetext=True).mapInPandas(run, "value string"))


def read_folder(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder (see files), and file, reason of the files that have none."""
    found = read_files(spark, path, **options)
    return read_json(spark, found.filter("reason IS NULL").select("value")), found.filter("reason IS NOT NULL").select("file", "reason")


def malformed(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("name").isNull() | F.col("backbones").isNull())


def _uncropped(permissive: bool) -> Column:
    """Semantic results lack crop_size; permissive, its older name train_resolution will do."""
    crop = "coalesce(s.crop_size, s.train_resolution)" if permissive else "s.crop_size"
    return F.expr(f"exists(backbones, b -> exists(coalesce(b.pretrained_backbones, array()), p -> exists(coalesce(p.semantic_seg_results, array()), s -> {crop} IS NULL)))")


def refused(docs: DataFrame, permissive: bool = False) -> Column:
    """Why a document can't be shredded, else null."""
    return F.when(F.col("name").isNull() | F.col("backbones").isNull(), "malformed").when(F.coalesce(_uncropped(permissive), F.lit(False)), "crop_size")


def key(*parts) -> Column:
    """A deterministic id of what names a row."""
    return F.xxhash64(*parts)


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[-1])


def _each(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row an element of an array of structs, which may be missing; `place` is its place."""
    return rows.select(*keep, F.posexplode(column).alias("place", "e")).select(*keep, "place", "e.*")


def shred(docs: DataFrame, permissive: bool = False, owners: bool = False, keep: bool = False) -> dict[str, DataFrame]:
    """Nested documents -> relational tables and bridges, with deterministic keys.

    Documents that refused() names are left out as a whole: load() and the
    stream report them. Permissive, train_resolution stands for crop_size. With
    owners every table but the dimensions says its rows' family_id. With keep
    what the documents name, as large as the dimensions, is written once, for
    all tables and joins that ask for it; else each reads the documents again.
    """
    own = ("family_id",) if owners else ()
    docs = docs.filter(refused(docs, permissive).isNull())
    t: dict[str, DataFrame] = {}
    t["family"] = docs.select(key("name").alias("family_id"), "name", "model_type", "hierarchical", "pretrain_method", F.to_date("pub_date").alias("pub_date"), _blank("paper"), _blank("github"))
    b = _each(docs.select(key("name").alias("family_id"), "backbones"), "backbones", "family_id").withColumn("backbone_id", key("name")).drop("place")
    t["backbone"] = b.select("backbone_id", "name", "family_id", "m_parameters", _blank("paper"), _blank("github"))
    p = _each(b.select("family_id", "backbone_id", "pretrained_backbones"), "pretrained_backbones", "family_id", "backbone_id").withColumn("pb_id", key("name")).drop("place")
    named = lambda c: F.when(F.col(c).isNotNull(), key(c)).alias(f"{c}_id", metadata={"refers_to": "head" if c == "head" else "task" if c == "instance_type" else "dataset"})
    t["pretrained_backbone"] = p.select("pb_id", "name", "backbone_id", "family_id", named("pretrain_dataset"), "pretrain_method", "pretrain_resolution", "pretrain_epochs", _blank("paper"), _blank("github"))
    c = _each(p.select("pb_id", *own, "classification_results"), "classification_results", "pb_id", *own).withColumn("result_id", key(F.lit("c"), "pb_id", "place"))
    i = _each(p.select("pb_id", *own, "instance_results"), "instance_results", "pb_id", *own).withColumn("result_id", key(F.lit("i"), "pb_id", "place"))
    s = _each(p.select("pb_id", *own, "semantic_seg_results"), "semantic_seg_results", "pb_id", *own).withColumn("result_id", key(F.lit("s"), "pb_id", "place"))
    if permissive:
        s = s.withColumn("crop_size", F.coalesce("crop_size", "train_resolution"))
    t["classification_result"] = c.select("result_id", "pb_id", *own, "place", named("dataset"), "resolution", named("fine_tune_dataset"), "fine_tune_epochs", "fine_tune_resolution", named("intermediate_fine_tune_dataset"), "intermediate_fine_tune_epochs", "intermediate_fine_tune_resolution", "top_1", "top_5", "gflops", _blank("paper"), _blank("github"))
    train = ("train_epochs", "intermediate_train_epochs", "gflops")
    refs = lambda: (named("head"), named("dataset"), named("train_dataset"), named("intermediate_train_dataset"))
    t["instance_result"] = i.select("result_id", "pb_id", *own, "place", *refs(), named("instance_type"), *train, "mAP", "AP50", "AP75", "mAPs", "mAPm", "mAPl", _blank("paper"), _blank("github"))
    scores = [f"{a}_{m}" for a in ("ms", "ss") for m in ("m_iou", "pixel_accuracy", "mean_accuracy")]
    t["semantic_result"] = s.select("result_id", "pb_id", *own, "place", *refs(), *train, "crop_size", *scores, F.coalesce("flip_test", F.lit(False)).alias("flip_test"), _blank("paper"), _blank("github"))
    measured = {"backbone": (b, "backbone_id"), "instance": (i, "result_id"), "semantic": (s, "result_id")}
    every = []
    for name, (rows, owner) in measured.items():
        m = rows.select(F.col(owner).alias("owner"), *own, "fps_measurements")
        m = _each(m, "fps_measurements", "owner", *own).withColumn("fps_id", key(F.lit(name), "owner", "place"))
        every.append(m.select("fps_id", *own, "resolution", "fps", "gpu", "precision", _blank("source")))
        t[f"{name}_fps"] = m.select(F.col("owner").alias(owner), "fps_id", *own)
    t["fps_measurement"] = reduce(DataFrame.unionByName, every)
    # dimensions are what the documents name; which tasks they serve is where they are used
    one = lambda kind, name, task=None: F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(None).cast("string") if task is None else task).alias("task"), F.lit(task is not None).alias("used"))
    also = lambda r, *names: (one("dataset", r[x]) for x in names)
    semantic = F.lit("Semantic Segmentation")
    of = {
        "classification_results": lambda r: F.array(one("dataset", r["dataset"], F.lit("Classification")), *also(r, "fine_tune_dataset", "intermediate_fine_tune_dataset")),
        "instance_results": lambda r: F.array(one("dataset", r["dataset"], r["instance_type"]), one("head", r["head"], r["instance_type"]), *also(r, "train_dataset", "intermediate_train_dataset")),
        "semantic_seg_results": lambda r: F.array(one("dataset", r["dataset"], semantic), one("head", r["head"], semantic), *also(r, "train_dataset", "intermediate_train_dataset")),
    }
    own_names = F.array(one("dataset", F.col("pretrain_dataset")))
    named_in = [own_names] + [F.coalesce(F.flatten(F.transform(F.filter(x, lambda r: r.isNotNull()), f)), F.array().cast(_MENTIONS)) for x, f in of.items()]
    mentions = p.select(F.inline(F.concat(*named_in))).distinct()
    mentions = kept(mentions) if keep else mentions
    uses = mentions.filter("kind = 'dataset' AND used").select(F.col("name").alias("dataset"), "task")
    t["dataset"] = mentions.filter("kind = 'dataset' AND name IS NOT NULL").groupBy("name").agg(F.max("used").alias("eval")).select(key("name").alias("dataset_id"), "name", "eval", F.lit("").alias("website"))
    heads = mentions.filter("kind = 'head' AND name IS NOT NULL").select(F.col("name").alias("head"), "task")
    t["head"] = heads.select("head").distinct().select(key("head").alias("head_id"), F.col("head").alias("name"), F.lit("").alias("paper"), F.lit("").alias("github"))
    tasks = uses.select("task").filter("task IS NOT NULL").distinct()
    t["task"] = tasks.select(key("task").alias("task_id"), F.col("task").alias("name"))
    t["dataset_task"] = uses.select(key("dataset").alias("dataset_id"), key("task").alias("task_id"))
    t["head_task"] = heads.select(key("head").alias("head_id"), key("task").alias("task_id"))
    return with_references(t)


def with_references(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables whose columns say what they refer to (see schema_text)."""
    for name, columns in REFERENCES.items():
        for column, (relation, to) in columns.items():
            t[name] = t[name].withMetadata(column, {"refers_to": to, "relation": relation})
    return t


def columns_without_owner(schemas: Mapping[str, T.StructType]) -> dict[str, list[str]]:
    """Columns of shred()'s tables without owners, from their schemas with them."""
    keep = ("family", "backbone", "pretrained_backbone")
    return {n: [c for c in s.names if n in keep or c != "family_id"] for n, s in schemas.items()}


#: What columns of the tables refer to: one of them (FK), or as a bridge many (M2M).
REFERENCES = {
    "backbone": {"family_id": ("FK", "family")},
    "pretrained_backbone": {"family_id": ("FK", "family"), "backbone_id": ("FK", "backbone")},
    "classification_result": {"pb_id": ("FK", "pretrained_backbone")},
    "instance_result": {"pb_id": ("FK", "pretrained_backbone")},
    "semantic_result": {"pb_id": ("FK", "pretrained_backbone")},
    "backbone_fps": {"fps_id": ("M2M", "fps_measurement")},
    "instance_fps": {"fps_id": ("M2M", "fps_measurement")},
    "semantic_fps": {"fps_id": ("M2M", "fps_measurement")},
    "dataset_task": {"task_id": ("M2M", "task")},
    "head_task": {"task_id": ("M2M", "task")},
}


# ---- data-quality rules: rows (rule, key)


def _violations(rows: DataFrame, name: str | Column, rule: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), (F.col(name) if isinstance(name, str) else name).cast("string").alias("key"))


def repeated(rows: DataFrame, name: str, rule: str) -> DataFrame:
    return _violations(rows.groupBy(name).count().filter("count > 1"), name, rule)


def outside(rows: DataFrame, name: str, column: str, values: Iterable[str], rule: str) -> DataFrame:
    """Not null and none of the values."""
    return _violations(rows.filter(~F.col(column).isin(list(values))), name, rule)


def absent(rows: DataFrame, name: str, columns: Sequence[str], rule: str) -> DataFrame:
    return _violations(rows.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))), name, rule)


def all_missing(rows: DataFrame, name: str, columns: Sequence[str], rule: str) -> DataFrame:
    """None of the columns says anything; zero and blank say nothing."""
    return _violations(rows.filter(reduce(lambda a, b: a & b, (missing(rows, c) for c in columns))), name, rule)


def missing(rows: DataFrame, column: str) -> Column:
    nothing = F.lit("") if isinstance(rows.schema[column].dataType, T.StringType) else F.lit(0)
    return F.coalesce(F.col(column), nothing) == nothing


def not_together(rows: DataFrame, name: str, a: str, b: str, rule: str) -> DataFrame:
    """One is null and the other isn't."""
    return _violations(rows.filter(F.col(a).isNull() != F.col(b).isNull()), name, rule)


def without(rows: DataFrame, name: str, other: DataFrame, other_name: str, rule: str, reference: str | None = None) -> DataFrame:
    """References (a column of rows; their names themselves if none is given) that nothing answers to; null refers to nothing."""
    at = reference or name
    found = other.select(F.col(other_name).alias(at)).distinct()
    return _violations(rows.filter(F.col(at).isNotNull()).join(found, at, "left_anti"), name, rule)


def by_family(t: Mapping[str, DataFrame], broken: DataFrame) -> DataFrame:
    """family, rule, key: violations with the name of the document that they are in."""
    families = t["family"].select("family_id", F.col("name").alias("family"))
    if "family_id" in t["classification_result"].columns:  # tables with owners say it themselves
        named = [t[x].select("family_id", F.col("name").alias("key")) for x in ("family", "backbone", "pretrained_backbone")]
        owners = named + [t[f"{x}_result"].select("family_id", F.col("result_id").cast("string").alias("key")) for x in ("classification", "instance", "semantic")]
        owners.append(t["fps_measurement"].select("family_id", F.col("fps_id").cast("string").alias("key")))
        return broken.distinct().join(reduce(DataFrame.unionByName, owners), "key").join(families, "family_id").select("family", "rule", "key").distinct()
    pbs = t["pretrained_backbone"].select("pb_id", "family_id")
    owners = [t[x].select("family_id", F.col("name").cast("string").alias("key")) for x in ("family", "backbone", "pretrained_backbone")]
    results = {x: t[f"{x}_result"].join(pbs, "pb_id").select("family_id", "result_id") for x in ("classification", "instance", "semantic")}
    owners += [r.select("family_id", F.col("result_id").cast("string").alias("key")) for r in results.values()]
    owners += [t[f"{x}_fps"].join(results[x], "result_id").select("family_id", F.col("fps_id").cast("string").alias("key")) for x in ("instance", "semantic")]
    owners.append(t["backbone_fps"].join(t["backbone"].select("backbone_id", "family_id"), "backbone_id").select("family_id", F.col("fps_id").cast("string").alias("key")))
    return broken.join(reduce(DataFrame.unionByName, owners).distinct(), "key").join(families, "family_id").select("family", "rule", "key").distinct()


def rejected(docs: DataFrame, permissive: bool = False, dimensions: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """family, reason of documents that may not be loaded: what can't be shredded, and what breaks rules, document by document."""
    why = docs.select(F.col("name").alias("family"), refused(docs, permissive).alias("reason")).filter("reason IS NOT NULL")
    t = shred(docs, permissive, owners=True)
    broken = by_family(t, violations(t, dimensions=dimensions)).groupBy("family").agg(F.array_join(F.sort_array(F.collect_set("rule")), ", ").alias("reason"))
    return why.unionByName(broken)


def flawless(docs: DataFrame, permissive: bool = False, dimensions: Mapping[str, DataFrame] | None = None) -> bool:
    """Whether all documents may be loaded; which may not, and why, is asked of rejected() only where this is false."""
    if docs.filter(refused(docs, permissive).isNotNull()).limit(1).count():
        return False
    return not violations(shred(docs, permissive), dimensions=dimensions).limit(1).count()


def sorted_out(docs: DataFrame, permissive: bool = False, dimensions: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents that may be loaded, and family, reason of the others (written once, for both uses)."""
    rejects = kept(rejected(docs, permissive, dimensions))
    good = docs.filter(refused(docs, permissive).isNull()).join(rejects.filter("family IS NOT NULL").select(F.col("family").alias("name")).distinct(), "name", "left_anti").select(*docs.columns)
    return good, rejects


def _listed(rows: DataFrame, name: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """rule, key of rows that break rules (name, condition), all in one pass."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in rules)))
    return rows.select(F.explode(broken).alias("rule"), F.col(name).cast("string").alias("key")).distinct()


def unknown(t: Mapping[str, DataFrame], dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """rule, key of what names a dataset, head or task that the given dimensions (name) don't have."""
    asked = []
    for table, name, columns in (("classification_result", "result_id", ("dataset", "fine_tune_dataset", "intermediate_fine_tune_dataset")), ("instance_result", "result_id", ("dataset", "train_dataset", "intermediate_train_dataset", "head", "instance_type")), ("semantic_result", "result_id", ("dataset", "train_dataset", "intermediate_train_dataset", "head")), ("pretrained_backbone", "name", ("pretrain_dataset",))):
        named = F.array(*(F.struct(F.lit({"head": "head", "instance_type": "task"}.get(c, "dataset")).alias("kind"), F.col(f"{c}_id").alias("id")) for c in columns))
        asked.append(t[table].select(F.col(name).cast("string").alias("key"), F.inline(named)))
    known = reduce(DataFrame.unionByName, (dimensions[k].select(F.lit(k).alias("kind"), key("name").alias("id")) for k in ("dataset", "head", "task")))
    lost = reduce(DataFrame.unionByName, asked).filter("id IS NOT NULL").join(known, ["kind", "id"], "left_anti")
    return lost.select(F.concat(F.lit("J10 "), "kind").alias("rule"), "key").distinct()


def violations(t: Mapping[str, DataFrame], enums: Mapping[str, Iterable[str]] = ENUMS, dimensions: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """rule, key of everything in shredded tables that breaks a rule; empty tables break none.

    With dimensions (dataset, head, task: name; dataset_task: dataset, task)
    what they don't know is a violation, and datasets serve the tasks they say;
    without, the documents' own names are all there is.
    """
    c, i, s = t["classification_result"], t["instance_result"], t["semantic_result"]
    out = [repeated(t[x], "name", f"K1 {x}") for x in ("family", "backbone", "pretrained_backbone")]
    null = lambda columns: reduce(lambda a, b: a | b, (F.col(x).isNull() for x in columns))
    nothing = lambda rows, columns: reduce(lambda a, b: a & b, (missing(rows, x) for x in columns))
    apart = lambda a, b: F.col(a).isNull() != F.col(b).isNull()
    odd = lambda rows: [("K8", F.col(x).isNotNull() & ~F.col(x).isin(list(values))) for x, values in enums.items() if x in rows.columns]

    def tuned(p):
        has, res, ep = F.col(f"{p}_dataset_id").isNotNull(), missing(c, f"{p}_resolution"), missing(c, f"{p}_epochs")
        return (has & res) | (~has & (~res | ~ep))

    out.append(_listed(t["family"], "name", [("K2", nothing(t["family"], ("paper", "github"))), *odd(t["family"])]))
    out.append(_listed(t["pretrained_backbone"], "name", [*odd(t["pretrained_backbone"]), ("K10", null(("pretrain_dataset_id", "pretrain_method", "pretrain_resolution", "pretrain_epochs")))]))
    out.append(_listed(t["fps_measurement"], "fps_id", odd(t["fps_measurement"])))
    out.append(_listed(c, "result_id", [("K3", tuned("fine_tune")), ("K4", tuned("intermediate_fine_tune")), ("K10", null(("dataset_id", "resolution", "top_1")))]))
    need = ("head_id", "dataset_id", "train_dataset_id", "train_epochs")
    out.append(_listed(i, "result_id", [("K5", apart("intermediate_train_dataset_id", "intermediate_train_epochs")), ("K10", null((*need, "instance_type_id", "mAP")))]))
    out.append(_listed(s, "result_id", [("K6", nothing(s, ("ms_m_iou", "ss_m_iou"))), ("K7", apart("intermediate_train_dataset_id", "intermediate_train_epochs")), ("K10", null((*need, "crop_size")))]))
    if dimensions:
        out.append(unknown(t, dimensions))
        served = dimensions["dataset_task"].select(key("dataset").alias("dataset_id"), key("task").alias("task_id"))
        uses = ((c, key(F.lit("Classification"))), (i, F.col("instance_type_id")), (s, key(F.lit("Semantic Segmentation"))))
        asked = reduce(DataFrame.unionByName, (rows.select("result_id", "dataset_id", task.alias("task_id")) for rows, task in uses))
        lost = asked.filter("dataset_id IS NOT NULL AND task_id IS NOT NULL").join(served, ["dataset_id", "task_id"], "left_anti")
        out.append(_violations(lost, "result_id", "K9"))
    return reduce(DataFrame.unionByName, out)


# ---- nesting


def nest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """A row a key with its rows' columns as a sorted array of structs."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def _hung(parent: DataFrame, key_: str, kids: DataFrame, name: str) -> DataFrame:
    """parent with its kids (key_, and the struct's columns, in order of place) as an array that is empty where it has none."""
    columns = [c for c in kids.columns if c != key_]
    listed = kids.groupBy(key_).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    kind = listed.schema[name].dataType
    drop = F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in columns if c != "place"))) if "place" in columns else F.col(name)
    out = parent.join(listed, key_, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return out.withColumn(name, drop)


def unshred(t: Mapping[str, DataFrame]) -> DataFrame:
    """Relational tables -> nested documents, a row a family; the inverse of shred, but for links of versions and results and the measurements' sources."""
    names = t["dataset"].select(F.col("dataset_id").alias("__i"), F.col("name").alias("__n"))
    heads = t["head"].select(F.col("head_id").alias("__i"), F.col("name").alias("__n"))
    tasks = t["task"].select(F.col("task_id").alias("__i"), F.col("name").alias("__n"))

    def name(rows, column, dim=names):
        return rows.join(dim.withColumnRenamed("__i", f"{column}_id"), f"{column}_id", "left").withColumnRenamed("__n", column).drop(f"{column}_id")

    fps = t["fps_measurement"].select("fps_id", "resolution", "gpu", "precision", "fps")
    of = lambda n, k: t[f"{n}_fps"].join(fps, "fps_id").drop("fps_id").select(k, "resolution", "gpu", "precision", "fps")
    c = reduce(name, ("dataset", "fine_tune_dataset", "intermediate_fine_tune_dataset"), t["classification_result"])
    c = c.select("pb_id", "place", "dataset", "resolution", "top_1", "top_5", "gflops", "fine_tune_dataset", "fine_tune_epochs", "fine_tune_resolution", "intermediate_fine_tune_dataset", "intermediate_fine_tune_epochs", "intermediate_fine_tune_resolution")
    i = reduce(name, ("dataset", "train_dataset", "intermediate_train_dataset"), t["instance_result"])
    i = name(name(i, "head", heads), "instance_type", tasks)
    i = _hung(i, "result_id", of("instance", "result_id"), "fps_measurements").select("pb_id", "place", "head", "dataset", "instance_type", "train_dataset", "train_epochs", "mAP", "AP50", "AP75", "mAPs", "mAPm", "mAPl", "gflops", "intermediate_train_dataset", "intermediate_train_epochs", "fps_measurements")
    s = name(reduce(name, ("dataset", "train_dataset", "intermediate_train_dataset"), t["semantic_result"]), "head", heads)
    scores = [f"{a}_{m}" for a in ("ms", "ss") for m in ("m_iou", "pixel_accuracy", "mean_accuracy")]
    s = _hung(s, "result_id", of("semantic", "result_id"), "fps_measurements").select("pb_id", "place", "head", "dataset", "train_dataset", "train_epochs", "crop_size", *scores, "flip_test", "gflops", "intermediate_train_dataset", "intermediate_train_epochs", "fps_measurements")
    p = name(t["pretrained_backbone"], "pretrain_dataset")
    for kids, n in ((c, "classification_results"), (i, "instance_results"), (s, "semantic_seg_results")):
        p = _hung(p, "pb_id", kids, n)
    p = p.select("backbone_id", "name", "pretrain_dataset", "pretrain_method", "pretrain_resolution", "pretrain_epochs", "classification_results", "instance_results", "semantic_seg_results")
    b = _hung(t["backbone"], "backbone_id", of("backbone", "backbone_id"), "fps_measurements")
    b = _hung(b, "backbone_id", p, "pretrained_backbones").select("family_id", "name", "m_parameters", "paper", "github", "fps_measurements", "pretrained_backbones")
    f = _hung(t["family"].withColumn("pub_date", F.date_format("pub_date", "yyyy-MM-dd")), "family_id", b, "backbones")
    return f.select("name", "model_type", "hierarchical", "pretrain_method", "pub_date", "paper", "github", "backbones")


def write_json(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder a family, fields in the schema's order."""
    docs.withColumn("family", F.col("name")).write.mode(mode).partitionBy("family").json(path)


def to_yaml(docs: DataFrame) -> Iterable[tuple[str, str]]:
    """Name and YAML text of each document, keys in the schema's order; documents come to the driver one by one."""
    import yaml

    for row in docs.toLocalIterator():
        yield row["name"], yaml.dump(row.asDict(recursive=True), sort_keys=False, allow_unicode=True)


def write_text(rows: DataFrame, path: str) -> None:
    """Lines, into a folder that must not exist."""
    rows.write.mode("errorifexists").text(path)


# ---- differences


def element_key(e: Column, names: Iterable[str], keys: Sequence[str] | None = None) -> Column:
    """What names an element of a list: its name; else gpu, precision and resolution; else dataset, head and mAP; else dataset, resolution, fine-tuning dataset and top_1; an element without these fields has no name."""
    have = set(names)
    if keys is None:
        rules = (("name",), ("gpu", "precision", "resolution"), ("dataset", "head", "mAP"), ("dataset", "resolution", "fine_tune_dataset", "top_1"))
        keys = next((r for first, r in zip(("name", "gpu", "mAP", "top_1"), rules) if first in have and have >= set(r)), ())
    return F.concat_ws("+", *(F.coalesce(e[k].cast("string"), F.lit("None")) for k in keys)) if keys else F.lit("")


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def canonical(docs: DataFrame) -> DataFrame:
    """docs with the fields of all levels by name, and all lists of structs by their elements' keys (equal keys keep their order)."""

    def ordered(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = sorted(kind.fields, key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*(ordered(c[f.name], f.dataType).alias(f.name) for f in fields)))
        if not _nested(kind):
            return c
        inner = kind.elementType
        keyed = F.transform(c, lambda e, i: F.struct(element_key(e, inner.names).alias("k"), i.alias("i"), ordered(e, inner).alias("e")))
        return F.transform(F.array_sort(keyed, lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(x["i"] - y["i"])), lambda x: x["e"])

    return docs.select(*(ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(docs.schema.fields, key=lambda f: f.name)))


def flatten(docs: DataFrame, name: str, arrays: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """path, value rows of documents, down to every leaf: elements of lists of structs are named by element_key(), or by the fields given for their list, others by their place."""
    rows: list[DataFrame] = []
    leaf = lambda kind: not isinstance(kind, (T.ArrayType, T.StructType))
    under = lambda *parts: F.concat_ws("/", "p", *parts).alias("p")

    def walk(d: DataFrame, kind: T.DataType, field: str) -> None:
        if leaf(kind):
            rows.append(d.select(F.col("p").alias("path"), F.col("e").cast("string").alias("value")))
        elif isinstance(kind, T.StructType):
            scalars = [f.name for f in kind.fields if leaf(f.dataType)]
            if scalars:
                part = lambda x: F.struct(F.concat_ws("/", "p", F.lit(x)).alias("path"), F.col(f"e.`{x}`").cast("string").alias("value"))
                rows.append(d.select(F.inline(F.array(*map(part, scalars)))))
            for f in kind.fields:
                if not leaf(f.dataType):
                    walk(d.select(under(F.lit(f.name)), F.col(f"e.`{f.name}`").alias("e")), f.dataType, f.name)
        else:
            inner = kind.elementType
            own = element_key(F.col("e"), inner.names, (arrays or {}).get(field)) if isinstance(inner, T.StructType) else F.col("at").cast("string")
            walk(d.select("p", F.posexplode("e").alias("at", "e")).select(under(own), "e"), inner, field)

    walk(docs.select(F.col(name).cast("string").alias("p"), F.struct(*docs.columns).alias("e")), docs.schema, "")
    return reduce(DataFrame.unionByName, rows).filter("value IS NOT NULL")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """sign, path, value: rows taken away (-) and added (+), as bags."""
    minus, plus = old.exceptAll(new), new.exceptAll(old)
    sign = lambda s, d: d.select(F.lit(s).alias("sign"), "path", "value")
    return sign("-", minus).unionByName(sign("+", plus))


def diff_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """changed, lines (of the longer), percent (may exceed 100; 0 of nothing)."""
    parts = [rows.select(F.lit(k).alias("of")) for k, rows in (("a", old), ("b", new), ("c", diff(old, new)))]
    n = {k: F.count_if(F.col("of") == k) for k in "abc"}
    counted = reduce(DataFrame.unionByName, parts).agg(n["c"].alias("changed"), F.greatest(n["a"], n["b"]).alias("lines"))
    return counted.select("changed", "lines", F.coalesce(F.try_divide(100.0 * F.col("changed"), F.col("lines")), F.lit(0.0)).alias("percent"))


def schema_text(df: DataFrame) -> str:
    """A line a column: name and type, and what it refers to where the column's metadata says so."""
    lines = []
    for f in df.schema.fields:
        to = f.metadata.get("refers_to")
        lines.append(f"{f.name} ({f.metadata.get('relation', 'FK')} to {to})" if to else f"{f.name}: {f.dataType.simpleString()}")
    return "\n".join(lines)


def examples(paths: Sequence[str], k: int, family: str) -> list[str]:
    """The first k document paths but those of drafts (with an underscore) and of the family itself."""
    stem = lambda p: p.rsplit("/", 1)[-1].removesuffix(".yml")
    return [p for p in sorted(paths) if p.endswith(".yml") and "_" not in stem(p) and stem(p) != family][:k]


def prompt(template: str, **parts: str) -> str:
    """The template with `{name}` replaced by each part; other braces stay."""
    return reduce(lambda t, kv: t.replace("{" + kv[0] + "}", kv[1]), parts.items(), template)
