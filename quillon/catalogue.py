"""The engine's roles, bound to any tables: trained versions, facts by kind, speed measurements, dimensions.

Canonical columns of a trained version (pb): pb_id, name, backbone_id,
backbone, family, m_parameters, pub_date, pretrain_dataset, pretrain_method,
pretrain_epochs. Of a fact: pb_id, dataset, head, instance_type, resolution,
train_dataset, train_epochs, gflops and its kind's metrics. Of a measurement:
fps_id, owner, gpu, precision, resolution, fps.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = {
    "classification": ("top_1", "top_5"),
    "instance": ("mAP", "AP50", "AP75", "mAPs", "mAPm", "mAPl"),
    "semantic": ("ms_m_iou", "ms_pixel_accuracy", "ms_mean_accuracy", "ss_m_iou", "ss_pixel_accuracy", "ss_mean_accuracy"),
}

#: What axes and metrics are called.
AXIS_TITLES = {"results": "Results", "m_parameters": "Parameters (M)", "fps": "Images / Second", "gflops": "GFLOPs", "pub_date": "Publication Date"}
METRIC_TITLES = {"top_1": "Top-1", "top_5": "Top-5"}
ERROR_TITLES = {"-C": "mCE&darr;", "-C-bar": "CE&darr;"}
MEANS = {"m_iou": "mIoU", "pixel_accuracy": "pAcc", "mean_accuracy": "mAcc"}
PRECISIONS = {"mAP": ("mAP", ""), "AP50": ("AP", "50"), "AP75": ("AP", "75"), "mAPs": ("mAP", "s"), "mAPm": ("mAP", "m"), "mAPl": ("mAP", "l")}
MARKS = {"Object Detection": "b", "Instance Segmentation": "m"}
LEGENDS = {"family": "Family", "pretrain_dataset": "Pretrain Dataset", "pretrain_method": "Pretrain Method"}
KIND_LEGENDS = {
    "classification": {"classification.resolution": "Classification Resolution"},
    "instance": {"instance.head": "Instance Head", "instance.train_epochs": "Instance Training Epochs"},
    "semantic": {"semantic.head": "Semantic Segmentation Head", "semantic.crop_size": "Semantic Segmentation Resolution", "semantic.train_epochs": "Semantic Segmentation Training Epochs"},
}
RESOLUTIONS = {"classification": {224: "224x224", 384: "384x384", 512: "512x512"}, "semantic": {512: "512x2048", 640: "640x2560"}}


def axis_title(attribute: str, task: str | None = None, dataset: str | None = None) -> str:
    """What an axis or a metric is called for a task on a dataset, with its markup; what isn't known is called by its name."""
    if attribute in METRIC_TITLES:
        ending = next((e for e in ("-C-bar", "-C") if dataset and dataset.endswith(e)), None)
        return ERROR_TITLES[ending] if ending and attribute == "top_1" else METRIC_TITLES[attribute]
    if attribute in PRECISIONS:
        name, below = PRECISIONS[attribute]
        above = MARKS.get(task or "")
        if above and below:
            return f"{name}<span class='supsub'><sup>{above}</sup><sub>{below}</sub></span>"
        return name + (f"<sup>{above}</sup>" if above else f"<sub>{below}</sub>" if below else "")
    way, _, mean = attribute.partition("_")
    return f"{MEANS[mean]}<sup>{way}</sup>" if mean in MEANS else AXIS_TITLES.get(attribute, attribute)


@dataclass(frozen=True)
class Measurements:
    """rows and the fact or pb column that owns them; by_resolution: the fact's resolution must be the measurement's."""

    rows: DataFrame
    owner: str
    by_resolution: bool


@dataclass(frozen=True)
class Catalogue:
    pbs: DataFrame
    facts: Mapping[str, DataFrame]
    measurements: Mapping[str, Measurements]
    metrics: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: METRICS)
    #: dataset (name, eval), head (name), task (name), dataset_task (dataset, task), head_task (head, task)
    dimensions: Mapping[str, DataFrame] = field(default_factory=dict)
    #: The pretraining method that is shown in short.
    plain_method: str = "Supervised"

    #: All facts as one frame, where the kinds are parts of one.
    whole: DataFrame | None = None

    def fact(self, kind: str) -> DataFrame:
        return self.facts[kind]

    def every_fact(self) -> DataFrame:
        """Facts of all kinds, with the columns that all have."""
        if self.whole is not None:
            return self.whole
        parts = list(self.facts.values())
        shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        return reduce(DataFrame.unionByName, (p.select(*shared) for p in parts))


def lookup(rows: DataFrame, key: str, dim: DataFrame, id_: str, **names: str) -> DataFrame:
    """rows with columns of a dimension, left as N:1; a null key gives nulls. Spark broadcasts a small dimension by itself."""
    d = dim.select(F.col(id_).alias(key), *(F.col(c).alias(a) for a, c in names.items()))
    return rows.join(d, key, "left")


def from_tables(t: Mapping[str, DataFrame]) -> Catalogue:
    """A catalogue of the relational tables that sources.documents makes."""
    family = t["family"].select("family_id", F.col("name").alias("family"), "model_type", "hierarchical", F.col("pub_date"), F.col("paper").alias("family_paper"), F.col("github").alias("family_github"))
    backbone = t["backbone"].select("backbone_id", F.col("name").alias("backbone"), "m_parameters", F.col("paper").alias("backbone_paper"), F.col("github").alias("backbone_github"))
    pb = t["pretrained_backbone"].withColumnRenamed("paper", "pb_paper").withColumnRenamed("github", "pb_github")
    pb = pb.join(family, "family_id").join(backbone, "backbone_id")
    pb = lookup(pb, "pretrain_dataset_id", t["dataset"], "dataset_id", pretrain_dataset="name")
    datasets, heads, tasks = t["dataset"], t["head"], t["task"]
    c = lookup(t["classification_result"], "dataset_id", datasets, "dataset_id", dataset="name")
    c = lookup(c, "fine_tune_dataset_id", datasets, "dataset_id", fine_tune_dataset="name")
    c = lookup(c, "intermediate_fine_tune_dataset_id", datasets, "dataset_id", intermediate_fine_tune_dataset="name")

    def downstream(f: DataFrame) -> DataFrame:
        f = lookup(f, "dataset_id", datasets, "dataset_id", dataset="name")
        f = lookup(f, "head_id", heads, "head_id", head="name")
        f = lookup(f, "train_dataset_id", datasets, "dataset_id", train_dataset="name")
        return lookup(f, "intermediate_train_dataset_id", datasets, "dataset_id", intermediate_train_dataset="name")

    i = lookup(downstream(t["instance_result"]), "instance_type_id", tasks, "task_id", instance_type="name")
    s = downstream(t["semantic_result"])
    fps = t["fps_measurement"].select("fps_id", "gpu", "precision", "resolution", "fps")
    of = lambda bridge, key: t[bridge].join(fps, "fps_id").withColumnRenamed(key, "owner")
    measured = {
        "classification": Measurements(of("backbone_fps", "backbone_id"), "backbone_id", True),
        "instance": Measurements(of("instance_fps", "result_id"), "result_id", False),
        "semantic": Measurements(of("semantic_fps", "result_id"), "result_id", False),
    }
    named = {x: t[x].select(F.col(f"{x}_id"), F.col("name").alias(x)) for x in ("dataset", "head", "task")}
    dims = {"dataset": datasets.select("name", "eval"), "head": heads.select("name"), "task": tasks.select("name")}
    dims |= {f"{x}_task": t[f"{x}_task"].join(named[x], f"{x}_id").join(named["task"], "task_id").select(x, "task") for x in ("dataset", "head")}
    return Catalogue(pb, {"classification": c, "instance": i, "semantic": s}, measured, dimensions=dims)
