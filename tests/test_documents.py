import json
import os

import pytest

from quillon.catalogue import from_tables
from quillon.operators import reports as rp
from quillon.plans import comparison as cp
from quillon.request import AxisArgs, DataArgs, Request
from quillon.sources import documents as ds

FPS = {"resolution": 224, "gpu": 3080, "precision": "AMP", "fps": 1000, "batch_size": 8}


def family(name="Fam", **more):
    c = {"dataset": "ImageNet-1k", "resolution": 224, "top_1": 80.5, "top_5": None, "gflops": 4.5}
    fine = {"fine_tune_dataset": "ImageNet-1k", "fine_tune_epochs": 30, "fine_tune_resolution": 384}
    i = {"head": "Mask", "dataset": "COCO", "instance_type": "Object Detection", "train_dataset": "COCO", "train_epochs": 36, "mAP": 46.0, "gflops": None, "fps_measurements": [FPS | {"resolution": 1280, "gpu": "V100"}]}
    s = {"head": "UPer", "dataset": "ADE", "train_dataset": "ADE", "train_epochs": 128, "crop_size": 512, "ms_m_iou": 48.0, "flip_test": True, "gflops": 900.0}
    pb = {"name": f"{name}-S-1k", "pretrain_dataset": "ImageNet-1k", "pretrain_method": "Supervised", "pretrain_resolution": 224, "pretrain_epochs": 300, "classification_results": [c, c | {"resolution": 384, "top_1": 82.0, "gflops": None} | fine], "instance_results": [i], "semantic_seg_results": [s]}
    return {"name": name, "model_type": "Attention", "hierarchical": True, "pretrain_method": "Supervised", "pub_date": "2022-04-15", "paper": "p", "github": "", "backbones": [{"name": f"{name}-S", "m_parameters": 20, "fps_measurements": [FPS, FPS | {"fps": 900}, FPS | {"resolution": 384, "gpu": "V100"}], "pretrained_backbones": [pb]}, {"name": f"{name}-Empty", "m_parameters": 5.0, "pretrained_backbones": []}]} | more


def load(spark, *docs, **kw):
    texts = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    return ds.shred(ds.read_json(spark, texts), **kw)


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, family(), family("Other", pub_date="2024-01-01"))


def test_shred(tables):
    n = {k: t.count() for k, t in tables.items()}
    assert [n[k] for k in ("family", "backbone", "pretrained_backbone", "classification_result", "instance_result", "semantic_result")] == [2, 4, 2, 4, 2, 2]
    assert n["backbone_fps"] == 6 and n["instance_fps"] == 2 and n["fps_measurement"] == 8
    assert {r["gpu"] for r in tables["fps_measurement"].collect()} == {"3080", "V100"}
    assert {r["name"] for r in tables["dataset"].filter("eval").collect()} == {"ImageNet-1k", "COCO", "ADE"}
    assert ds.violations(tables).count() == 0


def test_strict_and_permissive(spark):
    d = family()
    s = d["backbones"][0]["pretrained_backbones"][0]["semantic_seg_results"][0]
    s["train_resolution"] = s.pop("crop_size")
    assert load(spark, d, family("B"))["family"].count() == 1
    t = load(spark, d, family("B"), permissive=True)
    assert t["family"].count() == 2 and t["semantic_result"].filter("crop_size = 512").count() == 2


def test_each_rule(spark):
    def broken(change):
        d = family()
        change(d, d["backbones"][0]["pretrained_backbones"][0])
        return sorted(r["rule"] for r in ds.violations(load(spark, d)).collect())

    def put(kind, **values):
        return lambda d, p: p[kind][0].update(values)

    assert broken(lambda d, p: d.update(paper="", github="")) == ["K2"]
    assert broken(put("classification_results", fine_tune_dataset="X", fine_tune_resolution=0)) == ["K3"]
    assert broken(put("classification_results", intermediate_fine_tune_epochs=3)) == ["K4"]
    assert broken(put("instance_results", intermediate_train_epochs=3)) == ["K5"]
    assert broken(put("semantic_seg_results", ms_m_iou=0)) == ["K6"]
    assert broken(put("semantic_seg_results", intermediate_train_dataset="X")) == ["K7"]
    assert broken(lambda d, p: d.update(pretrain_method="magic")) == ["K8"]
    assert broken(lambda d, p: None) == []
    assert broken(put("classification_results", top_1=None)) == ["K10"]
    assert [r["rule"] for r in ds.violations(load(spark, family(), family())).collect()][:3] == ["K1 family", "K1 backbone", "K1 backbone"]


def test_roundtrip(spark, tables):
    back = {r["name"]: r.asDict(recursive=True) for r in ds.unshred(tables).collect()}["Fam"]

    def same(a, b, path=""):
        for k, v in a.items():
            if k in ("batch_size", "source"):
                continue
            if isinstance(v, list):
                x = sorted(v, key=lambda e: str((e.get("name"), e.get("resolution"), e.get("fps"))))
                y = sorted(b[k], key=lambda e: str((e.get("name"), e.get("resolution"), e.get("fps"))))
                assert len(x) == len(y), path + k
                for e, f in zip(x, y):
                    same(e, f, f"{path}{k}.")
            else:
                assert (str(v) if k == "gpu" else v) == b[k], path + k

    same(family(), back)


def test_catalogue_queries(spark, tables):
    cat = from_tables(tables)
    args = DataArgs("ImageNet-1k", "Classification")
    single = Request(AxisArgs("gflops"), AxisArgs("results", "top_1"), args, args, group_by="family")
    assert sorted(r["key"] for r in cp.points(cat, single).collect()) == ["Fam", "Other"]
    both = DataArgs("ImageNet-1k", "Classification", gpu="3080", precision="AMP")
    fps = cp.points(cat, Request(AxisArgs("fps"), AxisArgs("results", "top_1"), both, both)).collect()
    assert len(fps) == 4 and all(len({r["x"] for r in fps if r["family"] == f}) == 1 for f in ("Fam", "Other"))
    down = DataArgs("COCO", "Object Detection", gpu="V100", precision="AMP")
    assert [r["x"] for r in cp.points(cat, Request(AxisArgs("fps"), AxisArgs("results", "mAP"), down, down, family="Fam")).collect()] == [1000.0]
    multi = Request(AxisArgs("results", "top_1"), AxisArgs("results", "mAP"), args, DataArgs("COCO", "Object Detection"), group_by="classification.resolution", group_by_second="instance.head")
    assert sorted(r["key"] for r in cp.points(cat, multi).collect()) == ["224 / Mask"] * 2 + ["384 / Mask"] * 2
    none = Request(AxisArgs("m_parameters"), AxisArgs("pub_date"))
    assert cp.points(cat, none).count() == 6
    assert cp.with_results(cat, Request(AxisArgs("gflops"), AxisArgs("results", "top_1"), DataArgs("COCO", "Classification", resolution=224), DataArgs())).count() == 0
    assert rp.family_of(cat, "Fam") == rp.family_of(cat, "Fam-S") == "Fam"
    with pytest.raises(LookupError):
        rp.family_of(cat, "nobody")


def test_diff(spark, tmp_path):
    schema = "name string, year int, parts array<struct<name:string,n:int>>"
    a = spark.createDataFrame([("d", 1, [("x", 1), ("y", 2)])], schema)
    b = spark.createDataFrame([("d", 1, [("y", 2), ("x", 3)])], schema)
    flat = lambda d: ds.flatten(d, "name", {"parts": ["name"]})
    assert ds.diff(flat(a), flat(a)).count() == 0
    assert sorted(map(tuple, ds.diff(flat(a), flat(b)).collect())) == [("+", "d/parts/x/n", "3"), ("-", "d/parts/x/n", "1")]
    assert ds.diff_metrics(flat(a), flat(b)).first()["changed"] == 2
    ds.write_text(flat(a).select("path"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        ds.write_text(flat(a).select("path"), str(tmp_path / "out"))


def test_yaml_and_driver_helpers(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text(yaml.dump(family()))
    docs = ds.read_yaml(spark, str(tmp_path / "a.yml"))
    assert ds.shred(docs)["classification_result"].count() == 2
    assert [n for n, _ in ds.to_yaml(docs)] == ["Fam"]
    assert ds.malformed(ds.read_json(spark, spark.createDataFrame([("[1]",)], "value string"))).count() == 1
    assert ds.document_path("x") == ds.document_path("x.yml") == "x.yml"
    assert ds.examples(["d/b.yml", "d/a_draft.yml", "d/a.yml", "d/c.yml", "d/n.txt"], 2, "b") == ["d/a.yml", "d/c.yml"]
    assert ds.prompt("{a} and {b} {c}", a="1", b="2") == "1 and 2 {c}"
    assert "name: string" in ds.schema_text(docs)


def uncropped(name):
    d = family(name)
    d["backbones"][0]["pretrained_backbones"][0]["semantic_seg_results"][0].pop("crop_size")
    return d


def test_what_is_refused(spark):
    docs = lambda *d: ds.read_json(spark, spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in d], "value string"))
    good, rejects = ds.sorted_out(docs(family("A"), uncropped("B"), family("C", paper="", github=""), "[1]"))
    assert [r["name"] for r in good.collect()] == ["A"]
    assert sorted((str(r["family"]), r["reason"]) for r in rejects.collect()) == [("B", "crop_size"), ("C", "K2"), ("None", "malformed")]


def test_given_dimensions(spark):
    """Names that nobody knows, and a dataset that isn't there for a task."""
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    tasks = [("ImageNet-1k", "Classification"), ("COCO", "Object Detection"), ("ADE", "Semantic Segmentation")]
    dims = {"dataset": names("ImageNet-1k", "COCO", "ADE"), "head": names("Mask", "UPer"), "task": names(*(t for _, t in tasks)), "dataset_task": spark.createDataFrame(tasks, "dataset string, task string")}
    rules = lambda d: sorted({r["rule"] for r in ds.violations(load(spark, d), dimensions=dims).collect()})

    def put(kind, **values):
        d = family()
        d["backbones"][0]["pretrained_backbones"][0][kind][0].update(values)
        return d

    assert rules(family()) == []
    assert rules(put("classification_results", dataset="COCO")) == ["K9"]
    assert rules(put("instance_results", instance_type="Instance Segmentation")) == ["J10 task", "K9"]
    assert rules(put("instance_results", head="Nobody")) == ["J10 head"]
    assert rules(put("semantic_seg_results", train_dataset="Nowhere")) == ["J10 dataset"]


def test_nested_differences_and_order(spark):
    docs = lambda d: ds.read_json(spark, spark.createDataFrame([(json.dumps(d),)], "value string"))
    a, b = family(), family()
    b["backbones"][0]["pretrained_backbones"][0]["semantic_seg_results"][0]["ms_m_iou"] = 49.0
    b["backbones"].reverse()
    flat = lambda d: ds.flatten(docs(d), "name")
    assert sorted(map(tuple, ds.diff(flat(a), flat(b)).collect())) == [("+", "Fam/backbones/Fam-S/pretrained_backbones/Fam-S-1k/semantic_seg_results//ms_m_iou", "49.0"), ("-", "Fam/backbones/Fam-S/pretrained_backbones/Fam-S-1k/semantic_seg_results//ms_m_iou", "48.0")]
    one, other = (ds.canonical(docs(x)).first() for x in (a, a | {"backbones": a["backbones"][::-1]}))
    assert one == other and one.__fields__ == sorted(one.__fields__)
    fps = one["backbones"][1]["fps_measurements"]
    assert [(x["gpu"], x["resolution"], x["fps"]) for x in fps] == [("3080", 224, 1000.0), ("3080", 224, 900.0), ("V100", 384, 1000.0)]


def test_schema_text_names_references(tables):
    assert "family_id (FK to family)" in ds.schema_text(tables["backbone"]) and "dataset_id (FK to dataset)" in ds.schema_text(tables["instance_result"])
    assert "task_id (M2M to task)" in ds.schema_text(tables["dataset_task"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_nested_paths_have_every_result(spark):
    """Those of any price, under the nation that their backbone belongs to."""
    from quillon import queries

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_returnflag = 'A'")
    nations = {r["n_name"] for r in spark.read.parquet("/root/testdata/sf0.001/nation.parquet").collect()}
    paths = queries.nested_paths(spark, "/root/testdata/sf0.001").collect()
    assert len(paths) == lines.count() and {r["path"].split("/")[0] for r in paths} <= nations


def test_names_are_read_once_and_owners_said(spark, tmp_path):
    """With keep no dimension reads the documents again; rejects need no join to find a result's family."""
    texts = spark.createDataFrame([(json.dumps(d),) for d in (family(paper="", github=""), family("B", pretrain_method="magic"), family("B"))], "value string")
    ds.read_json(spark, texts).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.schema(ds.read_json(spark, texts).schema).parquet(str(tmp_path / "docs"))
    one, kept = ds.shred(docs), ds.shred(docs, keep=True)
    for n in ("dataset", "head", "task", "dataset_task", "head_task"):
        assert str(tmp_path / "docs") not in {f.removeprefix("file://").rsplit("/", 1)[0] for f in kept[n].inputFiles()}
        assert sorted(map(repr, kept[n].collect())) == sorted(map(repr, one[n].collect()))
    owned = ds.shred(docs, owners=True)
    want = sorted(map(repr, ds.by_family(one, ds.violations(one)).collect()))
    assert want and sorted(map(repr, ds.by_family(owned, ds.violations(owned)).collect())) == want
