import pytest
from test_documents import family, load

from quillon.catalogue import axis_title, from_tables
from quillon.operators import choices as ch
from quillon.operators import reports as rp
from quillon.plans import tables as tb
from quillon.request import AxisArgs, DataArgs, Request, default

TOP, COST = AxisArgs("results", "top_1"), AxisArgs("gflops")
IN, COCO = DataArgs("ImageNet-1k", "Classification"), DataArgs("COCO", "Object Detection")


@pytest.fixture(scope="module")
def cat(spark):
    return from_tables({k: t.persist() for k, t in load(spark, family(), family("Other", pub_date="2024-01-01", paper="")).items()})


def test_single(cat):
    rows = tb.plot_table(cat, Request(COST, TOP, DataArgs(), IN)).collect()
    assert list(rows[0].asDict()) == ["family", "model", "params (m)", "pretrain", "family link", "finetune", "GFLOPs", "GFLOPs link", "Top-1", "Top-1 link"]
    assert len(rows) == 2 and {r["finetune"] for r in rows} == {"&mdash; : &mdash; : &mdash;"} and {r["family link"] for r in rows} == {"/families/Fam?task=Classification", "/families/Other?task=Classification"}
    assert {r["family"]: r["Top-1 link"] for r in rows} == {"Fam": "p", "Other": ""}


def test_heads_and_pages(cat):
    r = Request(AxisArgs("m_parameters"), AxisArgs("results", "mAP"), DataArgs(), COCO)
    row = tb.plot_table(cat, r.scoped(family="Fam"), "family").first()
    assert list(row.asDict()) == ["model", "params (m)", "pretrain", "model link", "head", "head link", "train", "mAP<sup>b</sup>", "mAP<sup>b</sup> link"]
    assert (row["head"], row["head link"], row["train"], row["params (m)"]) == ("Mask", "/heads/Mask", "COCO : 36", 20.0)
    assert tb.plot_table(cat, r.scoped(family="Fam"), "head").first()["head link"] == ""


def test_multi_and_none(cat):
    rows = tb.plot_table(cat, Request(TOP, AxisArgs("results", "mAP"), IN, COCO, family="Fam")).collect()
    assert len(rows) == 2 and {r["head"] for r in rows} == {"Mask"}
    same = Request(AxisArgs("results", "gflops"), AxisArgs("results", "gflops"), DataArgs("COCO", "Object Detection"), DataArgs("ADE", "Semantic Segmentation"))
    assert {"x head", "y head", "GFLOPs (COCO)", "GFLOPs (ADE)"} <= set(tb.plot_table(cat, same).columns)
    # facts have no parameters: no rows, no error
    assert tb.plot_table(cat, Request(AxisArgs("m_parameters"), AxisArgs("results", "mAP"), IN, COCO)).count() == 0
    assert tb.plot_table(cat, Request(AxisArgs("m_parameters"), AxisArgs("pub_date"))).count() == 6


def test_pages(cat, tmp_path):
    rows = tb.downstream(cat, "Semantic Segmentation", "dataset", dataset="ADE")
    assert "head" in rows.columns and "params (m)" not in rows.columns
    cell = tb.shown(rows, ["mIoU<sup>ms</sup>", "mIoU<sup>ss</sup>"]).first()
    assert (cell["mIoU<sup>ms</sup>"], cell["mIoU<sup>ss</sup>"], cell["mIoU<sup>ss</sup> link"], cell["train"]) == ("48.0", "&mdash;", None, "ADE : 128 : 512")
    assert "head" not in tb.downstream(cat, "Object Detection", "head", head="Mask").columns
    tb.write_by_dataset(rows.select("dataset", "model", "gflops"), str(tmp_path / "by"))
    assert [p.name for p in (tmp_path / "by").glob("dataset=*")] == ["dataset=ADE"]
    rows = rp.in_order(tb.classification(cat, "ImageNet-1k"), "classification_dataset", ("top-1", "top-5"), ("model",)).collect()
    assert [r["top-1"] for r in rows] == [82.0, 82.0, 80.5, 80.5] and rows[0]["finetune"] == "IN-1k : 30 : 384"
    assert "top-1&darr;" in tb.classification(cat, "ImageNet-C").columns


def test_titles():
    assert [axis_title("top_1", dataset=d) for d in (None, "ImageNet-C", "ImageNet-C-bar")] == ["Top-1", "mCE&darr;", "CE&darr;"]
    assert axis_title("AP50") == "AP<sub>50</sub>" and axis_title("mAPs", "Object Detection") == "mAP<span class='supsub'><sup>b</sup><sub>s</sub></span>"
    assert axis_title("ss_mean_accuracy") == "mAcc<sup>ss</sup>" and axis_title("fps") == "Images / Second" and axis_title("odd") == "odd"


def test_choices(cat):
    def offered(*args, **kw):
        out = {}
        for r in ch.options(cat, *args, **kw).collect():
            out.setdefault(r["field"], []).append(r["value"])
        return out

    got = offered(Request(COST, TOP, DataArgs(), DataArgs("ImageNet-C", "Classification"), group_by="family"))
    assert got["y_metric"] == ["top_1", "gflops"] and got["y_dataset"] == ["ImageNet-1k"] and got["y_resolution"] == ["224", "384", "512"]
    assert "gflops" in got["x_axis"] and "gflops" not in got["y_axis"] and "y_head" not in got and "classification.resolution" in got["legend"]
    assert "family" not in got["legend_second"] and got["pretrain_dataset"] == ["ImageNet-1k"]
    page = offered(Request(AxisArgs("fps"), AxisArgs("results", "mAP"), DataArgs(), COCO), head="Mask")
    assert page["y_task"] == ["Object Detection"] and "y_head" not in page and "V100" in page["x_gpu"] and "AMP" in page["x_precision"]
    assert "y_dataset" not in offered(Request(COST, TOP, DataArgs(), IN), dataset="ImageNet-1k")
    r = ch.default_request(cat, "Object Detection", "COCO", family="Fam")
    assert (r.y.metric, r.group_by, r.group_by_second, r.family) == ("mAP", "pretrain_dataset", "pretrain_method", "Fam") and not r.problems()
    assert ch.default_request(cat, "Classification", "ImageNet-1k").group_by == "family" == default(cat.metrics).group_by


def test_legends_of_tasks():
    r = Request(COST, TOP, DataArgs(), IN, group_by="instance.head")
    assert r.problems() == ["no legend key 'instance.head' for these tasks"] and r.log_axes() == (True, False)


def test_lookups(cat):
    assert rp.one(cat.dimensions["dataset"].filter("name = 'COCO'"))["eval"]
    with pytest.raises(LookupError, match="several"):
        rp.one(cat.dimensions["dataset"])
    with pytest.raises(LookupError, match="no row"):
        rp.one(cat.dimensions["dataset"].filter("name = 'X'"))
