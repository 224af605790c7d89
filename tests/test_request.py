import pytest

from quillon.functions.text import display_name
from quillon.request import AxisArgs, DataArgs, QueryType, Request, default, parse, table_titles, title

R, G = AxisArgs("results", "top_1"), AxisArgs("gflops")


def make(a=DataArgs(), b=DataArgs(), **kw):
    return Request(R, kw.pop("y", R), a, b, **kw)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (DataArgs("D", "T", "H"), DataArgs("D", "T", "H"), QueryType.SINGLE),
        (DataArgs("D", "T", "H"), DataArgs("D", "T", "I"), QueryType.MULTI),
        (DataArgs("D", "T"), DataArgs("E", "T"), QueryType.MULTI),
        (DataArgs("D", "T"), DataArgs(), QueryType.SINGLE),
        (DataArgs(), DataArgs("D"), QueryType.SINGLE),
        (DataArgs(), DataArgs(), QueryType.NONE),
    ],
)
def test_dispatch(a, b, want):
    assert make(a, b).query_type is want


def test_merge_and_promotion():
    r = make(DataArgs("D", "T", resolution=224), DataArgs("E", head="H"), group_by_second="k")
    assert r.args == DataArgs("D", "T", "H", 224)
    assert r.title_dataset == "E"
    assert (r.group_by, r.group_by_second) == ("k", None)
    assert not DataArgs(gpu="V100").fps and DataArgs(gpu="V100", precision="AMP").fps


def test_parse_and_problems():
    r = parse({"x_axis": "gflops", "y_axis": "results", "y_metric": "top_1", "y_task": "Classification", "y_dataset": "D", "y_resolution": "384", "x_resolution": "", "legend": "family"})
    assert r.y_args.resolution == 384 and r.x_args.resolution is None and not r.problems()
    assert r.y.attribute == "top_1" and r.x.attribute == "gflops"
    assert len(Request(G, AxisArgs("fps")).problems()) == 2
    assert Request(AxisArgs("nope"), R).problems()[0].startswith("x: no axis")
    assert default({"classification": ("top_1",)}).query_type is QueryType.SINGLE


def test_scopes():
    r = make().scoped("F", "H", "D")
    assert (r.family, r.x_args.head, r.y_args.head, r.x_args.dataset) == ("F", "H", "H", "D")


def test_titles():
    assert title("top_1", dataset="ImageNet-C") == "mCE" and title("top_1", dataset="ImageNet-C-bar") == "CE"
    assert title("AP50", labels={"AP50": "AP50&darr;"}) == "AP50"
    assert title("mAP", dataset="COCO", suffix=True) == "mAP (COCO)"
    assert table_titles("a", "a", make(DataArgs("D"), DataArgs("E"))) == ("a (D)", "a (E)")
    assert table_titles("a", "a", make(DataArgs("D", head="H"), DataArgs("D", head="I"))) == ("a (H)", "a (I)")
    assert table_titles("a", "a", make()) == ("a (x)", "a (y)")
    assert display_name("ImageNet-C-bar") == "IN-C-bar&darr;"
