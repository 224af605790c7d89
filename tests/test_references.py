import json

import pytest
from test_documents import family

from quillon.operators import references as rf
from quillon.sources import documents as ds


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame([(json.dumps(family(n)),) for n in ("Fam", "Other")], "value string")
    return {n: rows.cache() for n, rows in ds.shred(ds.read_json(spark, texts)).items()}


def sizes(t):
    return {n: rows.count() for n, rows in t.items()}


def test_cascade_leaves_no_orphan(tables):
    assert rf.orphans(tables).count() == 0
    gone = tables["family"].filter("name = 'Fam'").select("family_id")
    left, before = sizes(out := rf.deleted(tables, {"family": gone})), sizes(tables)
    shared = ("dataset", "head", "task", "dataset_task", "head_task")
    assert all(left[n] == before[n] if n in shared else 2 * left[n] == before[n] for n in before)
    assert rf.orphans(out).count() == 0


def test_from_the_middle(tables):
    pb = tables["pretrained_backbone"].filter("name = 'Fam-S-1k'").select("pb_id")
    out = rf.deleted(tables, {"pretrained_backbone": pb})
    assert sizes(out)["backbone"] == 4 and sizes(out)["backbone_fps"] == 6 and sizes(out)["fps_measurement"] == 7 and rf.orphans(out).count() == 0
    fps = tables["backbone_fps"].select("fps_id").limit(1)
    out = rf.deleted(tables, {"fps_measurement": fps})
    assert sizes(out)["backbone_fps"] == 5 and sizes(out)["fps_measurement"] == 7 and rf.orphans(out).count() == 0


def test_a_measurement_with_another_link_stays(spark, tables):
    both = tables["backbone"].filter("name IN ('Fam-S', 'Other-S')").select("name", "backbone_id")
    ids = {r["name"]: r["backbone_id"] for r in both.collect()}
    one = tables["backbone_fps"].filter(f"backbone_id = {ids['Fam-S']}").limit(1).collect()[0]["fps_id"]
    t = tables | {"backbone_fps": tables["backbone_fps"].unionByName(spark.createDataFrame([(ids["Other-S"], one)], "backbone_id long, fps_id long"))}
    out = rf.deleted(t, {"backbone": tables["backbone"].filter("name = 'Fam-S'").select("backbone_id")})
    assert out["fps_measurement"].filter(f"fps_id = {one}").count() == 1 and out["backbone_fps"].count() == 4 and rf.orphans(out).count() == 0


def test_restrict(spark, tables):
    coco = tables["dataset"].filter("name = 'COCO'").select("dataset_id")
    with pytest.raises(rf.Restricted, match="instance_result -?[0-9]+ .dataset_id. refers to dataset"):
        rf.deleted(tables, {"dataset": coco})
    gone = rf.cascade(tables, {"dataset": coco})
    assert rf.restrictions(tables, gone).count() == 4  # dataset and train_dataset of two results
    # what refers goes as well
    out = rf.deleted(tables, {"dataset": coco, "instance_result": tables["instance_result"].select("result_id")})
    assert sizes(out)["dataset"] == 2 and sizes(out)["dataset_task"] == 2 and rf.orphans(out).count() == 0
    assert sizes(rf.deleted(tables, {"family": spark.createDataFrame([(1,), (1,)], "family_id long")})) == sizes(tables)
    assert sizes(rf.deleted(tables, {"family": tables["family"].limit(0).select("family_id")})) == sizes(tables)


def test_circles_end(spark):
    t = {"node": spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 4), (5, None), (6, 5)], "id long, up long")}
    graph = [rf.Edge("node", "up", "node", "id", "CASCADE")]
    of = lambda *i: rf.deleted(t, {"node": spark.createDataFrame([(x,) for x in i], "id long")}, graph, {"node": "id"})["node"]
    assert sorted(r["id"] for r in of(1).collect()) == [4, 5, 6]
    assert sorted(r["id"] for r in of(4, 5).collect()) == [1, 2, 3]


def test_replaced(spark, tables):
    fam = tables["family"].filter("name = 'Fam'").withColumn("model_type", ds.F.lit("LSTM"))
    new = fam.unionByName(fam.withColumn("family_id", ds.F.lit(9).cast("long")).withColumn("name", ds.F.lit("New")))
    out = rf.replaced(tables, {"family": new.unionByName(new), "dataset_task": tables["dataset_task"]})
    assert sorted((r["name"], r["model_type"]) for r in out["family"].collect()) == [("Fam", "LSTM"), ("New", "LSTM"), ("Other", "Attention")]
    assert out["dataset_task"].count() == tables["dataset_task"].count()
    lost = rf.replaced(tables, {"backbone": tables["backbone"].limit(1).withColumn("family_id", ds.F.lit(77).cast("long"))})
    assert [(r["table"], r["column"], r["key"]) for r in rf.orphans(lost).collect()] == [("backbone", "family_id", "77")]
