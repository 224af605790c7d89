from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import reports as rp
from quillon.plans import comparison as cp


def value(spark, column, **cols):
    rows = spark.range(1).select(*(F.lit(v).cast("string" if v is None else type(v).__name__.replace("str", "string").replace("float", "double")).alias(k) for k, v in cols.items()))
    return rows.select(column.alias("v")).first()[0]


def test_strings(spark):
    f = lambda **k: value(spark, tx.finetune_string("d", "e", "r", "id", "ie", "ir"), **{"d": None, "e": None, "r": None, "id": None, "ie": None, "ir": None} | k)
    assert f() == "&mdash; : &mdash; : &mdash;"
    assert f(d="ImageNet-1k", e=30, r=384) == "IN-1k : 30 : 384"
    assert f(d="ImageNet-1k", e=30, r=384, id="ImageNet-22k", ie=90, ir=224) == "IN-22k : 90 : 224 &rarr; IN-1k : 30 : 384"
    assert value(spark, tx.train_string("d", "e"), d="COCO", e=36) == "COCO : 36"
    assert value(spark, tx.train_string("d", "e", "c", "i", "j"), d="A", e=1, c=512, i="B", j=2) == "B : 2 &rarr; A : 1 : 512"
    assert value(spark, tx.pretrain_string("d", "m", "e"), d="ImageNet-1k", m="Supervised", e=300) == "IN-1k : Sup. : 300"
    assert value(spark, tx.pretrain_string("d", "m", "e"), d="ImageNet-1k", m="Sup. + TL", e=300) == "IN-1k : Sup. + TL : 300"
    assert value(spark, tx.pair_cell("a", "b"), a=81.5, b=0.0) == "81.5/&mdash;"
    assert value(spark, tx.first_link("a", "b", "c"), a="", b=None, c="x") == "x"
    assert value(spark, tx.legend(F.col("a"), F.col("b")), a="k", b=None) == "k / None"
    assert value(spark, tx.entity_label("a", "b", "c"), a="x", b=None, c=3) == "x/3/"
    assert value(spark, tx.hover("a", "b"), a="x &rarr; y", b=None) == "x → y<br>---"
    assert value(spark, tx.fenced("t"), t="a ```yaml\nk: 1\n``` b") == "\nk: 1\n" and value(spark, tx.fenced("t"), t="none") is None
    assert value(spark, tx.without_glyphs(F.array("a", "b")), a=" x /uni1/uni2abc y", b="z ") == "x  y\nz"
    assert value(spark, tx.until_entity("a"), a="AP&darr;") == "AP"


def test_pivot(spark):
    rows = spark.createDataFrame([("p", "f", "A", 224, 80.0, 95.0), ("p", "f", "A", 384, 82.0, 0.0), ("q", "f", "B", 224, 70.0, None)], "pb string, ft string, dataset string, resolution int, a double, b double")
    found = rp.classification_pivot(rows, ["pb", "ft"], None, "a", "b", F.struct("resolution"), names=str.lower)
    assert sorted(map(str, found.collect())) == sorted(map(str, rp.classification_pivot(rows, ["pb", "ft"], [r["dataset"] for r in rows.select("dataset").distinct().orderBy("dataset").collect()], "a", "b", F.struct("resolution"), names=str.lower).collect()))
    assert rp.classification_pivot(rows.limit(0), ["pb", "ft"], None, "a", "b", F.struct("resolution")).columns == ["pb", "ft"]
    got = {r["pb"]: r for r in rp.classification_pivot(rows, ["pb", "ft"], ["A", "B"], "a", "b", F.struct("resolution"), names=str.lower).collect()}
    assert got["p"]["a"] == "82.0/&mdash;" and got["p"]["b"] == "&mdash;/&mdash;" and got["q"]["b"] == "70.0/&mdash;"


def test_lists_modes_sorts(spark):
    rows = spark.createDataFrame([("h", "A", 1, 3), ("h", "A", 1, 9), ("h", "B", 2, 5), ("g", "B", 2, None)], "head string, dataset string, t int, pub_date int")
    u = {(r["head"], r["task"]): (r["n"], r["last"]) for r in rp.used(rp.usage(rows, "head", {"one": F.col("t") == 1, "two": F.col("t") == 2})).collect()}
    assert u == {("h", "one"): (2, 9), ("h", "two"): (1, 5), ("g", "two"): (1, None)}
    assert {r["head"]: r["dataset"] for r in rp.mode(rows, ["head"], "dataset").collect()} == {"h": "A", "g": "B"}
    assert [r["pub_date"] for r in rp.sorted_by(rows, "-pub_date").collect()] == [9, 5, 3, None]
    assert [r["pub_date"] for r in rp.sorted_by(rows, "pub_date").collect()] == [3, 5, 9, None]
    out = rp.rendered(rows.withColumn("url", F.lit("u")), ["dataset", "none", "head"], {"head": "url"}).first()
    assert out.asDict() == {"dataset": "A", "none": "", "head": ("u",)} or out["none"] == "" and out["head"]["url"] == "u"
    assert cp.text_filter(rows, "H b").count() == 1
    assert cp.best_under(rows, "pub_date", {"t": 0}, 2, ["head"]).count() == 2
    assert cp.by_legend(rows.select(F.col("head").alias("key"), F.col("t").alias("x"), F.col("pub_date").alias("y"))).filter("key = 'h'").first()["x"] == [1, 1, 2]
