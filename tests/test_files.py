import json

import pytest
from pyspark.sql import functions as F
from test_documents import family

from quillon.sources import documents as ds
from quillon.sources import files

yaml = pytest.importorskip("yaml")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.yml").write_text(yaml.dump(family("A")))
    (tmp_path / "b.yaml").write_text("name: B\nwhen: 2020-01-02\nn: .nan\n1: one\nbackbones: []\n")
    (tmp_path / "c.json").write_text(json.dumps(family("C")))
    (tmp_path / "broken.yml").write_text("name: x\nparts: [1, 2\nmore: 3\n")
    (tmp_path / "list.yml").write_text("- 1\n- 2\n")
    (tmp_path / "empty.yml").write_text("")
    (tmp_path / "latin.yml").write_bytes("name: caf\xe9".encode("latin-1"))
    (tmp_path / "bad.json").write_text("{\n'a': 1}")
    (tmp_path / "two.yml").write_text("a: 1\n---\nb: 2\n")
    (tmp_path / "tag.yml").write_text("a: !!python/object:os.system x\n")
    (tmp_path / "deep.yml").write_text("[" * 5000)
    (tmp_path / "notes.txt").write_text("no document")
    (tmp_path / "_draft.yml").write_text("name: draft")
    return tmp_path


def test_one_bad_file_is_a_row(spark, folder):
    rows = {r["file"]: r for r in files.read_files(spark, str(folder)).collect()}
    assert set(rows) == {"a", "b", "c", "broken", "list", "empty", "latin", "bad", "two", "tag", "deep"}
    assert {k for k, r in rows.items() if r["reason"] is None} == {"a", "b", "c"}
    assert rows["broken"]["reason"] == "malformed at line 3" and rows["latin"]["reason"] == "not UTF-8 at byte 9"
    assert rows["list"]["reason"] == rows["empty"]["reason"] == "not a mapping" and rows["bad"]["reason"] == "malformed at line 2"
    assert all(rows[k]["reason"].startswith("malformed") for k in ("two", "tag", "deep"))
    assert json.loads(rows["b"]["value"])["when"] == "2020-01-02"


def test_shredding_goes_on(spark, folder):
    good, rejects = ds.read_folder(spark, str(folder))
    assert ds.shred(good)["family"].count() == 3
    assert rejects.count() == 8 and rejects.columns == ["file", "reason"]


def test_one_document_and_some(spark, folder):
    for name in ("a", "a.yml"):
        assert [r["file"] for r in files.read_files(spark, str(folder / name)).collect()] == ["a"]
    assert {r["file"] for r in files.read_files(spark, str(folder), names="a, c,none").collect()} == {"a", "c"}
    with pytest.raises(Exception, match="no document"):
        files.read_files(spark, str(folder / "nobody")).collect()


def test_filters_reach_the_listing(spark, folder):
    df = files.read_files(spark, str(folder)).filter(F.col("file").isin("a", "list"))
    assert {r["file"] for r in df.collect()} == {"a", "list"}
    assert files.read_files(spark, str(folder), partitionBytes="1").filter("file = 'a'").rdd.getNumPartitions() == 1


def test_partitions(spark, folder):
    assert files.read_files(spark, str(folder), partitionBytes="1").rdd.getNumPartitions() == 11
    assert files.read_files(spark, str(folder)).rdd.getNumPartitions() == 1
    (folder / "sub").mkdir()
    assert files.read_files(spark, str(folder / "sub")).count() == 0


def test_round_trip(spark, folder, tmp_path):
    good, _ = ds.read_folder(spark, str(folder))
    out = str(tmp_path / "out")
    files.write_files(good.repartition(3), out)
    back, none = ds.read_folder(spark, out)
    assert none.count() == 0 and sorted(map(str, back.collect())) == sorted(map(str, good.collect()))
    text = (tmp_path / "out" / "A.yml").read_text()
    assert text.index("name:") < text.index("model_type:") < text.index("backbones:")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["A.yml", "B.yml", "C.yml"]


def test_writes_are_whole_or_nothing(spark, tmp_path):
    out, rows = tmp_path / "out", lambda *x: spark.createDataFrame(list(x), "name string, value string")
    save = lambda df, mode="append", **o: df.write.format("documents").options(**o).mode(mode).save(str(out))
    files.register(spark)
    save(rows(("x", '{"b": 1, "a": null}'), ("sl/ash é", '{"t": "ü"}')))
    assert (out / "x.yml").read_text() == "b: 1\na: null\n"
    with pytest.raises(Exception, match="that exist: x"):
        save(rows(("new", "{}"), ("x", "{}")))
    with pytest.raises(Exception, match="of one name"):
        save(rows(("new", "{}"), ("new", '{"a": 1}')).repartition(2))
    with pytest.raises(Exception, match="JSON"):
        save(rows(("new", "{}"), ("worse", "{")).repartition(2))
    with pytest.raises(Exception, match="missing: value"):
        save(spark.createDataFrame([("x",)], "name string"))
    assert {p.name for p in out.iterdir()} == {"x.yml", "sl%2Fash %C3%A9.yml"}
    save(rows(("x", "name: [raw")), "overwrite", raw="true")
    assert {(r["file"], r["reason"]) for r in files.read_files(spark, str(out)).collect()} == {("x", "malformed at line 2"), ("sl/ash é", None)}
