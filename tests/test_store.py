import json

import pytest
from test_documents import family, uncropped

from quillon.operators import references as rf
from quillon.sources import documents as ds
from quillon.sources.store import Conflict, Store


@pytest.fixture(autouse=True)
def one_partition(spark):
    """These tables are small and their jobs many: compiling them would take most of the time."""
    quick = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    old = {k: spark.conf.get(k, None) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def docs(spark):
    return lambda *d: ds.read_json(spark, spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in d], "value string").coalesce(1))


@pytest.fixture
def names(spark):
    return lambda *n: spark.createDataFrame([(x,) for x in n], "name string")


def there(store, **at):
    return sorted((r["name"], r["model_type"]) for r in store.tables(**at)["family"].collect())


def test_one_commit_for_all(spark, tmp_path, docs):
    store = Store(spark, str(tmp_path / "s"))
    assert there(store) == [] and store.log() == []
    assert store.begin().put(docs(family("A"), family("B"))).commit() == 1
    assert there(store) == [("A", "Attention"), ("B", "Attention")]
    versions = [p.name for p in (tmp_path / "s" / "data").iterdir()]
    assert len(versions) == 1 and not list((tmp_path / "s" / "pending").glob("*"))
    want, got = ds.shred(docs(family("A"), family("B"))), store.tables()
    assert set(want) == set(got)
    for n in want:
        assert want[n].columns == got[n].columns, n
        assert sorted(map(str, want[n].collect())) == sorted(map(str, got[n].collect())), n
    assert "family_id (FK to family)" in ds.schema_text(got["backbone"])


def test_replace_delete_and_history(spark, tmp_path, docs, names):
    store = Store(spark, str(tmp_path / "s"))
    store.begin().put(docs(family("A"), family("B"))).commit()
    smaller = family("A", model_type="LSTM")
    smaller["backbones"].pop(0)
    assert store.begin().put(docs(smaller)).put(docs(family("C"))).delete(names("B", "nobody")).commit() == 2
    assert there(store) == [("A", "LSTM"), ("C", "Attention")] and there(store, at=1) == [("A", "Attention"), ("B", "Attention")]
    t = store.tables()
    assert {n: t[n].count() for n in ("backbone", "pretrained_backbone", "classification_result", "backbone_fps", "instance_fps", "fps_measurement")} == {"backbone": 3, "pretrained_backbone": 1, "classification_result": 2, "backbone_fps": 3, "instance_fps": 1, "fps_measurement": 4}
    assert rf.orphans(t).count() == 0
    assert store.begin().put(docs(family("B"))).commit() == 3 and len(there(store)) == 3


def test_nothing_of_what_is_refused(spark, tmp_path, docs):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="B: crop_size; C: K2"):
        store.begin().put(docs(family("A"), uncropped("B"), family("C", paper="", github=""))).commit()
    assert not list((tmp_path / "s").glob("*/*")) and there(store) == []
    with pytest.raises(ValueError, match="K1 family"):
        store.begin().put(docs(family("A"), family("A"))).commit()
    with pytest.raises(ValueError, match="twice in one change: A"):
        store.begin().put(docs(family("A"))).put(docs(family("A"))).commit()
    store.begin().put(docs(family("A"))).commit()
    other = family("Z")
    other["backbones"][1]["name"] = "A-S"
    with pytest.raises(ValueError, match="another family has backbone A-S"):
        store.begin().put(docs(other)).commit()
    with pytest.raises(ValueError, match="there already: A"):
        store.begin().put(docs(family("A")), replace=False).commit()
    assert [(r["family"], r["key"]) for r in store.taken(docs(other)).collect()] == [("Z", "A-S")]
    assert len(store.log()) == 1 and len(list((tmp_path / "s" / "data").iterdir())) == 1


def test_two_writers(spark, tmp_path, docs, names):
    store = Store(spark, str(tmp_path / "s"))
    store.begin().put(docs(family("A"))).commit()
    one, two, three, four = (Store(spark, str(tmp_path / "s")).begin() for _ in range(4))
    assert one.put(docs(family("A", model_type="LSTM"))).commit() == 2
    with pytest.raises(Conflict, match="A"):
        two.put(docs(family("A", model_type="Random"))).commit()
    with pytest.raises(Conflict, match="A"):
        three.delete(names("A")).commit()
    assert four.put(docs(family("B"))).commit() == 3
    assert there(store) == [("A", "LSTM"), ("B", "Attention")]


def test_the_number_is_taken_at_the_last_moment(spark, tmp_path, docs, monkeypatch):
    """Another writer commits between the check and the rename."""
    from quillon.sources import store as module

    store, create, raced = Store(spark, str(tmp_path / "s")), module.create_once, []

    def late(spark, path, content):
        if not raced:
            raced.append(True)
            Store(spark, store.path).begin().put(docs(family(rival))).commit()
        return create(spark, path, content)

    monkeypatch.setattr(module, "create_once", late)
    rival = "A"
    with pytest.raises(Conflict):
        store.begin().put(docs(family("A"))).commit()
    raced.clear()
    rival = "B"
    assert store.begin().put(docs(family("C"))).commit() == 3
    assert [n for n, _ in there(store)] == ["A", "B", "C"]


def test_tokens(spark, tmp_path, docs):
    store = Store(spark, str(tmp_path / "s"))
    assert store.begin().put(docs(family("A"))).commit("batch 1") == store.begin().put(docs(family("B"))).commit("batch 1") == 1
    assert store.begin().commit() == 2 and there(store) == [("A", "Attention")]
