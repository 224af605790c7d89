import json
import shutil

import pytest
from test_documents import family, uncropped

from quillon.sources.store import Store
from quillon.streaming.ingest import ingest


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


def test_ingest(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def arrive(name, *docs):
        (folder / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")
        ingest(spark, str(folder), str(out), str(tmp_path / "c")).awaitTermination()

    def there():
        return sorted((r["name"], r["model_type"]) for r in Store(spark, str(out)).tables()["family"].collect())

    def reasons():
        return sorted(r["reason"] for r in spark.read.parquet(str(out / "rejected")).collect())

    arrive("a.json", family())
    arrive("b.json", family("Bad", paper="", github=""))
    assert there() == [("Fam", "Attention")] and reasons() == ["K2"]
    # a replay beside new ones, of which one is there twice; names that another family has
    thief = family("Thief")
    thief["backbones"][0]["name"] = "Fam-S"
    arrive("c.json", family(), family("Good"), family("Good"), family("Worse", paper="", github=""), uncropped("Late"), "[1]", thief)
    assert there() == [("Fam", "Attention"), ("Good", "Attention")]
    assert reasons() == ["K1 stored", "K2", "K2", "crop_size", "malformed"]
    # a late duplicate, a next version, and two texts of one name
    arrive("d.json", family("Good"), family(model_type="Convolution"), family("Twin"), family("Twin", model_type="LSTM"), "[1]")
    assert there() == [("Fam", "Convolution"), ("Good", "Attention")]
    assert reasons() == ["K1 family", "K1 family", "K1 stored", "K2", "K2", "crop_size", "malformed"]
    store = Store(spark, str(out))
    assert store.tables()["backbone"].count() == 4 and store.tables()["fps_measurement"].count() == 8
    assert [e.number for e in store.log()] == [1, 2, 3, 4]
    assert {r["model_type"] for r in store.tables(at=3)["family"].collect()} == {"Attention"}


def test_a_batch_that_runs_again(spark, tmp_path):
    """The last batch's end is lost: it runs again, and nothing is there twice."""
    folder, out, place = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(family()) + "\n")
    ingest(spark, str(folder), str(out), str(place)).awaitTermination()
    (folder / "b.json").write_text(json.dumps(family("Next")) + "\n")
    ingest(spark, str(folder), str(out), str(place)).awaitTermination()
    last = max((place / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (place / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    ingest(spark, str(folder), str(out), str(place)).awaitTermination()
    store = Store(spark, str(out))
    assert len(store.log()) == 2 and sorted(r["name"] for r in store.tables()["family"].collect()) == ["Fam", "Next"]
    shutil.rmtree(out / "data" / f"version={store.log()[-1].version}")
    assert store.log()[-1].token == f"{place}#{last.name}"
