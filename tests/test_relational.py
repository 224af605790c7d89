import json

import pytest
from test_documents import family

from quillon.operators.references import KEYS
from quillon.sources import documents as ds
from quillon.sources import relational

URL = "jdbc:derby:memory:quillon;create=true"


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame([(json.dumps(family(f"Fam{i}")),) for i in range(6)], "value string").coalesce(1)
    return ds.shred(ds.read_json(spark, texts))


def test_round_trip_of_all_tables(spark, tables, monkeypatch, tmp_path_factory):
    relational.write_tables(tables, URL, prefix="s_", parts=2)
    back = relational.read_tables(spark, URL, {n: KEYS.get(n) for n in tables}, prefix="s_", parts=4)
    for n, rows in tables.items():
        assert back[n].columns == rows.columns, n
        assert sorted(map(str, back[n].collect())) == sorted(map(str, rows.collect())), n
    assert back["family"].rdd.getNumPartitions() == 4 and back["dataset_task"].rdd.getNumPartitions() == 1


def test_filters_and_columns_reach_the_database(spark, tables, capsys):
    relational.write_table(tables["backbone"], URL, "b_backbone")
    df = relational.read_table(spark, URL, "b_backbone", "backbone_id").filter("name = 'Fam1-S' AND m_parameters > 3").select("name")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(name,Fam1-S)" in plan and "GreaterThan(m_parameters,3.0)" in plan and "ReadSchema: struct<name:string>" in plan
    assert [r["name"] for r in df.collect()] == ["Fam1-S"]


def test_append_and_empty(spark, tables):
    relational.write_table(tables["family"].limit(0), URL, "e_family")
    assert relational.read_table(spark, URL, "e_family", "family_id").count() == 0
    relational.write_table(tables["family"], URL, "e_family", mode="append")
    assert relational.read_table(spark, URL, "e_family", "family_id", parts=3).count() == 6
    with pytest.raises(Exception, match="(?i)trunca"):
        relational.write_table(spark.createDataFrame([("x" * 20,)], "name string"), URL, "e_short", string=10)
