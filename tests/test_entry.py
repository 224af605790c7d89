import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_without_the_llm_subpackage(monkeypatch):
    """The driver deletes it; all else goes on."""
    for name in [m for m in sys.modules if m.startswith(("quillon.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillon.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "single_metric_vs_cost" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    sys.modules.pop("__spark_entry__")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillon import queries

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    for name, query in queries.QUERIES.items():
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(repr([plain(r[x]) for x in columns]) for r in df.collect())
        found = c.sql(queries.ORACLE_SQL[name])
        assert sorted(found.columns) == columns, name
        at = [found.columns.index(x) for x in columns]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall()), name
