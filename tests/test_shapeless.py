import json
from collections import Counter

from quillon.sources import documents as ds
from quillon.sources import shapeless

DOCS = [
    ("a", {"name": "a", "o": {"k": 1, "deep": {"er": [True, None, "s"]}}, "l": [1, 2, [3, []]], "ks": [{"name": "x", "n": 1.5}, {"gpu": "V100", "precision": "AMP", "resolution": 224, "fps": 9}, {"q": {}}], "odd key": "v", "": 0}),
    ("b", [1, {"z": None}]),
    ("c", 7),
    ("d", {}),
    (None, {"long": "x" * 50_000}),
]


def walk(v, path="$"):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            plain = k and all(c.isalnum() or c == "_" for c in k) and not k[0].isdigit()
            yield from walk(x, f"{path}.{k}" if plain else f'{path}."{k}"')
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]")
    else:
        yield path, "{}" if v == {} else "[]" if v == [] else None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def frame(spark, docs):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs], "id string, value string")


def test_every_leaf_has_a_path(spark):
    texts = frame(spark, [*DOCS, ("bad", "{not"), ("a", DOCS[0][1])])
    got = shapeless.leaves(shapeless.variants(texts, "id"))
    want = Counter((k, p, v) for k, d in [*DOCS, DOCS[0]] for p, v in walk(d))
    assert Counter((r["key"], r["path"], r["value"]) for r in got.collect()) == want
    assert [r["key"] for r in shapeless.rejected(texts, "id").collect()] == ["bad"]
    kinds = {r["path"]: r["kind"] for r in got.filter("key = 'a'").collect()}
    assert kinds["$.ks[2].q"] == "OBJECT" and kinds["$.l[2][1]"] == "ARRAY" and kinds["$.name"] == "STRING" and kinds["$.o.deep.er[0]"] == "BOOLEAN"
    assert shapeless.leaves(shapeless.variants(texts.limit(0), "id")).count() == 0


def test_elements_keep_their_names(spark):
    old = {"name": "a", "ks": [{"name": "x", "n": 1}, {"name": "y", "n": 2}, {"gpu": "T4", "precision": "AMP", "resolution": 224, "fps": 1}], "new": [1]}
    new = {"name": "a", "ks": [{"gpu": "T4", "precision": "AMP", "resolution": 224, "fps": 2}, {"name": "y", "n": 2}, {"name": "x", "n": 1}], "more": {"z": 1}}
    v = lambda d: shapeless.variants(frame(spark, [("a", d)]), "id")
    found = sorted((r["sign"], r["path"], r["value"]) for r in shapeless.difference(v(old), v(new)).collect())
    assert found == [("+", "$.ks[T4+AMP+224].fps", "2"), ("+", "$.more.z", "1"), ("-", "$.ks[T4+AMP+224].fps", "1"), ("-", "$.new[0]", "1")]


def test_flatten_has_every_leaf(spark):
    docs = spark.createDataFrame([("d", (1, ("p",)), [1, None, 3], [("x", [5]), ("y", None)], [[1], [2, 3]])], "name string, o struct<n:int,q:struct<r:string>>, l array<int>, ks array<struct<name:string,of:array<int>>>, ll array<array<int>>")
    got = {r["path"]: r["value"] for r in ds.flatten(docs, "name").collect()}
    assert got == {"d/name": "d", "d/o/n": "1", "d/o/q/r": "p", "d/l/0": "1", "d/l/2": "3", "d/ks/x/name": "x", "d/ks/y/name": "y", "d/ks/x/of/0": "5", "d/ll/0/0": "1", "d/ll/1/0": "2", "d/ll/1/1": "3"}
