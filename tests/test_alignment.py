import random

from quillon.operators import alignment as al
from quillon.sources import documents as ds


def quadratic(a, b):
    """The same choice from the whole table of common lengths."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((" ", j))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and size[i + 1][j] >= size[i][j + 1]:
            out.append(("-", i))
            i += 1
        else:
            out.append(("+", j))
            j += 1
    return out


def test_against_the_whole_table():
    r = random.Random(3)
    for _ in range(1500):
        a = [r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 25))]
        b = list(a) if r.random() < 0.5 else [r.choice("abcdxy") for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            if b:
                b[r.randrange(len(b))] = r.choice("abcz")
        assert list(al.align(a, b)) == quadratic(a, b), (a, b)


def test_long_documents():
    a = [str(i) for i in range(20_000)]
    b = a[:7000] + a[12_000:] + ["new"] + a[7000:7010]
    found = list(al.align(a, b))
    assert sum(s == "-" for s, _ in found) == 5000 and sum(s == "+" for s, _ in found) == 11
    assert [b[k] for s, k in found if s != "-"] == b


def test_frames(spark):
    schema = "key string, lines array<string>"
    old = spark.createDataFrame([("same", ["a", "b"]), ("moved", ["a", "b", "c"]), ("gone", ["x"]), (None, ["n"]), ("twice", ["1"]), ("twice", ["2"]), ("none", None), ("null", ["a", None])], schema)
    new = spark.createDataFrame([("same", ["a", "b"]), ("moved", ["c", "a", "b"]), ("come", ["y", "z"]), (None, ["m"]), ("twice", ["2"]), ("twice", ["1"]), ("none", []), ("null", ["a", ""])], schema)
    pairs = al.aligned(old, new)
    rows = sorted(map(repr, map(tuple, al.edits(pairs).collect())))
    want = [("moved", "+", 1, "c"), ("moved", "-", 3, "c"), ("gone", "-", 1, "x"), ("come", "+", 1, "y"), ("come", "+", 2, "z"), (None, "-", 1, "n"), (None, "+", 1, "m")]
    assert rows == sorted(map(repr, want))
    assert tuple(al.figures(pairs).first()) == (7, 13, 700 / 13)
    assert tuple(al.figures(pairs, "key").filter("key = 'moved'").first()) == ("moved", 2, 3, 200 / 3)
    assert tuple(al.figures(al.aligned(old.limit(0), new.limit(0))).first()) == (0, 0, 0.0)
    assert al.edits(al.aligned(old, new, context=True)).filter("key = 'same'").count() == 2


def test_rendered(spark):
    rows = [("a", 1, [("x", [1, 2]), (None, [])], ("p", None), ["s\nt"]), (None, None, None, None, [])]
    docs = spark.createDataFrame(rows, "name string, year int, parts array<struct<n:string,of:array<int>>>, one struct<k:string,l:int>, tags array<string>")
    got = [r["lines"] for r in al.rendered(docs, "name").collect()]
    assert got[0] == ["name: a", "year: 1", "parts:", "- n: x", "  of:", "  - 1", "  - 2", "- n: null", "  of: []", "one:", "  k: p", "  l: null", "tags:", "- s\\nt"]
    assert got[1] == ["name: null", "year: null", "parts: []", "one: null", "tags: []"]


def test_order_of_lists_is_no_difference(spark):
    """What the line difference of two documents measures is their canonical form."""
    docs = lambda parts: spark.createDataFrame([("d", parts)], "name string, parts array<struct<name:string,n:int>>")
    a, b = docs([("y", 1), ("x", 2)]), docs([("x", 2), ("y", 3)])
    pairs = al.aligned(*(al.rendered(ds.canonical(d), "name") for d in (a, b)))
    assert [tuple(r) for r in al.edits(pairs).collect()] == [("d", "-", 5, "- n: 1"), ("d", "+", 5, "- n: 3")] or al.figures(pairs).first()["changed"] == 2


def test_short_pairs_leave_python_together():
    """Before, each was a batch of its own."""
    import pyarrow as pa

    pairs = [(i, [f"a{i}", "b"], ["b", f"c{i}"]) for i in range(300)] + [(300, ["x"] * 12_000, None)]
    kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*pairs), kinds)], names=["key", "old", "new"])
    out = list(al._differences([batch], ["key", "n_old", "n_new", "edits"], False))
    assert len(out) == 1 and out[0].column("key").to_pylist() == list(range(301))
    rows = out[0].to_pylist()
    assert [(e["sign"], e["number"], e["line"]) for e in rows[7]["edits"]] == [("-", 1, "a7"), ("+", 2, "c7")]
    assert rows[300]["n_old"] == 12_000 and rows[300]["n_new"] == 0 and len(rows[300]["edits"]) == 12_000
    assert len(list(al._differences([batch, batch], ["key", "n_old", "n_new", "edits"], False))) == 2
