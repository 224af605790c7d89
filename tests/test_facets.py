import random

from quillon.operators import facets


def test_against_sets(spark):
    r = random.Random(4)
    data = [(r.choice([r.randint(0, 120_000), 0, 32767, 32768, -5, None]), r.choice(["a", "b", None]), r.choice("xyz"), r.randint(1, 4)) for _ in range(1500)]
    df = spark.createDataFrame(data, "id long, f string, g string, h int").repartition(3)
    fields = ["f", "g", "h"]
    have = {}
    for i, *values in data:
        for f, v in zip(fields, values):
            if i is not None and v is not None:
                have.setdefault((f, str(v)), set()).add(i)
    indexed = facets.merged(facets.index(df.filter("h < 3"), "id", fields), facets.index(df.filter("h >= 3"), "id", fields))
    for choices in ({}, {"f": ["a"]}, {"f": ["a", "b"], "h": ["2"]}, {"f": ["a"], "g": ["x"], "h": ["1", "4"]}, {"f": ["nobody"]}, {"g": []}):
        want = {}
        for (f, v), ids in have.items():
            left = set(ids)
            for other, values in choices.items():
                if other != f and values:
                    left &= set().union(*(have.get((other, x), set()) for x in values))
            want[f, v] = len(left)
        assert {(x["field"], x["value"]): x["n"] for x in facets.counts(indexed, choices).collect()} == want, choices
    both = {"f": ["a"], "g": ["x", "y"]}
    n = facets.matching(indexed, both).select(facets.F.sum(facets.F.bitmap_count("bits"))).first()[0]
    assert n == len(have["f", "a"] & (have["g", "x"] | have["g", "y"]))
    assert facets.counts(facets.index(df.limit(0), "id", fields), both).count() == 0


def test_no_row_of_facts_is_sorted(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 AS f")
    assert "SortAggregate" not in facets.index(rows, "id", ["f"])._jdf.queryExecution().toString()
