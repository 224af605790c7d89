import numpy as np

from quillon.llm import nearest


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int")


def exact(x, q, k):
    d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
    order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]
    return order, d


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(10, 32))[rng.integers(0, 10, 3000)] + 0.5 * rng.normal(size=(3000, 32))).astype(np.float32)
    v = frame(spark, x)
    got = nearest.search(v, v.filter("vec_id % 100 = 0"), sample=1000).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert len(by) == 30
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        order, d = exact(x, q, 10)
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-9 for r in rows)
        assert [r["score"] for r in rows] == sorted(r["score"] for r in rows)
        hits += len({r["vec_id"] for r in rows} & set(order))
    assert hits / 300 >= 0.97


def test_ties_odd_vectors_and_few(spark):
    x = [[1, 0, 0], [1, 0, 0], [1, 0, 0], None, [0, 0, 0], [float("nan"), 1, 1], [float("inf"), 1, 1], [None, 1, 1], [1, 1], [0, 1, 0]]
    v = frame(spark, x)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.search(v, v.filter("vec_id = 1")).collect()]
    assert sorted(got) == [(1, 1, 0, 0.0), (1, 2, 2, 0.0), (1, 3, 9, np.sqrt(2))]
    assert nearest.search(v.limit(0), v.limit(0)).count() == 0


def test_a_thousand_equal_vectors_and_other_dimensions(spark):
    """Ties go to the smaller vec_id however often a vector repeats; each dimension is searched by itself."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[500:1500] = x[500]
    short = rng.normal(size=(40, 6)).astype(np.float32)
    v = frame(spark, [*x, *short])
    got = {}
    for r in sorted(nearest.search(v, v.filter("vec_id IN (500, 900, 1499, 3, 2005)")).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[500] == list(range(501, 511)) and got[900] == list(range(500, 510)) and got[1499] == list(range(500, 510))
    assert len(set(got[3]) & set(exact(x, 3, 10)[0])) >= 9
    assert got[2005] == [2000 + i for i in exact(short, 5, 10)[0]]


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(2)
    v = frame(spark, rng.normal(size=(300, 8)).astype(np.float32))
    q = v.filter("vec_id % 10 = 0")
    a = {tuple(r) for r in nearest.search(v, q).collect()}
    assert a == {tuple(r) for r in nearest.search(v, q, block=7).collect()} and len(a) == 300


def test_quantiser_weighs_parallel_error():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(threshold):
        z = nearest.Quantiser(x, threshold)
        code = z.codes(x)
        back = z.books[np.arange(z.m), code].reshape(len(x), -1)
        return (((x - back) * x).sum(1) ** 2).mean()

    assert parallel(0.5) < parallel(0.0)
