import math
import random

import pytest

from quillon.plans import fronts, grids


def rows(seed, n=400):
    r = random.Random(seed)
    out = [(r.choice(["a", "b", None]), r.choice([r.uniform(0, 9), float(r.randint(0, 5))]), r.choice([r.uniform(0, 9), float(r.randint(0, 5))]), i) for i in range(n)]
    return out + [("a", None, 1.0, -1), ("a", 1.0, None, -2), ("a", math.nan, 9.0, -3), ("a", 0.0, math.nan, -4), ("one", 1.0, 1.0, -5), ("ties", 1.0, 2.0, -6), ("ties", 1.0, 2.0, -7), ("ties", 2.0, 2.0, -8), ("inf", math.inf, math.inf, -9), ("inf", 0.0, -math.inf, -10)]


def whole(r):
    return all(v is not None and not math.isnan(v) for v in r[1:3])


def brute(data, x_lower, y_lower):
    better = lambda v, w, low: v < w if low else v > w
    good = [r for r in data if whole(r)]
    beats = lambda a, b: a[0] == b[0] and not better(b[1], a[1], x_lower) and not better(b[2], a[2], y_lower) and (better(a[1], b[1], x_lower) or better(a[2], b[2], y_lower))
    return sorted(b[3] for b in good if not any(beats(a, b) for a in good))


@pytest.mark.parametrize(("x_lower", "y_lower"), [(True, False), (False, False), (True, True)])
def test_front_against_all_pairs(spark, monkeypatch, x_lower, y_lower):
    monkeypatch.setattr(fronts, "HELD", 20)
    data = rows(1)
    df = spark.createDataFrame(data, "x string, v double, w double, id int").repartition(3)
    got = fronts.front(df, "x", "v", "w", x_lower, y_lower)
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == brute(data, x_lower, y_lower)
    bounds = [-1.0, 0.0, 2.5, 100.0]
    best = {(r["key"], r["bound"]): r["best"] for r in fronts.best_within(got, "x", "v", "w", bounds, x_lower, y_lower).collect()}
    for k in {r[0] for r in data if whole(r)}:
        for b in bounds:
            inside = [r[2] for r in data if whole(r) and r[0] == k and (r[1] <= b if x_lower else r[1] >= b)]
            assert best[k, b] == ((min if y_lower else max)(inside) if inside else None), (k, b)
    assert fronts.front(df.limit(0), "x", "v", "w").count() == 0


def cells(data, e, width, height):
    out = {}
    for key, x, y, at in data:
        if x is None or y is None or not math.isfinite(x) or not math.isfinite(y):
            continue
        px = min(math.floor((x - e.x_min) / (e.x_max - e.x_min) * width), width - 1)
        py = min(math.floor((y - e.y_min) / (e.y_max - e.y_min) * height), height - 1)
        out.setdefault((key, px, py), []).append((at, x, y))
    return {k: (len(v), min(v), max(v), min(p[1] for p in v), max(p[1] for p in v), min(p[2] for p in v), max(p[2] for p in v)) for k, v in out.items()}


def as_dict(grid):
    return {(r["key"], r["px"], r["py"]): (r["n"], tuple(r["first"]), tuple(r["last"]), r["x_min"], r["x_max"], r["y_min"], r["y_max"]) for r in grid.collect()}


def test_grid(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "key string, x double, y double, at int").repartition(3)
    e = grids.extent(df)
    got = grids.grid(df, "at", 16, 8)
    assert as_dict(got) == cells(data, e, 16, 8)
    assert as_dict(grids.coarser(got, 2)) == cells(data, e, 4, 2)
    parts = [grids.grid(df.filter(c), "at", 16, 8, e) for c in ("at % 2 = 0", "at % 2 <> 0")]
    assert as_dict(grids.merged(*parts)) == as_dict(got)
    near = grids.Extent(2.0, 5.0, 1.0, 3.0)
    assert sum(n for n, *_ in as_dict(grids.grid(df, "at", 4, 4, near)).values()) == sum(1 for r in data if whole(r) and 2 <= r[1] <= 5 and 1 <= r[2] <= 3)
    assert grids.grid(df.limit(0), "at", 4, 4).count() == 0
    one = spark.createDataFrame([("k", 3.0, 1.0, 1), ("k", 3.0, 2.0, 2)], "key string, x double, y double, at int")
    assert sorted((r["px"], r["py"], r["n"]) for r in grids.grid(one, "at", 4, 4).collect()) == [(0, 0, 1), (0, 3, 1)]


def test_points_are_gathered_by_hash(spark):
    """A hash table of cells, not a sort of points; ties and nulls of the order are as structs compare."""
    rows = [("k", 1, 0.0, 5.0), ("k", 1, 0.1, 4.0), ("k", 3, 0.2, 4.5), ("k", 3, 0.2, 4.9), (None, None, 1.0, 9.0), (None, 2, 0.9, 9.0), (None, 2, 1.0, 8.9)]
    got = grids.grid(spark.createDataFrame(rows, "key string, at long, x double, y double"), "at", 1, 1)
    assert "HashAggregate(keys=[key" in got._jdf.queryExecution().toString().split("Physical Plan")[1]
    found = {r["key"]: (r["n"], tuple(r["first"]), tuple(r["last"]), r["x_min"], r["y_max"]) for r in got.collect()}
    assert found == {"k": (4, (1, 0.0, 5.0), (3, 0.2, 4.9), 0.0, 5.0), None: (3, (None, 1.0, 9.0), (2, 1.0, 8.9), 0.9, 9.0)}
