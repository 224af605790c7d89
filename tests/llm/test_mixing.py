import random

import pytest

from quillon.llm import mixing


def fill(sizes, weights=(5, 2, 1), epochs=1.5, repeat=2.0):
    """Water filling step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), epochs * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > repeat * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in open_}
            break
        for s in over:
            target[s] = repeat * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(500):
        s = r.choice(["b", "a", "é", "Z", None, "", "big", "big", "big"])
        rows.append((i, None if i % 50 == 0 else " ".join(["w"] * r.randint(0, 60)), s, 1))
    rows += [rows[7]] * 3 + [(None, "x y", "a", 1), (1000, "w " * 20000, "big", 1)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(3)).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = fill(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert abs(g["target"] - want[g["source"]]) < 1e-6
        assert 0 <= g["taken"] <= 2 * g["size"]
        assert (g["position"] is None) == (g["taken"] == 0) and all(0 <= p <= 1 for p in g["positions"])
        taken[g["source"]] += g["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    early = {s: [p for g in got if g["source"] == s for p in g["positions"]] for s in "abc"}
    half = {s: sum(p < 0.5 for p in x) / len(x) for s, x in early.items()}
    assert abs(half["a"] - 0.6) < 0.02 and abs(half["b"] - 0.5) < 0.02 and abs(half["c"] - 0.35) < 0.02
    rows = [r["position"] for r in mixing.ordered(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()]
    known = [p for p in rows if p is not None]
    assert known == sorted(known) and rows[: len(known)] == known


def test_empty_and_wordless(spark, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(g["target"], g["taken"]) for g in got] == [(0.0, 0), (0.0, 0)]


def test_passes_have_places_of_their_own(spark):
    """A document that is mixed twice stands twice in training order, and none that isn't taken."""
    rows = [(i, "w " * (1 + i % 9), "abcd"[i % 4]) for i in range(400)] + [(900, None, "a"), (901, "", None)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.passes(mixed).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    want = {r["doc_id"]: r["positions"] for r in mixed.collect()}
    assert any(len(x) == 2 for x in want.values()) and not want[900] and not want[901]
    assert sorted((r["doc_id"], r["pass"], r["position"]) for r in got) == sorted((i, k, p) for i, x in want.items() for k, p in enumerate(x))
