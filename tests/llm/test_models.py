import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from quillon.llm import charlm, quality, toxicity


N = charlm.ORDER


def symbols(text, fold):
    raw = np.frombuffer(text.encode(), np.uint8)
    return charlm.symbols(raw, np.array([0, len(raw)]), fold)[0].tolist()


def packed(texts, fold=False):
    """n-grams of ORDER symbols, padded at the start."""
    out = []
    for t in texts:
        s = [0] * (N - 1) + symbols(t, fold)
        out.append([tuple(s[i : i + N]) for i in range(len(s) - N + 1)])
    return out


def discounts(counts):
    k = Counter(counts.values())
    y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
    return [0, *(min(j, max(0, j - (j + 1) * y * k[j + 1] / k[j])) if k[j] else min(0.5, j) for j in (1, 2, 3))]


class Level:
    """One order: discounted counts over contexts."""

    def __init__(self, counts):
        self.cut, self.by = discounts(counts), defaultdict(Counter)
        for g, v in counts.items():
            self.by[g[:-1]][g[-1]] = v

    def p(self, g, lower):
        own = self.by.get(g[:-1])
        if not own:
            return lower
        return (max(own[g[-1]] - self.cut[min(own[g[-1]], 3)], 0) + sum(self.cut[min(v, 3)] for v in own.values()) * lower) / sum(own.values())


def naive(grams):
    """Interpolated modified Kneser-Ney by dictionaries; the orders below the highest by continuation counts."""
    c = {N: Counter(grams)}
    for n in range(N - 1, 0, -1):
        c[n] = Counter(g[1:] for g in c[n + 1])
    level, size = {n: Level(c[n]) for n in c}, len(c[1]) + 1

    def p(g):
        return level[len(g)].p(g, p(g[1:]) if len(g) > 1 else 1 / size)

    return p


def half(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", "pmod(xxhash64(coalesce(t, '')), 2) AS h").collect()
    return [h for _, h in sorted(map(tuple, rows))]


ODD = "abc é.A1\n今天好かй𝒳"


def test_perplexity_against_dictionaries(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(30)] + ["今天天气很好" * 9, "zzz"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(24)], "doc_id long")
    halves, all_grams = half(spark, texts), packed(texts)
    p = {h: naive([g for i in range(24) if halves[i] != h for g in all_grams[i]]) for h in (0, 1)}
    # by broadcast entries and by sharded joins in small blocks
    charlm.BLOCK_BYTES, was = 200, charlm.BLOCK_BYTES
    try:
        for bound in (charlm.BOUND, 0):
            got = {x["doc_id"]: x for x in quality.perplexities(docs, trusted, ["doc_id"], bound).collect()}
            assert len(got) == len(texts) + 1 and got[99]["log_perplexity"] is None
            for i, g in enumerate(all_grams):
                if g:
                    want = -sum(math.log(p[halves[i]](x)) for x in g) / len(g)
                    assert abs(got[i]["log_perplexity"] - want) < 1e-4 and got[i]["n_chars_scored"] == len(g)
                else:
                    assert got[i]["log_perplexity"] is None
    finally:
        charlm.BLOCK_BYTES = was


def test_bounds_against_a_plain_version(spark):
    docs, labels, known = corpus(spark, 300)
    rows = [x.asDict() for x in quality.judged(docs, labels, low=0.05, high=0.9, enough=20).collect()]
    text = {x["doc_id"]: x["text"] for x in docs.collect()}
    good = {i for i, q, _ in known if q}

    def kind(x):
        n = max(len(text[x["doc_id"]]), 1)
        return x["lang"], max(0, min(4, int(math.log2(n) // 2) - 2))

    seen = 0
    for x in rows:
        if x["log_perplexity"] is None:
            continue
        cell = sorted(y["log_perplexity"] for y in rows if y["doc_id"] in good and y["log_perplexity"] is not None and kind(y) == kind(x))
        if len(cell) >= 20:
            seen += 1
            at = lambda q: cell[max(0, math.ceil(q * len(cell)) - 1)]  # noqa: B023, E731
            assert abs(x["lower"] - (at(0.05) - quality.SLACK)) < 1e-9 and abs(x["upper"] - (at(0.9) + quality.SLACK + quality.ONE_WORD / len(text[x["doc_id"]]))) < 1e-9
            assert x["kept"] == (x["lower"] <= x["log_perplexity"] <= x["upper"])
    assert seen > 200


def test_differences_against_dictionaries(spark):
    """Both classes' models over the shared lower orders, for n-grams seen and unseen."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcd é\n今好") for _ in range(r.randint(1, 50))) for _ in range(40)]
    toxic, halves, all_grams = [int(i % 3 == 0) for i in range(30)], half(spark, texts), packed(texts, True)
    docs = spark.createDataFrame([(t, toxic[i] + 2 * halves[i]) for i, t in enumerate(texts[:30])], "text string, key int")
    entries, (orders, fn) = toxicity.models(charlm.count(docs, True))
    rows = entries.collect()
    names = np.array([charlm.hashes(np.array([e["a"]]), np.array([e["b"]]), e["k"])[0] for e in rows], np.uint64)
    order = np.argsort(names)
    scorer = charlm.Scorer(names[order], np.array([e["v"] for e in rows], np.float32)[order], orders, fn)
    every = sorted({g for x in all_grams for g in x})
    got = scorer(np.array([g[1] | g[0] << 21 for g in every]), np.array([g[4] | g[3] << 21 | g[2] << 42 for g in every]))
    for m, own in ((0, [i for i in range(30) if halves[i] == 1]), (1, [i for i in range(30) if halves[i] == 0]), (2, range(30))):
        tops = [Counter(g for i in own if toxic[i] == y for g in all_grams[i]) for y in (0, 1)]
        of, types = [], set()
        for c in tops:
            level = {}
            for n in range(N, toxicity.SHARED, -1):
                level[n] = Level(c)
                types |= set(c) if n == toxicity.SHARED + 1 else set()
                c = Counter(g[1:] for g in c)
            of.append(level)
        shared = {}
        for n in range(toxicity.SHARED, 0, -1):
            c = Counter(g[1:] for g in types)
            shared[n], types = Level(c), set(c)
        size = len(types) + 1

        def p(y, g):
            level = of[y] if len(g) > toxicity.SHARED else shared  # noqa: B023
            return level[len(g)].p(g, p(y, g[1:]) if len(g) > 1 else 1 / size)  # noqa: B023

        for g, v in zip(every, got[m]):
            assert abs(v - (math.log(p(1, g)) - math.log(p(0, g)))) < 1e-4


def test_scores_by_shards_are_the_same(spark):
    docs, labels, _ = corpus(spark, 200)
    charlm.BLOCK_BYTES, was = 5000, charlm.BLOCK_BYTES
    try:
        one, other = ({x["doc_id"]: x["score"] for x in toxicity.toxicity(docs, labels, bound=b).collect()} for b in (charlm.BOUND, 0))
    finally:
        charlm.BLOCK_BYTES = was
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-9 for i in one)


def test_a_script_beyond_latin(spark):
    """Junk in Chinese is told from Chinese text, toxic Chinese from ordinary."""
    r = random.Random(9)
    words = ["".join(chr(0x4E00 + r.randint(0, 500)) for _ in range(2)) for _ in range(150)]
    spam = [chr(0x7000 + k) for k in range(300)]
    bad = ["毒恶骂", "臭坏蛋"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(r.randint(30, 60))]
        if i % 5 == 0:
            w[::10] = [r.choice(bad) for _ in w[::10]]
        rows.append((i, "".join(w) + "。" if i % 8 else "".join(r.choice(spam) for _ in range(90)), "zh"))
        labels.append((i, int(i % 8 != 0), int(i % 5 == 0 and i % 8 != 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["kept"] for x in quality.judged(docs, marks, enough=50).collect()}
    assert not any(kept[i] for i, q, _ in labels if not q) and sum(kept[i] for i, q, _ in labels if q) > 340
    out = [x for x in toxicity.toxicity(docs, marks).collect() if x["held_out"]]
    truth = {i: t for i, _, t in labels}
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in out) / len(out) > 0.95


def corpus(spark, n=900):
    r = random.Random(2)
    words = ["".join(r.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    bad = ["zaggor" + r.choice(["ka", "lo", "mi"]) for _ in range(10)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(8, 120))]
        toxic, junk = int(i % 7 == 0), int(i % 11 == 0)
        for k in range(0, len(w), 15) if toxic else ():
            w[k] = r.choice(bad)
        t = " ".join(w).capitalize() + "."
        rows.append((i, "".join(f"{x}&#$%" for x in w) if junk else t, "en" if i % 2 else "de"))
        labels.append((i, 1 - junk, toxic))
    rows += [(n, "", "en"), (n + 1, None, None), (None, "kalo mi", "xx"), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame([*labels, labels[0], (n + 9, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark):
    docs, labels, known = corpus(spark)
    out = toxicity.toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 904 and all(0 <= r["score"] <= 1 for r in rows)
    truth = {i: t for i, _, t in known}
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    # the held-out labels don't matter
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in known], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-12 for r in rows)


def test_features_do_not_follow_the_length():
    """The same differences a character give the same features, with and without spaces."""
    for every in (6, 10**9):
        rows = []
        for n in (240, 2400, 24_000):
            symbol = np.full(n, 97)
            symbol[every - 1 :: every] = toxicity.SPACE
            rows.append([float(x[0]) for x in toxicity._features(np.full(n, 0.12), np.array([0, n]), symbol)])
        assert np.allclose(rows[0], rows[1], rtol=0.02) and np.allclose(rows[0], rows[2], rtol=0.02)
    assert all(len(x) == 2 for x in toxicity._features(np.zeros(0), np.zeros(3, np.int64), np.zeros(0, np.int64)))


def test_scripts_without_spaces(spark):
    """Chinese and Thai: a few toxic expressions in texts of very different lengths."""
    r = random.Random(8)
    letters = ("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年", "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอาเแโไ")
    bad = (("滚蛋废物", "白痴混账"), ("ไอโง่", "สารเลว"))
    rows, marks = [], []
    for i in range(900):
        own, words, toxic = letters[i % 2], bad[i % 2], int(i % 5 < 2)
        text = [r.choice(own) for _ in range(r.choice([60, 400, 3000]))]
        for _ in range(max(3, len(text) // 60) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(words))
        rows.append((i, "".join(text)))
        marks.append((i, toxic))
    out = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(marks, "doc_id long, toxic int")).filter("held_out").collect()
    for script in (0, 1):
        held = [x for x in out if x["doc_id"] % 2 == script]
        assert sum(x["predicted"] == marks[x["doc_id"]][1] for x in held) / len(held) > 0.95


def test_toxicity_without_labels(spark):
    docs, labels, _ = corpus(spark, 20)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_long_texts_and_clashing_names(spark):
    text = "kalo miter un ka. " * 20_000
    docs = spark.createDataFrame([(1, text, "en", 1, 2, "x"), (2, text[:-5], "en", 1, 2, "y"), (3, None, None, None, None, None)], "doc_id long, text string, lang string, `__half` int, n_chars_scored int, m string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 2, 3]
    assert sorted(x["doc_id"] for x in toxicity.toxicity(docs, labels).collect()) == [1, 2, 3]
    assert quality.accepted(docs.limit(0), labels).count() == 0


def test_bounds_do_not_depend_on_order(spark):
    """Cells of the same values in any arrangement are the same to the last bit, and their quantiles are those of the sorted values."""
    r = random.Random(9)
    rows = [(r.choice(["en", "de", None]), r.randint(0, 2), r.gauss(2.0, 0.3)) for _ in range(4000)] + [("xx", 1, 2.5)]
    schema = "lang string, __class int, log_perplexity double"
    found = []
    for parts in (1, 7, 16):
        r.shuffle(rows)
        cells = quality._cells(spark.createDataFrame(rows, schema).repartition(parts), 0.001, 0.995)
        found.append({(x["g"], x["lang"], x["__class"]): (tuple(x["q"]), x["n"], x["mean"], x["var"]) for x in cells.collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 10 + 4 + 3 + 1
    for (g, lang, klass), (q, n, mean, var) in found[0].items():
        own = sorted(v for a, b, v in rows if (g in (2, 3) or a == lang) and (g in (1, 3) or b == klass))
        assert n == len(own) and abs(mean - sum(own) / n) < 1e-4
        assert (var is None) == (n == 1) and (n == 1 or abs(var / np.var(own, ddof=1) - 1) < 1e-2)
        for value, p in zip(q, (0.001, 0.995)):
            assert value in own and abs(value - own[max(0, math.ceil(p * n) - 1)]) <= 1 / quality.BINS_A_NAT
    assert quality._cells(spark.createDataFrame([], schema), 0.1, 0.9).count() == 0


def test_quality(spark):
    docs, labels, known = corpus(spark)
    out = quality.judged(docs, labels, enough=50)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 904 and "text" not in out.columns
    good = [rows[i]["kept"] for i, q, _ in known if q]
    bad = [rows[i]["kept"] for i, q, _ in known if not q]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05
    assert rows[900]["kept"] and rows[901]["kept"] and rows[900]["log_perplexity"] is None
    assert all(r["kept"] for r in quality.judged(docs, labels.limit(0)).collect())
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_quality_of_a_rare_language(spark):
    r = random.Random(5)

    def text(parts, n):
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."

    rows = [(i, text(["ka", "lo", "mi", "ter", "un"], r.randint(60, 100)), "en") for i in range(3000)]
    rows += [(3000 + i, text([a + b for a in "bcdfghjk" for b in "aeiouy"], r.randint(60, 100)), "qq") for i in range(12)]
    labels = [(i, 1) for i, *_ in rows]
    rows += [(4000 + i, text(["x&", "#z", "%q"], 60), "qq") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = {x["doc_id"]: x["kept"] for x in quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(out[i] for i in range(3000, 3012))
    assert not any(out[i] for i in range(4000, 4010))
    assert sum(out[i] for i in range(3000)) / 3000 > 0.98
