import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import common, phrases


def counts(rows, depth):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, depth + 1):
                f.update((lang, *w[i : i + d]) for i in range(len(w) - d + 1))
    return n, f


def brute(rows, depth=5, least=100, share=100, top=2000):
    n, f = counts(rows, depth)
    often = {p: a for p, a in f.items() if a >= least}
    inner = {}
    for p, a in often.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                q = (p[0], *p[i : i + m])
                inner[q] = max(inner.get(q, 0), a)
    found = []
    for p, a in often.items():
        lang, *w = p
        if len(w) < 2 or 100 * inner.get(p, 0) >= share * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.append((lang, score, a, " ".join(w), f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang]))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out += [(lang, i + 1, p, a, l, r, m, s) for i, (_, s, a, p, l, r, m) in enumerate(mine)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "doc_id long, text string, lang string, phrase int, n string, h long"


def invented(seed, docs=150):
    r = random.Random(seed)
    words = ["a", "A\x01", "a\x00b", "the", "of", "é", "É", "日本", "don't", "x-y", "\x1f", "q" * 50, "and", "(b)"]
    fixed = ["the end of it", "a\x01 the of the", "日本 the the", "of of of of of of"]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(r.randint(0, 60)):
            w.append(r.choice(fixed) if r.random() < 0.2 else r.choice(words))
            w.append(r.choice([" ", " ", "  ", "\t", " ", ". ", "\n", " , ", "\x0b", "?!"]))
        rows.append(("".join(w), r.choice(["en", "en", "en", None, "und", "de", "zh\x00"])))
    rows += [(None, "en"), ("", "de"), ("  \t", "xx"), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1]), ("the end of it " * 20_000, "en"), ("no break " * 3000 + "!" + "a b, " * 5000, "de")]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, x, 1, "n", 2) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("depth", "least", "share", "top"), [(5, 30, 100, 2000), (4, 3, 60, 7), (2, 50, 100, 50), (5, 1, 100, 100)])
def test_against_brute_force(spark, depth, least, share, top):
    rows = invented(depth)
    got = phrases.ranked(phrases.collocations(frame(spark, rows), depth, least, share, size=60, shard=3000, block=8), top).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == brute(rows, depth, least, share, top)


def test_ranges_split_subtrees(spark):
    """Many ranges over few first words: ancestors stand in earlier ones."""
    rows = invented(9)
    shards = common.cut(phrases.tries(frame(spark, rows), 5, 5, 3000, 8), nodes=F.sum(F.size("phrases")))
    nodes = common.cut(phrases.merged(shards, 5, 5, 60))
    assert nodes.filter("phrase LIKE '% %' AND (l0 IS NULL OR l1 IS NULL)").count()
    n, f = counts(rows, 5)
    want = {p: [n[p[0]], *(f[p[:k]] for k in range(2, len(p)))] for p, a in f.items() if a >= 5}
    full = phrases.with_left_parts(nodes).filter("phrase <> ''").collect()
    assert {(r["lang"], *r["phrase"].split(" ")): [r[f"l{k}"] for k in range(len(r["phrase"].split(" ")))] for r in full} == want


def test_long_texts_in_parts():
    import numpy as np

    texts = [b"", b"abc", b"aa, bb, cc, dd, ee", b"a" * 50 + b"." + b"b" * 50, b"c" * 60]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    cuts, owner = phrases._parts(data, offsets, 10)
    parts = [data[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
    assert [b"".join(p for p, o in zip(parts, owner) if o == i) for i in range(len(texts))] == texts
    assert all(p[-1:] in b".," for p, o, q in zip(parts, owner, owner[1:]) if o == q) and len(parts) > 6


def test_scores_beyond_64_bits(spark):
    nodes = spark.createDataFrame([("en", "", 10**15, None, None), ("en", "a", 10**15 - 7, 10**15, None), ("en", "b", 10**14 + 1, 10**15, None), ("en", "a b", 10**14 - 3, 10**15, 10**15 - 7)], "lang string, phrase string, a long, l0 long, l1 long")
    row = phrases.scored_cuts(nodes, 2).first()
    assert row["score"] == 1000 * (10**14 - 3) * 10**15 // ((10**15 - 7) * (10**14 + 1))


def test_empty(spark, empty):
    assert phrases.ranked(phrases.collocations(empty)).count() == 0


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({phrases.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, phrases.op13_phrases(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect())) == sorted(want)
