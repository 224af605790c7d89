import hashlib
import random
import re
from collections import Counter

import pytest

from quillon.llm import decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, width=13, share=20):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return out


def tables(spark):
    r = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma1", "déjà", "x", "y2", "z", "日本"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([13, 14, 30, 12, 3, 40])] + [(6, None), (7, ""), (8, "..."), (9, None), (10, "alpha alpha alpha")]
    items[9] = (9, items[2][1])
    rows = []
    for i in range(80):
        w = [r.choice(vocabulary + ["other", "word"] * 6) for _ in range(r.randint(0, 60))]
        if i % 4 == 0:
            part = words(items[i % 6][1])
            cut = part if i % 8 else part[: len(part) // 2 + 8]
            w[len(w) // 2 : len(w) // 2] = [x.upper() if x.isascii() else x for x in cut]
        rows.append((i, r.choice([" ", ", ", "-", "\n"]).join(w)))
    rows += [(90, None), (91, ""), rows[0], rows[0], (None, items[2][1])]
    return spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_hit int").repartition(3), spark.createDataFrame(items, "item_id long, text string"), rows, items


@pytest.mark.parametrize("block", [500_000, 20])
def test_against_brute_force(spark, block):
    docs, benchmark, rows, items = tables(spark)
    got = decontamination.report(docs, benchmark, block_windows=block)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, items))


def test_filter_and_empty(spark):
    docs, benchmark, rows, items = tables(spark)
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-1] for x in brute(rows, items))
    assert decontamination.report(docs.limit(0), benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontamination.report(docs, benchmark.limit(0)).collect())
