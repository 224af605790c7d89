import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import prefixes


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, rebuilt=True):
    """Every node from every conversation's turns, subtrees by comparing paths."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    convs = dict(own)
    if rebuilt:
        for c, t in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            convs[c] = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below)]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), sum(saved[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, digest int, depth string, words string"


def invented(seed=1, convs=90):
    r = random.Random(seed)
    say = ["", "hello there", "a b c", "so", None, "a\tb  c\n"]
    rows = []
    for c in range(-25, convs):
        if c % 7 == 3:
            continue
        for turn in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, None if r.random() < 0.1 else turn, r.choice(["user", None, "bot"]), r.choice(say)))
    rows += [(500 + i, t, "user", f"copy {t}") for i in range(40) for t in range(6)]
    rows += [(700, t, "user", f"long {t % 5}") for t in range(300)] + [(701, t, "user", f"long {t % 5}") for t in range(290)]
    rows += [rows[0], rows[0], (None, 1, "user", "nobody's"), (None, None, None, None), (800, 1, "ab", "c"), (801, 1, "a", "bc"), (820, 0, "x", "y" * 200_000), (821, 0, "x", "y" * 200_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "d", "w") for x in rows], SCHEMA).repartition(3)


def test_rebuilt_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 20)
    rows = invented()
    placed = prefixes.turns(frame(spark, rows))
    got = prefixes.trie(prefixes.prefixes(prefixes.rebuild(placed, 20, 4)))
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == brute(rows)


def test_whole_against_brute_force(spark):
    rows = invented(5, 40)
    got = prefixes.trie(prefixes.prefixes(prefixes.whole(prefixes.turns(frame(spark, rows)))))
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == brute(rows, rebuilt=False)


def test_turnless_and_empty(spark):
    c = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "user", "a"), (c, 1, "bot", "b")]
    placed = prefixes.turns(frame(spark, rows))
    got = prefixes.trie(prefixes.prefixes(prefixes.rebuild(placed, 20, 4))).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    none = prefixes.turns(frame(spark, rows).limit(0))
    assert prefixes.trie(prefixes.prefixes(prefixes.rebuild(none, 20, 4))).count() == 0


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefixes.ORACLE_SQL})").fetchall()
    assert Counter(map(tuple, prefixes.op11_prefixes(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect())) == Counter(want)
