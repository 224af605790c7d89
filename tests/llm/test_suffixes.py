import hashlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import suffixes


def brute(rows, length):
    """The contract read literally: rows (doc_id, text) -> a result row each."""
    distinct = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, results = set(), {}
    for name in distinct:
        raw = name[2].encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        results[name] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [(i, *results[i is not None, i or 0, t or ""]) for i, t in rows]


@pytest.mark.parametrize(("length", "gram", "shard"), [(100, 32, 6 << 20), (100, 32, 3000), (20, 8, 2000)])
def test_against_brute_force(spark, docs, length, gram, shard):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = suffixes.removed(docs, length, gram, shard)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, length))


def test_empty_table(spark, empty):
    assert suffixes.removed(empty).count() == 0


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"banana bandana banana bandana cabana" * 3, np.uint8)
    depth = 40
    order, _ = suffixes.suffix_array(data, depth)
    raw = data.tobytes() + b"\0" * depth
    want = sorted(range(len(data)), key=lambda i: (raw[i : i + depth], i))
    assert [raw[i : i + depth] for i in order] == [raw[i : i + depth] for i in want]
    prefix = suffixes.common_prefixes(data, order, depth)
    for k in range(1, len(data)):
        a, b = raw[order[k - 1] : order[k - 1] + depth], raw[order[k] : order[k] + depth]
        n = next((i for i in range(depth) if a[i] != b[i]), depth)
        assert min(prefix[k], n) == min(n, len(data) - max(order[k - 1], order[k])) or prefix[k] == n


def test_prefixes_of_long_repeats():
    """Repeats beyond depth, whose followers stand the other way round."""
    r = np.random.default_rng(4)
    for n, depth in ((1, 8), (63, 8), (700, 8), (3000, 40)):
        base = r.integers(97, 100, 150).astype(np.uint8)
        data = np.concatenate([base, r.integers(97, 99, 9).astype(np.uint8)] * (n // 100 + 1))[:n]
        data = np.where(r.random(n) < 0.01, 98, data).astype(np.uint8)
        order, _ = suffixes.suffix_array(data, depth)
        raw = data.tobytes()

        def common(a, b):
            k = 0
            while k < depth and max(a, b) + k < n and raw[a + k] == raw[b + k]:  # noqa: B023
                k += 1
            return k

        assert suffixes.common_prefixes(data, order, depth).tolist() == [0, *(common(order[k - 1], order[k]) for k in range(1, n))]


def test_windows_of_equal_hash_are_compared_by_bytes(monkeypatch, spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    monkeypatch.setattr(suffixes, "_window_hashes", lambda data, length: np.zeros(len(data), np.uint64))
    import pyarrow as pa

    texts = [b"q" * 5 + b"abcdefghij", b"r" * 5 + b"abcdefghij", b"s" * 5 + b"abcdefghik"]
    t = pa.table({"h": [1, 1, 1], "__id": [1, 2, 3], "__th": [0, 0, 0], "place": [5, 5, 5], "lo": [5, 5, 5], "hi": [5, 5, 5], "bytes": [x[5:] for x in texts]})
    got = [tuple(r.values()) for b in suffixes._merged(t, 10) for r in b.to_pylist()]
    assert set(got) == {(2, 0, 5, 5)}
    assert rows
