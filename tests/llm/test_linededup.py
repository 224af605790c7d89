import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quillon.llm import linededup


def chunks(text):
    """Chunks of one document, one text at a time."""
    raw = text.encode()
    doc, s, e, n, h = linededup._chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [(int(a), int(b)) for a, b in zip(s, e)]


def brute(rows):
    distinct = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    seen, out = set(), {}
    for name in distinct:
        text = name[2].encode()
        keep, lines, at = [], 0, 0
        for s, e in chunks(name[2]):
            if text[s:e] in seen:
                keep.append(text[at:s])
                at = e + (e < len(text))
                lines += text.count(b"\n", s, e) + 1
            seen.add(text[s:e])
        left = b"".join([*keep, text[at:]])
        if keep and at >= len(text) and left.endswith(b"\n"):
            left = left[:-1]
        out[name] = (left.decode(), lines)
    return Counter((i, None, 0) if t is None else (i, *out[i is not None, i or 0, t]) for i, t in rows)


def test_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = linededup.deduplicate(docs, linededup._chunks)
    assert got.columns == [*docs.columns, "__n_lines", "__n_removed"]
    assert Counter((r["doc_id"], r["text"], r["__n_removed"]) for r in got.collect()) == brute(rows)
    assert sum(r["__n_removed"] for r in got.collect()) > 10


def test_boundaries_resist_shifts():
    lines = [f"line {i} of a passage that repeats" for i in range(40)]
    a, b = "\n".join(lines), "\n".join(["new", "start", *lines])
    cut = lambda t: {t.encode()[s:e] for s, e in chunks(t)}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 2


def test_hashes_that_collide(spark):
    """Passages of one hash are told apart by their bytes."""
    rows = [(i, "\n".join([f"first line {i % 4} here", f"second line {i % 3} here", f"own line {i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def same(data, offsets):
        doc, s, e, chunk, h = linededup._seeded(data, offsets)
        return doc, s, e, chunk, h & np.uint64(1)

    plain = {x["doc_id"]: x["text"] for x in linededup.deduplicate(docs).collect()}
    assert {x["doc_id"]: x["text"] for x in linededup.deduplicate(docs, same).collect()} == plain == {k: t for k, (t, _) in repeated_lines(rows).items()}


def test_chunks_absorb_their_edges(spark):
    """A shared passage of many lines goes by its chunks: what is compared beside them are the edges that reach over them."""
    passage = [f"line {i} of the passage that the documents share" for i in range(60)]
    rows = [(i, "\n".join([f"before {i}", *passage, f"after {i}"])) for i in range(6)]
    raw = rows[1][1].encode()
    doc, s, e, chunk, h = linededup._seeded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    lo, hi = raw.index(b"line 0"), raw.index(b"\nafter")
    shared = (s >= lo) & (e <= hi)
    spans = [{"at": int(a), "size": int(b - a), "h": int(x.view(np.int64)), "own": False, "chunk": bool(c)} for a, b, x, c in zip(s[shared], e[shared], h[shared], chunk[shared])]
    before = pa.RecordBatch.from_pylist([{"__id": 1, "__th": 1, "want": spans}, {"__id": 2, "__th": 2, "want": [{**x, "own": True} for x in spans]}, {"__id": 3, "__th": 3, "want": [x for x in spans if not x["chunk"]]}])
    (after,) = linededup._absorbed([before])
    one, two, three = (x["want"] for x in after.to_pylist())
    assert two == before.to_pylist()[1]["want"] and three == before.to_pylist()[2]["want"]
    assert [x for x in one if x["chunk"]] == [x for x in spans if x["chunk"]]
    inner = lambda x: any(c["chunk"] and c["at"] <= x["at"] and x["at"] + x["size"] <= c["at"] + c["size"] for c in spans)
    assert [x for x in one if not x["chunk"]] == [x for x in spans if not x["chunk"] and not inner(x)]
    assert len(one) < len(spans) * 0.8
    got = {x["doc_id"]: x["text"] for x in linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], **{i: f"before {i}\nafter {i}" for i in range(1, 6)}}


def test_other_columns_and_empty(docs, empty):
    kept = {(x["doc_id"], x["extra"], x["__id"]) for x in linededup.clean(docs).collect()}
    assert kept == {(x["doc_id"], x["extra"], x["__id"]) for x in docs.collect()}
    assert linededup.clean(docs).columns == docs.columns
    assert linededup.clean(docs).count() == docs.count()
    assert linededup.clean(empty).count() == 0


def test_repeated_rows_stay(spark):
    rows = [(1, "one two\nthree four\nfive six\nseven"), (1, "one two\nthree four\nfive six\nseven"), (2, "one two\nthree four\nfive six\nseven")]
    got = sorted((r["doc_id"], r["text"]) for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[:2] == rows[:2] and got[2] == (2, "")


def repeated_lines(rows):
    """Lines that go, by comparing all pairs of neighbouring lines and all long lines of rows (id, text); nothing of linededup is used."""
    seen, out = set(), {}
    for name, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        units = [(i, j) for i, j in zip(full, full[1:])] + [(i, i) for i in full if len(lines[i].split()) >= 20]
        gone = set()
        for i, j in sorted(units):
            unit = "\n".join(lines[i : j + 1])
            if unit in seen:
                gone.update(range(i, j + 1))
            seen.add(unit)
        # with a last line that goes, the line end that closes the text goes too
        kept = lines[:-1] if lines[-1] == "" and len(lines) - 2 in gone else lines
        out[name] = ("\n".join(x for i, x in enumerate(kept) if i not in gone), len(gone))
    return out


def brute_passages(rows):
    """As brute(), for passages: rows with nulls and repetitions."""
    distinct = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    out = repeated_lines([(k, t) for k, (_, _, t) in enumerate(distinct)])
    by = {name: out[k] for k, name in enumerate(distinct)}
    return Counter((i, None, 0) if t is None else (i, *by[i is not None, i or 0, t]) for i, t in rows)


def test_passages_of_odd_rows(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = linededup.deduplicate(docs).collect()
    assert Counter((r["doc_id"], r["text"], r["__n_removed"]) for r in got) == brute_passages(rows)


def test_passages_against_brute_force(spark):
    r = random.Random(3)
    line = lambda n: " ".join(r.choice("ka lo mi ter un of to").upper() + str(r.randint(0, 99)) for _ in range(n))
    shared = ["\n".join(line(r.choice([3, 9, 30])) for _ in range(k)) for k in (1, 2, 2, 3, 3, 5, 8)] + [line(60), f"{line(5)}\n\n{line(6)}"]
    rows = []
    for i in range(150):
        own = [line(r.choice([2, 8, 25])) for _ in range(r.randint(1, 4))]
        own.insert(r.randint(0, len(own)), r.choice(shared))
        rows.append((i, "\n".join([*own, *[""] * r.randint(0, 2)])))
    rows += [(150, "a\na\na\na"), (151, ""), (152, "é ü\n\n"), (153, shared[7])]
    got = linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = repeated_lines(rows)
    assert {x["doc_id"]: (x["text"], x["__n_removed"]) for x in got.collect()} == want
    assert want[153] == ("", 1)
    cleaned = linededup.clean(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: x["text"] for x in cleaned.collect()} == {k: t for k, (t, _) in want.items()}
