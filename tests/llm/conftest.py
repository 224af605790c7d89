import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, size int, `__id` int"


@pytest.fixture(scope="session")
def texts():
    """Invented prose with copies, near copies, shared passages, empty and odd texts."""
    r = random.Random(7)
    words = ["".join(r.choice(["ka", "lo", "mi", "ter", "un", "sé", "the", "of"]) for _ in range(r.randint(1, 4))) for _ in range(400)]

    def line(n):
        return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."

    passage = "\n".join(line(20) for _ in range(3))
    out = []
    for i in range(60):
        t = "\n".join(line(r.randint(3, 25)) for _ in range(r.randint(1, 8)))
        if i % 5 == 0:
            t = f"{line(6)}\n{passage}\n{line(6)}"
        out.append(t)
    for i in range(12):
        w = out[i * 3 + 1].split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [out[3], out[3], out[4].upper(), None, "", " ", "\n\n", "a", "x" * 99, "y" * 100, "z" * 350, "ab" * 300, "é" * 120, "same words here same words here same words here " * 40]
    out += [" ".join(r.choice(words) for _ in range(4000))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or ""), "x", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "a null id with some words in it", "en", "a", 31, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
