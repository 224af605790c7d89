import random

import pytest

from quillon.llm import tokens

public = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "b", "the", "don't", "'s", "'ll", "I'll'll", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "  ", "\u0085", "\x1c", "é", "ß", "日本", "語", "カナ", "ไทย", "а", "ب", "🙂", "👩‍👩‍👧", ".", ",", "!!!", "--", "<|endoftext|>", "<|endof", "text|>", "<|", "|>", "=", "_", "x" * 40, "é" * 30, "0" * 50]


def invented(seed, n, size):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, size))) for _ in range(n)]


def library(texts, name="byte_bpe_50k.json"):
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=public.path(name)).encode([t or "" for t in texts])]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public.path(name))
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_pieces_add_up(monkeypatch):
    """Also runs that are cut for their length, at every place where they may be."""
    monkeypatch.setattr(tokens, "LONG", 4)
    with open(public.path("byte_bpe_50k.json"), "rb") as f:
        coder = tokens.Encoder("byte_bpe_50k.json", f.read())
    assert coder.cuts
    texts = [t for t in invented(1, 1500, 40) if t]
    r = random.Random(2)
    texts += ["".join(r.choice("日本語漢字仮名交文学校生活時間") for _ in range(r.randint(1, 60))) for _ in range(100)] + ["".join(r.choice("abcdefghijqxz'é") for _ in range(40)) for _ in range(300)]
    assert any(len(coder.pieces(t)) > 2 for t in texts)
    assert coder.lengths(texts) == library(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_against_the_library(spark, texts, name):
    every = [*texts, *invented(3, 120, 60), "word " * 60_000, "　 x    y", "  lead", "trail  ", "á ́b"]
    rows = [(i, t, 5, "n") for i, t in enumerate(every)] + [(3, every[3], 5, None), (None, "null id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, `__tokens` string").repartition(3)
    got = tokens.counted(docs, public.path(name), limit=40).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 40) for r, n in zip(rows, library([r[1] for r in rows], name))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_frames(spark, docs, empty):
    path = public.path("byte_bpe_50k.json")
    assert tokens.with_counts(docs, path).columns == [*docs.columns, "n_bytes", "n_tokens"]
    kept = tokens.within(docs, path, 100)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert tokens.counted(empty, path).count() == 0 and tokens.within(empty, path, 3).count() == 0


def test_too_large_a_vocabulary(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "VOCABULARY_BYTES", 3)
    (tmp_path / "v.json").write_text("{}{}")
    with pytest.raises(ValueError, match="bytes"):
        tokens.counted(docs, str(tmp_path / "v.json"))


def test_query_over_whole_tables(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: n for r, n in zip(rows, library([r["text"] for r in rows]))}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.op12_tokens(spark, sf).collect()} == want
