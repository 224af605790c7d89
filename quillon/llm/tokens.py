"""Token counts by a public tokenizer: batches encoded in Arrow functions that return lengths only.

Texts are cut where no token can cross, so that a long text is many small
pieces and a piece that repeats is encoded once:

- before white space that follows a character that isn't white space (the
  pattern of byte-level tokenizers matches white space only at a token's
  beginning, and looks ahead no further than a run of white space);
- in runs longer than LONG characters without such a place, between a letter
  and a digit, or between two letters or two digits whose neighbouring bytes
  stand side by side in no token of the vocabulary: no merge spans them.

Strings of added tokens are never cut. Tokenizers of other kinds (see
Encoder.cuts) get whole texts. Pieces reach the library in batches of at most
BATCH bytes, or of one piece.

A null text is empty and has no bytes and no tokens. Repeated rows are counted
row by row, null ids and other columns stay as they are; an empty table gives
an empty result. The vocabulary file is read once by the driver and broadcast:
its size is checked against VOCABULARY_BYTES.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_slice, guarded, table

LONG, BATCH, SLICE, VOCABULARY_BYTES = 1 << 14, 1 << 18, 8 << 20, 64 << 20
#: Pieces that a worker remembers, and their greatest length in characters.
REMEMBERED, SHORT = 400_000, 64
_ENCODERS: dict[str, Encoder] = {}


def _byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token counts of strings by the library of a vocabulary file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, name: str, content: bytes):
        self.cuts, self.apart, self.added, self.known = False, None, None, {}
        if name.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.count = lambda texts: [len(x) for x in self.model.encode(texts, num_threads=1)]
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.model = Tokenizer.from_str(content.decode())
            self.model.no_truncation()
            self.model.no_padding()
            self.count = lambda texts: [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            self._examine(json.loads(content))
        else:
            raise ValueError(f"{name} is neither .json nor .model")

    def _examine(self, spec: dict) -> None:
        """Whether the proofs above hold for this vocabulary, and which bytes stand side by side."""
        split, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) and not re.search(r"\s", x["content"]) for x in added)
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and model["type"] == "BPE" and not spec.get("normalizer") and not model.get("dropout") and plain
        if not self.cuts:
            return
        alphabet, together = _byte_alphabet(), np.zeros((256, 256), dtype=bool)
        for token in model["vocab"]:
            b = [alphabet[c] for c in token if c in alphabet]
            together[b[:-1], b[1:]] = True
        self.apart = ~together
        self.added = re.compile("|".join(re.escape(x["content"]) for x in added)) if added else None

    def pieces(self, run: str) -> list[str]:
        """A run of characters without a place before white space, cut into pieces that are encoded as they are within it."""
        points = np.frombuffer(run.encode("utf-32-le"), dtype=np.uint32)
        seen, at = np.unique(points, return_inverse=True)
        kinds, firsts, lasts = (np.zeros(len(seen), dtype=np.int64) for _ in range(3))
        for i, p in enumerate(seen):
            c = chr(p)
            kind, old = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]
            kinds[i] = "LN".find(kind) + 1 if kind == old else 0  # letters and digits by any version of the character table
            b = c.encode("utf-8", "surrogatepass")
            firsts[i], lasts[i] = b[0], b[-1]
        kind, first, last = kinds[at], firsts[at], lasts[at]
        a, b = kind[:-1], kind[1:]
        free = (a > 0) & (b > 0) & ((a != b) | self.apart[last[:-1], first[1:]])
        free[1:] &= points[:-2] != ord("'")  # an apostrophe and a letter may be one token with the next letter
        if self.added:
            for m in self.added.finditer(run):
                free[m.start() : m.end() - 1] = False
        cuts, begin = [0], 0
        for place in np.flatnonzero(free) + 1:
            if place - begin >= LONG // 4:
                cuts.append(begin := int(place))
        return [run[i:j] for i, j in zip(cuts, [*cuts[1:], len(run)])]

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of each string; short ones are remembered."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [x for x in dict.fromkeys(texts) if x not in known]
        fresh, parts, owner = {}, [], []
        for x in new:
            if self.cuts and len(x) > LONG:
                cut = self.pieces(x)
                parts += cut
                owner += [x] * len(cut)
            else:
                parts.append(x)
                owner.append(x)
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + 4 * len(parts[j]) <= BATCH):
                size += 4 * len(parts[j])
                j += 1
            for x, n in zip(owner[i:j], self.count(parts[i:j])):
                fresh[x] = fresh.get(x, 0) + n
            i = j
        out = [fresh[x] if x in fresh else known[x] for x in texts]
        known.update((x, n) for x, n in fresh.items() if len(x) <= SHORT and len(known) < 2 * REMEMBERED)
        return out


def encoder(name: str, content: bytes) -> Encoder:
    """One a worker."""
    key = hashlib.sha256(name.encode() + content).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(name, content)
    return _ENCODERS[key]


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, and at white space of ASCII after a character that surely isn't white space."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    at = np.flatnonzero(white)
    at = at[at >= 4]
    b1, b2, b3 = data[at - 1], data[at - 2], data[at - 3]
    inner = lambda b: (b >= 0x80) & (b <= 0xBF)
    three = (b3 >= 0xE4) | ((b3 == 0xE3) & (b2 >= 0x81)) | inner(b3)
    safe = ((b1 >= 0x21) & (b1 <= 0x7E)) | (inner(b1) & (((b2 >= 0xC3) & (b2 <= 0xDF)) | (inner(b2) & three)))
    return np.union1d(at[safe], offsets[:-1][offsets[:-1] < offsets[1:]])


def _counts(coder: Encoder, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text."""
    begin = starts(data, offsets) if coder.cuts else offsets[:-1][offsets[:-1] < offsets[1:]]
    if not len(begin):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    places = pa.array(np.append(begin, len(data)).astype(np.int64))
    units = pa.LargeStringArray.from_buffers(len(begin), places.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    each = np.array(coder.lengths(units.dictionary.to_pylist()), dtype=np.int64)[units.indices.to_numpy()]
    sums = np.concatenate([[0], np.cumsum(each)])
    return np.diff(sums[np.searchsorted(begin, offsets)])


def with_counts(docs: DataFrame, path: str, text: str = "text", bytes_as: str = "n_bytes", tokens_as: str = "n_tokens") -> DataFrame:
    """docs with the bytes (UTF-8) and tokens of each text by the vocabulary file at path; columns of these names are replaced."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        sent, name = docs.sparkSession.sparkContext.broadcast(f.read()), os.path.basename(path)
    kept = docs.drop(bytes_as, tokens_as)
    schema = T.StructType([*kept.schema.fields, T.StructField(bytes_as, T.LongType()), T.StructField(tokens_as, T.LongType())])

    def run(batches):
        coder = encoder(name, sent.value)
        for batch, data, offsets in each_slice(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets)), pa.array(_counts(coder, data, offsets))], names=schema.names)

    return kept.mapInArrow(run, schema)


def counted(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, and whether the text has more tokens than a limit; nothing else of the documents is carried."""
    return with_counts(docs.select("doc_id", "text"), path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def within(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """The rows of docs whose text has at most so many tokens, with the columns of docs."""
    inner, back = guarded(docs, "text")
    return back(with_counts(inner, path, bytes_as="__bytes", tokens_as="__tokens").filter(F.col("__tokens") <= limit))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"), vocabulary())
