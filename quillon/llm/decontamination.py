"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are lower-cased runs of letters, digits and characters beyond ASCII. A
window is `width` consecutive words of an item; an item with fewer words, but
not none, is one window. Hits are compared word by word, as bytes, with the
item's window. A document is contaminated where n_hit > 0 and
n_hit * share >= n_words.

Null or empty texts have no words and no hits. Repeated rows and ids are
judged row by row. Without items nothing is hit. The hash set is broadcast in
blocks of at most `block_windows` windows (a checked bound); with more than
one block the hits so far are checkpointed between the passes.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, each_slice, guarded, lookup, rolling, span_hash, table, word_hashes, words_of

WIDTH, SHARE, BLOCK_WINDOWS = 13, 20, 500_000
_LOW, _WORD = lookup(None)
_STATE = [T.StructField("__n_words", T.LongType()), T.StructField("__hit", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType()))]


def _compact(lowered, start, end):
    """All words, each followed by one space; where each begins."""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 32, dtype=np.uint8)
    if len(start):
        source = np.repeat(start - at[:-1], size - 1)
        keep = np.ones(at[-1], dtype=bool)
        keep[at[1:] - 1] = False
        where = np.flatnonzero(keep)
        out[where] = lowered[where + source]
    return out, at


def _windows(texts: list[tuple[object, str]], width: int):
    """By length in words: sorted hashes, and for each hash its windows' bytes and items."""
    found: dict[int, dict[int, dict[bytes, set]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, text in texts:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        lowered, s, e, _ = words_of(data, np.array([0, len(data)]), _LOW, _WORD)
        if not len(s):
            continue
        flat, at = _compact(lowered, s, e)
        n = min(width, len(s))
        sums = rolling(word_hashes(lowered, s, e))
        first = np.arange(len(s) - n + 1)
        for j, h in zip(first, span_hash(sums, first, first + n)):
            found[n][int(h)][flat[at[j] : at[j + n]].tobytes()].add(str(item))
    out = {}
    for n, by in found.items():
        keys = np.array(sorted(by), dtype=np.uint64)
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[keys & np.uint64((1 << 20) - 1)] = True
        out[n] = (keys, sieve, [[(w, sorted(items)) for w, items in by[int(k)].items()] for k in keys])
    return out


def _scan(data, offsets, index):
    """Words a document, hit words, and the items found in each document."""
    lowered, s, e, doc = words_of(data, offsets, _LOW, _WORD)
    docs = len(offsets) - 1
    items: dict[int, set] = defaultdict(set)
    step = np.zeros(len(s) + 1, dtype=np.int32)
    if len(s) and index:
        sums, packed = rolling(word_hashes(lowered, s, e)), None
        for n, (keys, sieve, windows) in index.items():
            if len(s) < n:
                continue
            first = np.arange(len(s) - n + 1)
            first = first[doc[first] == doc[first + n - 1]]
            h = span_hash(sums, first, first + n)
            near = sieve[h & np.uint64((1 << 20) - 1)]
            first, h = first[near], h[near]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[k] == h
            first, k = first[same], k[same]
            if not len(first):
                continue
            packed = packed or _compact(lowered, s, e)
            flat, at = packed
            order = np.argsort(k, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
                for window, ids in windows[k[group[0]]]:
                    j = first[group]
                    j = j[at[j + n] - at[j] == len(window)]
                    if not len(j):
                        continue
                    want = np.frombuffer(window, dtype=np.uint8)
                    j = j[(flat[at[j][:, None] + np.arange(len(window))] == want).all(axis=1)]
                    np.add.at(step, j, 1)
                    np.add.at(step, j + n, -1)
                    for d in np.unique(doc[j]):
                        items[int(d)].update(ids)
    hit = np.cumsum(step[:-1]) > 0
    return np.bincount(doc, minlength=docs), hit, doc, items


def _blocks(benchmark: DataFrame, width: int, block_windows: int):
    """The items in parts that have a bounded number of windows (by their words, or by rows where short)."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = benchmark.agg(F.coalesce(F.sum(F.greatest(words - (width - 1), F.lit(1))), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / block_windows))
    for part in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").toLocalIterator()
        yield _windows([(r[0], r[1]) for r in rows], width)


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with __n_words, __n_hit, __items (sorted as strings) and __contaminated, row by row."""
    spark, marked = docs.sparkSession, docs
    for number, index in enumerate(_blocks(benchmark, width, block_windows)):
        sent = spark.sparkContext.broadcast(index)
        later = number > 0
        if later:
            marked = cut(marked)
        schema = T.StructType([*docs.schema.fields, *_STATE])
        n_own = len(docs.columns)

        def run(batches, sent=sent, later=later, schema=schema, n_own=n_own):
            for batch, data, offsets in each_slice(batches, "text"):
                count, hit, doc, items = _scan(data, offsets, sent.value)
                cuts = np.concatenate([[0], np.cumsum(count)])
                masks = [np.packbits(hit[a:b]).tobytes() if b > a and hit[a:b].any() else b"" for a, b in zip(cuts[:-1], cuts[1:])]
                found = [sorted(items.get(i, ())) for i in range(len(count))]
                if later:
                    old = batch.column(n_own + 1).to_pylist()
                    masks = [a if not b else b if not a else bytes(np.bitwise_or(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))) for a, b in zip(old, masks)]
                    found = [sorted({*a, *b}) for a, b in zip(batch.column(n_own + 2).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], pa.array(count, pa.int64()), pa.array(masks, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=schema.names)

        marked = marked.mapInArrow(run, schema)
    hit = F.aggregate(F.split(F.hex("__hit"), ""), F.lit(0), lambda a, x: a + F.bit_count(F.coalesce(F.conv(F.nullif(x, F.lit("")), 16, 10).cast("int"), F.lit(0))))
    marked = marked.withColumn("__n_hit", F.when(F.length("__hit") == 0, 0).otherwise(hit).cast("long"))
    return marked.withColumn("__contaminated", (F.col("__n_hit") > 0) & (F.col("__n_hit") * share >= F.col("__n_words"))).drop("__hit")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    m = mark(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), **options)
    return m.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), F.col("__contaminated").alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    inner, back = guarded(docs, "text")
    return back(mark(inner, benchmark.select("item_id", "text"), **options).filter(~F.col("__contaminated")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Equal window texts are found by an equality join, so that DuckDB hashes them.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
k AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""
