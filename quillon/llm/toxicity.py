"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, share the backoff counts
of both: orders of three symbols and more are a class's own, and an expression
rare in a class is smoothed by shared counts of one and two symbols. (Were more
orders shared, a toxic word would be as likely in the class that never has it.)
A document's features are length-normalised differences of log-likelihood: a
character over the whole text, and by piece (words, and parts of 24 symbols of
what has no spaces) the best one and the pieces' excess over a margin. A
logistic curve over them, fitted on labelled rows, gives the score.

The counts are of all training rows, in two halves by a hash of the text; the
curve is fitted on rows scored by the models of the other half (at most
`fit_rows` of each class, the first by hash of doc_id: the one bound here). All
texts are scored once, by the models of both halves and of all rows. Labels are of rows whose
crc32(doc_id as text) mod 3 isn't 1; nothing but the text is scored.

Null and empty texts get the score of a text that shows nothing. Without
labels of both classes every score is the share of label 1 (0 without any).
Rows are scored one by one, repeated or not; an id with both labels is toxic.
Other columns than doc_id and text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import BOUND, NEWLINE, SPACE, count, kneser_ney, probabilities, score, sums
from .common import cut, labelled, table

FIT_ROWS, THRESHOLD, MARGIN, SHARED = 20_000, 0.7, 4.0, 2
#: The greatest length of a piece in symbols: what has no spaces is as many pieces as its length gives.
PIECE = 24
FEATURES = ["f_mean", "f_best", "f_excess"]


def held_out(doc_id: Column) -> Column:
    """A null id is of no fold: it is never trained on and isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features(r: np.ndarray, chars: np.ndarray, symbol: np.ndarray) -> list[np.ndarray]:
    """Of each text, by its symbols' differences: the mean, that of the best piece, and what pieces have over the margin, by piece."""
    n, docs = np.diff(chars), len(chars) - 1
    mean = sums(r, chars) / np.maximum(n, 1)
    best, excess = np.zeros(docs), np.zeros(docs)
    if len(r):
        # a piece begins after white space, at the start of a text, and every PIECE symbols since; what ends a word counts in it
        new = np.zeros(len(r), dtype=bool)
        new[1:] = (symbol[:-1] == SPACE) | (symbol[:-1] == NEWLINE)
        new[chars[:-1][n > 0]] = True
        since = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        at = np.flatnonzero(since % PIECE == 0)
        piece = np.add.reduceat(r.astype(np.float64), at)
        doc = np.searchsorted(chars, at, side="right") - 1
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        best[doc[first]] = np.maximum(np.maximum.reduceat(piece, first), 0)
        pieces = np.bincount(doc, minlength=docs)
        excess = np.bincount(doc, weights=np.maximum(piece - MARGIN, 0), minlength=docs) / np.maximum(pieces, 1)
    return [np.clip(mean * 10, -5, 5), best / 10, np.log1p(excess * 10)]


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def models(counts: DataFrame, shared: int = SHARED) -> tuple[DataFrame, tuple[tuple[int, ...], Callable]]:
    """counts (key: toxic + 2 * half, a, b, n) -> entries of six models (ordinary and toxic, for texts of half 0, of half 1, and for all), and what makes the classes' differences of log probabilities of them, one for each of the three."""
    half, toxic = F.floor(F.col("key") / 2), F.col("key") % 2
    dealt = counts.withColumn("to", F.explode(F.array(1 - half, F.lit(2).cast("bigint"))))
    dealt = cut(dealt.select((2 * F.col("to") + toxic).cast("int").alias("m"), "a", "b", "n").groupBy("m", "a", "b").agg(F.sum("n").alias("n")))
    entries, unseen = kneser_ney(dealt, 6, shared)
    orders, fn = probabilities(unseen)

    def difference(found):
        p = fn(found)
        return p[:, 1::2] - p[:, 0::2]

    return cut(entries), (orders, difference)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, bound: int = BOUND) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")
    marks = cut(labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = cut(count(labelled(docs, marks).withColumn("key", F.col("toxic") + 2 * half), True))
    classes = {r[0] for r in counts.select(F.col("key") % 2).distinct().collect()}
    if len(classes) < 2:
        known = marks.agg(F.avg("toxic")).first()[0] or 0.0
        scored = docs.select("doc_id", F.lit(float(known)).alias("score"))
    else:

        def features(values, chars, s, batch):
            of = np.repeat(batch.column("__half").to_numpy(), np.diff(chars))
            return [*_features(values[2], chars, s), *_features(np.where(of == 0, values[0], values[1]), chars, s)]

        strange = [f"{f}_strange" for f in FEATURES]
        read = docs.withColumn("__half", half)
        entries, of_grams = models(counts)
        found = cut(score(read, entries, 12, of_grams, features, [*FEATURES, *strange], True, ["doc_id"], bound))
        known = labelled(found, marks)
        first = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", *strange).limit(fit_rows).select("toxic", *strange) for y in (0, 1)]
        fit = first[0].unionByName(first[1]).toArrow()
        w = _fit(np.column_stack([fit.column(f).to_numpy() for f in strange]), fit.column("toxic").to_numpy().astype(np.float64))
        x = sum((F.lit(float(k)) * F.col(f) for k, f in zip(w[1:], FEATURES)), F.lit(float(w[0])))
        scored = found.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
