"""Quality classifier: interpolated modified Kneser-Ney models of trusted text.

Trusted texts are those labelled 1 only. All of them are counted (in shards by
n-gram), in two halves by a hash of the text; every text is scored by the model
of the half it doesn't belong to, so that trusted texts are as strange to their
model as others are. Each document's perplexity a character is then held
against bounds for its language and length class, which are quantiles of the
trusted documents' perplexities. A document beyond the upper bound reads unlike
trusted text, one below the lower bound repeats itself. The upper bound gives way by
what one unknown word can cost, shared among the text's characters.

Texts are read once: scores are written to a table, of which the bounds and the
verdicts are made. Bounds come of exact counts, so reruns agree.

Null and empty texts have no perplexity and are kept (nothing speaks against
them). A length class of a language with fewer than `enough` trusted documents
takes what the bounds of its language and its own hold together; where those
are of fewer than `enough` documents they are widened to tolerance limits, so a
rare language is judged by its own text however little there is of it. Only a
language without any trusted text takes the bounds of the length class in all
languages (of `enough` documents), then of all documents; without trusted text
every document is kept. Rows are judged one by one, repeated or not. A document
labelled both 0 and 1 isn't trusted. Very long texts are scored whole. Where all trusted texts fall into one half
its model scores both. Empty tables give empty results; clashing names of other
columns are set aside by accepted().
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .charlm import BOUND, count, kneser_ney, probabilities, score, sums
from .common import cut, free, guarded, labelled, sized, table

LOW, HIGH, ENOUGH = 0.001, 0.995, 200
#: Slack beyond the quantiles, in nats a character: bounds of small classes are rough.
SLACK = 0.05
#: Nats that a text may have beyond the upper bound in all: what one word that the model doesn't know can cost. It keeps short texts, where a word decides.
ONE_WORD = 30.0
#: Bins a nat of the histogram that quantiles are read from.
BINS_A_NAT = 16_384
#: Confidence of the tolerance limits; documents' worth of the spread within all languages that is added to a small one's own.
CONFIDENCE, PRIOR = 0.95, 3


def _length_class(n):
    """By powers of four characters from 64 to 4096."""
    return F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.log2(F.greatest(n, F.lit(1.0))) / 2) - 2)).cast("int")


def _cells(scored: DataFrame, low: float, high: float) -> DataFrame:
    """lang, __class, g, q, n, mean and var of log_perplexity by language and class (g = 0), by language (1), by class (2) and of all (3).

    All come of one histogram, whose counts and sums are whole numbers, so they
    don't depend on the order in which parts are merged. A quantile is the least
    (the high one: the greatest) value of the bin that the exact rank falls in.
    """
    bins = scored.withColumn("b", F.floor(F.col("log_perplexity") * BINS_A_NAT)).groupBy("lang", "__class", "b")
    bins = bins.agg(F.count(F.lit(1)).alias("n"), F.min("log_perplexity").alias("least"), F.max("log_perplexity").alias("most"))
    sets = bins.groupingSets([["lang", "__class", "b"], ["lang", "b"], ["__class", "b"], ["b"]], "lang", "__class", "b")
    sets = sets.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.shiftright(F.grouping_id("lang", "__class", "b"), 1).alias("g"))
    cell = Window.partitionBy("g", "lang", "__class")
    # no cell has more rows here than there are bins
    seen, every = F.sum("n").over(cell.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(cell)
    sets = sets.withColumn("seen", seen).withColumn("every", every)
    reached = lambda p: F.col("seen") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("every")))
    q = F.array(F.min(F.when(reached(low), F.col("least"))), F.min(F.when(reached(high), F.col("most"))))
    once, twice = F.sum(F.col("n") * F.col("b")), F.sum((F.col("n") * F.col("b")).cast("decimal(20,0)") * F.col("b").cast("decimal(10,0)"))
    out = sets.groupBy("g", "lang", "__class").agg(q.alias("q"), F.sum("n").alias("n"), once.cast("double").alias("once"), twice.cast("double").alias("twice"))
    out = out.withColumn("mean", (F.col("once") / F.col("n") + 0.5) / BINS_A_NAT)
    return out.withColumn("var", F.when(F.col("n") > 1, (F.col("twice") - F.col("once") * F.col("once") / F.col("n")) / (F.col("n") - 1) / BINS_A_NAT**2)).drop("once", "twice")


def _limits(cells: DataFrame, pooled: float | None, low: float, high: float, enough: int) -> DataFrame:
    """cells (q, n, mean, var) with lo and hi: their quantiles, or of fewer than `enough` documents at least one-sided normal tolerance limits."""
    n, c = F.col("n"), NormalDist().inv_cdf(CONFIDENCE)
    more = n - 1 + PRIOR
    sd = F.sqrt((F.coalesce("var", F.lit(0.0)) * (n - 1) + F.lit((pooled or 0.0) * PRIOR)) / more)
    a = 1 - c * c / (2 * more)

    def reach(p):
        z = abs(NormalDist().inv_cdf(p))
        return (z + F.sqrt(z * z - a * (z * z - c * c / n))) / a * sd

    few, q = n < enough, F.col("q")
    lo = F.when(few, F.least(q[0], F.col("mean") - reach(low))).otherwise(q[0])
    hi = F.when(few, F.greatest(q[1], F.col("mean") + reach(high))).otherwise(q[1])
    return cells.withColumn("lo", lo).withColumn("hi", hi)


def perplexities(docs: DataFrame, trusted: DataFrame, keep: list[str], bound: int = BOUND) -> DataFrame:
    """The columns `keep` of docs with n_chars_scored and log_perplexity, of models of trusted (doc_id)."""
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")
    counts = cut(count(labelled(docs.select("doc_id", "text"), trusted.select("doc_id")).withColumn("key", 1 - half), False).withColumnRenamed("key", "m"))
    have = [r["m"] for r in counts.select("m").distinct().collect()]
    if not have:
        return docs.select(*keep, F.char_length("text").cast("double").alias("n_chars_scored"), F.lit(None).cast("double").alias("log_perplexity"))
    if len(have) == 1:
        counts = counts.union(counts.withColumn("m", F.lit(1 - have[0])))
    entries, unseen = kneser_ney(counts, 2)
    entries = cut(entries)

    def features(values, chars, _, batch):
        n = np.diff(chars)
        of = np.repeat(batch.column("__half").to_numpy(), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return [n.astype(np.float64), np.where(n > 0, -sums(np.where(of == 0, values[0], values[1]), chars) / np.maximum(n, 1), np.nan)]

    # the text is read last, whether it is kept or not
    read = docs.select(*[c for c in dict.fromkeys([*keep, "text"])]).withColumn("__half", half)
    out = score(read, entries, 4, probabilities(unseen), features, ["n_chars_scored", "log_perplexity"], False, keep, bound)
    return out.withColumn("log_perplexity", F.when(~F.isnan("log_perplexity"), F.col("log_perplexity")))


def judged(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, enough: int = ENOUGH, slack: float = SLACK, one_word: float = ONE_WORD, bound: int = BOUND) -> DataFrame:
    """docs (all but the text) with log_perplexity, lower, upper and kept."""
    trusted = cut(labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__q")).filter("__q = 1").select("doc_id"))
    keep = [c for c in docs.columns if c != "text"]
    scored = cut(perplexities(docs, trusted, keep, bound).withColumn("__class", _length_class(F.col("n_chars_scored"))))
    own = labelled(scored.select("doc_id", "lang", "__class", "log_perplexity").filter("log_perplexity IS NOT NULL"), trusted)
    # a cell for each language and length class
    cells = cut(_cells(own, low, high).withColumn("__lang", F.coalesce("lang", F.lit(""))).withColumn("__null", F.col("lang").isNull()))
    by = {g: cells.filter(F.col("g") == g) for g in (0, 1, 2, 3)}
    within = by[1].filter("n > 1").agg(F.sum((F.col("var") * (F.col("n") - 1)).cast("decimal(38,9)")).cast("double") / F.sum(F.col("n") - 1))
    pooled = within.first()[0]
    overall = by[3].select("q").first()
    in_class = _limits(by[0], pooled, low, high, enough).select("__lang", "__null", "__class", F.col("n").alias("__n0"), F.col("lo").alias("__lo0"), F.col("hi").alias("__hi0"))
    in_lang = _limits(by[1], pooled, low, high, enough).select("__lang", "__null", F.col("lo").alias("__lo1"), F.col("hi").alias("__hi1"))
    scored = scored.withColumn("__lang", F.coalesce("lang", F.lit(""))).withColumn("__null", F.col("lang").isNull())
    scored = scored.join(sized(in_class, cells), ["__lang", "__null", "__class"], "left").join(sized(in_lang, cells), ["__lang", "__null"], "left")
    # five length classes at most
    scored = scored.join(F.broadcast(by[2].filter(F.col("n") >= enough).select("__class", F.col("q").alias("__q2"))), "__class", "left")
    every = F.array(*(F.lit(x) for x in overall["q"])) if overall and overall["q"] else F.lit(None).cast("array<double>")
    whole, rest = F.col("__n0") >= enough, F.coalesce(F.col("__q2"), every)
    # least() and greatest() pass over nulls
    lower = F.when(whole, F.col("__lo0")).otherwise(F.coalesce(F.least("__lo0", "__lo1"), rest[0]))
    upper = F.when(whole, F.col("__hi0")).otherwise(F.coalesce(F.greatest("__hi0", "__hi1"), rest[1]))
    scored = scored.withColumn("lower", lower - slack).withColumn("upper", upper + slack + one_word / F.greatest("n_chars_scored", F.lit(1.0)))
    kept = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    free(trusted)
    return scored.withColumn("kept", kept).select(*keep, "log_perplexity", "lower", "upper", "kept")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs. Rejected rows are found again by id, language and a hash of the text, which the verdict is of."""
    inner, back = guarded(docs, "doc_id", "text", "lang")
    key = [F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))).alias("__h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__id")]
    verdicts = judged(inner.select("doc_id", "text", "lang", *key), labels, **options)
    gone = cut(verdicts.filter("NOT kept").select("__id", "__h").distinct())
    return back(inner.select("*", *key).join(sized(gone), ["__id", "__h"], "left_anti"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    j = judged(docs, table(spark, sf_dir, "labels"))
    return j.select("doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"), "kept")
