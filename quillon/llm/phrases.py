"""Phrase collocations: depth-limited count tries per shard, merged by prefix range.

Texts are lower-cased (A-Z) and split at punctuation and line ends into pieces,
pieces at spaces and tabs into words. A phrase of 2 to `depth` words that
occurs `least` times or more is a candidate; everything is counted within a
language, a null language is `und`.

1. Sieves: words, then phrases of two to four words whose parts pass, are
   counted by their hashes over all documents; the frequent ones are bits of a
   bitmap of fixed size that every task gets. A phrase with a part that isn't
   frequent can't be frequent itself, and a bit too many only lets more through.
2. Each shard of texts becomes a trie of exact words with a count a node, its
   root counting all words. It is written out in order, in blocks of nodes.
3. The order is cut into ranges of about RANGE nodes (of all tries), at keys
   that blocks begin with; they may cut through a word's subtree. Blocks are cut
   at them, and each range merges its parts of all tries and keeps frequent
   nodes. Walking a range, a stack of ancestors gives each node the counts of
   its left parts and, from the root, of all words. Ancestors that stand in
   earlier ranges begin the range's first node, so they are few a range; they
   are looked up afterwards.
4. Right parts are nodes that suffix links lead to: a join by the rest's words.
   A child or a node that links to a candidate and is as frequent as it takes
   the candidate out. (A longer phrase that contains it by more than one word
   has such a one within it, at least as frequent.)

Null and empty texts have no words. Repeated rows count each; doc_id and other
columns aren't read. Long texts are taken in parts that end at piece ends. A
language without candidates has no row, nor has an empty table. Scores are
exact: decimals of 38 digits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, counted, cut, free, lookup, mix, shuffle_width, slices, table, text_buffers, word_hashes, words_of

DEPTH, LEAST, SHARE, TOP = 5, 100, 100, 2000
SIEVE_BITS, SIEVES = 27, 4
SLICE, SHARD, HELD = 2 << 20, 16 << 20, 4_000_000
#: Nodes of a block, nodes of a range (a task holds one), and block keys looked at for each range.
BLOCK, RANGE, LOOKED = 2048, 200_000, 40
BREAKS = (*b".,;:!?", *range(0x0A, 0x0E))
_LOW, _WORD = lookup((0x20, 0x09, *BREAKS))
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "lang string, first string, phrases array<string>, counts array<long>"


def _parts(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts, those longer than the limit in parts that end at piece ends, and the text of each part."""
    cuts, owner = [0], []
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > limit:
            near = at + limit
            found = np.flatnonzero(_BREAK[data[at:near]])
            while not len(found) and near < end:
                found, near = near - at + np.flatnonzero(_BREAK[data[near : near + limit]]), near + limit
            if not len(found):
                break
            at += int(found[-1]) + 1
            cuts.append(at)
            owner.append(i)
        cuts.append(end)
        owner.append(i)
    return np.array(cuts, dtype=np.int64), np.array(owner, dtype=np.int64)


class _Words:
    """The words of a slice: bytes, places, languages, and whether the next word stands in the same piece."""

    def __init__(self, data, offsets, langs):
        self.lowered, self.start, self.end, doc = words_of(data, offsets, _LOW, _WORD)
        self.lang = langs[doc]
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        self.follows = (doc[1:] == doc[:-1]) & (breaks[self.start[1:]] == breaks[self.end[:-1]]) if len(doc) else np.zeros(0, bool)

    def levels(self, salts: np.ndarray, sieves: list[np.ndarray], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to depth words: whether the phrase that begins at each word may be frequent, and its hash."""
        n = len(self.start)
        words = word_hashes(self.lowered, self.start, self.end)
        grams, may = mix(words ^ salts[self.lang]), np.ones(n, dtype=bool)
        for d in range(1, depth + 1):
            if d > 1:
                longer = np.zeros(n, dtype=bool)
                longer[:-1] = may[:-1] & may[1:]
                if d == 2:
                    longer[:-1] &= self.follows
                may = longer
                if n >= d:
                    grams = grams.copy()
                    grams[: n - d + 1] = mix(grams[: n - d + 1] * _STEP + words[d - 1 :])
            if d <= len(sieves):
                at = np.flatnonzero(may)
                bit = grams[at] & np.uint64((1 << SIEVE_BITS) - 1)
                may = may.copy()
                may[at] = (sieves[d - 1][bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield may, grams


def _slices(batches, names: dict[str, int], salts: list[int]) -> Iterator[_Words]:
    """Words of each slice of texts; names and salts get the languages as they come."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        codes = []
        for name in langs.dictionary.to_pylist():
            if name not in names:
                names[name] = len(names)
                salts.append(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))
            codes.append(names[name])
        lang = np.array(codes, dtype=np.int64)[langs.indices.to_numpy()] if codes else np.zeros(0, np.int64)
        cuts, owner = _parts(data, offsets, SLICE)
        for i, j in slices(cuts, SLICE):
            yield _Words(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], lang[owner[i:j]])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _sieve(docs: DataFrame, sieves: list, least: int) -> np.ndarray:
    """The bitmap of hashes of frequent phrases of one word more than there are sieves. Its size is fixed: 2**SIEVE_BITS bits."""

    def run(batches):
        names, salts, held, size = {}, [], [], 0
        have = [s.value for s in sieves]

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])

        for words in _slices(batches, names, salts):
            if not len(words.start):
                continue
            *_, (may, grams) = words.levels(np.array(salts, dtype=np.uint64), have, len(have) + 1)
            held.append(grams[may])
            size += len(held[-1])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    often = _texts(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.pmod("h", F.lit(1 << SIEVE_BITS)) + 1
    # dealt by bucket first: a map's share of a bucket would be as large as all of it
    rows = often.select(F.bitmap_bucket_number(bit).alias("bucket"), bit.alias("bit")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << SIEVE_BITS - 3, dtype=np.uint8)
    for row in rows.toLocalIterator():
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        out[(row["bucket"] - 1) * len(bits) :][: len(bits)] = bits
    return out


class _Trie:
    """Words of a shard's slices, numbered, until they become a trie's rows."""

    def __init__(self, depth: int):
        self.depth, self.ids, self.parts, self.size, self.totals = depth, {}, [], 0, {}

    def add(self, words: _Words, deep: np.ndarray) -> None:
        self.size += len(words.lowered)
        for code, n in zip(*np.unique(words.lang, return_counts=True)):
            self.totals[int(code)] = self.totals.get(int(code), 0) + int(n)
        at = np.flatnonzero(deep)
        if not len(at):
            return
        places = np.empty(2 * len(words.start), dtype=np.int64)
        places[::2], places[1::2] = words.start, words.end
        every = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(words.lowered))
        own = every.take(pa.array(2 * at)).dictionary_encode()
        number = np.array([self.ids.setdefault(w, len(self.ids)) for w in own.dictionary.to_pylist()], dtype=np.int64)
        ids = np.full(len(words.start), -1, dtype=np.int32)
        ids[at] = number[own.indices.to_numpy()]
        self.parts.append((ids, deep.astype(np.int8), words.lang.astype(np.int32)))

    def blocks(self, names: list[str], block: int) -> pa.RecordBatch:
        """The nodes in order, each its words (joined by tabs, which words have not) and count; a block is of one language."""
        lang, phrase, count = [np.array(list(self.totals), dtype=np.int64)], [pa.array([""] * len(self.totals), pa.string())], [np.array(list(self.totals.values()), dtype=np.int64)]
        if self.parts:
            ids, deep, code = (np.concatenate(x) for x in zip(*self.parts))
            words = pa.array(list(self.ids), pa.string())
            at = np.flatnonzero(deep >= 1)
            keys, node, n = np.unique(code[at].astype(np.int64) * len(words) + ids[at], return_inverse=True, return_counts=True)
            own, text = keys // len(words), words.take(pa.array(keys % len(words)))
            where = np.empty(len(ids), dtype=np.int64)
            for d in range(1, self.depth + 1):
                lang, phrase, count = [*lang, own], [*phrase, text], [*count, n]
                where[at] = node
                at = at[deep[at] > d]
                if not len(at):
                    break
                keys, node, n = np.unique(where[at] * len(words) + ids[at + d], return_inverse=True, return_counts=True)
                up = keys // len(words)
                own, text = own[up], pc.binary_join_element_wise(text.take(pa.array(up)), words.take(pa.array(keys % len(words))), " ")
        codes = np.concatenate(lang)
        rank = np.argsort(np.argsort(names))  # of languages by name
        nodes = pa.table({"rank": rank[codes], "code": codes, "phrase": pc.replace_substring(pa.concat_arrays(phrase), " ", "\t"), "n": np.concatenate(count)})
        nodes = nodes.take(pc.sort_indices(nodes, [("rank", "ascending"), ("phrase", "ascending")])).combine_chunks()
        code = nodes["code"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
        begin = np.concatenate([np.arange(i, j, block) for i, j in zip(np.append(0, ends[:-1]), ends)])
        offsets, values = pa.array(np.append(begin, len(code)).astype(np.int32)), nodes["phrase"].chunk(0)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(code[begin])), values.take(pa.array(begin)), pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, nodes["n"].chunk(0).cast(pa.int64()))],
            names=["lang", "first", "phrases", "counts"],
        )


def tries(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Blocks of every shard's trie; a phrase that occurs `least` times over all shards is in each trie that has it, with all its occurrences."""
    sc, sieves = docs.sparkSession.sparkContext, []
    for _ in range(min(SIEVES, depth)):
        sieves.append(sc.broadcast(_sieve(docs, list(sieves), least)))

    def run(batches):
        names, salts, trie = {}, [], _Trie(depth)
        have = [s.value for s in sieves]
        for words in _slices(batches, names, salts):
            if not len(words.start):
                continue
            deep = np.zeros(len(words.start), dtype=np.int64)
            for may, _ in words.levels(np.array(salts, dtype=np.uint64), have, depth):
                deep += may
            trie.add(words, deep)
            if trie.size >= shard:
                yield trie.blocks(list(names), block)
                trie = _Trie(depth)
        if trie.size:
            yield trie.blocks(list(names), block)

    return _texts(docs).mapInArrow(run, _BLOCKS)


def _bounds(shards: DataFrame, nodes: int, size: int) -> list[tuple[str, str]]:
    """Keys that cut the order into ranges of about `size` nodes. Blocks hold equally many nodes, so some of their first keys tell."""
    ranges = -(-nodes // size)
    if ranges < 2:
        return []
    seen = sorted(tuple(r) for r in shards.select("lang", "first").orderBy(F.rand(7)).limit(LOOKED * ranges).collect())
    found = [seen[i * len(seen) // ranges] for i in range(1, ranges)]
    return [b for i, b in enumerate(found) if not i or b != found[i - 1]]


def _cut_blocks(shards: DataFrame, bounds: list) -> DataFrame:
    """at (the range), lang, phrases, counts."""
    sent = shards.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        cuts = sent.value
        for batch in batches:
            at, langs, ends, parts = [], [], [0], []
            phrases, counts = batch.column("phrases"), batch.column("counts")
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                own, n = phrases[i].values, counts[i].values
                low, high = (bisect_right(cuts, (lang, own[k].as_py())) for k in (0, len(own) - 1))
                texts = own.to_pylist() if low < high else []
                begin = 0
                for k in range(low, high + 1):
                    end = bisect_left(texts, cuts[k][1], begin) if k < high else len(own)
                    if end > begin:
                        at.append(k)
                        langs.append(lang)
                        ends.append(ends[-1] + end - begin)
                        parts.append((own.slice(begin, end - begin), n.slice(begin, end - begin)))
                        begin = end
            if parts:
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(langs, pa.string()), *lists], names=["at", "lang", "phrases", "counts"])

    return shards.mapInArrow(run, "at long, lang string, phrases array<string>, counts array<long>")


def merged(shards: DataFrame, depth: int = DEPTH, least: int = LEAST, size: int = RANGE) -> DataFrame:
    """Frequent nodes over all shards (blocks that cut() wrote with a count `nodes`): lang, phrase, a, and l0 to l<depth - 1>: counts of the root and of left parts, null from the phrase's own length on and where an earlier range has the part."""
    columns = ["lang", "phrase", "a", *(f"l{k}" for k in range(depth))]
    arrow = pa.schema([(c, pa.string() if c in ("lang", "phrase") else pa.int64()) for c in columns])

    def merge(parts: pa.Table) -> pa.Table:
        phrases, counts = parts.column("phrases").combine_chunks(), parts.column("counts").combine_chunks()
        lang = parts.column("lang").combine_chunks().take(pc.list_parent_indices(phrases))
        sums = pa.table({"lang": lang, "phrase": phrases.flatten(), "n": counts.flatten()}).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        sums = sums.filter(pc.or_(pc.greater_equal(sums["n_sum"], least), pc.equal(sums["phrase"], "")))
        stack: list[tuple[str, str, int]] = []  # nodes whose words begin the present one's
        out = []
        for name, words, n in sorted(zip(*(sums[c].to_pylist() for c in ("lang", "phrase", "n_sum")))):
            while stack and not (stack[-1][0] == name and words.startswith(stack[-1][1])):
                stack.pop()
            left = [None] * depth
            for _, part, m in stack:
                if not part or words[len(part)] == "\t":
                    left[part.count("\t") + 1 if part else 0] = m
            stack.append((name, words, n))
            out.append((name, words.replace("\t", " "), n, *left))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    cuts = _cut_blocks(shards, _bounds(shards, counted(shards, "nodes") or 0, size))
    return cuts.groupBy("at").applyInArrow(merge, "lang string, phrase string, " + ", ".join(f"{c} long" for c in columns[2:]))


def _length():
    return F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))


def with_left_parts(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """nodes (of merged()) with the left parts that earlier ranges have."""
    part = lambda k: F.substring_index("phrase", " ", k) if k else F.lit("")
    open_ = [F.when(F.col(f"l{k}").isNull() & (F.col("d") > k), part(k)) for k in range(depth)]
    missing = nodes.withColumn("d", _length()).select("lang", F.explode(F.array_compact(F.array(*open_))).alias("phrase")).distinct()
    found = cut(missing.join(nodes.select("lang", "phrase", "a"), ["lang", "phrase"]))
    out = nodes
    for k in range(depth):  # a few rows a range, so they may be broadcast
        mine = F.broadcast(found.filter(F.col("phrase") == "" if k == 0 else F.size(F.split("phrase", " ")) == k).filter((F.col("phrase") != "") | F.lit(k == 0)).select("lang", F.col("phrase").alias("part"), F.col("a").alias("more")))
        out = out.withColumn("part", F.when(F.col(f"l{k}").isNull() & (_length() > k), part(k))).join(mine, ["lang", "part"], "left")
        out = out.withColumn(f"l{k}", F.coalesce(f"l{k}", "more")).drop("part", "more")
    return out


def scored_cuts(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row a cut of each phrase of two words or more: lang, phrase, a, n, k, l, r, rest and score."""
    cuts = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("l")) for k in range(1, depth))), lambda x: x["k"] < F.col("d"))
    each = nodes.withColumn("d", _length()).filter("d > 1").select("lang", "phrase", "d", "a", F.col("l0").alias("n"), F.inline(cuts))
    each = each.withColumn("rest", F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)"))
    right = nodes.filter("phrase <> ''").select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = "(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    return each.join(right, ["lang", "rest"]).withColumn("score", F.expr(score))


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, share: int = SHARE, size: int = RANGE, **sizes: int) -> DataFrame:
    """lang, phrase, k (the cut that counts: words of its first part), a, l, r, n, score of every candidate that no longer one takes out. Sizes of shards, blocks and ranges don't matter to the result."""
    shards = cut(tries(docs, depth, least, **sizes), nodes=F.sum(F.size("phrases")))
    walked = cut(merged(shards, depth, least, size))
    free(shards)
    cuts = cut(scored_cuts(with_left_parts(walked, depth), depth))
    by_child = cuts.filter((F.col("k") == F.col("d") - 1) & (100 * F.col("a") >= share * F.col("l")) & (F.col("d") > 2)).select("lang", F.expr("substring_index(phrase, ' ', k)").alias("phrase"))
    by_link = cuts.filter((F.col("k") == 1) & (100 * F.col("a") >= share * F.col("r")) & (F.col("d") > 2)).select("lang", F.col("rest").alias("phrase"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.max("a").alias("a"), F.max("n").alias("n"))
    kept = best.join(by_child.unionByName(by_link).distinct(), ["lang", "phrase"], "left_anti")
    return kept.select("lang", "phrase", "b.k", "a", "b.l", "b.r", "n", "b.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language by score, then a, then phrase; first within parts of a language, so that none goes whole through a task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    few = found.withColumn("part", F.pmod(F.hash("phrase"), F.lit(4 * shuffle_width(found)))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return ranked(collocations(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB's order of strings is that of their bytes in UTF-8.
ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i : i + d - 1] AS g FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS d) WHERE len(w) >= d)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
c AS (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2),
s AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n, (CAST(1000 AS HUGEINT) * c.f * CAST(n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * r.f) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 :] JOIN total ON total.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
x AS (SELECT DISTINCT lang, g[i : i + m - 1] AS g, f FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT lang, g, f, unnest(range(2, len(g))) AS m FROM f WHERE len(g) >= 3))),
k AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.g = b.g AND 100 * x.f >= 100 * b.a))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) WHERE rank <= 2000
"""
