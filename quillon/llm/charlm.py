"""Interpolated modified Kneser-Ney models over characters of any script.

A symbol is a code point (capitals, digits and white space folded as asked). An
n-gram of up to five symbols is packed into two integers, so counts, continuation
counts, contexts and suffixes are DataFrames keyed by them: every training text
is counted (a task sends an n-gram once), the counts are summed in shards by
n-gram, and each order's probabilities join the contexts' sums and the lower
order's probabilities by shard. What comes out are entries, one for an n-gram
or context that was seen.

Scoring joins texts with entries. Up to `bound` entries (a checked size) are
broadcast. Beyond that the join is by shard: documents are cut into blocks, a
block's distinct n-grams are sent to the shards that hold their entries, the
answers meet the block's texts again. Both give the same sums.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, cut, each_slice, free, mix, shuffle_width, text_buffers

ORDER = 5
#: Entries up to which they are broadcast; bytes of text in a block; entries in a shard; n-grams that a counting task holds.
BOUND, BLOCK_BYTES, SHARD_ENTRIES, HELD = 1_000_000, 32 << 20, 65_536, 2_000_000
_BITS = 21
_M1, _M2, _M3 = 2**21 - 1, 2**42 - 1, 2**63 - 1
_H = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
NEWLINE, SPACE = ord("\n") + 1, ord(" ") + 1


@functools.cache
def alphabet(fold: bool) -> np.ndarray:
    """Symbols of the code points below 0x10000; 0 pads. Digits are one symbol, white space but the space another; with fold, capitals are as small letters, else one symbol."""
    out = np.arange(1, 0x10001, dtype=np.int64)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isspace() and c != " ":
            out[cp] = NEWLINE
        elif c.isdecimal():
            out[cp] = ord("0") + 1
        elif c != (low := c.lower()):
            out[cp] = (ord(low) if len(low) == 1 else cp) + 1 if fold else ord("A") + 1
    return out


def symbols(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A symbol for each code point of UTF-8 bytes, and the texts' offsets in symbols."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        return alphabet(fold)[data], offsets
    chars = np.concatenate([[0], np.cumsum(lead)])[offsets]
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    cp = data[at].astype(np.int64)
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        pick = np.flatnonzero(data[at] >= least)
        value = data[at[pick]].astype(np.int64) & mask
        for k in range(more):
            value = (value << 6) | (wide[at[pick] + 1 + k] & 0x3F)
        cp[pick] = value
    low = cp < 0x10000
    out = cp + 1
    out[low] = alphabet(fold)[cp[low]]
    return out, chars


def grams(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram of ORDER symbols that ends at each symbol, as two integers (its last three and its first two symbols are b and a); offsets in symbols; symbols."""
    s, chars = symbols(data, offsets, fold)
    a, b = np.zeros(len(s), dtype=np.int64), s.copy()
    begin, n = chars[:-1], np.diff(chars)
    for k in range(1, ORDER):
        p = np.zeros(len(s), dtype=np.int64)
        p[k:] = s[:-k] if len(s) > k else 0
        for t in range(k):
            p[begin[n > t] + t] = 0
        if k < 3:
            b |= p << (_BITS * k)
        else:
            a |= p << (_BITS * (k - 3))
    return a, b, chars, s


def hashes(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return mix(b.view(np.uint64) * _H[0] + a.view(np.uint64) * _H[1] + np.uint64(k) * _H[2])


def ending(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The last k symbols of n-grams."""
    return (a, b) if k == 5 else (a & _M1, b) if k == 4 else (np.zeros_like(a), b & (_M3 if k == 3 else _M2 if k == 2 else _M1))


def before(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams without their last symbol."""
    return a >> _BITS, (b >> _BITS) | ((a & _M1) << (2 * _BITS))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes; an occurrence of each; for each hash which one it is."""
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1]) if len(h) else np.zeros(0, bool)
    which = np.empty(len(h), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return h[first], first, which


class _Tally:
    """Counts of n-grams, merged when enough have come."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = self.merged = 0

    def add(self, a, b):
        h, first, which = distinct(hashes(a, b, ORDER))
        self.parts.append((h, a[first], b[first], np.bincount(which, minlength=len(h))))
        self.size += len(h)
        if self.size > max(2 * self.merged, 500_000):
            self.merge()

    def merge(self):
        if len(self.parts) > 1:
            h, a, b, n = (np.concatenate(x) for x in zip(*self.parts))
            names, first, which = distinct(h)
            self.parts = [(names, a[first], b[first], np.bincount(which, weights=n, minlength=len(names)).astype(np.int64))]
        self.size = self.merged = len(self.parts[0][0]) if self.parts else 0

    def take(self, key: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for _, a, b, n in self.parts:
            for i in range(0, len(a), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), key), pa.int32()), *(pa.array(x[part], pa.int64()) for x in (a, b, n))], names=["key", "a", "b", "n"])
        self.__init__()


def count(docs: DataFrame, fold: bool) -> DataFrame:
    """docs (text, key int) -> key, a, b, n: the n-grams of ORDER symbols of all texts."""

    def run(batches):
        have: dict[int, _Tally] = {}
        for batch, data, offsets in each_slice(batches, "text"):
            a, b, chars, _ = grams(data, offsets, fold)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            of = np.repeat(keys, np.diff(chars))
            for k in np.unique(keys).tolist():
                own = slice(None) if (keys == k).all() else of == k
                tally = have.setdefault(k, _Tally())
                tally.add(a[own], b[own])
                if tally.merged > HELD:
                    yield from tally.take(k)
        for k, tally in have.items():
            yield from tally.take(k)

    sent = docs.select("text", F.col("key").cast("int").alias("key")).mapInArrow(run, "key int, a bigint, b bigint, n bigint")
    return sent.groupBy("key", "a", "b").agg(F.sum("n").alias("n"))


def _suffix(k: int) -> list[Column]:
    """Columns a and b of the n-gram of k symbols without its first."""
    a, b = F.col("a"), F.col("b")
    zero = F.lit(0).cast("bigint")
    of = {5: (a.bitwiseAND(F.lit(_M1)), b), 4: (zero, b), 3: (zero, b.bitwiseAND(F.lit(_M2))), 2: (zero, b.bitwiseAND(F.lit(_M1)))}[k]
    return [of[0].alias("a"), of[1].alias("b")]


def _context() -> list[Column]:
    """Columns ca and cb of the n-gram without its last symbol."""
    a, b = F.col("a"), F.col("b")
    return [F.shiftright(a, _BITS).alias("ca"), F.shiftright(b, _BITS).bitwiseOR(F.shiftleft(a.bitwiseAND(F.lit(_M1)), 2 * _BITS)).alias("cb")]


def _discounts(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, d1, d2, d3 of counts (keys, c): a row a key, few whatever the corpus."""
    of = counts.groupBy(*keys).agg(*(F.count(F.when(F.col("c") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    n = {k: F.col(f"n{k}") for k in (1, 2, 3, 4)}
    y = F.when(n[1] > 0, n[1] / (n[1] + 2 * n[2])).otherwise(0.5)

    def d(k):
        return F.when(n[k] > 0, F.least(F.lit(float(k)), F.greatest(F.lit(0.0), k - (k + 1) * y * n[k + 1] / F.greatest(n[k], F.lit(1.0))))).otherwise(min(0.5, k))

    return of.select(*keys, *(d(k).alias(f"d{k}") for k in (1, 2, 3)))


def _discounted(counts: DataFrame, *keys: str) -> DataFrame:
    """counts (keys, a, b, c) with its context ca, cb, the discounted share p of the context's sum and the share left over."""
    c = F.col("c")
    off = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).when(c > 2, F.col("d3")).otherwise(0.0)
    rows = counts.join(F.broadcast(_discounts(counts, *keys)), list(keys)).select(*keys, "a", "b", "c", off.alias("off"), *_context())
    # the n-grams of a context are no more than there are symbols
    own = Window.partitionBy(*keys, "ca", "cb")
    total = F.sum("c").over(own)
    return rows.select(*keys, "a", "b", "ca", "cb", "c", (F.greatest(c - F.col("off"), F.lit(0.0)) / total).alias("p"), (F.sum("off").over(own) / total).alias("rest"))


def levels(top: DataFrame, shared: int = 0) -> tuple[DataFrame, DataFrame]:
    """top (m, a, b: distinct n-grams of model m) -> the orders below ORDER, by continuation counts: a table (m, k, a, b, ca, cb, p, rest, prob), and m with its number of symbols. The orders up to `shared` count what models 2 m and 2 m + 1 have together."""
    last, found = top.select("m", "a", "b"), []
    for k in range(ORDER, 1, -1):
        if k - 1 == shared:
            last = last.select(F.floor(F.col("m") / 2).cast("int").alias("m"), "a", "b").distinct()
        last = last.select("m", *_suffix(k)).groupBy("m", "a", "b").agg(F.count(F.lit(1)).alias("c"))
        both = last.withColumn("m", F.explode(F.array(2 * F.col("m"), 2 * F.col("m") + 1))) if k - 1 <= shared else last
        found.append(both.select("m", F.lit(k - 1).alias("k"), "a", "b", "c"))
    table = found[0]
    for more in found[1:]:
        table = table.unionByName(more)
    counted = cut(table)
    table = cut(_discounted(counted, "m", "k"))
    free(counted)
    size = cut(table.filter("k = 1").groupBy("m").agg((F.count(F.lit(1)) + 1).cast("double").alias("symbols")))
    have = cut(table.filter("k = 1").join(F.broadcast(size), "m").withColumn("prob", F.col("p") + F.col("rest") / F.col("symbols")).drop("symbols"))
    out = have
    for k in range(2, ORDER):
        lower = have.select("m", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("prob").alias("lower"))
        sa, sb = _suffix(k)
        rows = table.filter(F.col("k") == k).select("*", sa.alias("sa"), sb.alias("sb"))
        have = cut(rows.join(lower, ["m", "sa", "sb"]).withColumn("prob", F.col("p") + F.col("rest") * F.col("lower")).drop("sa", "sb", "lower"))
        out = out.unionByName(have)
    free(table)
    return out, size


def with_lower(top: DataFrame, below: DataFrame) -> DataFrame:
    """top (m, a, b, ...) with `lower`, the probability of its suffix."""
    sa, sb = _suffix(ORDER)
    lower = below.filter(F.col("k") == ORDER - 1).select("m", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("prob").alias("lower"))
    return top.select("*", sa.alias("sa"), sb.alias("sb")).join(lower, ["m", "sa", "sb"]).drop("sa", "sb")


def kneser_ney(counts: DataFrame, models: int, shared: int = 0) -> tuple[DataFrame, list[float]]:
    """counts (m, a, b, n; a table) -> entries (k, a, b, v): by n-gram of k symbols v holds, for each model, its log probability and the log of the share that contexts leave (NaN where unseen); the models' log probabilities of a symbol never seen, without that share."""
    below, size = levels(counts, shared)
    top = _discounted(counts.select("m", F.lit(ORDER).alias("k"), "a", "b", F.col("n").alias("c")), "m", "k")
    top = with_lower(top, below).withColumn("prob", F.col("p") + F.col("rest") * F.col("lower"))
    columns = ["m", "k", "a", "b", "ca", "cb", "rest", "prob"]
    rows = top.select(*columns).unionByName(below.select(*columns))
    probs = rows.select("m", "k", "a", "b", F.log("prob").alias("p"), F.lit(None).cast("double").alias("rest"))
    rests = rows.select("m", (F.col("k") - 1).alias("k"), F.col("ca").alias("a"), F.col("cb").alias("b"), F.lit(None).cast("double").alias("p"), F.log(F.greatest("rest", F.lit(1e-12))).alias("rest"))
    both = probs.unionByName(rests).groupBy("k", "a", "b")
    of = lambda x, m: F.coalesce(F.max(F.when(F.col("m") == m, F.col(x))), F.lit(float("nan"))).cast("float")
    entries = both.agg(F.array(*(of(x, m) for m in range(models) for x in ("p", "rest"))).alias("v"))
    unseen = {r["m"]: -float(np.log(r["symbols"])) for r in size.collect()}
    return entries, [unseen.get(m, 0.0) for m in range(models)]


def asked(a: np.ndarray, b: np.ndarray, orders: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of the n-grams' endings, and of those without their last symbol."""
    out = []
    for k in orders:
        x, y = ending(a, b, k)
        out.append((hashes(x, y, k), hashes(*before(x, y), k - 1)))
    return out


def probabilities(unseen: list[float]) -> tuple[tuple[int, ...], Callable]:
    """Orders, and what makes each n-gram's log probabilities (a row a model) of the entries that were looked up for them."""

    def fn(found):
        lowest = True
        for gram, context in found:
            rest = np.nan_to_num(context[:, 1::2], nan=0.0)
            value = rest + (np.array(unseen, dtype=np.float32) if lowest else out)  # noqa: F821
            seen = gram[:, 0::2]
            out = np.where(np.isnan(seen), value, seen)
            lowest = False
        return out

    return tuple(range(1, ORDER + 1)), fn


class Scorer:
    """Values of n-grams from a table of entries (sorted hashes, values); those met before are kept, up to a bound."""

    def __init__(self, names: np.ndarray, values: np.ndarray, orders: tuple[int, ...], fn: Callable):
        self.names, self.values, self.orders, self.fn = names, values, orders, fn
        self.forget()

    def forget(self):
        self.known, self.of = np.zeros(0, np.uint64), None

    def look(self, h: np.ndarray) -> np.ndarray:
        out = np.full((len(h), self.values.shape[1]), np.nan, dtype=np.float32)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
            hit = self.names[at] == h
            out[hit] = self.values[at[hit]]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values by model and n-gram."""
        h, first, which = distinct(hashes(a, b, ORDER))
        if self.of is not None and len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            new = np.flatnonzero(self.known[at] != h)
        else:
            new = np.arange(len(h))
        if len(new):
            x, y = a[first[new]], b[first[new]]
            made = self.fn([(self.look(g), self.look(c)) for g, c in asked(x, y, self.orders)])
            if len(self.known) > 500_000:
                self.forget()
                return self(a, b)
            names = np.concatenate([self.known, h[new]])
            order = np.argsort(names)
            self.known, self.of = names[order], (np.concatenate([self.of, made]) if self.of is not None else made)[order]
            at = np.searchsorted(self.known, h)
        return self.of[at][which].T if len(h) else np.zeros((self.values.shape[1], 0), np.float32)


def _blocks(batches, text: str):
    """Blocks of rows whose texts have BLOCK_BYTES or more (the last may have less): name, and their slices. A row's block depends on the rows before it only."""
    held, size, name = [], 0, hashlib.blake2b(digest_size=8)
    for batch in batches:
        data, offsets = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = min(batch.num_rows, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES - size, side="left")))
            end = max(end, at + 1)
            own = data[offsets[at] : offsets[end]]
            name.update(own.tobytes())
            name.update(np.diff(offsets[at : end + 1]).tobytes())
            held.append(batch.slice(at, end - at))
            size += len(own)
            at = end
            if size >= BLOCK_BYTES:
                yield int.from_bytes(name.digest(), "big", signed=True), held
                held, size, name = [], 0, hashlib.blake2b(digest_size=8)
    if held:
        yield int.from_bytes(name.digest(), "big", signed=True), held


_ROW = "to bigint, kind int, seq bigint, block bigint, h binary, v binary"
_NAMES = ["to", "kind", "seq", "block", "h", "v"]


def _row(to: int, kind: int, seq: int, block: int, h: bytes, v: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([kind], pa.int32()), pa.array([seq], pa.int64()), pa.array([block], pa.int64()), pa.array([h], pa.binary()), pa.array([v], pa.binary())], names=_NAMES)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c) for c in _NAMES))


def _by_shards(docs: DataFrame, entries: DataFrame, many: int, orders, fn, fold: bool, width: int, finish: Callable, schema: T.StructType) -> DataFrame:
    """score() where the entries are joined by shard. docs is read twice (with the same columns, so that its plan is the same) and must give the same rows."""
    parts = shuffle_width(docs)
    shards = max(1, min(parts, -(-many // SHARD_ENTRIES)))
    salts = -(-parts // shards)

    def shard(h):
        return (h >> np.uint64(32)) % np.uint64(shards)

    def pack(batches):
        for batch in batches:
            k = batch.column("k").to_numpy()
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            h = np.zeros(len(k), np.uint64)
            for own in np.unique(k).tolist():
                at = k == own
                h[at] = hashes(a[at], b[at], own)
            v = batch.column("v").flatten().to_numpy().astype(np.float32).reshape(len(k), width)
            of = shard(h)
            for s in np.unique(of).tolist():
                own = of == s
                for salt in range(salts):
                    yield _row(int(s) * salts + salt, 0, 0, 0, h[own].tobytes(), v[own].tobytes())

    def ask(batches):
        for block, held in _blocks(batches, "text"):
            wanted = np.zeros(0, np.uint64)
            for _, data, offsets in each_slice(held, "text"):
                a, b, _, _ = grams(data, offsets, fold)
                _, first, _ = distinct(hashes(a, b, ORDER))
                every = asked(a[first], b[first], orders)
                wanted = np.unique(np.concatenate([wanted, *(x for pair in every for x in pair)]))
            of = shard(wanted)
            for s in range(shards):
                yield _row(s * salts + block % salts, 1, 0, block, wanted[of == s].tobytes(), b"")

    def answer(batches):
        at, pieces, scorer = None, [], None
        for to, kind, _, block, h, v in _rows(batches):
            if at != to.as_py():
                at, pieces, scorer = to.as_py(), [], None
            names = np.frombuffer(h.as_py(), np.uint64)
            if kind.as_py() == 0:
                pieces.append((names, np.frombuffer(v.as_py(), np.float32).reshape(-1, width)))
                continue
            if scorer is None:
                scorer = _table(pieces, width, orders, fn)
                pieces = []
            found = scorer.look(names)
            hit = ~np.isnan(found).all(axis=1)
            yield _row(block.as_py(), 0, 0, block.as_py(), names[hit].tobytes(), found[hit].tobytes())

    def carry(batches):
        for block, held in _blocks(batches, "text"):
            for seq, (batch, _, _) in enumerate(each_slice(held, "text", 1 << 20)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                yield _row(block, 1, seq, block, b"", sink.getvalue().to_pybytes())

    def meet(batches):
        at, pieces, scorer = None, [], None
        for to, kind, _, _, h, v in _rows(batches):
            if at != to.as_py():
                at, pieces, scorer = to.as_py(), [], None
            if kind.as_py() == 0:
                pieces.append((np.frombuffer(h.as_py(), np.uint64), np.frombuffer(v.as_py(), np.float32).reshape(-1, width)))
                continue
            if scorer is None:
                if not pieces:
                    raise RuntimeError("the documents were other ones when they were read again: write them to a table first")
                scorer = _table(pieces, width, orders, fn)
                pieces = []
            yield from finish(pa.ipc.open_stream(v.as_py()), scorer)

    answers = entries.select("k", "a", "b", "v").mapInArrow(pack, _ROW).union(docs.mapInArrow(ask, _ROW))
    answers = answers.repartition(parts, "to").sortWithinPartitions("to", "kind").mapInArrow(answer, _ROW)
    both = answers.union(docs.mapInArrow(carry, _ROW))
    return both.repartition(parts, "to").sortWithinPartitions("to", "kind", "seq").mapInArrow(meet, schema)


def _table(pieces: list[tuple[np.ndarray, np.ndarray]], width: int, orders, fn) -> Scorer:
    names = np.concatenate([x for x, _ in pieces]) if pieces else np.zeros(0, np.uint64)
    values = np.concatenate([x for _, x in pieces]) if pieces else np.zeros((0, width), np.float32)
    order = np.argsort(names)
    return Scorer(names[order], values[order], orders, fn)


def score(docs: DataFrame, entries: DataFrame, width: int, of_grams: tuple[tuple[int, ...], Callable], features: Callable, names: list[str], fold: bool, keep: list[str], bound: int = BOUND) -> DataFrame:
    """The columns `keep` of docs, and double columns that features(values by model and symbol, offsets, symbols, batch) -> arrays makes of each slice. entries: a table, of `width` values each; docs: text and what features() reads."""
    spark, (orders, fn) = docs.sparkSession, of_grams
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in names)])

    def finish(batches, scorer):
        for batch, data, offsets in each_slice(batches, "text"):
            a, b, chars, s = grams(data, offsets, fold)
            got = features(scorer(a, b), chars, s, batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.float64()) for x in got)], names=schema.names)

    many = counted(entries)
    if many > bound:
        return _by_shards(docs, entries, many, orders, fn, fold, width, finish, schema)
    t = entries.toArrow().combine_chunks()
    k, a, b = (t.column(c).to_numpy() for c in ("k", "a", "b"))
    h = np.zeros(len(k), np.uint64)
    for own in range(ORDER + 1):
        at = k == own
        h[at] = hashes(a[at], b[at], own)
    order = np.argsort(h)
    v = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(len(k), width) if len(k) else np.zeros((0, width), np.float32)
    sent = spark.sparkContext.broadcast((h[order], v[order]))
    del t, k, a, b, h, v, order
    pa.default_memory_pool().release_unused()

    def run(batches):
        yield from finish(batches, Scorer(*sent.value, orders, fn))

    return docs.mapInArrow(run, schema)


def sums(values: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[chars])
