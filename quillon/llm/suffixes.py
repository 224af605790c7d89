"""Repeated byte strings by suffix arrays.

Every byte that a string of `length` bytes covers is removed where that string
also starts earlier: in a document of smaller doc_id, or in the same one.

1. Documents are dealt into shards by hash. In each window of `length` bytes
   the `gram`-byte string of least hash is its anchor, so equal windows have
   equal anchors at equal distances, wherever they stand. Anchors are routes
   only: which occur in two shards is found by one shuffle of their hashes.
2. In each shard the windows whose anchors repeat there are indexed by a suffix
   array (Larsson and Sadakane's refinement by doubling, in numpy), neighbours'
   common prefixes are taken (Kasai), and of each run of equal windows all but
   the first are marked. What is left of a shard holds a window once, so a
   string that a third of all documents hold is sent once a shard.
3. What is left around anchors that other shards have too is sent to the
   anchors' own shards. Their windows' hashes stand for sorted suffixes there:
   a window finds the first of its hash by binary search and is compared with
   it byte by byte.

Texts are taken as UTF-8 bytes; null texts are empty. Rows that agree in doc_id
and text are one document, and each gets its result. Rows of one doc_id with
different texts are ordered by a hash of the text; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, SLICE_BYTES, mix, powers, rolling, slices, span_hash, table, text_buffers

LENGTH, GRAM, SHARD_BYTES = 100, 32, 6 << 20
STEP = SLICE_BYTES


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values that follow one another, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, place, and first and last window of each anchor, in order. Places are in data."""
    out = [[], [], [], [], []]
    for i, j in slices(offsets, STEP):
        start = offsets[i]
        part, at = data[start : offsets[j]], offsets[i : j + 1] - start
        n = len(part)
        if n < length:
            continue
        _, down = powers(n + 1)
        sums = rolling(BYTE_CODE[part])
        grams = mix((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])
        # the place makes ties go to the left; hashes keep 43 bits for the choice
        span = length - gram + 1
        place = np.arange(len(grams), dtype=np.uint64)
        bits = np.uint64(max(1, int(len(grams)).bit_length()))
        pick = _sliding_min((grams >> bits << bits) | place, span)
        pick = (pick & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # windows that cross a document's end are none
        window = np.arange(len(pick))
        end = np.repeat(at[1:], np.diff(at))[: len(pick)]
        window = window[window + length <= end]
        if not len(window):
            continue
        pick = pick[window]
        new = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (window[1:] != window[:-1] + 1)))
        last = np.append(new[1:], len(window)) - 1
        a = pick[new]
        for k, x in enumerate((grams[a], np.searchsorted(at, window[new], side="right") - 1 + i, a + start, window[new] + start, window[last] + start)):
            out[k].append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64 if k == 0 else np.int64) for k, x in enumerate(out))


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first depth bytes (ties by place), and their ranks: doubling, of groups that aren't sorted yet only.

    Beyond the end there are zeros; depth is at least 8.
    """
    n = len(data)
    key = np.zeros(n, dtype=np.uint64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        key |= wide[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key, kind="stable")
    first = np.append(True, key[order][1:] != key[order][:-1]) if n else np.zeros(0, bool)
    head = np.flatnonzero(first)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    sorted_ = 8
    while sorted_ < depth:
        step = min(sorted_, depth - sorted_)
        size = np.diff(np.append(head, n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        s = order[at]
        after = np.where(s + step < n, rank[np.minimum(s + step, n - 1)], -1)
        group = rank[s]
        by = np.lexsort((s, after, group))
        s, after, group = s[by], after[by], group[by]
        order[at] = s
        new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        first[at] = new
        head = np.flatnonzero(first)
        full = np.repeat(head, np.diff(np.append(head, n)))
        rank[s] = full[at]
        sorted_ += step
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, step: int = 64) -> np.ndarray:
    """Kasai's common prefixes of neighbours in the suffix array, up to depth; the first has 0.

    In text order a suffix shares at least one byte less with its neighbour
    than the one before it did. (Where that one shared all of depth the order of
    the two goes by place; it holds if their followers stand in the same order.)
    The text is walked in lanes of `step` places, all
    lanes at once, each with what the place before it has left: bytes are
    compared in proportion to the text, and up to depth anew for each lane.
    """
    n = len(order)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    begin = np.arange(0, n, step)
    have, last = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), -1, dtype=np.int64)
    for t in range(min(step, n)):
        at = begin + t
        if at[-1] >= n:
            at, have, last, begin = at[:-1], have[:-1], last[:-1], begin[:-1]
        other = before[at]
        sure = (have < depth) | ((last + 1 < n) & (place[np.minimum(last + 1, n - 1)] < place[at]))
        have = np.where(sure & (other >= 0), np.maximum(have - 1, 0), 0)
        last = other
        go = np.flatnonzero((other >= 0) & (have < depth))
        while len(go):
            a, b = at[go] + have[go], other[go] + have[go]
            inside = (a < n) & (b < n)
            go, a, b = go[inside], a[inside], b[inside]
            go = go[data[a] == data[b]]
            have[go] += 1
            go = go[have[go] < depth]
        out[at] = have
    return out[order]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of numbers that follow one another."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + 1))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1]


def _repeats(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Of the windows that start in the ranges lo..hi (sorted), those that have an equal one before them."""
    if not len(lo):
        return lo
    # ranges that touch are one region of text
    new = np.append(True, lo[1:] > hi[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = lo[first], np.maximum.reduceat(hi, first)
    size = hi - lo + length
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(at[-1]) + np.repeat(lo - at[:-1], size)
    text = data[source]
    order, _ = suffix_array(text, length)
    prefix = common_prefixes(text, order, length)
    inside = np.zeros(len(text), bool)
    inside[np.repeat(at[:-1], hi - lo + 1) + np.arange((hi - lo + 1).sum()) - np.repeat(np.concatenate([[0], np.cumsum(hi - lo + 1)[:-1]]), hi - lo + 1)] = True
    order_in = inside[order]
    kept, run = order[order_in], np.cumsum(prefix < length)[order_in]
    # in a run suffixes stand by place, so the first is the earliest
    later = kept[np.append(False, run[1:] == run[:-1])]
    return np.sort(source[later])


def _shard(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's documents in their order, each once: bytes, offsets, ids, text hashes."""
    t = t.sort_by([("__id", "ascending"), ("__th", "ascending")])
    ids, ths = (t.column(c).to_numpy() for c in ("__id", "__th"))
    new = np.append(True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])) if len(ids) else np.zeros(0, bool)
    t = t.filter(pa.array(new))
    data, offsets = text_buffers(t.column("text"))
    return data, offsets, ids[new], ths[new]


_HASHES = pa.schema([("part", pa.int64()), ("h", pa.int64())])
_SENT = "h bigint, __id bigint, __th bigint, place bigint, lo bigint, hi bigint, bytes binary"


def _cover(docs: DataFrame, length: int, gram: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The dealt documents, and the ranges lo..hi of windows to be removed."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(width, math.ceil(total / shard_bytes))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("__th", F.xxhash64("text"))
    part = F.pmod(F.xxhash64("__id", "__th"), F.lit(parts))
    keyed = keyed.withColumn("part", part)

    def hashes(t: pa.Table) -> pa.Table:
        data, offsets, _, _ = _shard(t)
        h = np.unique(anchors(data, offsets, length, gram)[0])
        return pa.table([pa.array(np.full(len(h), t.column("part")[0].as_py() if t.num_rows else 0), pa.int64()), pa.array(h.view(np.int64))], schema=_HASHES)

    def shared(batches):
        """Of rows sorted by h those whose h has more than one. What a batch ends with waits for the next."""
        wait_h, wait_p = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def chosen(h, p):
            same = h[1:] == h[:-1]
            own = np.append(False, same) | np.append(same, False)
            return pa.RecordBatch.from_arrays([pa.array(p[own]), pa.array(h[own])], schema=_HASHES)

        for batch in batches:
            h = np.concatenate([wait_h, batch.column("h").to_numpy()])
            p = np.concatenate([wait_p, batch.column("part").to_numpy()])
            k = int(np.searchsorted(h, h[-1])) if len(h) else 0
            wait_h, wait_p = h[k:], p[k:]
            if k:
                yield chosen(h[:k], p[:k])
        if len(wait_h):
            yield chosen(wait_h, wait_p)

    listed = keyed.groupBy("part").applyInArrow(hashes, "part bigint, h bigint")
    answers = listed.repartition(width, "h").sortWithinPartitions("h").mapInArrow(shared, "part bigint, h bigint")
    sent_schema = pa.schema([(n, pa.binary() if n == "bytes" else pa.int64()) for n in ("h", "__id", "__th", "place", "lo", "hi", "bytes")])

    def resolve(t: pa.Table, found: pa.Table) -> pa.Table:
        data, offsets, ids, ths = _shard(t)
        h, doc, place, lo, hi = anchors(data, offsets, length, gram)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        often = n[back] > 1 if len(h) else np.zeros(0, bool)
        gone = _repeats(data, lo[often], hi[often], length)
        s, e = _runs(gone)
        d = np.searchsorted(offsets, s, side="right") - 1
        # a run doesn't go on into the next document: its windows end before that
        none = np.zeros(len(s), np.int64)
        local = [s.astype(np.int64) * 7919 + none, ids[d], ths[d], none - 1, s - offsets[d], e - offsets[d]]
        empty = [b""] * len(s)
        asked = np.unique(found.column("h").to_numpy()) if found.num_rows else np.zeros(0, np.int64)
        if len(asked) and len(h):
            own = h.view(np.int64)
            k = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
            pick = np.flatnonzero(asked[k] == own)
            removed = np.zeros(len(data) + 1, bool)
            removed[gone] = True
            # the windows that stay, in runs within their anchor
            count = hi[pick] - lo[pick] + 1
            w = np.repeat(lo[pick] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            of = np.repeat(pick, count)
            stay = ~removed[w]
            w, of = w[stay], of[stay]
            new = np.flatnonzero(np.append(True, (w[1:] != w[:-1] + 1) | (of[1:] != of[:-1]))) if len(w) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(w)) - 1 if len(w) else new
            s, e, a = w[new], w[last], of[new]
            d = doc[a]
            size = e - s + length
            at = np.concatenate([[0], np.cumsum(size)])
            flat = data[np.arange(at[-1]) + np.repeat(s - at[:-1], size)]
            blob = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            other = [own[a], ids[d], ths[d], place[a] - offsets[d], s - offsets[d], e - offsets[d]]
            columns = [pa.array(np.concatenate([x, y]), pa.int64()) for x, y in zip(local, other)]
            both = pa.concat_arrays([pa.array(empty, pa.binary()), blob])
            return pa.table([*columns, both], schema=sent_schema)
        return pa.table([*(pa.array(x, pa.int64()) for x in local), pa.array(empty, pa.binary())], schema=sent_schema)

    sent = keyed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(resolve, _SENT)
    met = sent.repartition(width, "h").sortWithinPartitions("h").mapInArrow(lambda batches: _merge(batches, length), "__id bigint, __th bigint, lo bigint, hi bigint")
    return keyed, met.withColumn("part", part)


_OUT = ("__id", "__th", "lo", "hi")


def _merge(batches, length: int, limit: int = 4 << 20):
    """Rows sorted by h: what is marked already passes, the rest is merged by anchor."""
    wait: list[pa.RecordBatch] = []
    held = 0

    def flush(last: bool):
        nonlocal wait, held
        t = pa.Table.from_batches(wait).combine_chunks() if wait else None
        wait, held = [], 0
        if t is None or not t.num_rows:
            return
        h = t.column("h").to_numpy()
        k = len(h) if last else int(np.searchsorted(h, h[-1]))
        if k < len(h):
            rest = t.slice(k)
            wait = rest.to_batches()
            held = rest.nbytes
            t = t.slice(0, k)
        if t.num_rows:
            yield from _merged(t, length)

    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            wait.append(batch)
            held += batch.num_rows * (length + 80)
            if held > limit:
                before = held
                yield from flush(False)
                limit = max(limit, 2 * held) if held > before // 2 else limit
    yield from flush(True)


def _merged(t: pa.Table, length: int):
    marked = t.column("place").to_numpy() < 0
    if marked.any():
        own = t.filter(pa.array(marked))
        yield pa.RecordBatch.from_arrays([own.column(c).combine_chunks() for c in _OUT], names=list(_OUT))
    t = t.filter(pa.array(~marked))
    if t.num_rows < 2:
        return
    column = t.column("bytes").combine_chunks()
    data, offsets = text_buffers(pa.Array.from_buffers(pa.string(), len(column), column.buffers()[:3], offset=column.offset))
    h, ids, ths, place, lo, hi = (t.column(c).to_numpy() for c in ("h", "__id", "__th", "place", "lo", "hi"))
    # rows in document order, so that the first of equal windows is the earliest
    order = np.lexsort((lo, ths, ids))
    level = np.empty(len(order), np.int64)
    level[order] = np.arange(len(order))
    count = hi - lo + 1
    row = np.repeat(np.arange(len(h)), count)
    step = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = offsets[row] + step
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.zeros(0, np.uint64))]) if not len(data) else _window_hashes(data, length)
    key = sums[at] ^ mix(h[row].view(np.uint64) + (lo[row] + step - place[row]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # the runs' windows in one sorted list; each looks up the first of its key by binary search
    by = np.lexsort((level[row], key))
    heads = by[np.append(True, key[by][1:] != key[by][:-1])]
    names = key[heads]
    leader = heads[np.searchsorted(names, key)]
    repeat = np.flatnonzero(leader != np.arange(len(key)))
    if not len(repeat):
        return
    lead = leader[repeat]
    # neighbours with neighbouring leaders are compared together
    new = np.flatnonzero(np.append(True, (row[repeat][1:] != row[repeat][:-1]) | (repeat[1:] != repeat[:-1] + 1) | (lead[1:] != lead[:-1] + 1) | (row[lead][1:] != row[lead][:-1])))
    last = np.append(new[1:], len(repeat)) - 1
    a, b, n = at[repeat[new]], at[lead[new]], last - new + length
    good = np.ones(len(new), bool)
    for i in range(0, len(new), 20_000):
        part = slice(i, i + 20_000)
        ends = np.concatenate([[0], np.cumsum(n[part])])
        inside = np.arange(ends[-1])
        same = data[inside + np.repeat(a[part] - ends[:-1], n[part])] == data[inside + np.repeat(b[part] - ends[:-1], n[part])]
        good[part] = np.logical_and.reduceat(same, ends[:-1])
    r = row[repeat[new]]
    s = lo[r] + step[repeat[new]]
    e = lo[r] + step[repeat[last]]
    if good.all():
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[r], ths[r], s, e)], names=list(_OUT))
        return
    # a hash that two texts share: these keys are settled by the bytes alone
    yield pa.RecordBatch.from_arrays([pa.array(x[good], pa.int64()) for x in (ids[r], ths[r], s, e)], names=list(_OUT))
    seen: dict[tuple, int] = {}
    odd = set(key[np.concatenate([repeat[x : y + 1] for x, y in zip(new[~good], last[~good])])].tolist())
    more = [x for x in by.tolist() if key[x] in odd]
    for x in more:
        name = (h[row[x]], lo[row[x]] + step[x] - place[row[x]], data[at[x] : at[x] + length].tobytes())
        if name in seen:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (ids[row[x]], ths[row[x]], lo[row[x]] + step[x], lo[row[x]] + step[x])], names=list(_OUT))
        seen[name] = x


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window at each place, in parts of a bounded size."""
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(0, max(0, len(data) - length + 1), STEP):
        part = data[i : i + STEP + length - 1]
        n = len(part) - length + 1
        first = np.arange(n)
        out[i : i + n] = span_hash(rolling(BYTE_CODE[part]), first, first + length)
    return out


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, and with keep_text the bytes that are left."""
    keyed, cover = _cover(docs, length, gram, shard_bytes)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]

    def digest(t: pa.Table, found: pa.Table) -> pa.Table:
        by: dict[tuple[int, int], list] = {}
        for i, th, s, e in zip(*(found.column(c).to_pylist() for c in _OUT)):
            by.setdefault((i, th), []).append((s, e + length))
        out: list[list] = [[] for _ in names]
        texts = t.column("text").to_pylist()
        for doc_id, i, th, text in zip(t.column("doc_id").to_pylist(), t.column("__id").to_pylist(), t.column("__th").to_pylist(), texts):
            raw, spans = text.encode("utf-8", "surrogatepass"), []
            for s, e in sorted(by.get((i, th), ())):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([s, e])
            at, kept = 0, []
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept = b"".join([*kept, raw[at:]]) if spans else raw
            row = [doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept]
            for column, x in zip(out, row):
                column.append(x)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array(x, kind) for x, kind in zip(out, types)], names=names)

    return keyed.groupBy("part").cogroup(cover.groupBy("part")).applyInArrow(digest, schema)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT r, doc_id, 100 * b AS q, substr(x, 200 * b + 1, 398) AS y FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 200 + 1)) AS b FROM d)),
w AS (SELECT r, doc_id, q + i AS i, md5_number(substr(y, 2 * i + 1, 200)) AS s FROM (SELECT r, doc_id, q, y, unnest(range(0, least(100, greatest(len(y) // 2 - 99, 0)))) AS i FROM t)),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT r, i FROM w JOIN f USING (s) WHERE (doc_id, i) <> first),
l AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS island FROM l),
b AS (SELECT r, island, min(i) AS s, max(i) + 100 AS e FROM k GROUP BY ALL),
o AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS before FROM b),
a AS (SELECT r, sum(e - s) AS gone, count(*) AS spans, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM o JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN a.r IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
