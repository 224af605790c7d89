"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines chooses boundaries, so
that chunks depend on what they hold and not on where they stand. A chunk begins
and ends with a line that isn't blank, and has two of them at least. Of the
occurrences of a chunk in all documents the first (by doc_id, then by place)
stays; the others are removed after their bytes are compared with the first's.

A chunk that reaches over the edge of a shared passage is nobody's equal, so
chunks alone lose the ends of passages, and passages too short to hold a chunk.
Edges are therefore units beside the chunks: every two neighbouring lines that
aren't blank, with what is between them, and every line of LONG_WORDS words or
more. Chunks come first: a chunk that goes absorbs the edges inside it, which
are repeats of edges inside the chunk's first occurrence. What is left of the
edges extends a repeated chunk line by line on both sides, and finds the short
repeats. A line goes with any unit that stands somewhere before, so one copy of
each always stays.

Only hashes are grouped over the corpus, added up by batch before they are
shuffled. Then the bytes are compared: each batch holds the units of a hash
against one another, and sends the bytes of one of them, so a hot passage is a
row a batch. A hash all of whose bytes are the same stands for its unit. One
with different bytes is a collision: then nothing is absorbed, since a chunk
that seemed to repeat may not, and the units of that hash are settled by their
bytes.

Null texts stay null and have no lines, empty texts stay empty and have none.
Rows that agree in doc_id and text are one document: none of them makes the
other a repetition. Null ids come before all others. Other columns, whatever
their names, are passed on untouched; an empty table gives an empty one. A text
is one row, however long: memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODE, cut, each_slice, guarded, mix, rolling, settle, sized, small, span_hash, table

BOUNDARY, LEAST_LINES = 2, 2
#: A line of so many words is a passage by itself.
LONG_WORDS = 20


def _lines(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray):
    """Document, first and last byte (exclusive) of each line of docs, whether it is its document's last, whether it isn't blank."""
    newline = np.flatnonzero(data == 10)
    # a document's lines begin at its start and after each newline in it; the last may be empty
    begin = np.concatenate([offsets[docs], newline + 1])
    doc = np.concatenate([docs, np.searchsorted(offsets, newline, side="right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.where(last, offsets[doc + 1], np.append(begin[1:], 0) - 1)
    dark = np.concatenate([[0], np.cumsum((data != 10) & (data != 32) & (data != 9) & (data != 13))])
    full = dark[end] > dark[begin]
    return doc, begin, end, last, full


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """Document, first and last byte (exclusive), whether it is a chunk, and hash of each chunk of at least LEAST_LINES lines that aren't blank."""
    docs = np.flatnonzero(np.diff(offsets))
    if not len(docs):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool), none.astype(np.uint64)
    doc, begin, end, last, full = _lines(data, offsets, docs)
    sums = rolling(BYTE_CODE[data])
    line = span_hash(sums, begin, end)
    first = np.append(True, doc[1:] != doc[:-1])
    before = np.concatenate([[np.uint64(0)], line[:-1]])
    before[first] = 0
    bound = (mix(before * np.uint64(3) + line) >> np.uint64(20)) % np.uint64(BOUNDARY) == 0
    # a boundary counts where the chunk has its lines by then; after it the count starts anew
    ends, have = [], 0
    for full_, bound_, last_ in zip(full.tolist(), bound.tolist(), last.tolist()):
        have += full_
        if last_ or (bound_ and have >= LEAST_LINES):
            ends.append(True)
            have = 0
        else:
            ends.append(False)
    ends = np.array(ends)
    e = np.flatnonzero(ends)
    s = np.concatenate([[0], e[:-1] + 1])
    lines = np.concatenate([[0], np.cumsum(full)])
    own = lines[e + 1] - lines[s] >= LEAST_LINES
    # blank lines at a chunk's ends are none of it
    at = np.flatnonzero(full)
    s, e = at[lines[s[own]]], at[lines[e[own] + 1] - 1]
    return doc[s], begin[s], end[e], np.ones(len(s), bool), span_hash(sums, begin[s], end[e])


def _edges(data: np.ndarray, offsets: np.ndarray):
    """As _chunks(), of each two neighbouring lines that aren't blank and of each long line; they overlap."""
    docs = np.flatnonzero(np.diff(offsets))
    if not len(docs):
        return _chunks(data, offsets)
    doc, begin, end, _, full = _lines(data, offsets, docs)
    dark = (data != 10) & (data != 32) & (data != 9) & (data != 13)
    starts = dark.copy()
    starts[1:] &= ~dark[:-1]
    at = begin[begin < end]
    starts[at] = dark[at]
    words = np.concatenate([[0], np.cumsum(starts)])
    own = np.flatnonzero(full)
    pair = np.flatnonzero(doc[own[1:]] == doc[own[:-1]])
    long = own[words[end[own]] - words[begin[own]] >= LONG_WORDS]
    s, e = np.concatenate([own[pair], long]), np.concatenate([own[pair + 1], long])
    return doc[s], begin[s], end[e], np.zeros(len(s), bool), span_hash(rolling(BYTE_CODE[data]), begin[s], end[e])


def _seeded(data: np.ndarray, offsets: np.ndarray):
    """Chunks, and the edges that aren't chunks themselves."""
    chunks, edges = _chunks(data, offsets), _edges(data, offsets)
    # starts are places in a whole slice, so a start and an end name a unit
    width = len(data) + 1
    own = ~np.isin(edges[1] * width + edges[2], chunks[1] * width + chunks[2])
    doc, s, e, _, h = (np.concatenate([c, x[own]]) for c, x in zip(chunks, edges))
    return doc, s, e, np.arange(len(doc)) < len(chunks[0]), h


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("__th", F.xxhash64("text"))


def _merged(spans: list[dict]) -> list[list[int]]:
    """Start and end of spans (at, size), those that overlap as one."""
    out = []
    for x in sorted(spans, key=lambda x: x["at"]):
        end = x["at"] + x["size"]
        if out and x["at"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([x["at"], end])
    return out


def _agreed(batches):
    """Rows (text, want: places at, size, hash h) -> h, size, bytes: of each hash and size one passage, and those that differ from it."""
    for batch, data, offsets in each_slice(batches, "text"):
        want = batch.column("want")
        spans = want.flatten()
        if not len(spans):
            continue
        ends = want.offsets.to_numpy()
        of = np.repeat(np.arange(len(want)), np.diff(ends))
        at, size, h = (spans.field(c).to_numpy() for c in ("at", "size", "h"))
        at = at + offsets[of]
        order = np.lexsort((size, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1]))
        rep = np.empty(len(order), np.int64)
        rep[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        send = [order[new]]
        others = np.flatnonzero(rep != np.arange(len(rep)))
        for i in range(0, len(others), 2000):
            x = others[i : i + 2000]
            n = size[x]
            end = np.cumsum(n)
            inside = np.arange(end[-1])
            same = data[inside + np.repeat(at[x] - end + n, n)] == data[inside + np.repeat(at[rep[x]] - end + n, n)]
            send.append(x[~np.logical_and.reduceat(same, end - n)])
        chosen = np.concatenate(send)
        for i in range(0, len(chosen), 1000):
            x = chosen[i : i + 1000]
            raw = [data[a : a + n].tobytes() for a, n in zip(at[x].tolist(), size[x].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h[x]), pa.array(size[x]), pa.array(raw, pa.binary())], names=["h", "size", "bytes"])


def _listing(units: Callable):
    """Rows (__id, __th, text) -> their passages."""

    def run(batches):
        for batch, data, offsets in each_slice(batches, "text"):
            doc, s, e, chunk, h = units(data, offsets)
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(pick), batch.column("__th").take(pick), pa.array(s - offsets[doc], pa.int64()), pa.array(e - s, pa.int64()), pa.array(h.view(np.int64)), pa.array(chunk)], names=["__id", "__th", "at", "size", "h", "chunk"])

    return run


def _counting(units: Callable):
    """Rows (__id, __th, text) -> h, size, the first occurrence and the number of a slice's passages."""

    def run(batches):
        for batch, data, offsets in each_slice(batches, "text"):
            doc, s, e, _, h = units(data, offsets)
            if not len(doc):
                continue
            ids, ths = (batch.column(c).to_numpy()[doc] for c in ("__id", "__th"))
            at, size = s - offsets[doc], e - s
            order = np.lexsort((at, ths, ids, size, h))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1]))
            first = order[new]
            n = np.diff(np.append(np.flatnonzero(new), len(order)))
            columns = (h[first].view(np.int64), size[first], ids[first], ths[first], at[first], n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["h", "size", "id", "th", "at", "n"])

    return run


def _absorbed(batches):
    """Rows (__id, __th, want: at, size, h, own, chunk) -> the same without the edges inside chunks that go."""
    for batch in batches:
        want = batch.column("want")
        spans = want.flatten()
        of = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
        at, size = (spans.field(c).to_numpy() for c in ("at", "size"))
        own, chunk = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("own", "chunk"))
        # chunks don't overlap: the last one that begins no later than an edge is the only one that can hold it
        width = int((at + size).max(initial=0)) + 1
        going = np.flatnonzero(chunk & ~own)
        going = going[np.argsort(of[going] * width + at[going])]
        found = np.searchsorted(of[going] * width + at[going], of * width + at, side="right") - 1
        inside = np.zeros(len(of), bool)
        if len(going):
            host = going[np.maximum(found, 0)]
            inside = (found >= 0) & (of[host] == of) & (at + size <= at[host] + size[host]) & ~chunk
        left = np.flatnonzero(~inside)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of[left], minlength=len(want)))]).astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(offsets), spans.take(pa.array(left)))
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__th"), kept], names=["__id", "__th", "want"])


WANT = "__id bigint, __th bigint, want array<struct<at: bigint, size: bigint, h: bigint, own: boolean, chunk: boolean>>"


def deduplicate(docs: DataFrame, units: Callable = _seeded, absorb: bool = True) -> DataFrame:
    """docs with its repeated chunks and what extends them taken out of text, and __n_lines, __n_removed. units=_chunks takes out chunks alone."""
    inner = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)))
    return _deduplicated(inner, units, absorb).toDF(*docs.columns, "__n_lines", "__n_removed")


def _deduplicated(docs: DataFrame, units: Callable, absorb: bool) -> DataFrame:
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _keyed(docs).repartition(width, "__id", "__th")
    texts = _keyed(docs.select("doc_id", "text")).select("__id", "__th", "text")
    counted = texts.mapInArrow(_counting(units), "h bigint, size bigint, id bigint, th bigint, at bigint, n bigint")
    repeated = counted.groupBy("h", "size").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.sum("n").alias("n")).filter("n > 1")
    repeated = cut(repeated.select("h", "size", "first.*").withColumnsRenamed({"id": "id1", "th": "th1", "at": "at1"}))
    listed = texts.mapInArrow(_listing(units), "__id bigint, __th bigint, at bigint, size bigint, h bigint, chunk boolean")
    own = (F.col("__id") == F.col("id1")) & (F.col("__th") == F.col("th1")) & (F.col("at") == F.col("at1"))
    candidates = listed.join(sized(repeated), ["h", "size"]).select("__id", "__th", "h", "at", "size", own.alias("own"), "chunk")
    wanted = candidates.groupBy("__id", "__th").agg(F.collect_set(F.struct("at", "size", "h", "own", "chunk")).alias("want"))
    wanted = cut(wanted.mapInArrow(_absorbed, WANT) if absorb else wanted)
    marked = dealt.join(wanted, ["__id", "__th"], "left")
    sent = marked.filter("want IS NOT NULL").select("text", "want").mapInArrow(_agreed, "h bigint, size bigint, bytes binary")
    odd = cut(sent.groupBy("h", "size").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).filter("a != b").select("h", "size"))
    if absorb and not small(odd, 0):
        return _deduplicated(docs, units, False)
    # the texts are dealt again for the result: the first time's shuffle files may go
    settle(docs.sparkSession)
    gone = wanted.select("__id", "__th", F.explode(F.filter("want", lambda w: ~w["own"])).alias("w")).select("__id", "__th", "w.at", "w.size", "w.h")
    if not small(odd, 0):
        # a hash that different units share: their occurrences are grouped by their bytes
        part = F.substring(F.col("text").cast("binary"), F.col("w.at").cast("int") + 1, F.col("w.size").cast("int"))
        spans = marked.filter("want IS NOT NULL").select("__id", "__th", "text", F.explode("want").alias("w"))
        pieces = spans.select("__id", "__th", "w.at", "w.size", "w.h", part.alias("bytes")).join(sized(odd), ["h", "size"])
        firsts = pieces.groupBy("h", "size", "bytes").agg(F.min(F.struct("__id", "__th", "at")).alias("first"))
        settled = pieces.join(firsts, ["h", "size", "bytes"]).filter(F.struct("__id", "__th", "at") != F.col("first")).select("__id", "__th", "at", "size", "h")
        gone = gone.join(sized(odd), ["h", "size"], "left_anti").select("__id", "__th", "at", "size", "h").unionByName(settled)
    removed = gone.groupBy("__id", "__th").agg(F.collect_set(F.struct("at", "size")).alias("__gone"))
    whole = dealt.join(removed, ["__id", "__th"], "left").drop("__id", "__th")
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_removed", T.LongType())])
    place = docs.columns.index("text")

    def rebuild(batches):
        for batch, data, offsets in each_slice(batches, "text"):
            old = batch.column("text")
            gone_ = batch.column("__gone").to_pylist()
            newline = np.concatenate([[0], np.cumsum(data == 10)])
            lines = newline[offsets[1:]] - newline[offsets[:-1]] + (np.diff(offsets) > 0)
            dropped = np.zeros(len(gone_), dtype=np.int64)
            changed = {}
            for i, spans in enumerate(gone_):
                if spans:
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    out, at = [], 0
                    for start, end in _merged(spans):
                        out.append(text[at:start])
                        at = end
                        dropped[i] += text.count(b"\n", start, end) + 1
                        at += at < len(text)  # with the line's end
                    out.append(text[at:])
                    kept = b"".join(out)
                    changed[i] = (kept[:-1] if at >= len(text) and kept.endswith(b"\n") else kept).decode()
            if changed:
                values = old.to_pylist()
                for i, x in changed.items():
                    values[i] = x
                old = pa.array(values, old.type)
            columns = [*batch.columns[: len(docs_names)]]
            columns[place] = old
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines.astype(np.int64)), pa.array(dropped)], names=schema.names)

    docs_names = docs.columns
    return whole.select(*docs_names, "__gone").mapInArrow(rebuild, schema)


def clean(docs: DataFrame) -> DataFrame:
    """docs, its columns, with repeated chunks and what extends them taken out of text."""
    inner, back = guarded(docs, "doc_id", "text")
    return back(deduplicate(inner))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed_lines"), "text")
