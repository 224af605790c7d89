"""Conversation prefix trie: chained digests of every prefix of every conversation.

A turn's digest is the SHA-256 of its role's length in bytes, a colon, the role
and the text; a prefix's digest is the SHA-256 of the digest of the prefix
before it and of its last turn's. Every prefix is exploded and grouped by
(depth, digest): the trie's nodes.

Subtree sums: a node belongs to its smallest member, so a conversation's own
nodes are a run at the end of its path. Within the run sums are a running sum;
all of it is exploded once to each ancestor before the run. That is at most a
row a prefix, however deep conversations are and however many copies they have.

Order: turns by `turn`, null first; turns of one number by their digest, so
repeated rows are repeated turns. A null role or text is empty. Rows without
conv_id belong to no conversation and are left out. A conversation without
turns (rebuild() makes such) is a member of the root. Without conversations
there is no node, not even a root. Texts of any length are hashed where they
are read; no later step carries them. Other columns are ignored. A conversation
goes through one task as a sorted stream, of which only a digest is held.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, bound_batches, cut, table

ROOT = hashlib.sha256().digest()
CHUNK = 1 << 16
_PREFIX = "conv_id long, depth int, digest binary, parent binary, words long, ends boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), words and digest of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), digest.alias("turn_digest"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_digest")
    return slim.select("conv_id", F.row_number().over(order).alias("place"), "words", "turn_digest")


def whole(placed: DataFrame) -> DataFrame:
    """The turns and a root (place 0) of each conversation: what prefixes() takes."""
    return _with_roots(placed, placed.filter("place = 1").select("conv_id"))


def _with_roots(placed: DataFrame, conversations: DataFrame) -> DataFrame:
    root = conversations.select("conv_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("binary").alias("turn_digest"))
    return root.unionByName(placed)


def rebuild(placed: DataFrame, every: int, keep: int) -> DataFrame:
    """whole() of conversations that each begin with the first h turns of conversation c - c % every instead of their own first h; h = crc32(c) % keep."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % keep
    conversations = placed.filter("place = 1").select("conv_id")
    first = placed.filter((F.col("conv_id") % every == 0) & (F.col("place") < keep)).withColumnRenamed("conv_id", "base")
    lent = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base").filter(F.col("place") <= h)
    own = placed.filter(F.col("place") > h)
    return _with_roots(own.unionByName(lent.select(*own.columns)), conversations)


def prefixes(placed: DataFrame) -> DataFrame:
    """conv_id, depth, digest, the digest before it (parent), words of the last turn, and whether the conversation ends there: a row a prefix."""
    schema = T._parse_datatype_string(_PREFIX)

    def run(batches):
        arrow = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ends", pa.bool_())])
        held = None  # a row whose end shows in the next one
        for batch in batches:
            out = []
            for conv, words, turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "words", "turn_digest"))):
                if held is not None:
                    out.append((*held, held[0] != conv))
                if turn is None:
                    held = (conv, 0, ROOT, None, 0)
                else:
                    held = (conv, held[1] + 1, hashlib.sha256(held[2] + turn).digest(), held[2], words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*held, True), arrow)], schema=arrow)

    return placed.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "words", "turn_digest").mapInArrow(run, schema)


def _streamed(key, rows, flush_at: int):
    """Runs of equal keys as (key, first id, comma-joined ids), cut at about flush_at characters."""
    now, first, ids, size = None, None, [], 0
    for k, i in rows:
        if ids and (k != now or size >= flush_at):
            yield now, first, ",".join(ids)
            ids, size = [], 0
        if not ids:
            now, first = k, i
        ids.append(str(i))
        size += len(ids[-1]) + 1
    if ids:
        yield now, first, ",".join(ids)


def end_hashes(ended: DataFrame) -> DataFrame:
    """digest, ends_sha256: of the ids (conv_id) that end at each digest, ascending, comma-joined.

    Ids are sorted and joined to texts of CHUNK characters by ranges, so that
    copies of one conversation are split; a digest's texts are then hashed one
    after another, which is all that has to follow an order.
    """

    def join(batches):
        rows = ((k, i) for b in batches for k, i in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist()))
        for k, first, text in _streamed("digest", rows, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.binary()), pa.array([first], pa.int64()), pa.array([text])], names=["digest", "first", "ids"])

    def packed(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in join(batches):
            held.append(b)
            size += b.nbytes
            if size > 16 * CHUNK or len(held) >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def finish(batches):
        now, sha, done = None, None, []
        for b in batches:
            for k, text in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist()):
                if k != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["digest", "ends_sha256"])
                done = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])

    texts = ended.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(packed, "digest binary, first long, ids string")
    return texts.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(finish, "digest binary, ends_sha256 string")


def nodes(prefix: DataFrame) -> DataFrame:
    """depth, digest, parent, conv_id (the smallest member), n_convs and words of each node."""
    return prefix.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.any_value("parent").alias("parent"), F.any_value("words").alias("words"))


def trie(prefix: DataFrame) -> DataFrame:
    """A row a node: its place in the trie (conv_id, depth, parent_conv_id, digest), members, children, leaves and saved tokens of its subtree, and what ends there."""
    at = ["depth", "digest"]
    prefix = cut(prefix)
    node = cut(nodes(prefix))
    below = node.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    node_kids = node.join(below, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    run = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    upward = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut(
        node_kids.withColumn("saved", F.sum((F.col("n_convs") - 1) * F.col("words")).over(upward))
        .withColumn("leaves", F.sum((F.col("n_children") == 0).cast("long")).over(upward))
        .withColumn("heads", F.lead("depth").over(run).isNull())
    )
    head = own.filter("heads AND depth > 0")
    up = head.filter("saved > 0 OR leaves > 0").select("conv_id", F.col("depth").alias("until"), F.col("saved").alias("more_saved"), F.col("leaves").alias("more_leaves"))
    lifted = prefix.select("conv_id", *at).join(up, "conv_id").filter("depth < until").groupBy(*at).agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    parents = node.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    parents = head.select("depth", "parent", "digest").join(parents, ["depth", "parent"]).select(*at, "above")
    full = own.join(lifted, at, "left").join(parents, at, "left").join(end_hashes(prefix.filter("ends")), "digest", "left")
    zero = F.lit(0)
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.when(F.col("heads"), F.col("above")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"), "digest",
    )


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    placed = cut(turns(table(spark, sf_dir, "conversations")))
    return trie(prefixes(rebuild(placed, every=20, keep=4))).drop("digest")


_CRC = "xor(list_reduce([CAST(4294967295 AS UBIGINT)] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END)), CAST(4294967295 AS UBIGINT))"

ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, CAST({_CRC} % 4 AS BIGINT) AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1 : h.h], []), h.own[h.h + 1 :]) AS l FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, l[1 : d] AS path, len(l) = d AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS members FROM p GROUP BY path, d),
w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n),
k AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT path[1 : up] AS path, up AS d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT w.path, w.saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, w.d + 1)) AS up FROM w LEFT JOIN k ON w.path = k.path AND w.d = k.d) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, f.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.members, '')) AS ends_sha256
FROM n JOIN a ON n.path = a.path AND n.d = a.d LEFT JOIN k ON n.path = k.path AND n.d = k.d LEFT JOIN n f ON n.d > 0 AND f.d = n.d - 1 AND f.path = n.path[1 : n.d - 1]
"""
