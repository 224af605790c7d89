"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are product-quantised in pairs of dimensions with sixteen centroids
each (four bits). Codes and codebooks minimise a residual's squared length with
its component parallel to the vector weighted by `eta`, which keeps large inner
products exact where it matters. A query's inner products with all centroids
make tables; two codes share a byte, so a scan adds up one table entry for each
four dimensions. The squared norms, kept exactly, turn inner products into
Euclidean distances. Of each batch a query's best `rerank` codes, and all that
tie with the last of them, are ranked again by the distance of the original
vectors in double precision. Of vectors that are the same in a batch the first
k + 1 by vec_id stand for all: the others can't be among a query's k nearest.

The codebooks are fitted on at most `sample` vectors (the first by hash of
vec_id); every vector is encoded, once, and scanned. Queries are sent in blocks
of at most `block` vectors, a pass over the codes for each block.

Vectors that are null, zero, or hold null or non-finite components take no
part. Vectors of another dimension are searched among themselves, each
dimension with codebooks of its own. Equal distances are ranked by vec_id. A repeated vec_id counts once as a query (the smallest of its
vectors) and row by row as a candidate; rows with the query's own id are no
candidates of it. Rows with a null id take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, table

EVERY, K, RERANK, SAMPLE, BLOCK, THRESHOLD = 100, 10, 100, 8192, 8192, 0.2
CENTROIDS, WIDTH = 16, 2


def _eta(d: int, threshold: float) -> float:
    return max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """Codebooks of shape (subspaces, 16, 2)."""

    def __init__(self, x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 3, seed: int = 5):
        self.d = x.shape[1]
        self.m = 2 * math.ceil(self.d / (2 * WIDTH))  # even, so that two codes share a byte
        self.eta = _eta(self.d, threshold)
        x = self.padded(x.astype(np.float64))
        rng = np.random.default_rng(seed)
        sub = x.reshape(len(x), self.m, WIDTH)
        self.books = np.empty((self.m, CENTROIDS, WIDTH))
        for j in range(self.m):
            c = sub[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS), j].copy()
            for _ in range(10):
                near = ((sub[:, j, None] - c) ** 2).sum(-1).argmin(1)
                n = np.bincount(near, minlength=CENTROIDS)
                for a in range(WIDTH):
                    c[:, a] = np.where(n > 0, np.bincount(near, weights=sub[:, j, a], minlength=CENTROIDS) / np.maximum(n, 1), c[:, a])
            self.books[j] = c
        for _ in range(rounds):
            self._refit(x, self.codes(x))

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.m * WIDTH - x.shape[1]))) if x.shape[1] < self.m * WIDTH else x

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Nearest centroids, then coordinate descent on the anisotropic loss."""
        sub = x.reshape(len(x), self.m, WIDTH)
        u = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(sub.shape)
        code = np.empty((len(x), self.m), dtype=np.int64)
        rest = np.zeros(len(x))
        for j in range(self.m):
            code[:, j] = ((sub[:, j, None] - self.books[j]) ** 2).sum(-1).argmin(1)
            rest += ((sub[:, j] - self.books[j][code[:, j]]) * u[:, j]).sum(-1)
        for _ in range(sweeps):
            for j in range(self.m):
                r = sub[:, j, None] - self.books[j]
                along = (r * u[:, j, None]).sum(-1)
                rest -= along[np.arange(len(x)), code[:, j]]
                code[:, j] = ((r**2).sum(-1) + (self.eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
                rest += along[np.arange(len(x)), code[:, j]]
        return code

    def _refit(self, x: np.ndarray, code: np.ndarray) -> None:
        """The codebooks that minimise the loss of these codes: one least-squares system."""
        n, size = len(x), self.m * CENTROIDS * WIDTH
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        place = ((np.arange(self.m) * CENTROIDS + code) * WIDTH)[:, :, None] + np.arange(WIDTH)
        place = place.reshape(n, -1)
        g = np.zeros((n, size), dtype=np.float32)
        np.put_along_axis(g, place, u.astype(np.float32), axis=1)
        normal = (self.eta - 1) * (g.T @ g).astype(np.float64)
        right = (self.eta - 1) * (g.T @ (x * u).sum(1).astype(np.float32)).astype(np.float64)
        count = np.bincount(place.ravel(), minlength=size)
        normal[np.arange(size), np.arange(size)] += count + 1e-3
        right += np.bincount(place.ravel(), weights=x.ravel(), minlength=size) + 1e-3 * self.books.ravel()
        self.books = np.linalg.solve(normal, right).reshape(self.books.shape)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        code = self.codes(self.padded(x.astype(np.float64)))
        return (code[:, 0::2] * CENTROIDS + code[:, 1::2]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products by query, byte and its 256 values."""
        sub = self.padded(q.astype(np.float64)).reshape(len(q), self.m, WIDTH)
        t = np.einsum("qmw,mcw->qmc", sub, self.books)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), self.m // 2, CENTROIDS**2).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    ok = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(ok)


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, dist))[:k]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, rerank: int = RERANK, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found."""
    spark = vectors.sparkSession
    bound_batches(spark)
    vectors, queries = usable(vectors), usable(queries)
    out = spark.createDataFrame([], _RESULT)
    # a row a dimension, and one pass for each
    for (d,) in vectors.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        own = (x.filter(F.size("embedding") == d) for x in (vectors, queries))
        out = out.unionByName(_found(*own, d, k, rerank, sample, block))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_RESULT = "query_id bigint, vec_id bigint, score double"


def _found(vectors: DataFrame, queries: DataFrame, d: int, k: int, rerank: int, sample: int, block: int) -> DataFrame:
    """Of vectors of dimension d: each task's nearest k of each query."""
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    fit = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toArrow()
    sent = spark.sparkContext.broadcast(Quantiser(_matrix(fit.column("embedding"), d)))
    kind = vectors.schema["embedding"].dataType.simpleString()

    def encode(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch.column("embedding"), d)
                code, norm = sent.value.encode(x), ((x.astype(np.float64) ** 2).sum(1) / 2).astype(np.float32)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), codes, pa.array(norm)], names=["vec_id", "embedding", "code", "norm"])

    coded = vectors.mapInArrow(encode, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, embedding {kind}, code binary, norm float")
    parts = max(1, math.ceil(queries.count() / block))
    if parts > 1:
        coded = cut(coded)
    found = []
    for part in range(parts):
        q = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow()
        asked = spark.sparkContext.broadcast((q.column("vec_id").to_numpy(), _matrix(q.column("embedding"), d)))

        def run(batches, asked=asked):
            own, q = asked.value
            quantiser = sent.value
            kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(own)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    ids, x = batch.column("vec_id").to_numpy().astype(np.int64), _matrix(batch.column("embedding"), d)
                    first = _stand(ids, x, k + 1)
                    ids, wide = ids[first], x[first].astype(np.float64)
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), -1)[first]
                    norm = batch.column("norm").to_numpy()[first]
                    for begin in range(0, len(own), 256):
                        t = quantiser.tables(q[begin : begin + 256])
                        near = np.repeat(-norm[None], len(t), axis=0)
                        for j in range(code.shape[1]):
                            near += t[:, j][:, code[:, j]]
                        near[own[begin : begin + 256, None] == ids[None]] = -np.inf
                        n = min(rerank, len(ids))
                        least = np.partition(near, len(ids) - n, axis=1)[:, len(ids) - n]
                        for i in range(len(t)):
                            c = np.flatnonzero((near[i] >= least[i]) & (ids != own[begin + i]))
                            dist = np.sqrt(((wide[c] - q[begin + i].astype(np.float64)) ** 2).sum(1))
                            dist, name = np.concatenate([kept[begin + i][0], dist]), np.concatenate([kept[begin + i][1], ids[c]])
                            b = _best(dist, name, k)
                            kept[begin + i] = dist[b], name[b]
            for i, (dist, name) in enumerate(kept):
                if len(dist):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dist), own[i]), pa.int64()), pa.array(name), pa.array(dist)], names=["query_id", "vec_id", "score"])

        found.append(coded.mapInArrow(run, _RESULT))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _stand(ids: np.ndarray, x: np.ndarray, many: int) -> np.ndarray:
    """Which rows to look at: of rows with one vector the first `many` by id."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    which = np.unique(rows, return_inverse=True)[1]
    order = np.lexsort((ids, which))
    sorted_ = which[order]
    begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < many]


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
