"""Exact top-k inner products with Fagin's threshold algorithm.

A shard holds some of the vectors with, for each dimension, the list of its rows sorted by that dimension; it is built once and
kept as an Arrow file in the shared folder. A query walks all lists together from the end its sign favours, a block of
places at a time; rows not seen before get their whole score by random access. What the lists show at the walked depth
bounds the score of every unseen row: once the k-th best score is above the bound, the rest cannot enter. A block of queries
goes past one shard's file after the other, and each query takes its k best with it, so that later walks end sooner; neither
vectors nor queries are sent more than once.

Components are floor(scale * x) as integers, so scores are exact. Ties go to the smaller vec_id, which is why
the k-th score must exceed the bound, not equal it.

Defined results: vectors that are null or hold null, NaN or infinite components, or components that are infinite once scaled,
and rows without an id, take no part; a query meets the vectors of its own length only; rows with the query's id are not its
candidates; rows repeated with one id are candidates each, and equal query rows are asked once; with fewer than k
candidates all are returned; a score that no 64-bit integer holds among a query's k best is an OverflowError; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import fresh, load_arrays, save_arrays

#: Vectors in a shard and queries in a block, about, and the blocks that a small query set is cut into for the sake of many tasks.
SHARD, BLOCK, BLOCKS = 8192, 32_768, 32

Best = tuple[np.ndarray, np.ndarray]


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _exact(whole: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.array([[int(x) for x in row] for row in whole.tolist()], object).reshape(whole.shape)


class Lists:
    """A shard's vectors and its sorted lists; rows are in ascending order of vec_id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None, ranked: np.ndarray | None = None):
        if order is None:
            by = np.argsort(ids, kind="stable")
            ids, vectors = ids[by], vectors[by]
            order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.ids, self.vectors, self.order = ids, vectors, order
        self.sorted = np.take_along_axis(vectors, order, axis=0) if ranked is None else ranked
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0

    def save(self, uri: str) -> None:
        save_arrays(uri, {"ids": self.ids, "vectors": self.vectors.ravel(), "order": self.order.ravel(), "sorted": self.sorted.ravel()})

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def mapped(uri: str) -> Lists:
        x = load_arrays(uri)
        n = len(x["ids"])
        return Lists(x["ids"], *(x[k].reshape(n, -1) for k in ("vectors", "order", "sorted")))

    @functools.cached_property
    def exactly(self) -> Lists:
        """The same with Python's integers, for products that doubles do not hold."""
        return Lists(self.ids, _exact(self.vectors), self.order)

    def top(self, query: np.ndarray, own: int, k: int, walked: list[int] | None = None, best: Best | None = None) -> Best:
        """(vec_id, score) arrays of the ``k`` best of ``best`` and the rows whose id is not ``own``."""
        n, dims = self.vectors.shape[0], np.flatnonzero(query)
        up = dims[query[dims] < 0]  # small values first
        down = dims[query[dims] > 0]
        seen = np.zeros(n, bool)
        best_id, best_score = best or (np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype))
        depth, step = 0, max(8, 4 * k)
        while depth < n:
            to = min(n, depth + step) if len(dims) else n
            if len(dims):
                fresh_ = np.zeros(n, bool)
                fresh_[self.order[depth:to, up]] = True
                fresh_[self.order[n - to : n - depth, down]] = True
                new = np.flatnonzero(fresh_ & ~seen)
            else:
                new = np.arange(n)
            seen[new] = True
            new = new[self.ids[new] != own]
            ids, score = np.concatenate([best_id, self.ids[new]]), np.concatenate([best_score, self.vectors[new] @ query])
            if len(ids) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                ids, score = ids[score >= cut], score[score >= cut]
            order = np.lexsort((ids, -score))[:k]
            best_id, best_score = ids[order], score[order]
            depth, step = to, 2 * step
            if depth < n and len(best_score) == k and best_score[-1] > self.sorted[depth - 1, up] @ query[up] + self.sorted[n - depth, down] @ query[down]:
                break
        if walked is not None:
            walked.append(depth)
        return best_id, best_score


def _matrix(t: pa.Table, scale: float) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("embedding").chunks]).astype(np.float64)
    return np.floor(scale * flat).reshape(t.num_rows, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dims"), is_query.alias("asks"))
    good = good.filter(~F.exists("embedding", lambda x: F.abs(x * scale) == float("inf")))
    n, asked = good.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    folder = fresh(spark, "lists")

    def build(t: pa.Table) -> pa.Table:
        import uuid

        uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        Lists(t.column("vec_id").to_numpy(), _matrix(t, scale)).save(uri)
        return pa.table([pa.array([t.column("dims")[0].as_py()], pa.int32()), pa.array([uri])], ["dims", "uri"])

    dealt = good.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, -(-n // shard)))).alias("shard"), "dims", F.col("vec_id").cast("long"), "embedding")
    files = sorted(tuple(r) for r in dealt.groupBy("shard", "dims").applyInArrow(build, "dims int, uri string").collect())  # one row for each shard

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        size = rows.column("dims").to_numpy()
        for dims in np.unique(size).tolist():
            some = rows.filter(pa.array(size == dims))
            queries, own = _matrix(some, scale), some.column("vec_id").to_pylist()
            reach = np.abs(queries).max(1, initial=0.0) * max(1, dims)
            found: list[Best | None] = [None] * len(own)
            for d, uri in files:
                if d == dims:
                    lists = Lists.mapped(uri)
                    for i, id_ in enumerate(own):
                        # doubles hold every product and sum below 2 ** 53; beyond, scores are Python's integers
                        if reach[i] * lists.largest < 2.0**53 and (found[i] is None or found[i][1].dtype != object):
                            found[i] = lists.top(queries[i], id_, k, best=found[i])
                        else:
                            best = found[i] and (found[i][0], np.array([int(s) for s in found[i][1]], object))
                            found[i] = lists.exactly.top(_exact(queries[i : i + 1])[0], id_, k, best=best)
            for id_, best in zip(own, found, strict=True):
                if best is not None and len(best[0]):
                    m = len(best[0])
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * m, pa.int64()), pa.array(range(1, m + 1), pa.int32()), pa.array(best[0], pa.int64()), pa.array([int(s) for s in best[1]], pa.int64())], ["query_id", "rank", "vec_id", "score"])

    asks = good.filter("asks").select(F.col("vec_id").cast("long"), "embedding", "dims").dropDuplicates(["vec_id", "embedding"])
    blocks = max(-(-asked // block), min(BLOCKS, -(-asked // 16)), 1)
    return asks.repartition(blocks, F.xxhash64("vec_id")).mapInArrow(search, "query_id long, rank int, vec_id long, score long")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
