"""Exact vector search (O-T5, O-T6, O-J18, O-W2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.shared import settle


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors have similarity zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, id_column: str, column: str, query: list[float], k: int) -> DataFrame:
    """id, similarity of the k nearest, ties by id; rows of another dimension are skipped. One scan with partial top-k per task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where(F.size(column) == len(query)).select(F.col(id_column).alias("id"), F.round(cosine(F.col(column), q), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def nearest_batched(vectors: DataFrame, id_column: str, column: str, queries: np.ndarray, k: int) -> DataFrame:
    """query, id, similarity: many queries at once by matrix products over Arrow batches, each handing on its own k best, then k of these."""
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-30)
    dim = unit.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            sim = np.round(unit @ (x / np.where(norm > 0, norm, 1)[:, None]).T, 6)
            rows = [(q, ids[j], sim[q, j]) for q in range(len(unit)) for j in np.lexsort((ids, -sim[q]))[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query", "id", "similarity"])

    part = vectors.where(F.size(column) == dim).select(F.col(id_column).cast("long"), column).mapInArrow(run, "query int, id long, similarity double")
    return part.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


#: Vectors of a pack: a pack of queries and one of vectors make one matrix product.
PACK = 4096


def _packs(rows: DataFrame, id_column: str, column: str, name: str, most: int) -> DataFrame:
    """Rows of ids and vectors of one dimension, most at a time, as flat arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column(1)])
            for dim in np.unique(size[size > 0]):
                own = np.flatnonzero(size == dim)
                for i in range(0, len(own), most):
                    t = b.take(pa.array(own[i : i + most]))
                    x = t.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([t.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], [f"{name}_dim", f"{name}_ids", f"{name}_x"])

    return rows.where(F.col(column).isNotNull()).select(F.col(id_column).cast("long"), column).mapInArrow(run, f"{name}_dim int, {name}_ids binary, {name}_x binary")


def nearest_all(vectors: DataFrame, queries: DataFrame, id_column: str, column: str, k: int, block: int = PACK) -> DataFrame:
    """O-J18: query, id, similarity, rank of the k nearest of every row of queries, which is held against all vectors in blocks of so many at most.

    All pairs are compared, packs against packs, in the tasks: nothing is collected, and a task holds a pack of either side. Each pair of packs
    hands on k rows a query.
    """
    unit = lambda b, dim: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None])(np.frombuffer(b, np.float64).reshape(-1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, q_ids, q, ids, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                sim = np.round(unit(q, dim) @ unit(x, dim).T, 6)
                best = np.stack([np.lexsort((ids, -s))[:k] for s in sim])
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(sim, best, 1).ravel())], ["query", "id", "similarity"])

    ours = settle(_packs(queries, id_column, column, "q", block), "queries")
    theirs = settle(_packs(vectors, id_column, column, "v", PACK), "vectors")
    pairs = ours.crossJoin(theirs).where("q_dim = v_dim + 0")  # packs, not rows
    found = pairs.select("q_dim", "q_ids", "q_x", "v_ids", "v_x").mapInArrow(run, "query long, id long, similarity double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def confidence(ranked: DataFrame, top: int = 3) -> DataFrame:
    """O-T6: mean similarity of the best few; zero without any."""
    return ranked.orderBy(F.desc("similarity"), "id").limit(top).agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("confidence"))
