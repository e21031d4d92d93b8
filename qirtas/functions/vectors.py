"""Vector functions: cosine, inner product and normalisation as columns, and blocked top-k search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that are held in a task, and vectors that are multiplied with them at once.
QUERY_BLOCK, STEP = 4096, 2048


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 if either vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, inner_product(a, b) / size).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def top_k_cosine(queries: DataFrame, vectors: DataFrame, k: int, decimals: int | None = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): for each (query_id, embedding) the k nearest (doc_id, embedding).

    Queries and vectors meet in the cells of a grid: blocks of at most about QUERY_BLOCK queries times slices of the vectors,
    one task a cell. Each vector goes once to each block of queries; a task multiplies matrices and gives its best k of each
    query, so the last shuffle has queries x k x slices rows. Ties go to the lower doc_id, on the rounded score. Null vectors
    are left out; an empty table on either side gives no rows.
    """
    spark = queries.sparkSession
    q = queries.where("embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    blocks = -(-q.count() // QUERY_BLOCK) or 1
    slices = max(1, spark.sparkContext.defaultParallelism // blocks, vectors.rdd.getNumPartitions() // 4)
    cell = lambda block, part: (F.pmod(block, F.lit(blocks)) * slices + part).cast("int").alias("cell")
    left = q.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "query_id", "embedding").select(cell(F.xxhash64("query_id"), F.col("slice")), "query_id", "embedding")
    own = F.pmod(F.xxhash64("doc_id"), F.lit(slices))
    right = vectors.where("embedding is not null").select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>"))
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), own.alias("own"), "doc_id", "embedding").select(cell(F.col("block"), F.col("own")), "doc_id", "embedding")
    best = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell(k, decimals), "query_id bigint, doc_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cell(k: int, decimals: int | None):
    names = ["query_id", "doc_id", "score"]

    def matrix(column) -> np.ndarray:
        return _unit(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, docs = left.column("query_id").to_numpy(), right.column("doc_id").to_numpy()
        if not len(ids) or not len(docs):
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q = matrix(left.column("embedding"))
        scores, found = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)
        for low in range(0, len(docs), STEP):
            part = slice(low, low + STEP)
            s = q @ matrix(right.column("embedding").slice(low, STEP)).T
            s = np.round(s, decimals) if decimals is not None else s
            scores, found = np.concatenate([scores, s], 1), np.concatenate([found, np.broadcast_to(docs[part], s.shape)], 1)
            if scores.shape[1] > k:
                keep = np.lexsort((found, -scores), axis=1)[:, :k]
                scores, found = np.take_along_axis(scores, keep, 1), np.take_along_axis(found, keep, 1)
        return pa.table([pa.array(np.repeat(ids, found.shape[1])), pa.array(found.ravel()), pa.array(scores.ravel())], names=names)

    return best


def _unit(a: np.ndarray) -> np.ndarray:
    n = np.sqrt((a**2).sum(1, keepdims=True))
    return a / np.where(n > 0, n, 1)
