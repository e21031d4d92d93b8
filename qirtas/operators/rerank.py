"""Second-stage ranking: stored vectors or a pluggable scorer over a first stage's candidates.

A scorer is a function of a DataFrame (query_id, query, doc_id, text) that adds a column `model_score`; null means that the
pair got none. `lexical_scorer` is a deterministic stand-in for a neural cross-encoder, and no equivalent of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip, tokenize
from ..functions.vectors import cosine
from .retrieval import DECIMALS, FUSED_DECIMALS, min_max, ranked

Scorer = Callable[[DataFrame], DataFrame]


def lexical_scorer(pairs: DataFrame) -> DataFrame:
    """Share of the query's distinct normalised words that the text has; null for an empty text."""
    q, d = F.array_distinct(tokenize(F.col("query"))), tokenize(F.col("text"))
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(0.0)
    return pairs.withColumn("model_score", F.when(F.col("text") != "", F.round(share, DECIMALS)))


def failing_scorer(pairs: DataFrame) -> DataFrame:
    """A scorer whose service is down: no pair gets a score."""
    return pairs.withColumn("model_score", F.lit(None).cast("double"))


def pool_of(first: DataFrame, size: int) -> DataFrame:
    """The candidates; `lone` marks the only one of its query, which no re-ranker scores again."""
    pool = first.where(F.col("rank") <= size).select("query_id", "doc_id", F.col("rank").alias("stage1_rank"), F.col("score").alias("stage1_score"))
    return pool.withColumn("lone", F.count("*").over(Window.partitionBy("query_id")) == 1)


def with_cosine(pool: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The candidates that have a vector, with `cosine`; others are dropped."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    d = vectors.select("doc_id", F.col("embedding").alias("d"))
    return pool.join(d, "doc_id").join(q, "query_id").withColumn("cosine", F.round(cosine(F.col("q"), F.col("d")), DECIMALS)).drop("q", "d")


def with_text(pool: DataFrame, queries: DataFrame, texts: DataFrame, limit: int, stripped: bool = True) -> DataFrame:
    """The candidates with the query and up to `limit` characters of their text; a missing text is ''."""
    raw = F.coalesce("content", F.lit(""))
    raw = strip(raw) if stripped else raw
    # A pool has few and small rows, which would all be scored in one task; the work on its texts is what counts.
    spread = pool.repartition(pool.sparkSession.sparkContext.defaultParallelism, "doc_id")
    joined = spread.join(texts.select(F.col("id").alias("doc_id"), "content"), "doc_id", "left").join(queries.select("query_id", "query"), "query_id")
    return joined.select(*pool.columns, "query", F.substring(raw, 1, limit).alias("text"), (F.length(raw) > limit).alias("truncated"))


def _meta(**fields: Column | str) -> Column:
    return F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))


def rerank_cosine(first: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10, pool: int = 10) -> DataFrame:
    """The pool re-sorted by cosine. A query without any candidate vector keeps its first stage."""
    return _vector_or_stage1(first, queries, vectors, k, pool, lambda c: c.withColumn("score", F.col("cosine")))


def rerank_cosine_blend(first: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10, pool: int = 10, w1: float = 0.5, w2: float = 0.5) -> DataFrame:
    """w1 x min-max of the first stage + w2 x min-max of the cosine, over the candidates that have a vector."""
    blend = lambda c: c.withColumn("score", F.round(w1 * min_max(F.col("stage1_score"), "query_id") + w2 * min_max(F.col("cosine"), "query_id"), FUSED_DECIMALS))
    return _vector_or_stage1(first, queries, vectors, k, pool, blend)


def _vector_or_stage1(first, queries, vectors, k, pool, score):
    pooled = pool_of(first, pool)
    scored = score(with_cosine(pooled.where("not lone"), queries, vectors)).withColumn("fallback", F.lit(False))
    alone = pooled.drop("lone").join(scored.select("query_id").distinct(), "query_id", "left_anti").withColumns({"cosine": F.lit(None).cast("double"), "score": F.col("stage1_score"), "fallback": F.lit(True)})
    both = scored.select("query_id", "doc_id", "stage1_rank", "stage1_score", "cosine", "score", "fallback").unionByName(alone)
    return ranked(both.withColumn("metadata", _meta(stage1_rank="stage1_rank", stage1_score="stage1_score", stage2_score="cosine", fallback="fallback")), k, ("metadata",))


def rerank_backfill(first: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer = lexical_scorer, k: int = 10, pool: int = 10, limit: int = 8000) -> DataFrame:
    """The scored candidates, and after them first-stage ones up to k; candidates with an empty text are only filled back."""
    pooled = pool_of(first, pool)
    scored = scorer(with_text(pooled.where("not lone"), queries, texts, limit).where("text <> ''")).where("model_score is not null")
    used = scored.select("query_id", "doc_id", "stage1_rank", "stage1_score", F.col("model_score").alias("score"), F.lit(False).alias("fallback"))
    rest = pooled.join(used.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "stage1_rank", "stage1_score", F.col("stage1_score").alias("score"), F.lit(True).alias("fallback"))
    order = Window.partitionBy("query_id").orderBy("fallback", F.when(~F.col("fallback"), -F.col("score")), F.when(F.col("fallback"), F.col("stage1_rank")), "doc_id")
    out = used.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "doc_id", "score", "rank", _meta(stage1_rank="stage1_rank", stage1_score="stage1_score", fallback="fallback").alias("metadata"))


def rerank_blend(first: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer = lexical_scorer, k: int = 10, pool: int = 30, limit: int = 800, w1: float = 0.3, w2: float = 0.7) -> DataFrame:
    """w1 x min-max of the first stage + w2 x min-max of the model score; without a text, min-max of the first stage alone."""
    pooled = pool_of(first, max(pool, k))
    scored = scorer(with_text(pooled, queries, texts, limit))
    n1 = scored.withColumn("n1", min_max(F.col("stage1_score"), "query_id"))
    # Null scores stay out of min and max, as Spark's aggregates skip them.
    n2 = n1.withColumn("n2", F.when(F.col("model_score").isNotNull(), min_max(F.col("model_score"), "query_id")))
    final = n2.withColumn("score", F.round(F.when(F.col("lone"), F.col("stage1_score")).when(F.col("n2").isNotNull(), w1 * F.col("n1") + w2 * F.col("n2")).otherwise(F.col("n1")), FUSED_DECIMALS))
    return ranked(final.withColumn("metadata", _meta(stage1_rank="stage1_rank", stage1_score="stage1_score", stage1_norm="n1", stage2_score="model_score", stage2_norm="n2", truncated="truncated")), k, ("metadata",))


def rerank_scorer(first: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer = lexical_scorer, k: int = 10, pool: int = 10, limit: int = 8000) -> DataFrame:
    """By model score; a query whose pairs got no score keeps its first-stage order."""
    scored = scorer(with_text(pool_of(first, pool), queries, texts, limit, stripped=False))
    any_score = F.max("model_score").over(Window.partitionBy("query_id")).isNotNull()
    kept = scored.withColumn("answered", any_score & ~F.col("lone")).where(F.col("model_score").isNotNull() | ~F.col("answered"))
    final = kept.withColumn("score", F.when(F.col("lone"), F.col("stage1_score")).otherwise(F.coalesce("model_score", "stage1_score")))
    return ranked(final.withColumn("metadata", _meta(stage1_rank="stage1_rank", stage1_score="stage1_score", stage2_score="model_score", fallback=~F.col("answered"))), k, ("metadata",))


def rerank_cascade(first: DataFrame, scored_pool: Callable[[DataFrame], DataFrame], k: int = 10, stage2: int = 45, blend: float = 0.55) -> DataFrame:
    """final = (1 - blend) x min-max(fused) + blend x min-max(model_score) for the best `stage2` candidates; all others keep
    their fused score, on its own scale, and all are sorted together. scored_pool adds `model_score` to the pool."""
    pooled = scored_pool(pool_of(first, stage2)).where("model_score is not null")
    for name, default in (("truncated", F.lit(None).cast("boolean")), ("text", F.lit(None).cast("string"))):
        pooled = pooled if name in pooled.columns else pooled.withColumn(name, default)
    final = pooled.withColumn("final", (1 - blend) * min_max(F.col("stage1_score"), "query_id") + blend * min_max(F.col("model_score"), "query_id")).select("query_id", "doc_id", "model_score", "final", "truncated", F.substring("text", 1, 120).alias("preview"))
    joined = first.select("query_id", "doc_id", F.col("rank").alias("stage1_rank"), F.col("score").alias("fused_score")).join(final, ["query_id", "doc_id"], "left")
    out = joined.withColumn("score", F.round(F.coalesce("final", "fused_score"), FUSED_DECIMALS))
    return ranked(out.withColumn("metadata", _meta(fused_score="fused_score", rerank_score="model_score", rerank_applied=F.col("final").isNotNull(), doc_truncated="truncated", rerank_input_preview="preview")), k, ("metadata",))
