"""Ranked retrieval over batches of queries: keyword counts, BM25, vectors, and rank and score fusion.

Every ranking is (query_id, doc_id, score, rank). Scores are rounded before they are ranked, and ties go to the lower id, so
that a ranking doesn't depend on the order in which partitions are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.substrings import top_k_counts
from ..functions.text import occurrences, split_simple, tokenize
from ..functions.vectors import top_k_cosine
from ..session import materialise
from .index import GRAM, Index

DECIMALS = 6
#: Fused scores keep more, as they are made of rounded ones and would often fall just between two roundings.
FUSED_DECIMALS = 9


def ranked(scores: DataFrame, k: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The k best of each query by score, then id. The limit is applied before the shuffle as well."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).select("query_id", "doc_id", "score", "rank", *extra)


def chunks_with(words: DataFrame, index: Index) -> DataFrame:
    """(word, chunk, n): the chunks of the corpus that hold each of the (word), which have no white space, n times.

    A word's first characters find the chunks that may hold it, so neither texts nor all pairs are looked at.
    """
    _, grams = index.chunks()
    asked = words.where("word <> ''").select("word").distinct().withColumn("gram", F.substring("word", 1, GRAM))
    held = grams.join(asked, "gram").where(F.contains("chunk", F.col("word"))).select("word", "chunk").distinct()
    # Written, so that its size is known when it meets the chunks of all documents.
    return materialise(held.select("word", "chunk", occurrences(F.col("chunk"), F.col("word")).alias("n")), "word-chunks")


def keyword_scores(queries: DataFrame, index: Index, k: int | None = None) -> DataFrame:
    """Occurrences of each word of (query_id, query) as substrings of the lower-case text; words count as often as repeated.

    With `k` only what can be among the k best of a query comes out.
    """
    words = queries.select("query_id", F.explode(split_simple(F.col("query"))).alias("word"))
    texts = index.documents.select(F.col("id").alias("doc_id"), F.lower("content").alias("text"))
    return top_k_counts(words, texts, index.n_bytes(), k)


def bm25_scores(queries: DataFrame, index: Index, k1: float = 1.5, b: float = 0.75, script: str = "arabic") -> DataFrame:
    """BM25 of (query_id, query); terms of no idf are skipped, repeated query terms count as often."""
    terms = queries.select("query_id", F.explode(tokenize(F.col("query"), script)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # Written first: its size is then known when the join with all postings is planned, and a small set of queries is sent to them.
    weighted = materialise(terms.join(index.term_stats.where("idf > 0").select("term", "idf"), "term"), "query-terms")
    found = index.postings.join(weighted, "term").join(F.broadcast(index.corpus_stats))  # one row
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_doc_len")))
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DECIMALS).alias("score")).where("score > 0")


def vector_ranking(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Cosine ranking of (query_id, embedding) against (doc_id, embedding)."""
    return top_k_cosine(queries, vectors, k, DECIMALS)


def min_max(score: Column, *partition: str) -> Column:
    """(x - min) / (max - min) within a query; all ones where the range is below 1e-9."""
    w = Window.partitionBy(*partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise((score - low) / (high - low))


def combine(first: DataFrame, second: DataFrame, pool: int) -> DataFrame:
    """Candidates of either ranking's pool: (query_id, doc_id, r1, s1, n1, r2, s2, n2); a missing score is 0 and enters min-max."""
    a = first.where(F.col("rank") <= pool).select("query_id", "doc_id", F.col("rank").alias("r1"), F.col("score").alias("s1"))
    b = second.where(F.col("rank") <= pool).select("query_id", "doc_id", F.col("rank").alias("r2"), F.col("score").alias("s2"))
    both = a.join(b, ["query_id", "doc_id"], "full").withColumns({"s1": F.coalesce("s1", F.lit(0.0)), "s2": F.coalesce("s2", F.lit(0.0))})
    return both.withColumns({"n1": min_max(F.col("s1"), "query_id"), "n2": min_max(F.col("s2"), "query_id")})


def reciprocal(rank: Column, k: float, base: int) -> Column:
    """1 / (k + rank - base); 0 without a rank."""
    return F.coalesce(1.0 / (k + rank - base), F.lit(0.0))


def check_weights(w1: float, w2: float) -> None:
    if not (0 <= w1 <= 1 and 0 <= w2 <= 1) or abs(w1 + w2 - 1) > 0.001:
        raise ValueError("weights must be in [0, 1] and add up to 1")


_META = ("r1", "r2", "s1", "s2", "n1", "n2")


def _fused(candidates: DataFrame, score: Column, k: int | None) -> DataFrame:
    scored = candidates.withColumn("score", F.round(score, FUSED_DECIMALS))
    meta = F.struct(F.col("r1").alias("rank1"), F.col("r2").alias("rank2"), F.col("s1").alias("score1"), F.col("s2").alias("score2"), F.col("n1").alias("norm_score1"), F.col("n2").alias("norm_score2"))
    return ranked(scored.withColumn("metadata", meta), k, ("metadata",))


def _weighted(w1: float, w2: float) -> Column:
    check_weights(w1, w2)
    return w1 * F.col("n1") + w2 * F.col("n2")


def _rrf(k: float, base: int) -> Column:
    return reciprocal(F.col("r1"), k, base) + reciprocal(F.col("r2"), k, base)


def _first_bonus(up_to: int, boost: float) -> Column:
    return F.when(F.col("r1") <= up_to, boost / F.col("r1")).otherwise(0.0)


def fuse_rrf(first, second, k=10, pool=50, rrf_k=60):
    return _fused(combine(first, second, pool), _rrf(rrf_k, 0), k)


def fuse_weighted(first, second, k=10, pool=50, w1=0.5, w2=0.5):
    return _fused(combine(first, second, pool), _weighted(w1, w2), k)


def fuse_rrf_blend(first, second, k=10, pool=75, rrf_k=60, blend=0.35, w1=0.6, w2=0.4):
    return _fused(combine(first, second, pool), _rrf(rrf_k, 1) + blend * _weighted(w1, w2), k)


def fuse_ensemble(first, second, k=10, pool=80, rrf_k=50, rrf_weight=0.5, score_weight=0.35, w1=0.6, w2=0.4, max_weight=0.15, boost=0.12, boost_rank=2):
    score = rrf_weight * _rrf(rrf_k, 1) + score_weight * _weighted(w1, w2) + max_weight * F.greatest("n1", "n2") + _first_bonus(boost_rank, boost)
    return _fused(combine(first, second, pool), score, k)


def density(rank: Column, window: float) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.exp(-(rank - 1) / window)), F.lit(0.0))


def fuse_density(first, second, k=10, pool=95, rrf_k=50, rrf_weight=0.6, score_weight=0.25, w1=0.6, w2=0.4, density_weight=0.1, window=6, position_boost=0.1, exponent=1.15):
    near = F.greatest(density(F.col("r1"), window), density(F.col("r2"), window))
    score = F.pow(rrf_weight * _rrf(rrf_k, 1), F.lit(exponent)) + score_weight * _weighted(w1, w2) + density_weight * near + _first_bonus(3, position_boost)
    return _fused(combine(first, second, pool), score, k)


def fuse_cascade(first, second, k=None, pool=110, rrf_k=55, rrf_weight=0.4, score_weight=0.25, w1=0.6, w2=0.4, boost=0.12, boost_rank=1):
    """First stage of the cascade: all candidates with their fused score."""
    score = rrf_weight * _rrf(rrf_k, 1) + score_weight * _weighted(w1, w2) + _first_bonus(boost_rank, boost)
    return _fused(combine(first, second, pool), score, k)
