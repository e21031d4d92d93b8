"""Exploration of a corpus and of what a ranking missed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NO_TITLE, occurrences, split_simple, title, tokenize
from ..session import materialise
from .index import Index
from .retrieval import chunks_with


def phrase_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, doc_id, n): occurrences of each phrase as a substring of the lower-case text, where there are any.

    Only texts that hold each word of a phrase within a chunk are looked at.
    """
    stated = phrases.select(F.lower("phrase").alias("phrase")).where("phrase <> ''").distinct()
    words = stated.select("phrase", F.explode(F.array_distinct(split_simple(F.col("phrase")))).alias("word"))
    sizes = words.groupBy("phrase").agg(F.count("*").alias("size"))
    holds = index.chunks()[0].join(chunks_with(words, index).select("word", "chunk"), "chunk").select("word", "doc_id").distinct()
    whole = words.join(holds, "word").groupBy("phrase", "doc_id").agg(F.count("*").alias("held")).join(sizes, "phrase").where("held = size").select("phrase", "doc_id")
    texts = index.documents.select(F.col("id").alias("doc_id"), F.lower("content").alias("low"))
    return whole.join(texts, "doc_id").select("phrase", "doc_id", occurrences(F.col("low"), F.col("phrase")).alias("n")).where("n > 0")


def phrase_search(index: Index, phrases: DataFrame, most: int = 10) -> DataFrame:
    """The first documents by id that hold each phrase."""
    order = Window.partitionBy("phrase").orderBy("doc_id")
    return phrase_hits(index, phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("phrase", "doc_id", "rank")


def candidate_queries(index: Index, phrases: DataFrame, least: int = 2, top: int = 15, each: int = 5) -> DataFrame:
    """The phrases that most documents hold, `least` or more, with the documents that hold them most often."""
    hits = materialise(phrase_hits(index, phrases), "phrase-hits")
    totals = hits.groupBy("phrase").agg(F.count("*").alias("matches")).where(F.col("matches") >= least).orderBy(F.desc("matches"), "phrase").limit(top)
    order = Window.partitionBy("phrase").orderBy(F.desc("n"), "doc_id")
    best = hits.join(totals, "phrase").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    return best.join(index.documents.select(F.col("id").alias("doc_id"), title(F.col("content")).alias("title")), "doc_id").select("phrase", "matches", "rank", "doc_id", "n", "title")


def title_words(docs: DataFrame, top: int = 30, longer_than: int = 2) -> DataFrame:
    """The most frequent words of the titles; short ones are dropped after the limit."""
    named = docs.select(title(F.col("content_text")).alias("title")).where(F.col("title") != NO_TITLE)
    words = named.select(F.explode(F.filter(F.split("title", r"(?U)\s+"), lambda w: w != "")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top).where(F.length("word") > longer_than)


def title_sample(docs: DataFrame, positions: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """Titles at fixed positions of the list by id. Only the first ids are ordered, not the table."""
    first = docs.orderBy("id").limit(max(positions) + 1)
    return first.withColumn("position", F.row_number().over(Window.orderBy("id")) - 1).where(F.col("position").isin(*positions)).select("position", "id", title(F.col("content_text")).alias("title"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))


def term_coverage(queries: DataFrame, index: Index) -> DataFrame:
    """For each query term: documents with it, their percentage, idf and whether that is low."""
    total = index.corpus_stats.select("n_docs")
    rows = query_terms(queries).join(index.term_stats, "term", "left").join(F.broadcast(total))  # one row
    df = F.coalesce("df", F.lit(0))
    return rows.select("query_id", "term", df.cast("long").alias("df"), F.round(df / F.col("n_docs") * 100, 6).alias("percent"), F.round(F.coalesce("idf", F.lit(0.0)), 6).alias("idf"), (F.coalesce("idf", F.lit(0.0)) < 1.0).alias("low"))


def common_queries(queries: DataFrame, index: Index, bound: float = 2.0) -> DataFrame:
    """(query_id, all_common): whether all terms of a query have an idf below the bound."""
    return term_coverage(queries, index).groupBy("query_id").agg(F.bool_and(F.col("idf") < bound).alias("all_common"))


def truth_terms(queries: DataFrame, qrels: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, term, tf): how often each relevant document holds each query term, 0 included."""
    pairs = qrels.select("query_id", "doc_id").distinct().join(query_terms(queries), "query_id")
    return pairs.join(index.postings, ["doc_id", "term"], "left").select("query_id", "doc_id", "term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))


def term_variants(queries: DataFrame, qrels: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, term, variant): other words of relevant documents that contain a query term or lie in it."""
    pairs = qrels.select("query_id", "doc_id").distinct().join(query_terms(queries), "query_id")
    words = index.postings.select("doc_id", F.col("term").alias("variant"))
    near = F.col("variant").contains(F.col("term")) | F.col("term").contains(F.col("variant"))
    return pairs.join(words, "doc_id").where(near & (F.col("variant") != F.col("term"))).select("query_id", "doc_id", "term", "variant")


def missed(qrels: DataFrame, ranking: DataFrame) -> DataFrame:
    """Relevant documents with their rank and score in a ranking, null where it doesn't have them."""
    return qrels.select("query_id", "doc_id").distinct().join(ranking.select("query_id", "doc_id", "rank", "score"), ["query_id", "doc_id"], "left")
