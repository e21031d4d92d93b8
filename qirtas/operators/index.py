"""Index tables: postings, document, term and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_simple, tokenize
from ..session import materialise
from ..sources.tables import successful


@dataclass(frozen=True)
class Index:
    """Written once, read by every engine: no engine tokenises the corpus again."""

    documents: DataFrame  # id, url, content
    postings: DataFrame  # doc_id, term, tf, doc_len: the length goes with each posting, so that scoring needs no join for it
    doc_stats: DataFrame  # doc_id, doc_len
    term_stats: DataFrame  # term, df, idf
    corpus_stats: DataFrame  # n_docs, avg_doc_len
    _kept: dict = field(default_factory=dict, repr=False, compare=False)

    def chunks(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, chunk, tf) and (gram, chunk): what stands between white space in the lower-case texts, and the substrings of
        one to GRAM characters of each different chunk. Written at the first substring search."""
        if "chunks" not in self._kept:
            words = self.documents.select(F.col("id").alias("doc_id"), F.explode(split_simple(F.col("content"))).alias("chunk"))
            held = materialise(words.groupBy("doc_id", "chunk").agg(F.count("*").alias("tf")), "chunks")
            self._kept["chunks"] = held
            self._kept["grams"] = materialise(held.select("chunk").distinct().select(F.explode(grams(F.col("chunk"))).alias("gram"), "chunk"), "chunk-grams")
        return self._kept["chunks"], self._kept["grams"]

    def n_bytes(self) -> int:
        """Bytes of all texts, added up at the first call."""
        if "bytes" not in self._kept:
            self._kept["bytes"] = self.documents.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        return self._kept["bytes"]


#: Characters of the substrings by which chunks are found.
GRAM = 3


def grams(word: Column) -> Column:
    """The different substrings of one to GRAM characters."""

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - (size - 1))
        return F.when(F.length(word) >= size, F.transform(starts, lambda i: F.substring(word, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(1, GRAM + 1))))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf) from (doc_id, tokens)."""
    return tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(doc_stats: DataFrame) -> DataFrame:
    """One row (n_docs, avg_doc_len); the mean is 0 for an empty corpus."""
    return doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len"))


def inverse_document_frequencies(postings: DataFrame, corpus_stats: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = max(0, ln((N - df + 0.5) / (df + 0.5)))."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    one = corpus_stats.select("n_docs")
    idf = F.greatest(F.lit(0.0), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return df.join(F.broadcast(one)).select("term", "df", idf.alias("idf"))  # one row, by construction


def build_index(docs: DataFrame, script: str = "arabic") -> Index:
    base = successful(docs).select("id", "url", F.col("content_text").alias("content"))
    tokens = base.select(F.col("id").alias("doc_id"), tokenize(F.col("content"), script).alias("tokens"))
    # Documents without a token count in the corpus, so lengths are written with the postings, as one row without a term.
    counted = tokens.select("doc_id", F.size("tokens").cast("long").alias("doc_len"), F.explode_outer("tokens").alias("term")).groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))
    stored = materialise(counted, "postings")
    postings = stored.where("term is not null").select("doc_id", "term", "tf", "doc_len")
    doc_stats = materialise(stored.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len")), "doc-stats")
    corpus = materialise(corpus_statistics(doc_stats), "corpus-stats")
    return Index(base, postings, doc_stats, materialise(inverse_document_frequencies(postings, corpus), "term-stats"), corpus)


def idf_band(idf):
    """Reading of an idf value."""
    return F.when(idf > 5, "very rare").when(idf > 3, "rare").when(idf > 1, "medium").when(idf > 0.5, "common").otherwise("very common")


def extreme_idfs(index: Index, n: int = 10) -> DataFrame:
    """The n rarest and the n most common terms."""
    high = index.term_stats.orderBy(F.desc("idf"), "term").limit(n).withColumn("side", F.lit("highest"))
    low = index.term_stats.orderBy("idf", "term").limit(n).withColumn("side", F.lit("lowest"))
    return high.unionByName(low)


def top_terms(index: Index, n: int = 20) -> DataFrame:
    """The n most frequent terms of each document."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    return index.postings.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("doc_id", "term", "tf", F.col("n").alias("rank"))
