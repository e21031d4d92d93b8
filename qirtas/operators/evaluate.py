"""Evaluation of rankings against relevant documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTOFFS = (1, 3, 5, 10)


def clean_runs(results: DataFrame) -> DataFrame:
    """Logged result lists: engine names in lower case, and each (run_id, rank) once, as first logged."""
    first = Window.partitionBy("run_id", "rank").orderBy("logged_at", "doc_id")
    named = results.withColumn("engine", F.lower(F.trim("engine")))
    return named.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def judged(results: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Results with `relevant`."""
    marks = qrels.select("query_id", "doc_id", F.lit(True).alias("hit")).distinct()
    return results.join(marks, ["query_id", "doc_id"], "left").select(*keys, "doc_id", "rank", F.coalesce("hit", F.lit(False)).alias("relevant"))


def success_at(k: int):
    return F.max(F.when((F.col("rank") <= k) & F.col("relevant"), 1.0).otherwise(0.0))


def first_hit():
    """Rank of the first relevant result; null without one."""
    return F.min(F.when(F.col("relevant"), F.col("rank")))


def reciprocal_rank():
    return F.coalesce(1.0 / first_hit(), F.lit(0.0))


def metrics(results: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hit@1/3/5/10, MRR and the first hit's rank for each query, in one aggregation."""
    rows = judged(results, qrels, keys)
    return rows.groupBy(*keys).agg(*(success_at(k).alias(f"hit_{k}") for k in CUTOFFS), F.round(reciprocal_rank(), 6).alias("mrr"), first_hit().alias("first_hit"))


def precision_ndcg(results: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("query_id",), cutoffs: tuple[int, ...] = (5, 10), ndcg: int = 10) -> DataFrame:
    """P@k and NDCG@k with binary gain; the ideal ranking has all relevant documents of the query first."""
    rows = judged(results, qrels, keys)
    gain = F.when(F.col("relevant") & (F.col("rank") <= ndcg), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    found = rows.groupBy(*keys).agg(*((F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0)) / k).alias(f"p_{k}") for k in cutoffs), F.sum(gain).alias("dcg"))
    sizes = qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(ndcg)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    joined = found.join(sizes, "query_id", "left")
    return joined.select(*keys, *(f"p_{k}" for k in cutoffs), F.round(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias(f"ndcg_{ndcg}"))


def benchmark(per_query: DataFrame) -> DataFrame:
    """Averages of metrics() for each engine, and of `time_ms` where it is there."""
    names = [f"hit_{k}" for k in CUTOFFS] + ["mrr"] + (["time_ms"] if "time_ms" in per_query.columns else [])
    return per_query.groupBy("engine").agg(F.count("*").alias("queries"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names))


def numbered_runs(results: DataFrame) -> DataFrame:
    """Results with `run_no`: the runs of each engine and query, counted from 1 in the order of their ids."""
    # Only the runs themselves are numbered, not their rows: a query that holds much of the log has few rows here.
    runs = results.select("engine", "query_id", "run_id").distinct().withColumn("run_no", F.row_number().over(Window.partitionBy("engine", "query_id").orderBy("run_id")))
    return results.join(runs, ["engine", "query_id", "run_id"])


def side_by_side(results: DataFrame, engines: list[str], top: int = 5, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The top results of each engine, aligned by rank: one column of doc ids an engine."""
    return results.where(F.col("rank") <= top).groupBy(*keys, "rank").pivot("engine", engines).agg(F.first("doc_id"))


def mrr_matrix(per_query: DataFrame, engines: list[str]) -> DataFrame:
    """MRR of each query by engine, one column an engine; null where an engine has no run."""
    return per_query.groupBy("query_id").pivot("engine", engines).agg(F.round(F.avg("mrr"), 6))
