"""The driver's entry points, and queries beside their SQL on the smallest data."""

import math
import os
from datetime import datetime

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SAMPLE = "ground_truth tokens snippet_keyword term_idf bm25_topk keyword_topk cosine_topk hybrid_rrf hybrid_cascade hybrid_cosine_combined rerank_indexed_backfill metrics_per_query precision_ndcg engine_mrr_pivot refresh_age upsert_failed candidate_queries term_coverage phrase_search crawl_run crawl_totals parsed_answers negative_samples engine_metadata live_benchmark chat_to_qfs qfs_template".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    theirs = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, ours)) == sorted(repr(tuple(map(plain, r))) for r in theirs)
