"""Comparisons of all logged engines: every run and every engine is in the result."""

import os

import pytest

import __spark_entry__ as entry
from qirtas.queries import runs_of

from .test_entry import DATA, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_logged_result_is_compared(spark):
    rows = entry.queries()["engine_position_pivot_all"](spark, DATA).collect()
    found = sorted((r["query_id"], engine, r["rank"], doc) for r in rows for engine, doc in r.asDict().items() if engine not in ("query_id", "run_no", "rank") and doc is not None)
    logged = sorted((r["query_id"], r["engine"], r["rank"], r["doc_id"]) for r in runs_of(spark, DATA).where("rank <= 5").collect())
    assert found == logged


def test_every_logged_engine_has_a_mean(spark):
    rows = entry.queries()["engine_mrr_pivot_all"](spark, DATA).collect()
    found = {(r["query_id"], engine) for r in rows for engine, mrr in r.asDict().items() if engine != "query_id" and mrr is not None}
    assert found == {(r["query_id"], r["engine"]) for r in runs_of(spark, DATA).collect()}


@pytest.mark.parametrize("name", ["engine_position_pivot_all", "engine_mrr_pivot_all"])
def test_pivot_matches_sql(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    theirs = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, ours)) == sorted(repr(tuple(map(plain, r))) for r in theirs)
