"""Text functions, index, engines and evaluation against plain Python on small corpora."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qirtas.functions import text as tx
from qirtas.functions.vectors import cosine, l2_normalize, top_k_cosine
from qirtas.operators import diagnostics as dg
from qirtas.operators import evaluate as ev
from qirtas.operators import index as ix
from qirtas.operators import rerank as rr
from qirtas.operators import retrieval as rt
from qirtas.plans.engines import BM25_THEN_VECTOR, Corpus, SearchSession, create, registry

TEXTS = ["رخصة القيادة رخصة جديدة", "شهادة الميلاد", "تجديد رخصة السيارة، والشهادة", "", "خدمة الميناء والسفر 12", "السجل التجاري في المدينة"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i + 1, f"u{i + 1}", t, "success") for i, t in enumerate(TEXTS)] + [(9, "u9", None, "success"), (10, "u10", "رخصة", "failed")]
    return spark.createDataFrame(rows, "id bigint, url string, content_text string, crawl_status string")


@pytest.fixture(scope="module")
def corpus(spark, docs):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (5, [0.0, 0.0])], "doc_id bigint, embedding array<float>")
    return Corpus(ix.build_index(docs), vectors)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "رخصة قيادة", [1.0, 0.2]), (2, "xyz nonexistent", [0.0, 1.0]), (3, "", None), (4, "رخصة رخصة", [1.0, 1.0])], "query_id bigint, query string, embedding array<float>")


@pytest.mark.parametrize("text, normal", [("شهادة الميلاد", "شهاده ميلاد"), ("الرخصة القيادة", "رخصه قياده"), ("إصدار السجل", "اصدار سجل"), ("أنا ذاهب إلى المدرسة", "انا ذاهب ي مدرسه"), ("مَرْحَبـا، Hello 12", "مرحبا، 12"), (None, ""), ("  ", ""), ("ال", "ال")])
def test_normaliser(spark, text, normal):
    assert one(spark, tx.normalize(F.lit(text).cast("string"))) == normal


def test_other_scripts_and_stop_words(spark):
    assert one(spark, tx.normalize(F.lit("Été-2 ÜBER"), "any")) == "été 2 über"
    assert one(spark, tx.tokenize(F.lit("من رخصة في من"), "arabic", True)) == ["رخصه"]
    assert one(spark, tx.split_simple(F.lit(" A\tb C "))) == ["a", "b", "c"]


def test_small_text_functions(spark):
    long = "a" * 199 + " " + "b"
    assert one(spark, tx.snippet(F.lit(long), "keyword")) == "a" * 199 + "..." and one(spark, tx.snippet(F.lit(long), "vector")) == "a" * 199 + " ..." and one(spark, tx.snippet(F.lit(long), "bm25")) == "a" * 199 + " "
    assert one(spark, tx.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and one(spark, tx.occurrences(F.lit("aaaa"), F.lit(""))) == 0
    assert one(spark, tx.title(F.lit("x ##  The title \ny"))) == "The title" and one(spark, tx.title(F.lit("none"))) == "No title"
    assert one(spark, tx.think_part(F.lit("<think>a\nb</think> c"))) == "a\nb" and one(spark, tx.answer_part(F.lit("<think>a</think> c "))) == "c" and one(spark, tx.think_part(F.lit("<think>open"))) is None
    assert one(spark, tx.after_thinking(F.lit("<think>a</think>b</think> c "))) == "c" and one(spark, tx.after_thinking(F.lit(" c"))) == " c"
    assert one(spark, tx.dummy_parse(F.lit("<b>x</b>"), F.lit("u"))) == "Parsed from u: bx/b" and one(spark, tx.dummy_parse(F.lit(""), F.lit("u"))) is None
    assert one(spark, tx.cut_to_marker(F.lit("ab|c"), "|")) == "|c" and one(spark, tx.cut_to_marker(F.lit("abc"), "|")) == "abc"
    assert [one(spark, tx.elapsed(F.lit(x))) for x in (0.5, 20.0, 2500.0)] == ["500.00 μs", "20.00 ms", "2.50 s"]


def brute_bm25(asked, k1=1.5, b=0.75):
    import re

    fold = str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)

    def tokens(t):
        t = re.sub(f"[{tx.DIACRITICS}]", "", t.lower()).translate(fold)
        t = re.sub(r"[^؀-ۿݐ-ݿ\s\d]", " ", t)
        return re.sub(r"\bال(\w)", r"\1", t).split()

    corpus = [tokens(t) for t in TEXTS]
    n, mean = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = Counter(w for t in corpus for w in set(t))
    out = {}
    for qid, text in asked:
        for i, t in enumerate(corpus):
            tf = Counter(t)
            s = sum(max(0, math.log((n - df[w] + 0.5) / (df[w] + 0.5))) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean)) for w in tokens(text) if tf[w])
            if s > 0:
                out[qid, i + 1] = round(s, 6)
    return out


def test_bm25_by_hand(asked, corpus):
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in create("bm25").search(asked, corpus).collect()}
    assert found == pytest.approx(brute_bm25([(1, "رخصة قيادة"), (2, "xyz nonexistent"), (3, ""), (4, "رخصة رخصة")])) and found
    assert corpus.index.corpus_stats.first()["n_docs"] == len(TEXTS)


def test_keyword_counts_substrings(asked, corpus):
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in create("keyword").search(asked, corpus).collect()}
    assert found == {(1, 1): 3.0, (1, 3): 1.0, (4, 1): 4.0, (4, 3): 2.0}


@pytest.mark.parametrize("block, n_bytes", [(4096, 16 << 20), (2, 64)])
def test_keyword_search_in_a_grid(spark, monkeypatch, block, n_bytes):
    from qirtas.functions import substrings as su

    monkeypatch.setattr(su, "QUERY_BLOCK", block)
    monkeypatch.setattr(su, "TEXT_BLOCK", n_bytes)
    rng = random.Random(3)
    texts = [(rng.randrange(40), "".join(rng.choices("aAbé \u00a0\n\x1c\u2003", k=rng.randrange(60)))) for _ in range(60)] + [(None, "ab"), (50, None), (51, " "), (52, "\U0001f600a" * 9)]
    asked = [(q, "".join(rng.choices("abÉ \x1c\u2003", k=6))) for q in range(9)] + [(None, "A"), (20, ""), (21, None), (22, "\U0001f600"), (3, "a a ab")]
    index = ix.build_index(spark.createDataFrame([(d, "u", t, "success") for d, t in texts], "id bigint, url string, content_text string, crawl_status string"))
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    want = Counter()
    for q, query in asked:
        for d, text in texts:
            for word in (query or "").lower().replace("\u2003", " ").split(" "):
                want[q, d] += (text or "").lower().count(word) if word else 0
    want = {at: float(n) for at, n in want.items() if n}
    assert {tuple(r)[:2]: r["score"] for r in rt.keyword_scores(queries, index).collect()} == want
    best = {(r["query_id"], r["doc_id"], r["rank"]) for r in create("keyword").search(queries, Corpus(index), 3).collect()}
    order = sorted(want, key=lambda at: (at[0] is not None, at[0] or 0, -want[at], at[1] is not None, at[1] or 0))
    place = Counter()
    for q, _ in order:
        place[q] += 1
    assert len(best) == sum(min(3, n) for n in place.values())
    assert best == {(q, d, i) for x in place for i, (q, d) in enumerate((at for at in order if at[0] == x), 1) if i <= 3}
    assert rt.keyword_scores(queries.limit(0), index, 3).collect() == [] == rt.keyword_scores(queries, ix.build_index(spark.createDataFrame([], "id bigint, url string, content_text string, crawl_status string")), 3).collect()


def test_keyword_search_writes_no_text_for_each_of_its_substrings(spark, monkeypatch):
    """A text without white space has as many substrings of three characters as characters."""
    text = "".join(chr(0x4E00 + i) for i in range(2000))
    index = ix.build_index(spark.createDataFrame([(1, "u", text, "success")], "id bigint, url string, content_text string, crawl_status string"))
    written = []

    def kept(df, tag):
        from qirtas.session import materialise

        written.append(materialise(df, tag))
        return written[-1]

    monkeypatch.setattr(ix, "materialise", kept)
    monkeypatch.setattr(rt, "materialise", kept)
    queries = spark.createDataFrame([(1, text[7:9])], "query_id bigint, query string")
    assert [tuple(r)[:4] for r in create("keyword").search(queries, Corpus(index)).collect()] == [(1, 1, 1.0, 1)]
    strings = [[F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c) for c, kind in df.dtypes if kind == "string"] for df in written]
    assert sum(sum(df.agg(*s).first()) for df, s in zip(written, strings) if s) <= 3 * len(text)


def test_vectors(spark, asked, corpus):
    found = [(r["query_id"], r["doc_id"], r["rank"]) for r in create("vector-gemma").search(asked, corpus, 2).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 1), (1, 3, 2), (2, 2, 1), (2, 3, 2), (4, 3, 1), (4, 1, 2)]
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, cosine(a, a)) == pytest.approx(1) and one(spark, l2_normalize(a)) == pytest.approx([0.6, 0.8]) and one(spark, cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    with pytest.raises(RuntimeError):
        create("vector-gemma").search(asked, Corpus(corpus.index))
    assert top_k_cosine(asked.select("query_id", "embedding").limit(0), corpus.vectors, 3).count() == 0


def ranking(spark, rows):
    return rt.ranked(spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double"))


def test_fusion_formulas(spark):
    first, second = ranking(spark, [(1, 10, 5.0), (1, 11, 3.0), (2, 10, 1.0)]), ranking(spark, [(1, 11, 0.9), (1, 12, 0.1)])
    got = lambda df: {(r["query_id"], r["doc_id"]): r["score"] for r in df.collect()}
    assert got(rt.fuse_rrf(first, second)) == pytest.approx({(1, 11): 1 / 62 + 1 / 61, (1, 10): 1 / 61, (1, 12): 1 / 62, (2, 10): 1 / 61})
    # Query 2 has no second list: its zeros are all alike, so they count as ones.
    assert got(rt.fuse_weighted(first, second, w1=0.7, w2=0.3)) == pytest.approx({(1, 10): 0.7, (1, 11): 0.7 * 0.6 + 0.3, (1, 12): 0.3 * (0.1 / 0.9), (2, 10): 1.0})
    assert got(rt.fuse_density(first, second))[1, 10] == pytest.approx((0.6 / 50) ** 1.15 + 0.25 * 0.6 + 0.1 + 0.1, abs=1e-8)
    with pytest.raises(ValueError):
        rt.fuse_weighted(first, second, w1=0.7, w2=0.7)


def test_fusion_does_not_depend_on_order(spark):
    rng = random.Random(1)
    rows = [(q, d, float(rng.randrange(5))) for q in range(5) for d in range(30)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        first = ranking(spark, rows[: len(rows) // 2 * 2]).repartition(seed + 1)
        got = [tuple(r)[:4] for r in rt.fuse_ensemble(first, first.where("doc_id % 3 > 0")).orderBy("query_id", "rank").collect()]
        want = want or got
        assert got == want


def test_rerankers(spark, asked, corpus):
    first = ranking(spark, [(1, 1, 3.0), (1, 3, 2.0), (1, 4, 1.0), (2, 4, 0.7)])
    rows = lambda df: [(r["query_id"], r["doc_id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(rr.rerank_cosine(first, asked, corpus.vectors)) == [(1, 1), (1, 3), (2, 4)]
    assert rows(rr.rerank_backfill(first, asked, corpus.texts)) == [(1, 1), (1, 3), (1, 4), (2, 4)]
    assert rows(rr.rerank_scorer(first, asked, corpus.texts, rr.failing_scorer)) == [(1, 1), (1, 3), (1, 4), (2, 4)]
    blended = {(r["query_id"], r["doc_id"]): r["score"] for r in rr.rerank_blend(first, asked, corpus.texts).collect()}
    assert blended == pytest.approx({(1, 1): 1.0, (1, 3): 0.15, (1, 4): 0.0, (2, 4): 0.7})
    cascade = rr.rerank_cascade(first, lambda p: rr.with_cosine(p, asked, corpus.vectors).withColumnRenamed("cosine", "model_score"), stage2=2)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in cascade.collect()} == pytest.approx({(1, 1): 1.0, (1, 3): 0.0, (1, 4): 1.0, (2, 4): 0.7})


def test_registry_has_all_engines(spark, docs, asked, corpus):
    assert len(registry()) == 21
    with pytest.raises(ValueError, match="known: keyword"):
        create("nothing")
    for name in registry():
        found = create(name).search(asked, corpus, 3)
        assert "CartesianProduct" not in plan(found)
        assert found.where("rank > 3").count() == 0 and found.columns[:4] == ["query_id", "doc_id", "score", "rank"]
    assert BM25_THEN_VECTOR.search(asked, corpus, 5).count() > 0


def test_session(spark, docs, asked):
    session = SearchSession(docs)
    with pytest.raises(RuntimeError):
        session.search(asked)
    assert session.initialize() == len(TEXTS)
    got = session.timed(asked, "bm25", 2, cold=True)
    assert got.rows == got.results.count() > 0 and got.total_ms > got.search_ms > 0
    assert {"url", "snippet"} <= set(got.results.columns)


@pytest.mark.parametrize("results, truth, mrr", [([1, 2, 3, 4, 5], [1], 1.0), ([99, 1, 2, 3, 4], [1], 0.5), ([99, 88, 77, 66, 1], [1], 0.2), ([99, 88, 77, 66, 55], [1], 0.0), ([9, 8, 7, 6, 5, 18332], [18332, 18341], 1 / 6)])
def test_reciprocal_ranks(spark, results, truth, mrr):
    runs, judged = _runs(spark, results, truth)
    assert ev.metrics(runs, judged).first()["mrr"] == pytest.approx(mrr, abs=1e-6)


@pytest.mark.parametrize(
    "results, truth, p5, p10, low, high",
    [(list(range(1, 11)), [1, 2, 3, 4, 5], 1.0, 0.5, 1, 1), ([1, 99, 2, 88, 3, 77, 66, 55, 44, 33], [1, 2, 3], 0.6, 0.3, 0.8, 1), ([1, 3, 2, 99, 98, 97, 96, 95, 94, 93], [1, 2, 3], 0.6, 0.3, 0.9, 1), ([99, 88, 77, 66, 55, 44, 33, 1, 2, 3], [1, 2, 3], 0, 0.3, 0.1, 0.5), ([99, 88], [1], 0, 0, 0, 0)],
)
def test_precision_and_ndcg(spark, results, truth, p5, p10, low, high):
    row = ev.precision_ndcg(*_runs(spark, results, truth)).first()
    assert (row["p_5"], row["p_10"]) == (p5, p10) and low <= row["ndcg_10"] <= high


def _runs(spark, results, truth):
    return spark.createDataFrame([(1, d, r + 1) for r, d in enumerate(results)], "query_id bigint, doc_id bigint, rank int"), spark.createDataFrame([(1, d, False) for d in truth], "query_id bigint, doc_id bigint, highly_relevant boolean")


def test_diagnostics(spark, docs, asked, corpus):
    judged = spark.createDataFrame([(1, 1), (1, 3)], "query_id bigint, doc_id bigint")
    rows = {(r["doc_id"], r["term"]): r["tf"] for r in dg.truth_terms(asked.where("query_id = 1"), judged, corpus.index).collect()}
    assert rows == {(1, "رخصه"): 2, (1, "قياده"): 1, (3, "رخصه"): 1, (3, "قياده"): 0}
    assert dg.phrase_search(corpus.index, spark.createDataFrame([("رخصة",)], "phrase string")).count() == 2


# ---- plans
def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from qirtas.session import table
    from qirtas.sources.tables import scan_keyword

    text = plan(scan_keyword(table(spark, "/root/testdata/sf0.001", "crawl_documents")))
    pushed = text.split("PushedFilters")[-1].split("]")[0]
    assert "EqualTo(crawl_status,success)" in pushed and "IsNotNull(content_text)" in pushed and "content_raw" not in text.split("ReadSchema")[-1]


def test_pools_are_limited_before_the_shuffle(spark, asked, corpus):
    text = plan(create("bm25").search(asked, corpus, 10))
    assert text.count("WindowGroupLimit") >= 2 and "BroadcastHashJoin" in text


def test_engines_are_evaluated_one_by_one(spark, docs, corpus, asked):
    """The plan of an evaluation reads the engines' results and has no engine in it."""
    session = SearchSession(docs)
    session.corpus = corpus
    judged = spark.createDataFrame([(1, 1), (4, 3)], "query_id bigint, doc_id bigint")
    out = session.evaluate(asked, judged, ["keyword", "bm25", "hybrid"])
    text = plan(out).split("== Physical Plan ==")[-1]
    assert text.count("run-") == 3 and not any(x in text for x in ("CoGroups", "postings", "Window"))
    assert {(r["engine"], r["query_id"]): r["mrr"] for r in out.where("engine = 'keyword'").collect()} == {("keyword", 1): 1.0, ("keyword", 2): 0.0, ("keyword", 3): 0.0, ("keyword", 4): 0.5}


def test_a_lone_candidate_is_returned_as_it_is(spark, asked, corpus):
    first = ranking(spark, [(1, 1, 0.3)])
    for out in (rr.rerank_cosine(first, asked, corpus.vectors), rr.rerank_cosine_blend(first, asked, corpus.vectors), rr.rerank_backfill(first, asked, corpus.texts), rr.rerank_blend(first, asked, corpus.texts), rr.rerank_scorer(first, asked, corpus.texts)):
        assert [(r["doc_id"], r["score"], r["rank"]) for r in out.collect()] == [(1, 0.3, 1)]


def test_encoders(spark):
    from dataclasses import replace

    from qirtas.functions import encoding as en

    config = replace(en.MODELS["gemma"], dimension=64, batch_size=2)
    texts = spark.createDataFrame([(1, "open permit"), (2, "permit open"), (3, None), (4, ""), (5, "harbour")], "id bigint, text string")
    got = {r["id"]: r["embedding"] for r in en.encode(texts, "text", config).collect()}
    assert got[1] == got[2] and got[3] is None and len(got[5]) == 64 and not any(got[4]) and sum(x * x for x in got[1]) == pytest.approx(1)
    with pytest.raises(ValueError):
        replace(config, dimension=0)
    with pytest.raises(ValueError):
        replace(config, batch_size=0)
    int8 = en.MODELS["gemma-int8"]

    def missing(config):
        raise OSError("no such model")

    assert en.load(int8, missing, en.HashingEncoder).config.local_path is None and en.load(int8, en.HashingEncoder, missing).config.label == "vector-basic-gemma-300M-int8" and int8.local_path


def test_free_queries_search_vectors(spark, docs):
    from qirtas.plans.engines import report

    session = SearchSession(docs)
    session.encode_documents()
    session.initialize()
    asked = session.encode_queries(spark.createDataFrame([(1, TEXTS[0])], "query_id bigint, query string"))
    answer = session.timed(asked, "vector-gemma", 2)
    assert answer.results.where("rank = 1").first()["doc_id"] == 1
    lines = report(answer, verbose=True).split("\n")
    assert "model=google/embeddinggemma-300M" in lines[2] and lines[-1].startswith("2 results, search ")
    assert set(session.benchmark(asked, spark.createDataFrame([(1, 1)], "query_id bigint, doc_id bigint"), ["bm25"], timed=True).columns) >= {"mrr", "time_ms"}


@pytest.mark.parametrize("block", [4096, 3])
def test_vector_search_in_a_grid(spark, monkeypatch, block):
    import numpy as np

    from qirtas.functions import vectors as ve

    monkeypatch.setattr(ve, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((10, 8)), rng.standard_normal((50, 8))
    make = lambda m, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{name} bigint, embedding array<float>")
    scores = np.round((a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, 5)
    want = {(q, d) for q in range(10) for d in np.argsort(-scores[q], kind="stable")[:4].tolist()}
    assert {(r["query_id"], r["doc_id"]) for r in ve.top_k_cosine(make(a, "query_id"), make(b, "doc_id"), 4, 5).collect()} == want
    assert ve.top_k_cosine(make(a, "query_id").limit(0), make(b, "doc_id"), 4).collect() == [] == ve.top_k_cosine(make(a, "query_id"), make(b, "doc_id").limit(0), 4).collect()
