"""Queries over the search operators, by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.text import think_part
from .functions.vectors import l2_normalize, top_k_cosine
from .operators import diagnostics as dg
from .operators import evaluate as ev
from .operators import index as ix
from .operators import ingest as ig
from .operators import rerank as rr
from .operators import retrieval as rt
from .operators import training_data as td
from .plans.crawl import ListBot, crawl
from .plans.engines import BM25_THEN_VECTOR, Corpus, SearchSession, create, registry
from .session import table
from .sources import tables as src

AS_OF = datetime(2025, 6, 1, tzinfo=timezone.utc)
K = 10
_kept: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf: str) -> Corpus:
    """The index tables of a data folder, built once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _kept:
        index = ix.build_index(table(spark, sf, "crawl_documents"))
        vectors = vectors_of(spark, sf).join(index.documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        _kept[key] = Corpus(index, vectors)
    return _kept[key]


def docs_of(spark, sf):
    return table(spark, sf, "crawl_documents")


def vectors_of(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def truth_of(spark, sf):
    return src.ground_truth(table(spark, sf, "judged_queries"))


def queries_of(spark, sf):
    """The judged queries; the stored vector of the same number stands in for an encoded query."""
    return truth_of(spark, sf).select(F.col("id").alias("query_id"), "query").join(vectors_of(spark, sf).withColumnRenamed("doc_id", "query_id"), "query_id", "left")


def runs_of(spark, sf):
    return ev.clean_runs(table(spark, sf, "search_results"))


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def q(name: str, f, sql: str | None = None) -> None:
    _Q[name] = f
    if sql:
        _SQL[name] = sql


# ---- SQL building blocks ------------------------------------------------------------------------------------------------
def n_sql(x: str, script: str = "arabic") -> str:
    """The normaliser in SQL."""
    kept = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\p{Nd}" if script == "arabic" else r"\p{L}\p{M}\p{N}"
    space = r"\t\n\x0B\f\r\x{85}\p{Z}"
    marks = "".join(f"\\x{{{ord(c):04x}}}" for c in tx.DIACRITICS)
    x = f"regexp_replace(lower(coalesce({x}, '')), '[{marks}]', '', 'g')"
    x = f"translate({x}, '{tx.FOLD_FROM}', '{tx.FOLD_TO}')"
    x = f"regexp_replace({x}, '[^{kept}{space}]', ' ', 'g')"
    x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])ال([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return f"trim(regexp_replace({x}, '[{space}]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({n_sql(x)}, ' '), lambda t: t <> '')"


STRIP = r"regexp_replace(regexp_replace({x}, '^[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+', ''), '[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+$', '')"


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


DOCS = "docs AS (SELECT id, url, content_text AS content FROM crawl_documents WHERE crawl_status = 'success' AND content_text IS NOT NULL)"
TRUTH = """truth AS (SELECT id, query, description, list_sort(list_distinct(coalesce(relevant_docs, CAST([] AS BIGINT[])))) AS relevant_docs, list_sort(list_distinct(coalesce(highly_relevant, CAST([] AS BIGINT[])))) AS highly_relevant
    FROM judged_queries WHERE query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY id DESC) = 1)"""
QRELS = "qrels AS (SELECT DISTINCT id AS query_id, unnest(relevant_docs) AS doc_id FROM truth)"
INDEX = f"""{DOCS},
    toks AS MATERIALIZED (SELECT id AS doc_id, {tokens_sql("content")} AS tokens FROM docs),
    doc_stats AS (SELECT doc_id, len(tokens) AS doc_len FROM toks),
    corpus AS (SELECT count(*) AS n_docs, coalesce(avg(doc_len), 0) AS avg_doc_len FROM doc_stats),
    post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY doc_id, term),
    terms AS (SELECT term, df, greatest(0.0, ln((n_docs - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus)"""
BM = f"""{INDEX}, {TRUTH},
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT id AS query_id, unnest({tokens_sql("query")}) AS term FROM truth) GROUP BY query_id, term),
    bm AS (SELECT query_id, post.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_doc_len))), 6) AS score
        FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN doc_stats ON doc_stats.doc_id = post.doc_id, corpus WHERE idf > 0 GROUP BY query_id, post.doc_id),
    bmr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0)"""
VEC = """vecs AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT id FROM docs)),
    qv AS (SELECT id AS query_id, query, CAST(embedding AS DOUBLE[]) AS v FROM truth JOIN embeddings ON vec_id = id),
    ve AS (SELECT query_id, doc_id, round(list_cosine_similarity(qv.v, vecs.v), 6) AS score FROM qv, vecs),
    ver AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ve)"""


def mm_sql(x: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"CASE WHEN max({x}) {w} - min({x}) {w} < 1e-9 THEN 1.0 ELSE ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END"


def fused_sql(pool: int, score: str, name: str = "fused") -> str:
    return f"""{BM}, {VEC},
    cand AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS r1, b.rank AS r2, coalesce(a.score, 0.0) AS s1, coalesce(b.score, 0.0) AS s2
        FROM (SELECT * FROM bmr WHERE rank <= {pool}) a FULL JOIN (SELECT * FROM ver WHERE rank <= {pool}) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    normed AS (SELECT *, {mm_sql("s1")} AS n1, {mm_sql("s2")} AS n2 FROM cand),
    {name}s AS (SELECT query_id, doc_id, r1, r2, round({score}, 9) AS score FROM normed),
    {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}s)"""


def top_sql(source: str) -> str:
    return f"SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM {source} WHERE rank <= {K}"


RRF = "(coalesce(1.0 / ({k} + r1 - {b}), 0) + coalesce(1.0 / ({k} + r2 - {b}), 0))"


# ---- scans, sources ------------------------------------------------------------------------------------------------------
q("success_docs", lambda s, sf: src.scan_keyword(docs_of(s, sf)), f"WITH {DOCS} SELECT id, url, content AS content_text FROM docs")
q("full_text_scan", lambda s, sf: src.scan_full_text(docs_of(s, sf)), "SELECT id, coalesce(content_text, '') AS content FROM crawl_documents WHERE crawl_status = 'success'")
q("doc_count", lambda s, sf: src.successful(docs_of(s, sf)).agg(F.count("*").alias("n")), f"WITH {DOCS} SELECT count(*) AS n FROM docs")
q("point_lookup", lambda s, sf: src.by_id(docs_of(s, sf), 9).select("id", "url", "crawl_status", "http_status"), "SELECT id, url, crawl_status, http_status FROM crawl_documents WHERE id = 9")
q("ground_truth", lambda s, sf: truth_of(s, sf).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("relevant_docs", "highly_relevant")}),
  f"WITH {TRUTH} SELECT id, query, coalesce(description, '') AS description, array_to_string(relevant_docs, ',') AS relevant_docs, array_to_string(highly_relevant, ',') AS highly_relevant FROM truth")
q("qrels", lambda s, sf: src.qrels(truth_of(s, sf)), f"WITH {TRUTH} SELECT DISTINCT query_id, doc_id, list_contains(h, doc_id) AS highly_relevant FROM (SELECT id AS query_id, unnest(relevant_docs) AS doc_id, highly_relevant AS h FROM truth)")
q("sitemap_urls", lambda s, sf: src.sitemap_urls(table(s, sf, "sitemaps")),
  r"SELECT sitemap_id, url FROM (SELECT sitemap_id, unnest(regexp_extract_all(xml, '(?s)<url>\s*<loc>\s*(.*?)\s*</loc>', 1)) AS url FROM sitemaps WHERE regexp_matches(xml, '</(urlset|sitemapindex)>\s*$')) WHERE contains(url, '/ar/services/')")
q("service_urls", lambda s, sf: docs_of(s, sf).where(F.col("url").contains("/ar/services/")).select("id", "url"), "SELECT id, url FROM crawl_documents WHERE contains(url, '/ar/services/')")
q("shuffled_texts", lambda s, sf: src.shuffled(table(s, sf, "documents")).select("doc_id", F.length("text").alias("n")), "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE length(text) >= 300")
q("length_filters", lambda s, sf: docs_of(s, sf).agg(*(F.count_if(F.length("content_text") >= n).alias(f"at_least_{n}") for n in (50, 100, 300))),
  "SELECT " + ", ".join(f"count(*) FILTER (length(content_text) >= {n}) AS at_least_{n}" for n in (50, 100, 300)) + " FROM crawl_documents")

# ---- projections and text functions --------------------------------------------------------------------------------------
for _style, _expr in (("keyword", strip_sql("substr(content, 1, 200)") + " || CASE WHEN length(content) > 200 THEN '...' ELSE '' END"), ("bm25", "substr(content, 1, 200)"), ("vector", "CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END")):
    q(f"snippet_{_style}", partial(lambda s, sf, style: src.scan_keyword(docs_of(s, sf)).select("id", tx.snippet(F.col("content_text"), style).alias("snippet")), style=_style), f"WITH {DOCS} SELECT id, {_expr} AS snippet FROM docs")
q("normalize_text", lambda s, sf: src.scan_keyword(docs_of(s, sf)).select("id", tx.normalize(F.col("content_text")).alias("normalized")), f"WITH {DOCS} SELECT id, {n_sql('content')} AS normalized FROM docs")
q("normalize_any_script", lambda s, sf: table(s, sf, "documents").select("doc_id", tx.normalize(F.col("text"), "any").alias("normalized")), f"SELECT doc_id, {n_sql('text', 'any')} AS normalized FROM documents")
q("tokens", lambda s, sf: truth_of(s, sf).select("id", F.posexplode(tx.tokenize(F.col("query"))).alias("at", "token")),
  f"WITH {TRUTH} SELECT id, CAST(i - 1 AS INTEGER) AS at, ts[i] AS token FROM (SELECT id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT id, {tokens_sql('query')} AS ts FROM truth))")
q("tokens_no_stop_words", lambda s, sf: src.scan_keyword(docs_of(s, sf)).select("id", F.size(tx.tokenize(F.col("content_text"), "arabic", True)).alias("n")),
  f"WITH {DOCS} SELECT id, CAST(len(list_filter({tokens_sql('content')}, lambda t: t NOT IN ({', '.join(repr(w) for w in tx.STOP_WORDS)}))) AS INTEGER) AS n FROM docs")
q("simple_split", lambda s, sf: truth_of(s, sf).select("id", F.array_join(tx.split_simple(F.col("query")), "|").alias("words")),
  rf"WITH {TRUTH} SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(query), '[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+'), lambda t: t <> ''), '|') AS words FROM truth")
_TITLE_SQL = "CASE WHEN {t} = '' THEN 'No title' ELSE {t} END".replace("{t}", strip_sql(r"regexp_extract(content, '#[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+(.+?)(?:\n|$)', 1)".replace("{{", "{").replace("}}", "}")))
q("page_titles", lambda s, sf: src.scan_keyword(docs_of(s, sf)).select("id", tx.title(F.col("content_text")).alias("title")), f"WITH {DOCS} SELECT id, {_TITLE_SQL} AS title FROM docs")
q("marker_cut", lambda s, sf: src.scan_keyword(docs_of(s, sf)).select("id", tx.cut_to_marker(F.col("content_text"), "›").alias("cut")), f"WITH {DOCS} SELECT id, CASE WHEN strpos(content, '›') > 0 THEN substr(content, strpos(content, '›')) ELSE content END AS cut FROM docs")
q("dummy_parse", lambda s, sf: docs_of(s, sf).select("id", tx.dummy_parse(F.col("content_raw"), F.col("url")).alias("parsed")),
  "SELECT id, CASE WHEN length(content_raw) > 0 THEN 'Parsed from ' || url || ': ' || substr(translate(content_raw, '<>', ''), 1, 100) END AS parsed FROM crawl_documents")
q("prepared_texts", lambda s, sf: src.scan_full_text(docs_of(s, sf)).select("id", F.substring(tx.strip(F.col("content")), 1, 800).alias("text"), (F.length(tx.strip(F.col("content"))) > 800).alias("truncated")),
  f"SELECT id, substr(t, 1, 800) AS text, length(t) > 800 AS truncated FROM (SELECT id, {strip_sql(chr(99) + 'oalesce(content_text, ' + chr(39) * 2 + ')')} AS t FROM crawl_documents WHERE crawl_status = 'success')")

# ---- index ---------------------------------------------------------------------------------------------------------------
q("term_freq", lambda s, sf: corpus(s, sf).index.postings.select("doc_id", "term", "tf"), f"WITH {INDEX} SELECT doc_id, term, tf FROM post")
q("doc_stats", lambda s, sf: corpus(s, sf).index.doc_stats, f"WITH {INDEX} SELECT doc_id, CAST(doc_len AS BIGINT) AS doc_len FROM doc_stats")
q("corpus_stats", lambda s, sf: corpus(s, sf).index.corpus_stats.select("n_docs", F.round("avg_doc_len", 6).alias("avg_doc_len")), f"WITH {INDEX} SELECT n_docs, round(avg_doc_len, 6) AS avg_doc_len FROM corpus")
q("term_idf", lambda s, sf: corpus(s, sf).index.term_stats.select("term", "df", F.round("idf", 6).alias("idf")), f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms")
q("idf_bands", lambda s, sf: corpus(s, sf).index.term_stats.groupBy(ix.idf_band(F.col("idf")).alias("band")).agg(F.count("*").alias("terms")),
  f"WITH {INDEX} SELECT CASE WHEN idf > 5 THEN 'very rare' WHEN idf > 3 THEN 'rare' WHEN idf > 1 THEN 'medium' WHEN idf > 0.5 THEN 'common' ELSE 'very common' END AS band, count(*) AS terms FROM terms GROUP BY 1")
q("idf_extremes", lambda s, sf: ix.extreme_idfs(corpus(s, sf).index).select("term", "df", F.round("idf", 6).alias("idf"), "side"),
  f"WITH {INDEX} (SELECT term, df, round(idf, 6) AS idf, 'highest' AS side FROM terms ORDER BY terms.idf DESC, term LIMIT 10) UNION ALL (SELECT term, df, round(idf, 6) AS idf, 'lowest' AS side FROM terms ORDER BY terms.idf, term LIMIT 10)")
q("top_terms_per_doc", lambda s, sf: ix.top_terms(corpus(s, sf).index), f"WITH {INDEX} SELECT doc_id, term, tf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM post) WHERE rank <= 20")


# ---- retrieval -----------------------------------------------------------------------------------------------------------
def searched(spark, sf, name):
    return create(name).search(queries_of(spark, sf), corpus(spark, sf), K).select("query_id", "doc_id", "score", "rank")


_KEYWORD = f"""qw AS (SELECT query_id, word, count(*) AS times FROM (SELECT id AS query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]+'), lambda t: t <> '')) AS word FROM truth) GROUP BY query_id, word),
    kw AS (SELECT query_id, id AS doc_id, CAST(sum(times * ((length(lower(content)) - length(replace(lower(content), word, ''))) // length(word))) AS DOUBLE) AS score FROM qw, docs WHERE contains(lower(content), word) GROUP BY query_id, id),
    kwr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw)"""
q("keyword_topk", lambda s, sf: searched(s, sf, "keyword"), f"WITH {DOCS}, {TRUTH}, {_KEYWORD} {top_sql('kwr')}")
q("bm25_topk", lambda s, sf: searched(s, sf, "bm25"), f"WITH {BM} {top_sql('bmr')}")
for _name in ("vector-gemma", "vector-gemma-faiss", "vector-gemma-int8", "vector-gemma-int8-faiss"):
    q("engine_" + _name.replace("-", "_"), partial(lambda s, sf, n: searched(s, sf, n), n=_name), f"WITH {DOCS}, {TRUTH}, {VEC} {top_sql('ver')}")
q("cosine_topk", lambda s, sf: top_k_cosine(vectors_of(s, sf).where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), vectors_of(s, sf), 50),
  "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 50")
q("l2_normalize", lambda s, sf: vectors_of(s, sf).select("doc_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("at", "x")).select("doc_id", "at", F.round("x", 6).alias("x")),
  "SELECT vec_id AS doc_id, CAST(i - 1 AS INTEGER) AS at, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")

q("hybrid_rrf", lambda s, sf: searched(s, sf, "hybrid"), f"WITH {fused_sql(50, RRF.format(k=60, b=0))} {top_sql('fused')}")
for _name, _w1, _w2 in (("hybrid-weighted", 0.5, 0.5), ("hybrid-weighted-bm25", 0.7, 0.3), ("hybrid-weighted-vector", 0.3, 0.7)):
    q(_name.replace("-", "_"), partial(lambda s, sf, n: searched(s, sf, n), n=_name), f"WITH {fused_sql(50, f'{_w1} * n1 + {_w2} * n2')} {top_sql('fused')}")
_W64 = "(0.6 * n1 + 0.4 * n2)"
q("hybrid_rrf_fusion", lambda s, sf: searched(s, sf, "hybrid-rrf-fusion"), f"WITH {fused_sql(75, RRF.format(k=60, b=1) + ' + 0.35 * ' + _W64)} {top_sql('fused')}")
q("hybrid_ensemble_boost", lambda s, sf: searched(s, sf, "hybrid-ensemble-boost"), f"WITH {fused_sql(80, '0.5 * ' + RRF.format(k=50, b=1) + ' + 0.35 * ' + _W64 + ' + 0.15 * greatest(n1, n2) + CASE WHEN r1 <= 2 THEN 0.12 / r1 ELSE 0 END')} {top_sql('fused')}")
_DENS = "greatest(coalesce(least(1.0, exp(-(r1 - 1) / 6.0)), 0.0), coalesce(least(1.0, exp(-(r2 - 1) / 6.0)), 0.0))"
q("hybrid_rrf_density", lambda s, sf: searched(s, sf, "hybrid-rrf-density"), f"WITH {fused_sql(95, 'pow(0.6 * ' + RRF.format(k=50, b=1) + ', 1.15) + 0.25 * ' + _W64 + ' + 0.1 * ' + _DENS + ' + CASE WHEN r1 <= 3 THEN 0.1 / r1 ELSE 0 END')} {top_sql('fused')}")
_CASCADE = fused_sql(110, "0.4 * " + RRF.format(k=55, b=1) + " + 0.25 * " + _W64 + " + CASE WHEN r1 <= 1 THEN 0.12 / r1 ELSE 0 END")
q("hybrid_cascade", lambda s, sf: searched(s, sf, "hybrid-cascade-rerank"), f"""WITH {_CASCADE},
    texts AS (SELECT f.query_id, f.doc_id, f.score, substr(coalesce({strip_sql("content")}, ''), 1, 900) AS text, query FROM fused f LEFT JOIN docs ON docs.id = f.doc_id JOIN truth ON truth.id = f.query_id WHERE f.rank <= 45),
    cuts AS (SELECT *, list_distinct({tokens_sql("query")}) AS qs, {tokens_sql("text")} AS ds FROM texts WHERE text <> ''),
    second AS (SELECT query_id, doc_id, score, CASE WHEN len(qs) = 0 THEN 0.0 ELSE round(len(list_intersect(qs, list_distinct(ds))) / len(qs), 6) END AS model FROM cuts),
    blended AS (SELECT query_id, doc_id, 0.45 * {mm_sql("score")} + 0.55 * {mm_sql("model")} AS final FROM second),
    alls AS (SELECT query_id, doc_id, round(coalesce(final, fused.score), 9) AS score FROM fused LEFT JOIN blended USING (query_id, doc_id)),
    allr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM alls) {top_sql("allr")}""")

_STAGE1 = fused_sql(50, "0.5 * n1 + 0.5 * n2")


def cosine_sql(source: str, pool: int, score: str, start: str) -> str:
    return f"""WITH {start},
    pooled AS (SELECT query_id, doc_id, rank AS stage1_rank, score AS stage1_score, count(*) OVER (PARTITION BY query_id) = 1 AS lone FROM {source} WHERE rank <= {pool}),
    cosines AS (SELECT pooled.*, round(list_cosine_similarity(qv.v, vecs.v), 6) AS cosine FROM pooled JOIN vecs USING (doc_id) JOIN qv USING (query_id) WHERE NOT lone),
    both_ AS (SELECT query_id, doc_id, {score} AS score FROM cosines UNION ALL SELECT query_id, doc_id, stage1_score FROM pooled WHERE query_id NOT IN (SELECT query_id FROM cosines)),
    outr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM both_) {top_sql("outr")}"""


for _name in ("hybrid-cosine-rerank", "hybrid-rerank-gemma"):
    q(_name.replace("-", "_"), partial(lambda s, sf, n: searched(s, sf, n), n=_name), cosine_sql("fused", 10, "cosine", _STAGE1))
q("hybrid_rerank", lambda s, sf: BM25_THEN_VECTOR.search(queries_of(s, sf), corpus(s, sf), K).select("query_id", "doc_id", "score", "rank"), cosine_sql("bmr", 50, "cosine", f"{BM}, {VEC}"))
for _name, _w1, _w2 in (("hybrid-cosine-combined", 0.5, 0.5), ("hybrid-cosine-combined-0.7", 0.7, 0.3)):
    q(_name.replace("-", "_").replace(".", ""), partial(lambda s, sf, n: searched(s, sf, n), n=_name), cosine_sql("fused", 10, f"round({_w1} * {mm_sql('stage1_score')} + {_w2} * {mm_sql('cosine')}, 9)", _STAGE1))


def scored_sql(pool: int, limit: int, stripped: bool = True) -> str:
    content = strip_sql("content") if stripped else "content"
    return f"""WITH {_STAGE1},
    pooled AS (SELECT count(*) OVER (PARTITION BY f.query_id) = 1 AS lone, f.query_id, f.doc_id, f.rank AS stage1_rank, f.score AS stage1_score, substr(coalesce({content}, ''), 1, {limit}) AS text, query FROM fused f LEFT JOIN docs ON docs.id = f.doc_id JOIN truth ON truth.id = f.query_id WHERE f.rank <= {pool}),
    cuts AS (SELECT *, list_distinct({tokens_sql("query")}) AS qs, {tokens_sql("text")} AS ds FROM pooled),
    scored AS (SELECT *, CASE WHEN text = '' THEN NULL WHEN len(qs) = 0 THEN 0.0 ELSE round(len(list_intersect(qs, list_distinct(ds))) / len(qs), 6) END AS model FROM cuts)"""


q("rerank_blend", lambda s, sf: searched(s, sf, "hybrid-jina-rerank"), f"""{scored_sql(30, 800)},
    ns AS (SELECT *, {mm_sql("stage1_score")} AS n1, CASE WHEN model IS NOT NULL THEN {mm_sql("model")} END AS n2 FROM scored),
    fin AS (SELECT query_id, doc_id, round(CASE WHEN lone THEN stage1_score WHEN n2 IS NOT NULL THEN 0.3 * n1 + 0.7 * n2 ELSE n1 END, 9) AS score FROM ns),
    outr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fin) {top_sql("outr")}""")
q("rerank_indexed_backfill", lambda s, sf: searched(s, sf, "hybrid-rerank-gemma-indexed"), f"""{scored_sql(10, 8000)},
    kept AS (SELECT * REPLACE (CASE WHEN NOT lone THEN model END AS model) FROM scored),
    fin AS (SELECT query_id, doc_id, coalesce(model, stage1_score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY model IS NULL, model DESC, CASE WHEN model IS NULL THEN stage1_rank END, doc_id) AS rank FROM kept) {top_sql("fin")}""")
q("rerank_model", lambda s, sf: searched(s, sf, "hybrid-deepinfra-rerank"), f"""{scored_sql(10, 8000, False)},
    kept AS (SELECT query_id, doc_id, CASE WHEN lone THEN stage1_score ELSE model END AS score FROM scored),
    outr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kept WHERE score IS NOT NULL) {top_sql("outr")}""")
q("rerank_fallback", lambda s, sf: create("hybrid-deepinfra-rerank", rr.failing_scorer).search(queries_of(s, sf), corpus(s, sf), K).select("query_id", "doc_id", "score", "rank"), f"WITH {_STAGE1} {top_sql('fused')}")

# ---- evaluation ----------------------------------------------------------------------------------------------------------
_RUNS = "runs AS (SELECT run_id, query_id, lower(trim(engine)) AS engine, rank, doc_id, score FROM search_results QUALIFY row_number() OVER (PARTITION BY run_id, rank ORDER BY logged_at, doc_id) = 1)"
_HITS = f"{TRUTH}, {QRELS}, {_RUNS}, hits AS (SELECT runs.*, qrels.doc_id IS NOT NULL AS relevant FROM runs LEFT JOIN qrels ON qrels.query_id = runs.query_id AND qrels.doc_id = runs.doc_id)"
_METRICS = f"""{_HITS}, per AS (SELECT run_id, engine, query_id, {", ".join(f"max(CASE WHEN rank <= {k} AND relevant THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_{k}" for k in ev.CUTOFFS)},
    round(coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0), 6) AS mrr, min(CASE WHEN relevant THEN rank END) AS first_hit FROM hits GROUP BY run_id, engine, query_id)"""
_RUN = ("run_id", "engine", "query_id")


def per_run(s, sf):
    return ev.metrics(runs_of(s, sf), src.qrels(truth_of(s, sf)), _RUN)


q("clean_runs", lambda s, sf: runs_of(s, sf).select("run_id", "query_id", "engine", "rank", "doc_id", "score"), f"WITH {_RUNS} SELECT * FROM runs")
q("metrics_per_query", per_run, f"WITH {_METRICS} SELECT * FROM per")
q("precision_ndcg", lambda s, sf: ev.precision_ndcg(runs_of(s, sf), src.qrels(truth_of(s, sf)), _RUN), f"""WITH {_HITS},
    per AS (SELECT run_id, engine, query_id, sum(CASE WHEN relevant AND rank <= 5 THEN 1 ELSE 0 END) / 5 AS p_5, sum(CASE WHEN relevant AND rank <= 10 THEN 1 ELSE 0 END) / 10 AS p_10,
        sum(CASE WHEN relevant AND rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg FROM hits GROUP BY run_id, engine, query_id),
    sizes AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id)
    SELECT run_id, engine, per.query_id, p_5, p_10, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0 / log2(i + 1.0))) ELSE 0.0 END, 6) AS ndcg_10 FROM per LEFT JOIN sizes ON sizes.query_id = per.query_id""")
q("benchmark_summary", lambda s, sf: ev.benchmark(per_run(s, sf)), f"WITH {_METRICS} SELECT engine, count(*) AS queries, {', '.join(f'round(coalesce(avg({c}), 0), 6) AS {c}' for c in ['hit_1', 'hit_3', 'hit_5', 'hit_10', 'mrr'])} FROM per GROUP BY engine")
_ENGINES = ["bm25", "hybrid", "keyword"]
_NAMES = ", ".join(f"'{e}'" for e in _ENGINES)
q("engine_position_pivot", lambda s, sf: ev.side_by_side(first_runs(s, sf), _ENGINES), f"""WITH {_RUNS}, firsts AS (SELECT * FROM runs WHERE run_id IN (SELECT min(run_id) FROM runs WHERE engine IN ({_NAMES}) GROUP BY engine, query_id))
    SELECT query_id, rank, {", ".join(f"max(CASE WHEN engine = '{e}' THEN doc_id END) AS {e}" for e in _ENGINES)} FROM firsts WHERE rank <= 5 GROUP BY query_id, rank""")
q("engine_mrr_pivot", lambda s, sf: ev.mrr_matrix(per_run(s, sf), _ENGINES), f"WITH {_METRICS} SELECT query_id, {', '.join(f'round(avg(CASE WHEN engine = {chr(39)}{e}{chr(39)} THEN mrr END), 6) AS {e}' for e in _ENGINES)} FROM per GROUP BY query_id")


_LOGGED = ["bm25", "hybrid", "hybrid-rrf-fusion", "hybrid-weighted", "keyword", "vector-gemma"]
q("engine_position_pivot_all", lambda s, sf: ev.side_by_side(ev.numbered_runs(runs_of(s, sf)), _LOGGED, keys=("query_id", "run_no")), f"""WITH {_RUNS}, numbered AS (SELECT *, dense_rank() OVER (PARTITION BY engine, query_id ORDER BY run_id) AS run_no FROM runs)
    SELECT query_id, run_no, rank, {", ".join(f"max(CASE WHEN engine = '{e}' THEN doc_id END) AS " + f'"{e}"' for e in _LOGGED)} FROM numbered WHERE rank <= 5 GROUP BY query_id, run_no, rank""")
q("engine_mrr_pivot_all", lambda s, sf: ev.mrr_matrix(per_run(s, sf), _LOGGED), f"WITH {_METRICS} SELECT query_id, " + ", ".join(f"round(avg(CASE WHEN engine = '{e}' THEN mrr END), 6) AS " + f'"{e}"' for e in _LOGGED) + " FROM per GROUP BY query_id")


def first_runs(s, sf):
    """The first run of each engine and query."""
    runs = runs_of(s, sf).where(F.col("engine").isin(_ENGINES))
    return runs.join(runs.groupBy("engine", "query_id").agg(F.min("run_id").alias("run_id")), ["engine", "query_id", "run_id"], "left_semi")


_LIVE = ["keyword", "bm25", "vector-gemma", "hybrid", "hybrid-weighted"]
_HIT = ", ".join(f"coalesce(max(CASE WHEN r.rank <= {k} AND q.doc_id IS NOT NULL THEN 1.0 END), 0.0)::DOUBLE AS hit_{k}" for k in ev.CUTOFFS)
q("live_benchmark", lambda s, sf: live(s, sf), f"""WITH {fused_sql(50, RRF.format(k=60, b=0))}, {QRELS}, {_KEYWORD},
    weighted AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(0.5 * n1 + 0.5 * n2, 9) AS score FROM normed)),
    alls AS (SELECT 'keyword' AS engine, query_id, doc_id, rank FROM kwr UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM bmr UNION ALL SELECT 'vector-gemma', query_id, doc_id, rank FROM ver UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused UNION ALL SELECT 'hybrid-weighted', query_id, doc_id, rank FROM weighted),
    asked AS (SELECT unnest({_LIVE}) AS engine, id AS query_id FROM truth),
    per AS (SELECT a.engine, a.query_id, {_HIT}, round(coalesce(1.0 / min(CASE WHEN q.doc_id IS NOT NULL THEN r.rank END), 0), 6) AS mrr FROM asked a LEFT JOIN (SELECT * FROM alls WHERE rank <= {K}) r ON r.engine = a.engine AND r.query_id = a.query_id
        LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id GROUP BY a.engine, a.query_id)
    SELECT engine, count(*) AS queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ['hit_1', 'hit_3', 'hit_5', 'hit_10', 'mrr'])} FROM per GROUP BY engine""")


def live(s, sf):
    """Some engines of each kind over the judged queries, evaluated in one DataFrame."""
    session = SearchSession(docs_of(s, sf))
    session.corpus = corpus(s, sf)
    return session.benchmark(queries_of(s, sf), src.qrels(truth_of(s, sf)), _LIVE)


# What each engine tells of a result.
_FUSED = "engine in_engine1 in_engine2 rank1 rank2 score1 score2 norm_score1 norm_score2 pool"
_STAGED = "engine stage1_rank stage1_score stage2_rank pool"
METADATA = {
    "keyword": "engine keyword_count", **dict.fromkeys(("vector-gemma", "vector-gemma-faiss", "vector-gemma-int8", "vector-gemma-int8-faiss"), "engine model"), "hybrid": f"{_FUSED} rrf_k",
    **dict.fromkeys(("hybrid-weighted", "hybrid-weighted-bm25", "hybrid-weighted-vector"), f"{_FUSED} w1 w2"), **dict.fromkeys(("hybrid-cosine-rerank", "hybrid-rerank-gemma"), f"{_STAGED} stage2_score fallback rerank_method"),
    **dict.fromkeys(("hybrid-cosine-combined", "hybrid-cosine-combined-0.7"), f"{_STAGED} stage2_score fallback rerank_method weight1 weight2"), "hybrid-jina-rerank": f"{_STAGED} stage1_norm stage2_score stage2_norm truncated reranker_model stage1_weight stage2_weight",
    "hybrid-rerank-gemma-indexed": f"{_STAGED} fallback rerank_prompt", "hybrid-deepinfra-rerank": f"{_STAGED} stage2_score fallback reranker_model", "hybrid-rrf-fusion": f"{_FUSED} rrf_k blend w1 w2",
    "hybrid-ensemble-boost": f"{_FUSED} rrf_k rrf_weight score_weight w1 w2 max_weight boost boost_rank", "hybrid-rrf-density": f"{_FUSED} rrf_k rrf_weight score_weight w1 w2 density_weight window position_boost exponent",
    "hybrid-cascade-rerank": "engine fused_score rerank_score rerank_applied doc_truncated rerank_input_preview bm25_rank vector_rank",
}


def engine_metadata(s, sf):
    """The fields of each engine's typed metadata, as the results have them; the schema needs no query to be run."""
    rows, none = [], queries_of(s, sf).where("false")
    for name, engine in registry().items():
        found = engine.search(none, corpus(s, sf), K).schema
        rows += [(name, f.name) for f in (found["metadata"].dataType.fields if "metadata" in found.names else ())]
    return s.createDataFrame(rows, "engine string, field string")


q("engine_metadata", engine_metadata, "SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{f}')" for e, fs in METADATA.items() for f in fs.split()) + ") AS t(engine, field)")

# ---- ingest --------------------------------------------------------------------------------------------------------------
def listed(s, sf):
    return src.sitemap_urls(table(s, sf, "sitemaps")).select("url").distinct()


_LISTED = "listed AS (SELECT DISTINCT url FROM (" + _SQL["sitemap_urls"] + "))"
_AS_OF = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"
q("url_lookup", lambda s, sf: docs_of(s, sf).join(listed(s, sf), "url", "left_semi").select("id", "url"), f"WITH {_LISTED} SELECT id, url FROM crawl_documents WHERE url IN (SELECT url FROM listed)")
q("refresh_all", lambda s, sf: ig.urls_to_crawl(listed(s, sf), docs_of(s, sf), refresh=True), f"WITH {_LISTED} SELECT url FROM listed")
q("refresh_failed", lambda s, sf: ig.urls_to_crawl(listed(s, sf), docs_of(s, sf), retry_failed=True), f"WITH {_LISTED} SELECT url FROM listed WHERE url IN (SELECT url FROM crawl_documents WHERE crawl_status = 'failed')")
q("refresh_age", lambda s, sf: ig.urls_to_crawl(listed(s, sf), docs_of(s, sf), refresh_days=90, as_of=AS_OF),
  f"WITH {_LISTED} SELECT listed.url FROM listed LEFT JOIN crawl_documents d ON d.url = listed.url WHERE d.url IS NULL OR d.updated_at < {_AS_OF} - INTERVAL 90 DAY")
q("refresh_default", lambda s, sf: ig.urls_to_crawl(listed(s, sf), docs_of(s, sf)), f"WITH {_LISTED} SELECT url FROM listed WHERE url NOT IN (SELECT url FROM crawl_documents WHERE crawl_status = 'success')")
q("crawl_outcome", lambda s, sf: docs_of(s, sf).select("id", ig.classify_fetch(F.col("http_status"), F.col("content_raw"), F.col("content_text"), F.col("error_message")).alias("o")).select("id", "o.*"),
  """SELECT id, CASE WHEN b OR t THEN 'failed' ELSE 'success' END AS crawl_status, CASE WHEN b THEN coalesce(error_message, 'HTTP ' || coalesce(http_status, 0)) WHEN t THEN 'Parsing failed: no content extracted' END AS error_message
    FROM (SELECT *, http_status IS NULL OR http_status <> 200 OR coalesce(content_raw, '') = '' AS b, coalesce(content_text, '') = '' AS t FROM crawl_documents)""")  # fmt: skip
q("crawl_counters", lambda s, sf: ig.crawl_counters(docs_of(s, sf)), "SELECT count(*) AS total, count(*) FILTER (crawl_status = 'success') AS success, count(*) FILTER (crawl_status = 'failed') AS failed, CAST(0 AS BIGINT) AS skipped FROM crawl_documents")


def fetched_of(s, sf, status):
    """Every address of the sitemaps, fetched again with this outcome."""
    none = F.lit(None).cast("string")
    return listed(s, sf).select("url", (F.concat(F.lit("<p>"), "url", F.lit("</p>")) if status == "success" else none).alias("content_raw"), (F.concat(F.lit("text of "), "url") if status == "success" else none).alias("content_text"),
                                F.lit(status).alias("crawl_status"), F.lit(200 if status == "success" else 500).alias("http_status"), (none if status == "success" else F.lit("HTTP 500")).alias("error_message"))


_COLUMNS = ["id", "url", "content_raw", "content_text", "created_at", "updated_at", "crawled_at", "crawl_status", "http_status", "error_message"]
for _status in ("success", "failed"):
    _ok = _status == "success"
    q(f"upsert_{_status}", partial(lambda s, sf, st: ig.upsert(docs_of(s, sf), fetched_of(s, sf, st), AS_OF).withColumns({c: F.unix_micros(c) for c in ("created_at", "updated_at", "crawled_at")}), st=_status), f"""WITH {_LISTED},
        fresh AS (SELECT url, (SELECT max(id) FROM crawl_documents) + row_number() OVER (ORDER BY url) AS id FROM listed WHERE url NOT IN (SELECT url FROM crawl_documents))
        SELECT coalesce(d.id, fresh.id) AS id, coalesce(d.url, l.url) AS url, CASE WHEN l.url IS NULL THEN content_raw ELSE {"'<p>' || l.url || '</p>'" if _ok else "NULL"} END AS content_raw,
            CASE WHEN l.url IS NULL THEN content_text ELSE {"'text of ' || l.url" if _ok else "content_text"} END AS content_text,
            epoch_us(coalesce(created_at, {_AS_OF})) AS created_at, epoch_us(CASE WHEN l.url IS NULL THEN updated_at ELSE {_AS_OF} END) AS updated_at, epoch_us(CASE WHEN l.url IS NULL THEN crawled_at ELSE {_AS_OF} END) AS crawled_at,
            CASE WHEN l.url IS NULL THEN crawl_status ELSE '{_status}' END AS crawl_status, CASE WHEN l.url IS NULL THEN http_status ELSE {200 if _ok else 500} END AS http_status,
            CASE WHEN l.url IS NULL THEN error_message ELSE {"NULL" if _ok else "'HTTP 500'"} END AS error_message
        FROM crawl_documents d FULL JOIN listed l ON l.url = d.url LEFT JOIN fresh ON fresh.url = l.url""")
def recorded(s, sf):
    """Recorded answers for the addresses of the sitemaps, told by their last digit: pages, pages without text, errors."""
    def make():
        def fetch(url):
            last = url[-1:]
            if last in "12":
                return None, 404 if last == "1" else 0, None if last == "1" else "timeout"
            return ("<html><body></body></html>" if last == "3" else f"<html><body><p>page {url}</p></body></html>"), 200, None

        return fetch

    return make


def crawl_run(s, sf):
    """A whole crawl of the listed addresses over recorded answers: the document table after it."""
    run = crawl(ListBot("recorded", listed(s, sf)), docs_of(s, sf), recorded(s, sf), run_preflight=False, delay=0.0, now=AS_OF)
    return run.documents.select("id", "url", "content_raw", "content_text", F.unix_micros("updated_at").alias("updated_at"), "crawl_status", "http_status", "error_message")


def crawl_totals(s, sf):
    run = crawl(ListBot("recorded", listed(s, sf)), docs_of(s, sf), recorded(s, sf), delay=0.0, now=AS_OF)
    return s.createDataFrame([tuple(run.counters[k] for k in ("total", "success", "failed", "skipped"))], "total bigint, success bigint, failed bigint, skipped bigint")


_RUN_SQL = f"""{_LISTED}, todo AS (SELECT url, right(url, 1) AS c FROM listed WHERE url NOT IN (SELECT url FROM crawl_documents WHERE crawl_status = 'success')),
    got AS (SELECT url, CASE WHEN c = '3' THEN '<html><body></body></html>' WHEN c NOT IN ('1', '2') THEN '<html><body><p>page ' || url || '</p></body></html>' END AS raw, CASE WHEN c NOT IN ('1', '2', '3') THEN 'page ' || url END AS txt,
        CASE WHEN c IN ('1', '2', '3') THEN 'failed' ELSE 'success' END AS st, CASE c WHEN '1' THEN 404 WHEN '2' THEN 0 ELSE 200 END AS http, CASE c WHEN '1' THEN 'HTTP 404' WHEN '2' THEN 'timeout' WHEN '3' THEN 'Parsing failed: no content extracted' END AS err FROM todo)"""
q("crawl_run", crawl_run, f"""WITH {_RUN_SQL},
    fresh AS (SELECT url, (SELECT max(id) FROM crawl_documents) + row_number() OVER (ORDER BY url) AS id FROM got WHERE url NOT IN (SELECT url FROM crawl_documents))
    SELECT coalesce(d.id, fresh.id) AS id, coalesce(d.url, g.url) AS url, CASE WHEN g.url IS NULL THEN content_raw ELSE raw END AS content_raw, CASE WHEN st = 'success' THEN txt ELSE content_text END AS content_text,
        epoch_us(CASE WHEN g.url IS NULL THEN updated_at ELSE {_AS_OF} END) AS updated_at, CASE WHEN g.url IS NULL THEN crawl_status ELSE st END AS crawl_status, CASE WHEN g.url IS NULL THEN http_status ELSE http END AS http_status, CASE WHEN g.url IS NULL THEN error_message ELSE err END AS error_message
    FROM crawl_documents d FULL JOIN got g ON g.url = d.url LEFT JOIN fresh ON fresh.url = g.url""")
q("crawl_totals", crawl_totals, f"WITH {_RUN_SQL} SELECT count(*) AS total, count(*) FILTER (st = 'success') AS success, count(*) FILTER (st = 'failed') AS failed, CAST(0 AS BIGINT) AS skipped FROM got")
q("delete_url", lambda s, sf: ig.delete_url(docs_of(s, sf), "https://khadamat-services.example/ar/faq/9").select("id"), "SELECT id FROM crawl_documents WHERE url IS DISTINCT FROM 'https://khadamat-services.example/ar/faq/9'")
q("page_text", lambda s, sf: ig.parse_pages(docs_of(s, sf).select("id", "content_raw"), html_col="content_raw").select("id", "content_text"))
q("preflight", lambda s, sf: ig.preflight(docs_of(s, sf)), """WITH c AS (SELECT count(*) AS n, count(*) FILTER (id IS NULL OR url IS NULL) AS k, count(DISTINCT url) AS u, count(url) AS w, count(*) FILTER (crawl_status NOT IN ('pending', 'success', 'failed')) AS o,
        count(*) FILTER (crawl_status = 'success' AND content_text IS NULL) AS t FROM crawl_documents)
    SELECT 'has_rows' AS name, n > 0 AS passed, 'rows=' || n AS message FROM c UNION ALL SELECT 'keys_present', k = 0, 'keyless=' || k FROM c UNION ALL SELECT 'urls_unique', u = w, 'urls=' || u FROM c
    UNION ALL SELECT 'known_status', o = 0, 'odd=' || o FROM c UNION ALL SELECT 'success_has_text', t = 0, 'textless=' || t FROM c""")


# ---- diagnostics ---------------------------------------------------------------------------------------------------------
def phrases_of(s, sf):
    return truth_of(s, sf).select(F.trim("query").alias("phrase")).distinct()


_PHRASES = f"{DOCS}, {TRUTH}, phrases AS (SELECT DISTINCT lower(trim(query)) AS phrase FROM truth WHERE trim(query) <> ''), hits AS (SELECT phrase, id AS doc_id, (length(lower(content)) - length(replace(lower(content), phrase, ''))) // length(phrase) AS n FROM phrases, docs WHERE contains(lower(content), phrase))"
q("phrase_search", lambda s, sf: dg.phrase_search(corpus(s, sf).index, phrases_of(s, sf)), f"WITH {_PHRASES} SELECT phrase, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY doc_id) AS rank FROM hits) WHERE rank <= 10")
q("candidate_queries", lambda s, sf: dg.candidate_queries(corpus(s, sf).index, phrases_of(s, sf)), f"""WITH {_PHRASES}, totals AS (SELECT phrase, count(*) AS matches FROM hits GROUP BY phrase HAVING count(*) >= 2 ORDER BY matches DESC, phrase LIMIT 15),
    best AS (SELECT hits.*, matches, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, doc_id) AS rank FROM hits JOIN totals USING (phrase))
    SELECT phrase, matches, CAST(rank AS INTEGER) AS rank, doc_id, CAST(n AS BIGINT) AS n, {_TITLE_SQL} AS title FROM best JOIN docs ON docs.id = doc_id WHERE rank <= 5""")
q("title_words", lambda s, sf: dg.title_words(src.successful(docs_of(s, sf))), rf"""WITH {DOCS}, t AS (SELECT {_TITLE_SQL} AS title FROM docs),
    w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(title, '[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+')) AS word FROM t WHERE title <> 'No title') WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 30) SELECT * FROM w WHERE length(word) > 2""")
q("title_sample", lambda s, sf: dg.title_sample(src.successful(docs_of(s, sf))), f"WITH {DOCS} SELECT position, id, {_TITLE_SQL} AS title FROM (SELECT *, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS position FROM docs) WHERE position IN (0, 20, 40, 60, 80)")
_QT = f"{INDEX}, {TRUTH}, {QRELS}, qd AS (SELECT id AS query_id, unnest(list_distinct({tokens_sql('query')})) AS term FROM truth)"
_COV = f"{_QT}, cov AS (SELECT query_id, qd.term, CAST(coalesce(df, 0) AS BIGINT) AS df, round(coalesce(df, 0) / n_docs * 100, 6) AS percent, round(coalesce(idf, 0.0), 6) AS idf, coalesce(idf, 0.0) < 1.0 AS low FROM qd LEFT JOIN terms USING (term), corpus)"
q("term_coverage", lambda s, sf: dg.term_coverage(queries_of(s, sf), corpus(s, sf).index), f"WITH {_COV} SELECT * FROM cov")
q("common_queries", lambda s, sf: dg.common_queries(queries_of(s, sf), corpus(s, sf).index), f"WITH {_COV} SELECT query_id, bool_and(idf < 2.0) AS all_common FROM cov GROUP BY query_id")
q("truth_terms", lambda s, sf: dg.truth_terms(queries_of(s, sf), src.qrels(truth_of(s, sf)), corpus(s, sf).index), f"WITH {_QT} SELECT qd.query_id, qrels.doc_id, qd.term, coalesce(tf, 0) AS tf FROM qrels JOIN qd ON qd.query_id = qrels.query_id LEFT JOIN post ON post.doc_id = qrels.doc_id AND post.term = qd.term")
q("term_variants", lambda s, sf: dg.term_variants(queries_of(s, sf), src.qrels(truth_of(s, sf)), corpus(s, sf).index),
  f"WITH {_QT} SELECT qd.query_id, qrels.doc_id, qd.term, post.term AS variant FROM qrels JOIN qd ON qd.query_id = qrels.query_id JOIN post ON post.doc_id = qrels.doc_id WHERE post.term <> qd.term AND (contains(post.term, qd.term) OR contains(qd.term, post.term))")
q("missed_by_bm25", lambda s, sf: dg.missed(src.qrels(truth_of(s, sf)), searched(s, sf, "bm25")), f"WITH {BM}, {QRELS}, top AS ({top_sql('bmr')}) SELECT qrels.query_id, qrels.doc_id, rank, score FROM qrels LEFT JOIN top ON top.query_id = qrels.query_id AND top.doc_id = qrels.doc_id")

# ---- training samples ----------------------------------------------------------------------------------------------------
q("doc_export", lambda s, sf: td.export_texts(docs_of(s, sf)), f"WITH {DOCS} SELECT 'doc_' || id || '.txt' AS filename, 'Source URL: ' || url || chr(10) || chr(10) || content AS body FROM docs")
_EOS = "'<|im_end|>'"
_TURNS = "SELECT sample_id, conversations[1].content AS a, conversations[2].content AS b, conversations[3].content AS c FROM chat_samples WHERE len(conversations) >= 3"
q("chat_template", lambda s, sf: td.chat_rows(table(s, sf, "chat_samples")), f"SELECT sample_id, '<|im_start|>system' || chr(10) || a || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || b || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || c || '<|im_end|>' || {_EOS} AS text FROM ({_TURNS}) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
_AFTER = f"CASE WHEN contains(c, '</think>') THEN {strip_sql('string_split(c, ' + repr('</think>') + ')[-1]')} ELSE c END"
# The template is written out here, as the SQL is to check the code's.
_QFS = """'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) ||
    'You are a Query-Focused Summarization engine. Extract relevant information from the provided document to answer the user query. Output ONLY the summary. Do not use internal reasoning or conversational filler.'
    || chr(10) || chr(10) || '### Input:' || chr(10) || {i} || chr(10) || chr(10) || '### Response:' || chr(10) || {o} || """ + _EOS
q("chat_to_qfs", lambda s, sf: td.chat_to_qfs(table(s, sf, "chat_samples")), f"SELECT sample_id, {_QFS.format(i='b', o=_AFTER)} AS text FROM ({_TURNS}) WHERE b IS NOT NULL AND c IS NOT NULL")
q("think_split", lambda s, sf: td.think_split(table(s, sf, "chat_samples")), f"""SELECT sample_id, CASE WHEN regexp_matches(t, '(?s)<think>.*?</think>') THEN {strip_sql("regexp_extract(t, '(?s)<think>(.*?)</think>', 1)")} END AS thought,
    {strip_sql("regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')")} AS answer FROM (SELECT sample_id, x.content AS t FROM (SELECT sample_id, unnest(conversations) AS x FROM chat_samples) WHERE x.role = 'assistant')""")
q("qfs_template", lambda s, sf: td.qfs_rows(table(s, sf, "qfs_samples")), f"SELECT min(sample_id) AS sample_id, {_QFS.format(i='concat_ws(chr(10), instruction, input)', o='output')} AS text FROM qfs_samples WHERE input IS NOT NULL AND length(trim(output)) > 0 GROUP BY instruction, input, output")
_MD5 = "CAST('0x' || substr(md5(id || ':{seed}'), 1, 8) AS BIGINT)"
q("negative_samples", lambda s, sf: td.negatives(docs_of(s, sf), ["ما لون السماء؟", "كم عدد الكواكب؟"], "لا يجيب النص عن هذا السؤال."), f"""WITH {DOCS}
    SELECT id AS doc_id, 'السياق:' || chr(10) || substr(content, 1, 1000) || chr(10) || chr(10) || 'السؤال:' || chr(10) || ['ما لون السماء؟', 'كم عدد الكواكب؟'][{_MD5.format(seed=1)} % 2 + 1] AS "user", 'لا يجيب النص عن هذا السؤال.' AS assistant
    FROM docs WHERE length(content) >= 50 AND {_MD5.format(seed=0)} % 100 < 15""")


def raw_answers(s, sf):
    """Answers of a teacher model as JSON, made of the conversations; those of one turn are no answers."""
    turn = lambda i: F.get("conversations", F.lit(i))["content"]
    named = F.struct(turn(1).alias("question"), turn(2).alias("final_response"), think_part(turn(2)).alias("thought_process"))
    return table(s, sf, "chat_samples").select("sample_id", F.when(F.size("conversations") > 1, F.to_json(named)).otherwise("{cut short").alias("raw"))


q("parsed_answers", lambda s, sf: td.parse_answers(raw_answers(s, sf)), f"""WITH turns AS (SELECT sample_id, conversations[2].content AS question, conversations[3].content AS final_response FROM chat_samples WHERE len(conversations) > 1),
    thoughts AS (SELECT *, CASE WHEN regexp_matches(final_response, '(?s)<think>.*?</think>') THEN {strip_sql("regexp_extract(final_response, '(?s)<think>(.*?)</think>', 1)")} ELSE '<think>Answer generated based on context.</think>' END AS thought FROM turns)
    SELECT sample_id, question, thought, final_response, thought || chr(10) || final_response AS assistant FROM thoughts WHERE question IS NOT NULL AND final_response IS NOT NULL""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
