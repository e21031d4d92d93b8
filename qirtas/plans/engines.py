"""The named engines: configurations that turn queries into ranked results, over one shared set of index tables."""

from __future__ import annotations

import inspect
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import MODELS, Factory, HashingEncoder, encode
from ..functions.text import snippet
from ..operators import rerank as rr
from ..operators import retrieval as rt
from ..operators.evaluate import benchmark, metrics
from ..operators.index import Index, build_index
from ..session import materialise


RANKING = ("query_id", "doc_id", "score", "rank")


@dataclass(frozen=True)
class Corpus:
    """What engines search: an index, the vectors (doc_id, embedding) and the texts (id, content) of its documents."""

    index: Index
    vectors: DataFrame | None = None

    @property
    def texts(self) -> DataFrame:
        return self.index.documents.select("id", "content")


def tagged(found: DataFrame, engine: str, **fields) -> DataFrame:
    """The ranking with the engine's name, and further values or columns, in its typed `metadata`."""
    own = [F.col(f"metadata.{f.name}").alias(f.name) for f in found.schema["metadata"].dataType.fields if f.name not in fields] if "metadata" in found.columns else []
    more = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]
    return found.withColumn("metadata", F.struct(F.lit(engine).alias("engine"), *own, *more))


class Engine(ABC):
    """Queries are (query_id, query [, embedding]); a ranking is (query_id, doc_id, score, rank [, metadata])."""

    name: str

    @abstractmethod
    def search(self, queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame: ...


@dataclass(frozen=True)
class Keyword(Engine):
    name: str = "keyword"

    def search(self, queries, corpus, k=10):
        return tagged(rt.ranked(rt.keyword_scores(queries, corpus.index, k), k), self.name, keyword_count=F.col("score"))


@dataclass(frozen=True)
class BM25(Engine):
    name: str = "bm25"
    k1: float = 1.5
    b: float = 0.75

    def search(self, queries, corpus, k=10):
        return rt.ranked(rt.bm25_scores(queries, corpus.index, self.k1, self.b), k)


@dataclass(frozen=True)
class Vector(Engine):
    """Exact cosine search. Precision variants differ in the encoder only and share the stored vectors."""

    name: str = "vector"
    model: str = "gemma"

    def search(self, queries, corpus, k=10):
        if corpus.vectors is None:
            raise RuntimeError("the corpus has no embeddings")
        return tagged(rt.vector_ranking(queries, corpus.vectors, k), self.name, model=MODELS[self.model].model_id)


@dataclass(frozen=True)
class Fusion(Engine):
    """Two engines' pools, fused."""

    name: str
    fuse: Callable
    pool: int
    options: dict = field(default_factory=dict)
    first: Engine = BM25()
    second: Engine = Vector()

    def search(self, queries, corpus, k=10):
        a, b = self.first.search(queries, corpus, self.pool), self.second.search(queries, corpus, self.pool)
        found = self.fuse(a.select(*RANKING), b.select(*RANKING), k=k, pool=self.pool, **self.options)
        settings = {n: p.default for n, p in inspect.signature(self.fuse).parameters.items() if isinstance(p.default, (int, float)) and n != "k"} | self.options | {"pool": self.pool}
        return tagged(found, self.name, in_engine1=F.col("metadata.rank1").isNotNull(), in_engine2=F.col("metadata.rank2").isNotNull(), **settings)


@dataclass(frozen=True)
class Rerank(Engine):
    """A first stage's pool, ranked again. The first stage is written once, as re-rankers read it more than once."""

    name: str
    stage1: Engine
    stage2: Callable
    pool: int
    fields: dict = field(default_factory=dict)

    def search(self, queries, corpus, k=10):
        first = materialise(self.stage1.search(queries, corpus, max(self.pool, k)).select(*RANKING), "stage-1")
        return tagged(self.stage2(first, queries, corpus, k, self.pool), self.name, stage2_rank=F.col("rank"), pool=self.pool, **self.fields)


def _cosine(first, queries, corpus, k, pool):
    return rr.rerank_cosine(first, queries, corpus.vectors, k, pool)


def _cosine_blend(w1, w2):
    return lambda first, queries, corpus, k, pool: rr.rerank_cosine_blend(first, queries, corpus.vectors, k, pool, w1, w2)


@dataclass(frozen=True)
class Cascade(Engine):
    name: str = "hybrid-cascade-rerank"
    pool: int = 110
    stage2: int = 45
    blend: float = 0.55
    limit: int = 900
    scorer: rr.Scorer = rr.lexical_scorer

    def search(self, queries, corpus, k=10):
        a, b = BM25().search(queries, corpus, self.pool), Vector().search(queries, corpus, self.pool)
        fused = materialise(rt.fuse_cascade(a.select(*RANKING), b.select(*RANKING), pool=self.pool).select(*RANKING, F.col("metadata.rank1").alias("bm25_rank"), F.col("metadata.rank2").alias("vector_rank")), "cascade")
        found = rr.rerank_cascade(fused.select(*RANKING), lambda pool: self.scorer(rr.with_text(pool, queries, corpus.texts, self.limit)), k, self.stage2, self.blend)
        ranks = found.join(fused.select("query_id", "doc_id", "bm25_rank", "vector_rank"), ["query_id", "doc_id"])
        return tagged(ranks, self.name, bm25_rank=F.col("bm25_rank"), vector_rank=F.col("vector_rank")).select(*RANKING, "metadata")


def _weighted(name: str, w1: float, w2: float, pool: int = 50) -> Fusion:
    return Fusion(name, rt.fuse_weighted, pool, {"w1": w1, "w2": w2})


def registry(scorer: rr.Scorer = rr.lexical_scorer) -> dict[str, Engine]:
    """All named engines; `scorer` stands in for the model of the model-based re-rankers."""
    stage1, model = _weighted("stage1", 0.5, 0.5), getattr(scorer, "__name__", "scorer")
    engines: list[Engine] = [
        Keyword(), BM25(),
        *(Vector(n, "gemma-int8" if "int8" in n else "gemma") for n in ("vector-gemma", "vector-gemma-faiss", "vector-gemma-int8", "vector-gemma-int8-faiss")),
        Fusion("hybrid", rt.fuse_rrf, 50, {"rrf_k": 60}),
        _weighted("hybrid-weighted", 0.5, 0.5), _weighted("hybrid-weighted-bm25", 0.7, 0.3), _weighted("hybrid-weighted-vector", 0.3, 0.7),
        Rerank("hybrid-rerank-gemma", stage1, _cosine, 10, {"rerank_method": "cached-vectors"}),
        Rerank("hybrid-jina-rerank", stage1, lambda f, q, c, k, p: rr.rerank_blend(f, q, c.texts, scorer, k, p), 30, {"reranker_model": model, "stage1_weight": 0.3, "stage2_weight": 0.7}),
        Rerank("hybrid-rerank-gemma-indexed", stage1, lambda f, q, c, k, p: rr.rerank_backfill(f, q, c.texts, scorer, k, p), 10, {"rerank_prompt": "Retrieval-query"}),
        Rerank("hybrid-cosine-rerank", stage1, _cosine, 10, {"rerank_method": "cosine"}),
        Rerank("hybrid-deepinfra-rerank", stage1, lambda f, q, c, k, p: rr.rerank_scorer(f, q, c.texts, scorer, k, p), 10, {"reranker_model": model}),
        Fusion("hybrid-rrf-fusion", rt.fuse_rrf_blend, 75), Fusion("hybrid-ensemble-boost", rt.fuse_ensemble, 80), Fusion("hybrid-rrf-density", rt.fuse_density, 95),
        Cascade(scorer=scorer),
        Rerank("hybrid-cosine-combined", stage1, _cosine_blend(0.5, 0.5), 10, {"rerank_method": "combined", "weight1": 0.5, "weight2": 0.5}),
        Rerank("hybrid-cosine-combined-0.7", stage1, _cosine_blend(0.7, 0.3), 10, {"rerank_method": "combined", "weight1": 0.7, "weight2": 0.3}),
    ]
    return {e.name: e for e in engines}


#: Not among the named engines: the BM25 pool of 50 re-sorted by cosine.
BM25_THEN_VECTOR = Rerank("hybrid-rerank", BM25(), _cosine, 50)


def create(name: str, scorer: rr.Scorer = rr.lexical_scorer) -> Engine:
    engines = registry(scorer)
    if name not in engines:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(engines)}")
    return engines[name]


@dataclass
class Response:
    results: DataFrame
    rows: int
    init_ms: float
    search_ms: float

    @property
    def total_ms(self) -> float:
        return self.init_ms + self.search_ms


class SearchSession:
    """Documents and embeddings, indexed on first use, and searched by any engine."""

    def __init__(self, docs: DataFrame, embeddings: DataFrame | None = None, script: str = "arabic", model: str = "gemma", encoder: Factory = HashingEncoder):
        self.docs, self.embeddings, self.script, self.model, self.encoder = docs, embeddings, script, MODELS[model], encoder
        self.corpus: Corpus | None = None
        self.init_ms = 0.0

    def initialize(self) -> int:
        """Build the index tables; the number of documents in them."""
        began = time.perf_counter()
        index = build_index(self.docs, self.script)
        vectors = self.embeddings
        if vectors is not None:
            vectors = vectors.join(index.documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "embedding")
        self.corpus = Corpus(index, vectors)
        self.init_ms = (time.perf_counter() - began) * 1000
        return index.corpus_stats.first()["n_docs"]

    def encode_documents(self) -> None:
        """Vectors of all texts by the session's encoder, written once, in place of stored ones."""
        self.embeddings = materialise(encode(self.docs.where("content_text is not null").select(F.col("id").alias("doc_id"), "content_text"), "content_text", self.model, self.encoder).select("doc_id", "embedding"), "embeddings")

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        """(query_id, query, embedding)."""
        return encode(queries.select("query_id", "query"), "query", self.model, self.encoder, query=True)

    def search(self, queries: DataFrame, engine: str | Engine = "bm25", k: int = 10) -> DataFrame:
        """(query_id, doc_id, url, score, rank, snippet, ...): a DataFrame, evaluated by its first action."""
        if self.corpus is None:
            raise RuntimeError("initialize() the session before searching")
        chosen = create(engine) if isinstance(engine, str) else engine
        found = chosen.search(queries, self.corpus, k)
        style = {"keyword": "keyword", "bm25": "bm25"}.get(chosen.name, "vector")
        docs = self.corpus.index.documents.select(F.col("id").alias("doc_id"), "url", snippet(F.col("content"), style).alias("snippet"))
        return found.join(docs, "doc_id", "left")

    def timed(self, queries: DataFrame, engine: str | Engine = "bm25", k: int = 10, cold: bool = False) -> Response:
        """Search and count; with `cold` the index is built anew and its time reported."""
        if cold or self.corpus is None:
            self.initialize()
        began = time.perf_counter()
        results = self.search(queries, engine, k)
        n = results.count()
        return Response(results, n, self.init_ms if cold else 0.0, (time.perf_counter() - began) * 1000)

    def evaluate(self, queries: DataFrame, qrels: DataFrame, engines: list[str], k: int = 10, timed: bool = False) -> DataFrame:
        """Metrics of each query and engine: (engine, query_id, hit_1, ..., mrr). A query without results counts as 0."""
        parts = []
        asked = queries.select("query_id").distinct().count() if timed else 0
        for name in engines:
            began = time.perf_counter()
            # Written, so that each engine is a job of its own: one plan of all engines takes most of the driver's memory.
            found = materialise(create(name).search(queries, self.corpus, k).select("query_id", "doc_id", "rank"), "run")
            if timed:  # all queries of an engine are one job, so each has an equal share of its time
                times = F.lit((time.perf_counter() - began) * 1000 / max(asked, 1))
            own = metrics(found, qrels)
            full = queries.select("query_id").distinct().join(own, "query_id", "left")
            parts.append(full.select(F.lit(name).alias("engine"), "query_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("hit_1", "hit_3", "hit_5", "hit_10", "mrr")), "first_hit", *([times.alias("time_ms")] if timed else [])))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def benchmark(self, queries: DataFrame, qrels: DataFrame, engines: list[str], k: int = 10, timed: bool = False) -> DataFrame:
        """Averages of each engine; with `timed` also of its response time."""
        return benchmark(self.evaluate(queries, qrels, engines, k, timed))


def report(response: Response, verbose: bool = False, width: int = 80) -> str:
    """A search as lines of text: rank, score, address; snippet and metadata if verbose; the times at the end."""
    lines = []
    for r in response.results.orderBy("query_id", "rank").limit(1000).collect():
        lines.append(f"{r['rank']:>3}  {r['score']:.4f}  {r['url']}")
        if verbose:
            lines.append("     " + " ".join((r["snippet"] or "").split())[:width])
            if "metadata" in response.results.columns:
                lines.append("     " + ", ".join(f"{k}={v}" for k, v in r["metadata"].asDict().items() if v is not None))
    return "\n".join([*lines, f"{response.rows} results, search {elapsed_text(response.search_ms)}, total {elapsed_text(response.total_ms)}"])


def elapsed_text(ms: float) -> str:
    """A time in µs, ms or s."""
    return f"{ms * 1000:.2f} μs" if ms < 1 else f"{ms:.2f} ms" if ms < 1000 else f"{ms / 1000:.2f} s"


def main(argv: list[str] | None = None) -> int:
    """Command line: search a data folder, compare engines or run the benchmark."""
    import argparse

    from ..session import get_spark, table
    from ..sources.tables import ground_truth, qrels

    args = argparse.ArgumentParser(prog="qirtas")
    args.add_argument("--data")
    args.add_argument("--query")
    args.add_argument("--engine", default="bm25")
    args.add_argument("--top", type=int, default=10)
    args.add_argument("--list-engines", action="store_true")
    args.add_argument("--benchmark", action="store_true")
    args.add_argument("--verbose", action="store_true")
    got = args.parse_args(argv)
    if got.list_engines:
        print("\n".join(registry()))
        return 0
    if not got.data or not (got.query or got.benchmark):
        args.error("--data and one of --query and --benchmark are needed")
    spark: SparkSession = get_spark()
    session = SearchSession(table(spark, got.data, "crawl_documents"), table(spark, got.data, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"))
    if got.query:  # a free query has no stored vector, so texts and query go through one encoder
        session.encode_documents()
    session.initialize()
    truth = ground_truth(table(spark, got.data, "judged_queries"))
    names = got.engine.split(",")
    if got.benchmark:
        queries = truth.select(F.col("id").alias("query_id"), "query").join(table(spark, got.data, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
        session.benchmark(queries, qrels(truth), names, timed=True).show(truncate=False)
        return 0
    for name in names:
        print(name)
        print(report(session.timed(session.encode_queries(spark.createDataFrame([(1, got.query)], "query_id bigint, query string")), name, got.top), got.verbose))
    return 0
