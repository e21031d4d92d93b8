"""Sources: document scans, ground truth, sitemaps, text folders, JSON lines, embedding tables, fetched pages."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialise

DOCUMENT_SCHEMA = (
    "id bigint NOT NULL, url string NOT NULL, content_raw string, content_text string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL, "
    "crawled_at timestamp, crawl_status string NOT NULL, http_status int, error_message string"
)
GROUND_TRUTH_SCHEMA = "queries array<struct<id:bigint,query:string,description:string,relevant_docs:array<bigint>,highly_relevant:array<bigint>>>"


def successful(docs: DataFrame) -> DataFrame:
    """Rows that were crawled with success and have a text."""
    return docs.where((F.col("crawl_status") == "success") & F.col("content_text").isNotNull())


def scan_keyword(docs: DataFrame) -> DataFrame:
    return successful(docs).select("id", "url", "content_text")


def scan_full_text(docs: DataFrame) -> DataFrame:
    """Texts for re-rankers: success only, a null text as ''."""
    return docs.where(F.col("crawl_status") == "success").select("id", F.coalesce("content_text", F.lit("")).alias("content"))


def by_url(docs: DataFrame, url: str) -> DataFrame:
    return docs.where(F.col("url") == url)


def by_id(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.where(F.col("id") == doc_id)


def ground_truth(queries: DataFrame) -> DataFrame:
    """One row a query text, the last one by id; null lists become empty, repeats in a list are dropped."""
    last = Window.partitionBy("query").orderBy(F.desc("id"))
    rows = queries.where("query is not null").withColumn("n", F.row_number().over(last)).where("n = 1")
    ids = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))))
    return rows.select("id", "query", F.coalesce("description", F.lit("")).alias("description"), ids(F.col("relevant_docs")).alias("relevant_docs"), ids(F.col("highly_relevant")).alias("highly_relevant"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """From a JSON file {"queries": [...]}; a missing file or malformed JSON gives no rows."""
    empty = spark.createDataFrame([], GROUND_TRUTH_SCHEMA)
    source = spark.read.schema(GROUND_TRUTH_SCHEMA).option("multiLine", True).json(path) if _exists(spark, path) else empty
    return ground_truth(source.where("queries is not null").select(F.inline("queries")))


class GroundTruth:
    """Look-ups in the judged queries, each a DataFrame of at most the asked rows."""

    def __init__(self, truth: DataFrame):
        self.truth = truth

    def get(self, query: str) -> DataFrame:
        return self.truth.where(F.col("query") == query)

    def has(self, query: str) -> bool:
        return not self.get(query).isEmpty()

    def list(self) -> DataFrame:
        return self.truth.select("query")

    def count(self) -> int:
        return self.truth.count()


def qrels(truth: DataFrame) -> DataFrame:
    """(query_id, doc_id, highly_relevant): one row for each relevant document."""
    rows = truth.select(F.col("id").alias("query_id"), F.explode("relevant_docs").alias("doc_id"), "highly_relevant")
    return rows.select("query_id", "doc_id", F.array_contains("highly_relevant", F.col("doc_id")).alias("highly_relevant")).distinct()


def _locations(kind: str) -> Callable:
    """Arrow function: addresses of the `kind` elements of sitemaps, with or without namespace or prefix; null for what is no XML."""

    def found(xml: str | None) -> list[str] | None:
        try:
            root = ElementTree.fromstring(xml.strip().encode())
        except (ElementTree.ParseError, AttributeError, ValueError):
            return None
        local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
        return [loc.text.strip() for e in root if local(e) == kind for loc in e if local(loc) == "loc" and loc.text and loc.text.strip()]

    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.map(lambda x: found(x if isinstance(x, str) else None))

    return F.pandas_udf(run, "array<string>")


def listed_urls(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_id, url) of all addresses in order, repeats kept; a map that is cut short gives none."""
    return sitemaps.select("sitemap_id", F.posexplode(_locations("url")("xml")).alias("position", "url"))


def sitemap_urls(sitemaps: DataFrame, part: str = "/ar/services/") -> DataFrame:
    """(sitemap_id, url) of the addresses that contain `part`, repeats kept; a map that is cut short gives none."""
    return listed_urls(sitemaps).where(F.col("url").contains(part)).select("sitemap_id", "url")


def sitemap_children(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_id, url) of the maps that an index lists."""
    return sitemaps.select("sitemap_id", F.explode(_locations("sitemap")("xml")).alias("url"))


def follow_sitemaps(spark: SparkSession, root: str, fetcher: Callable, part: str = "/ar/services/") -> DataFrame:
    """(position, url) of the addresses that a sitemap, or the maps an index lists, hold in order; repeats kept.

    Maps that an index lists are fetched by the executors. As in any index, these are maps of addresses: their own lists of
    maps are not followed. What can't be fetched or read gives nothing.
    """
    one = spark.createDataFrame([(root,)], "url string")
    first = materialise(fetch_pages(one, fetcher).where("status = 200 and html <> ''").select(F.lit(0).cast("bigint").alias("sitemap_id"), F.col("html").alias("xml")), "sitemap")
    children = first.select(F.posexplode(_locations("sitemap")("xml")).alias("sitemap_id", "url"))
    pages = materialise(fetch_pages(children, fetcher).where("status = 200 and html <> ''"), "sub-sitemaps")
    maps = children.join(pages.dropDuplicates(["url"]), "url").select(F.col("sitemap_id").cast("bigint").alias("sitemap_id"), F.col("html").alias("xml"))
    urls = listed_urls(first.unionByName(maps)).where(F.col("url").contains(part))
    return urls.select((F.col("sitemap_id") * (1 << 32) + F.col("position")).alias("position"), "url")


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{txt,html,md,json}") -> DataFrame:
    """(path, text) of each text file of a folder, in an order that doesn't depend on the run."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), F.col("value").alias("text")).orderBy(F.xxhash64("path", F.lit(42)))


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def shuffled(texts: DataFrame, text_col: str = "text", key_col: str = "doc_id", least: int = 300, seed: int = 42) -> DataFrame:
    """Texts of at least so many characters, in a pseudo-random order that doesn't depend on the run."""
    return texts.where(F.length(text_col) >= least).orderBy(F.xxhash64(key_col, F.lit(seed)), key_col)


def cache_path(folder: str, model: str) -> tuple[str, str]:
    """Table and metadata file of a model's embeddings; reduced-precision variants share those of the full model."""
    name = f"vector-{model.removesuffix('-int8')}"
    return f"{folder}/{name}.parquet", f"{folder}/{name}.meta.json"


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def write_embeddings(vectors: DataFrame, folder: str, model: str, model_id: str) -> None:
    """Vectors and what is known of them, through the cluster's file system."""
    spark = vectors.sparkSession
    data, meta = cache_path(folder, model)
    vectors.select("doc_id", "embedding").write.mode("overwrite").parquet(data)
    spark.read.parquet(data).agg(F.lit(model_id).alias("model_id"), F.count("*").alias("rows"), F.current_timestamp().alias("created_at")).write.mode("overwrite").json(meta)


def read_embeddings(spark: SparkSession, folder: str, model: str, model_id: str, documents: int | None = None) -> DataFrame | None:
    """The cached embeddings; None if either file is missing or they were made by another model. If they are not as many as
    `documents`, a warning says so."""
    data, meta = cache_path(folder, model)
    if not (_exists(spark, data) and _exists(spark, meta)):
        return None
    known = spark.read.schema("model_id string, rows bigint").json(meta).first()
    if known is None or known["model_id"] != model_id:
        return None
    if documents is not None and known["rows"] != documents:
        warnings.warn(f"{known['rows']} embeddings for {documents} documents", stacklevel=2)
    return spark.read.parquet(data)


def fetch_pages(urls: DataFrame, fetcher: Callable[[], Callable[[str], tuple[str | None, int, str | None]]], delay: float = 0.0) -> DataFrame:
    """(url, html, status, error) of each address. fetcher() is called once a task; what it raises becomes the error, with
    status 0. A task waits `delay` seconds between two requests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, first = fetcher(), True
        for frame in frames:
            rows = []
            for url in frame["url"]:
                if delay and not first:
                    time.sleep(delay)
                first = False
                try:
                    rows.append((url, *fetch(url)))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, 0, str(e)))
            yield pd.DataFrame(rows, columns=["url", "html", "status", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, status int, error string")
