"""Landed pages as a stream: each micro-batch is parsed and upserted into a new version of the document table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import classify_fetch, html_to_markdown, parse_pages, upsert

PAGE_SCHEMA = "url string, html string, status int, error string"


def to_fetched(pages: DataFrame, parse: Callable[[str | None], str | None] = html_to_markdown) -> DataFrame:
    """(url, content_raw, content_text, crawl_status, http_status, error_message) of fetched pages."""
    outcome = classify_fetch(F.col("status"), F.col("html"), F.col("content_text"), F.col("error"))
    parsed = parse_pages(pages, parse).withColumn("outcome", outcome)
    # Of a failed fetch no markup is kept; it stays where only parsing failed.
    raw = F.when(F.col("status") == 200, F.col("html"))
    return parsed.select("url", raw.alias("content_raw"), "content_text", "outcome.crawl_status", F.col("status").alias("http_status"), "outcome.error_message")


class VersionedTable:
    """Parquet folders v0, v1, ... of one table; a version is never overwritten, so readers and restarts see whole tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, version: int) -> str:
        return f"{self.folder}/v{version}"

    def exists(self, version: int) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(version))
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(version))


def upsert_stream(pages: DataFrame, target: VersionedTable, checkpoint: str, now: datetime | None = None, once: bool = True) -> StreamingQuery:
    """Batch b turns version b into b + 1. A batch that is repeated after a failure reads the same version and writes the same next one."""

    def step(batch: DataFrame, number: int) -> None:
        moment = now or datetime.now(timezone.utc)
        upsert(target.read(number), to_fetched(batch), moment).write.mode("overwrite").parquet(target.path(number + 1))

    writer = pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
