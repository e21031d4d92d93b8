"""A crawl from end to end: check, discover, choose, limit, fetch, parse, upsert, count."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as ig
from ..session import materialise
from ..sources import tables as src
from ..streaming.crawl import VersionedTable, to_fetched

Fetcher = Callable[[], Callable[[str], tuple[str | None, int, str | None]]]


class Bot(ABC):
    """A site: how its addresses are found, how a page is parsed, and whether it can be crawled now."""

    name: str

    @abstractmethod
    def urls(self, spark: SparkSession) -> DataFrame:
        """(position, url) in order of discovery."""

    @abstractmethod
    def parser(self) -> Callable[[str | None], str | None]:
        """A function that gives a page's clean text, None if there is none. It is sent to the tasks, without the bot."""

    @abstractmethod
    def check(self) -> tuple[bool, str]:
        """Whether the site answers, and a message."""


@dataclass(frozen=True)
class SitemapBot(Bot):
    """A site that lists its service pages in a sitemap or an index of sitemaps."""

    name: str
    fetcher: Fetcher
    home: str
    sitemap: str
    sample: str
    part: str = "/ar/services/"
    marker: str = ig.MARKER

    def urls(self, spark):
        return src.follow_sitemaps(spark, self.sitemap, self.fetcher, self.part)

    def parser(self):
        return partial(ig.html_to_markdown, marker=self.marker)

    def check(self):
        """The main page answers, and a sample page parses to a text with the marker."""
        fetch = self.fetcher()
        for what, url in (("Main site", self.home), ("Sample page fetch", self.sample)):
            html, status, error = fetch(url)
            if status != 200 or not html:
                return False, f"{what} failed: {status}, {error}"
        text = self.parser()(html)
        if not text:
            return False, "Parsing failed: no content extracted"
        if self.marker not in text:
            return False, f"Breadcrumb marker '{self.marker}' not found in parsed content"
        return True, "Main site OK, Parsing OK, Marker found"


@dataclass(frozen=True)
class ListBot(Bot):
    """Addresses from a table (url), pages by any fetcher and parser."""

    name: str
    listed: DataFrame
    parse: Callable[[str | None], str | None] = ig.html_to_markdown

    def urls(self, spark):
        return self.listed.select(F.monotonically_increasing_id().alias("position"), "url")

    def parser(self):
        return self.parse

    def check(self):
        return True, f"{self.name} lists addresses"


def site_test(name: str, call: Callable[[], tuple[bool, str]]) -> tuple[str, bool, str]:
    """(name, passed, message) of a test; what it raises is its message."""
    try:
        passed, message = call()
    except Exception as e:  # noqa: BLE001
        passed, message = False, f"Exception: {e}"
    return name, bool(passed), message


def round_trip(spark: SparkSession, folder: str) -> tuple[bool, str]:
    """Write, read and delete a document in the folder of the document table."""
    jvm = spark.sparkContext._jvm
    path = f"{folder.rstrip('/')}/preflight"
    spark.createDataFrame([("https://preflight.example/", "x")], "url string, content_text string").write.mode("overwrite").parquet(path)
    held = spark.read.parquet(path).count()
    at = jvm.org.apache.hadoop.fs.Path(path)
    gone = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return held == 1 and gone, f"wrote 1, read {held}, deleted {gone}"


def checks(bot: Bot, docs: DataFrame, fetcher: Fetcher, folder: str | None = None) -> list[tuple[str, bool, str]]:
    """All checks before a crawl: the table, the folder, the fetcher, the site."""
    spark = docs.sparkSession
    # What an upsert relies on; other faults of the table are no reason not to crawl.
    found = [tuple(r) for r in ig.preflight(docs).where(F.col("name").isin("keys_present", "urls_unique")).collect()]
    if folder:
        found.append(site_test("storage round trip", lambda: round_trip(spark, folder)))
    found.append(site_test("fetcher", lambda: (callable(fetcher()), "fetcher ready")))
    return [*found, site_test(f"{bot.name} preflight", bot.check)]


def failures(found: list[tuple[str, bool, str]]) -> list[str]:
    """What failed; empty if all passed."""
    return [f"{name}: {message}" for name, passed, message in found if not passed]


@dataclass
class CrawlRun:
    """documents is the new table, None if nothing was fetched; failed holds the checks that stopped the run."""

    documents: DataFrame | None
    counters: dict[str, int]
    checks: list[tuple[str, bool, str]]

    @property
    def failed(self) -> list[str]:
        return failures(self.checks)


NOTHING = {"total": 0, "success": 0, "failed": 0, "skipped": 0}


def crawl(bot: Bot, docs: DataFrame, fetcher: Fetcher, max_pages: int | None = None, refresh: bool = False, retry_failed: bool = False, refresh_days: int | None = None, run_preflight: bool = True, delay: float = 1.0, now: datetime | None = None, folder: str | None = None) -> CrawlRun:
    """One crawl. A run whose checks fail fetches nothing. Fetched pages are written before they are parsed, so that an executor
    that is lost later costs no second request. `delay` seconds pass between two requests of a task."""
    moment = now or datetime.now(timezone.utc)
    found = checks(bot, docs, fetcher, folder) if run_preflight else []
    if failures(found):
        return CrawlRun(None, dict(NOTHING), found)
    spark = docs.sparkSession
    listed = bot.urls(spark).groupBy("url").agg(F.min("position").alias("position"))
    wanted = ig.urls_to_crawl(listed, docs, refresh, retry_failed, refresh_days, moment)
    chosen = ig.first_pages(listed.join(wanted, "url", "left_semi"), max_pages)
    pages = materialise(src.fetch_pages(chosen, fetcher, delay), "fetched-pages")
    fetched = materialise(to_fetched(pages, bot.parser()), "parsed-pages")
    counters = ig.crawl_counters(fetched).first().asDict()
    return CrawlRun(ig.upsert(docs, fetched, moment) if counters["total"] else None, counters, found)


def web_fetcher(timeout: float = 30.0, agent: str = "qirtas") -> Fetcher:
    """Pages over HTTP with the standard library."""

    def make():
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        def fetch(url):
            try:
                with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:  # noqa: S310
                    return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), answer.status, None
            except HTTPError as e:
                return None, e.code, f"HTTP {e.code}"

        return fetch

    return make


def main(argv: list[str] | None = None) -> int:
    """Command line: crawl a site into the next version of a document table."""
    import argparse

    from ..session import get_spark

    args = argparse.ArgumentParser(prog="qirtas crawl")
    args.add_argument("--site", required=True, help="address of the main page")
    args.add_argument("--sitemap", help="default: sitemap.xml of the site")
    args.add_argument("--sample", help="page for the check; default: the main page")
    args.add_argument("--part", default="/ar/services/")
    args.add_argument("--table", required=True, help="folder of the versions of the document table")
    args.add_argument("--version", type=int, default=0, help="version to read; the next one is written")
    args.add_argument("--max-pages", type=int)
    mode = args.add_mutually_exclusive_group()
    mode.add_argument("--refresh", action="store_true")
    mode.add_argument("--retry-failed", action="store_true")
    mode.add_argument("--refresh-days", type=int, metavar="DAYS")
    args.add_argument("--no-preflight", action="store_true")
    args.add_argument("--delay", type=float, default=1.0, metavar="SECONDS")
    got = args.parse_args(argv)
    spark = get_spark()
    versions = VersionedTable(spark, got.table)
    docs = versions.read(got.version) if versions.exists(got.version) else spark.createDataFrame([], src.DOCUMENT_SCHEMA)
    fetcher = web_fetcher()
    bot = SitemapBot("site", fetcher, got.site, got.sitemap or f"{got.site.rstrip('/')}/sitemap.xml", got.sample or got.site, got.part)
    run = crawl(bot, docs, fetcher, got.max_pages, got.refresh, got.retry_failed, got.refresh_days, not got.no_preflight, got.delay, folder=got.table)
    for name, passed, message in run.checks:
        print("ok    " if passed else "FAILED", name, message)
    if run.failed:
        return 1
    if run.documents is not None:
        run.documents.write.mode("overwrite").parquet(versions.path(got.version + 1))
    print("  ".join(f"{k}: {v}" for k, v in run.counters.items()))
    return 0
