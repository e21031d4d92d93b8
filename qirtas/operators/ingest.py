"""Crawl ingest: which addresses to fetch, what a fetch gave, page parsing and keyed upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

#: The link with which the body of a service page begins.
MARKER = "[الخدمات](/ar/services)"
# Elements that are left out.
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "iframe", "noscript"))


# Refresh filters: (url) of the addresses to fetch, given documents and the time of the run.
def refresh_all(urls: DataFrame) -> DataFrame:
    return urls.select("url")


def refresh_failed(urls: DataFrame, docs: DataFrame) -> DataFrame:
    return urls.select("url").join(docs.where("crawl_status = 'failed'").select("url"), "url", "left_semi")


def refresh_age(urls: DataFrame, docs: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Unknown addresses, and those whose document was updated before `as_of` less so many days."""
    newest = docs.groupBy("url").agg(F.max("updated_at").alias("updated_at"))
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return urls.select("url").join(newest, "url", "left").where(F.col("updated_at").isNull() | (F.col("updated_at") < limit)).select("url")


def refresh_default(urls: DataFrame, docs: DataFrame) -> DataFrame:
    """Unknown addresses and those not crawled with success."""
    return urls.select("url").join(docs.where("crawl_status = 'success'").select("url"), "url", "left_anti")


def urls_to_crawl(urls: DataFrame, docs: DataFrame, refresh: bool = False, retry_failed: bool = False, refresh_days: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """By the first mode that is set: refresh, retry_failed, refresh_days, else the default."""
    if refresh:
        return refresh_all(urls)
    if retry_failed:
        return refresh_failed(urls, docs)
    if refresh_days is not None:
        return refresh_age(urls, docs, as_of or datetime.now(timezone.utc), refresh_days)
    return refresh_default(urls, docs)


def first_pages(urls: DataFrame, most: int | None, position: str = "position") -> DataFrame:
    """The first addresses in order of discovery; all for 0 or None."""
    return urls.orderBy(position).limit(most) if most else urls


def classify_fetch(status: Column, html: Column, text: Column, error: Column) -> Column:
    """struct(crawl_status, error_message) of a fetch and what was parsed from it."""
    failed = lambda message: F.struct(F.lit("failed").alias("crawl_status"), message.alias("error_message"))
    bad = (status != 200) | status.isNull() | html.isNull() | (html == "")
    return (
        F.when(bad, failed(F.coalesce(error, F.concat(F.lit("HTTP "), F.coalesce(status, F.lit(0)).cast("string")))))
        .when(text.isNull() | (text == ""), failed(F.lit("Parsing failed: no content extracted")))
        .otherwise(F.struct(F.lit("success").alias("crawl_status"), F.lit(None).cast("string").alias("error_message")))
    )


class _Markdown(HTMLParser):
    """HTML to Markdown with ATX headings; elements in DROPPED are left out with all they hold."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.lists, self.links, self.pre, self.cells = [], [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip.append(tag)
        if self.skip:
            return
        if tag in ("p", "div", "section", "article", "main", "aside", "table", "tr", "blockquote", "pre", "ul", "ol", "br", "hr", "body"):
            self.out.append("\n")
        if tag == "blockquote":
            self.out.append("> ")
        if tag == "hr":
            self.out.append("---\n")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self.out.append("\n" + "  " * depth + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "* "))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            if self.links[-1]:
                self.out.append("[")
        elif tag == "img":
            found = dict(attrs)
            self.out.append(f"![{found.get('alt') or ''}]({found.get('src') or ''})")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "blockquote"):
            self.out.append("\n")
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr":
            self.out.append("|")
        elif tag == "a" and self.links and (to := self.links.pop()):
            self.out.append(f"]({to})")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else " ".join(data.split()) if data.strip() == data else (" " if data[:1].isspace() else "") + " ".join(data.split()) + (" " if data[-1:].isspace() and data.strip() else ""))


def html_to_markdown(page: str | None, marker: str = MARKER) -> str | None:
    """Markdown of a page's body from the marker on, without blank lines; None for a page without a body or text."""
    if not page or "<body" not in page.lower():
        return None
    parser = _Markdown()
    at = page.lower().find("<body")
    parser.feed(page[at:])
    parser.close()
    text = "".join(parser.out)
    if (at := text.find(marker)) >= 0:
        text = text[at:]
    # Blank lines go; others keep their indentation, as code and nested lists need it.
    return "\n".join(line.rstrip() for line in text.split("\n") if line.strip()).strip() or None


def parse_pages(pages: DataFrame, parse: Callable[[str | None], str | None] = html_to_markdown, html_col: str = "html") -> DataFrame:
    """The pages with `content_text`, parsed in Arrow batches."""

    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.map(lambda x: parse(x if isinstance(x, str) else None))

    return pages.withColumn("content_text", F.pandas_udf(run, "string")(F.col(html_col)))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """(column, no): numbers from 1 in order of a unique column, without a sort of all rows in one task.

    Range partitions are written once; each is numbered by itself and shifted by the size of those before it.
    """
    parts = materialise(rows.select(column).repartitionByRange(column).withColumn("part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return parts.join(F.broadcast(shifts), "part").select(column, (F.col("shift") + own).alias("no"))  # one row a partition


def upsert(docs: DataFrame, fetched: DataFrame, now: datetime) -> DataFrame:
    """The whole new document table after fetches (url, content_raw, content_text, crawl_status, http_status, error_message).

    One row an address: a fetched address is updated or added. Success replaces both contents and clears the error. Failure
    replaces the markup (null if none came) and keeps the text. id and created_at never change; new ids follow the largest
    one in order of address. Of several fetches of one address the last in order of status and markup counts. Plain Parquet has
    no MERGE: write the result to another path.
    """
    one = Window.partitionBy("url").orderBy(F.desc("crawl_status"), F.desc("content_raw"))
    news = fetched.withColumn("n", F.row_number().over(one)).where("n = 1").select("url", *(F.col(c).alias(f"new_{c}") for c in ("content_raw", "content_text", "crawl_status", "http_status", "error_message")), F.lit(True).alias("fetched"))
    both = docs.join(news, "url", "full")
    got, ok = F.col("fetched").isNotNull(), F.col("new_crawl_status") == "success"
    time = F.lit(now).cast("timestamp")
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = numbered(news.join(docs.select("url"), "url", "left_anti"), "url").join(F.broadcast(top)).select("url", (F.col("top") + F.col("no")).alias("new_id"))
    out = both.join(fresh, "url", "left")
    pick = lambda c: F.when(got, F.col(f"new_{c}")).otherwise(F.col(c))
    return out.select(
        F.coalesce("id", "new_id").alias("id"), "url", pick("content_raw").alias("content_raw"),
        F.when(got & (ok | (F.col("new_crawl_status") == "pending")), F.col("new_content_text")).otherwise(F.col("content_text")).alias("content_text"),
        F.coalesce("created_at", time).alias("created_at"), F.when(got, time).otherwise(F.col("updated_at")).alias("updated_at"), F.when(got, time).otherwise(F.col("crawled_at")).alias("crawled_at"),
        pick("crawl_status").alias("crawl_status"), pick("http_status").alias("http_status"),
        F.when(got & ok, F.lit(None)).when(got, F.col("new_error_message")).otherwise(F.col("error_message")).alias("error_message"),
    )


def insert(docs: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """The table with new (url, content_raw, content_text) rows as `pending` where they have no status; known addresses stay as they are."""
    ready = rows.withColumns({c: F.coalesce(F.col(c) if c in rows.columns else F.lit(None), F.lit(d)).cast(t) for c, d, t in (("crawl_status", "pending", "string"), ("http_status", None, "int"), ("error_message", None, "string"))})
    fresh = ready.join(docs.select("url"), "url", "left_anti")
    added = upsert(docs.limit(0), fresh, now)
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return docs.unionByName(added.join(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top")).drop("top").select(*docs.columns))


def delete_url(docs: DataFrame, url: str) -> DataFrame:
    return docs.where(~F.col("url").eqNullSafe(url))


def crawl_counters(fetched: DataFrame) -> DataFrame:
    """total, success, failed and skipped of a crawl; nothing is ever skipped."""
    status = F.col("crawl_status")
    return fetched.agg(F.count("*").alias("total"), F.count_if(status == "success").alias("success"), F.count_if(status == "failed").alias("failed"), F.lit(0).cast("long").alias("skipped"))


def preflight(docs: DataFrame) -> DataFrame:
    """(name, passed, message) of checks of the document table, in one pass."""
    c = docs.agg(
        F.count("*").alias("rows"), F.count_if(F.col("id").isNull() | F.col("url").isNull()).alias("keyless"), F.countDistinct("url").alias("urls"), F.count("url").alias("with_url"),
        F.count_if(~F.col("crawl_status").isin("pending", "success", "failed")).alias("odd"), F.count_if((F.col("crawl_status") == "success") & F.col("content_text").isNull()).alias("textless"),
    )
    checks = (("has_rows", F.col("rows") > 0, "rows"), ("keys_present", F.col("keyless") == 0, "keyless"), ("urls_unique", F.col("urls") == F.col("with_url"), "urls"), ("known_status", F.col("odd") == 0, "odd"), ("success_has_text", F.col("textless") == 0, "textless"))
    return c.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), p.alias("passed"), F.concat(F.lit(f"{m}="), F.col(m).cast("string")).alias("message")) for n, p, m in checks))).alias("c")).select("c.*")
