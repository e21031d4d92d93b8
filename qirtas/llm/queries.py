"""Queries over the training-data operators, named pN_..., and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .language import identify_languages, mislabelled
from .leakage import leaks
from .lookalikes import unify_lookalikes
from .main_body import MainBody, main_body
from .markup import clean_markup
from .mixing import Mix, count_tokens
from .near_duplicates import NearDuplicates
from .repeated_lines import remove_repeated_lines, repeated_line_blocks, repeated_line_places
from .splitting import split_oversized
from .template_residue import template_residue


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "crawl_documents")).select("id").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "crawl_documents"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_line_places(table(spark, sf, "crawl_documents"))


def p2_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_line_blocks(table(spark, sf, "crawl_documents"))


def p2_block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many blocks of so many lines span so many documents of a host."""
    return p2_blocks(spark, sf).groupBy("host", F.size("block").alias("lines"), "docs").agg(F.count("*").alias("blocks"))


def p2_clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf, "crawl_documents"))


def _page_duplicates(spark: SparkSession, sf: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf, "crawl_documents"), shingle=3, similarity=0.55, min_words=100)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _page_duplicates(spark, sf).pairs()


def p3_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8: each page's class of equal texts and its number of links."""
    return NearDuplicates(table(spark, sf, "crawl_documents")).documents()


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    """Linked pairs of class representatives; p3_classes has the members."""
    return _page_duplicates(spark, sf).links()


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _page_duplicates(spark, sf).classes()


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _page_duplicates(spark, sf).groups()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return unify_lookalikes(table(spark, sf, "crawl_documents")).select("id", F.explode("lines").alias("line_no")).distinct()


def p4_clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return unify_lookalikes(table(spark, sf, "crawl_documents")).select("id", "clean_text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return MainBody(table(spark, sf, "crawl_documents")).line_numbers()


def p5_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return main_body(table(spark, sf, "crawl_documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return template_residue(table(spark, sf, "crawl_documents")).select("id").distinct()


def p7_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return template_residue(table(spark, sf, "crawl_documents")).groupBy("reason").agg(F.count("*").alias("pages"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return clean_markup(table(spark, sf, "crawl_documents")).select("id", F.explode("markup").alias("markup")).distinct()


def p6_clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return clean_markup(table(spark, sf, "crawl_documents")).select("id", "clean_text")


def _mix(spark: SparkSession, sf: str) -> Mix:
    return Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each record occurs in the mix."""
    return _mix(spark, sf).copies()


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Achieved beside target shares of each source."""
    return _mix(spark, sf).shares()


def p9_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return mislabelled(identify_languages(table(spark, sf, "documents")))


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    return identify_languages(table(spark, sf, "documents")).select("doc_id", "lang", "confidence", F.explode("segments").alias("segment")).select("doc_id", "lang", "confidence", F.col("segment.no").alias("paragraph"), F.col("segment.lang").alias("paragraph_lang"), F.col("segment.confidence").alias("paragraph_confidence"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "stress_cases"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("words_in_row").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_LINES = r"""
        pages AS (
            SELECT id, regexp_extract(url, '//([^/]*)', 1) AS site, string_split(content_text, chr(10)) AS ls
            FROM crawl_documents WHERE content_text IS NOT NULL AND regexp_extract(url, '//([^/]*)', 1) <> ''),
        lines AS (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS pos FROM (
                SELECT id, site, CAST(i AS INTEGER) AS line_no, regexp_replace(lower(ls[i]), '[^\p{L}]+', '', 'g') AS letters
                FROM (SELECT id, site, ls, unnest(range(1, len(ls) + 1)) AS i FROM pages)) WHERE letters <> ''),
        sizes AS (SELECT site, count(*) AS n FROM pages GROUP BY site),
        often AS (
            SELECT l.site, letters FROM lines l JOIN sizes s ON l.site = s.site
            GROUP BY l.site, letters, n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.2 * n)"""
SQL: dict[str, str] = {
    "p1_found": "SELECT id FROM crawl_documents WHERE length(content_text) > 4000",
    "p2_found": f"WITH {_LINES} SELECT id, line_no FROM lines JOIN often USING (site, letters)",
    # Blocks are enumerated over the lines that are frequent alone, as every line of a block is.
    "p2_block_sizes": f"""WITH {_LINES},
        marked AS (SELECT l.*, l.pos - row_number() OVER (PARTITION BY l.id ORDER BY l.pos) AS run FROM lines l JOIN often o ON l.site = o.site AND l.letters = o.letters),
        runs AS (SELECT site, id, list(letters ORDER BY pos) AS ls FROM marked GROUP BY site, id, run),
        blocks AS (SELECT DISTINCT site, id, ls[i:j] AS block FROM (SELECT *, unnest(range(i, least(len(ls), i + 63) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM runs))),
        spans AS (SELECT b.site, block, count(*) AS docs FROM blocks b JOIN sizes s ON s.site = b.site GROUP BY b.site, block, n HAVING count(*) >= 5 AND count(*) >= 0.2 * n)
        SELECT site AS host, CAST(len(block) AS INTEGER) AS lines, docs, count(*) AS blocks FROM spans GROUP BY site, len(block), docs""",
    # Every line of a block on 5 % of the rows is on 5 % of the rows itself.
    "p2_clean_texts": f"""WITH {_LINES},
        fairly AS (SELECT l.site, letters FROM lines l JOIN sizes s ON l.site = s.site GROUP BY l.site, letters, n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.05 * n),
        marked AS (SELECT l.*, l.pos - row_number() OVER (PARTITION BY l.id ORDER BY l.pos) AS run FROM lines l JOIN fairly o ON l.site = o.site AND l.letters = o.letters),
        runs AS (SELECT site, id, list(letters ORDER BY pos) AS ls, list(line_no ORDER BY pos) AS ns FROM marked GROUP BY site, id, run),
        subs AS (SELECT site, id, ls[i:j] AS block, ns[i:j] AS numbers FROM (SELECT *, unnest(range(i + 1, least(len(ls), i + 63) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM runs))),
        spans AS (SELECT b.site, block FROM (SELECT DISTINCT site, id, block FROM subs) b JOIN sizes s ON s.site = b.site GROUP BY b.site, block, n HAVING count(*) >= 5 AND count(*) >= 0.05 * n),
        dropped AS (SELECT id, line_no FROM lines JOIN often USING (site, letters) UNION SELECT id, unnest(numbers) FROM subs JOIN spans USING (site, block)),
        gone AS (SELECT id, list(line_no) AS d FROM dropped GROUP BY id)
        SELECT c.id, CASE WHEN d IS NULL THEN content_text ELSE coalesce(array_to_string(list_filter(string_split(content_text, chr(10)), lambda x, i: NOT list_contains(d, i)), chr(10)), '') END AS clean_text, CAST(coalesce(len(d), 0) AS INTEGER) AS removed
        FROM crawl_documents c LEFT JOIN gone USING (id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
