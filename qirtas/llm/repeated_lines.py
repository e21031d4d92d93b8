"""Lines repeated across the documents of one host (problem 2).

The lines of a host's documents become identifiers; the suffixes of these sequences are sorted, and runs of equal prefixes give
the repeated blocks of one and more lines with the number of documents that hold each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import materialise
from .common import host, schema_of

MIN_ROWS, MIN_SHARE = 5, 0.2
#: A block of two and more lines is removed from this share of its host's rows on, though its lines be less frequent alone.
BLOCK_SHARE = 0.05
#: Lines of a suffix that are sorted. A longer block comes out as blocks of so many lines that overlap: they cover the same lines.
DEPTH = 64


def line_key(line: Column) -> Column:
    """Identifier of a line: its letters in order without letter case; null for a line without a letter."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


def host_lines(df: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "content_text") -> DataFrame:
    """(id, row, site, host, at, line_no, key): the lettered lines of each document with a host and a text, at counting from 0.

    row tells documents apart, whatever their ids. A document without such lines has one row of nulls, so that it is counted.
    """
    docs = df.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(text_col).alias("text")).where("text is not null and host is not null")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), line_key(x).alias("key")))
    lettered = docs.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.xxhash64("host").alias("site"), "host", F.posexplode_outer(F.filter(lines, lambda x: x["key"].isNotNull())).alias("at", "x"))
    return lettered.select("id", "row", "site", "host", "at", "x.line_no", "x.key")


def frequent_lines(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, id_col: str = "id", url_col: str = "url", text_col: str = "content_text") -> DataFrame:
    """(site, key, docs): lines that occur in at least `min_rows` rows and `min_share` of their host's rows with text.

    A host has at most (its mean number of lines / min_share) of them, however many rows it has. Counts are aggregated
    before the shuffle, so a hot host costs its distinct lines, not its rows.
    """
    text, site = F.col(text_col), F.xxhash64(host(F.col(url_col)))
    docs = df.where(text.isNotNull() & host(F.col(url_col)).isNotNull()).select(site.alias("site"), text.alias("text"))
    keys = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: line_key(x)))
    total = F.lit(None).cast("long")
    # The null key stands for the row itself: one pass counts lines and rows of a host.
    counted = docs.select("site", F.explode(F.array_union(F.filter(keys, lambda x: x.isNotNull()), F.array(total))).alias("key")).groupBy("site", "key").agg(F.count("*").alias("docs"))
    rows = counted.where("key is null").select("site", F.col("docs").alias("rows"))
    lines = counted.where(F.col("key").isNotNull() & (F.col("docs") >= min_rows))
    return lines.join(rows, "site").where(F.col("docs") >= F.lit(min_share) * F.col("rows")).select("site", "key", "docs")


def _intervals(batches, schema, least: int):
    """LCP intervals of sorted suffixes, streamed: memory holds one suffix and its open prefixes only."""
    target = to_arrow_schema(schema)
    previous, stack, out = None, [], ([], [], [])

    def close(depth):
        below = 0
        while len(stack) > depth:
            n = stack.pop() + below
            below = n
            if n >= least:
                out[0].append(previous[0]), out[1].append(list(previous[1][: len(stack) + 1])), out[2].append(n)
        if stack:
            stack[-1] += below

    for batch in batches:
        for site, suffix, n in zip(*(c.to_pylist() for c in batch.columns)):
            common = 0
            if previous is not None and previous[0] == site:
                for a, b in zip(previous[1], suffix):
                    if a != b:
                        break
                    common += 1
            if previous is not None:
                close(common)
            stack += [0] * (len(suffix) - len(stack))
            stack[-1] += n
            previous = (site, suffix)
        if len(out[0]) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, target)], schema=target)
            out = ([], [], [])
    if previous is not None:
        close(0)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, target)], schema=target)


class RepeatedLines:
    """Repeated blocks of a table's hosts, by suffix arrays over line identifiers.

    Null texts, rows without a host and lines without a letter take no part; repeated rows count each; an empty table gives no
    rows; other columns are ignored. A line that occurs fewer than `min_rows` times can be in no block, so suffixes end before
    it. The table is read once; suffixes are counted before they are sorted, so a hot host costs its different suffixes.
    """

    def __init__(self, df: DataFrame, min_rows: int = MIN_ROWS, **columns: str):
        self.min_rows = min_rows
        self.lines = materialise(host_lines(df, **columns), "host-lines")
        self.sizes = self.lines.groupBy("site").agg(F.first("host").alias("host"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("rows"))
        lettered = self.lines.where("key is not null")
        often = lettered.groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select("site", "key")
        marked = lettered.join(often, ["site", "key"])
        by_row = Window.partitionBy("row").orderBy("at")
        runs = marked.withColumn("run", F.sum(F.when(F.col("at") - F.lag("at").over(by_row) == 1, 0).otherwise(1)).over(by_row))
        runs = runs.withColumn("left", F.row_number().over(Window.partitionBy("row", "run").orderBy(F.desc("at"))))
        found = runs.groupBy("row", "site", "id").agg(F.array_sort(F.collect_list(F.struct("at", "line_no", "key", "left"))).alias("found"))
        #: One row a document: its repeated lines in order, and how many follow each without a gap, itself included.
        self.runs = materialise(found.select("row", "site", "id", F.col("found.line_no").alias("numbers"), F.col("found.key").alias("keys"), F.col("found.left").alias("lefts")), "line-runs")
        self._blocks: DataFrame | None = None

    @staticmethod
    def _suffixes() -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("keys")), lambda i: F.slice("keys", i, F.least(F.lit(DEPTH), F.element_at("lefts", i))))

    def blocks(self) -> DataFrame:
        """(site, host, block, docs, rows): blocks of consecutive lettered lines in at least `min_rows` documents of a host."""
        if self._blocks is None:
            counted = self.runs.select("site", F.explode(self._suffixes()).alias("suffix")).groupBy("site", "suffix").agg(F.count("*").alias("n"))
            # A document's suffixes in order: a block that it holds k times is a prefix of k neighbours, hence of k - 1 common prefixes.
            own = self.runs.where("size(keys) > 1").select("site", F.array_sort(self._suffixes()).alias("all"))
            pair = own.select("site", F.explode(F.arrays_zip(F.slice("all", 1, F.size("all") - 1).alias("a"), F.slice("all", 2, F.size("all") - 1).alias("b"))).alias("p")).where("p.a[0] = p.b[0]")
            differ = F.array_position(F.zip_with("p.a", "p.b", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
            common = pair.select("site", F.slice("p.a", 1, F.when(differ > 0, differ - 1).otherwise(F.size("p.a")).cast("int")).alias("suffix"))
            again = common.groupBy("site", "suffix").agg((-F.count("*")).alias("n"))
            ordered = counted.unionByName(again).withColumn("first", F.col("suffix")[0]).repartition("site", "first").sortWithinPartitions("site", "suffix").select("site", "suffix", "n")
            schema, least = schema_of("site bigint, block array<bigint>, docs bigint"), self.min_rows
            found = ordered.mapInArrow(lambda batches: _intervals(batches, schema, least), schema)
            self._blocks = materialise(found.join(self.sizes, "site").select("site", "host", "block", "docs", "rows"), "line-blocks")
        return self._blocks

    def spanning(self, share: float) -> DataFrame:
        """The blocks in at least this share of their host's rows with text."""
        return self.blocks().where(F.col("docs") >= F.lit(share) * F.col("rows"))

    def places(self, share: float = MIN_SHARE) -> DataFrame:
        """(id, line_no) of every line that a block with this share covers, counted from 1."""
        covering = self.spanning(share).select("site", F.explode("block").alias("key")).distinct()
        return self.lines.where("key is not null").join(covering, ["site", "key"], "left_semi").select("id", "line_no").distinct()

    def block_places(self, share: float = BLOCK_SHARE) -> DataFrame:
        """(id, line_no) of every line of an occurrence of a block of two and more lines with this share."""
        blocks = self.spanning(share).where("size(block) > 1").select("site", F.col("block")[0].alias("a"), F.col("block")[1].alias("b"), "block")
        at = F.transform(F.sequence(F.lit(1), F.size("keys")), lambda i: F.struct(F.slice("keys", i, F.least(F.lit(DEPTH), F.element_at("lefts", i))).alias("suffix"), F.slice("numbers", i, DEPTH).alias("numbers")))
        starts = self.runs.select("site", "id", F.explode(at).alias("x")).where("size(x.suffix) > 1").select("site", "id", "x.suffix", "x.numbers", F.col("x.suffix")[0].alias("a"), F.col("x.suffix")[1].alias("b"))
        held = starts.join(blocks, ["site", "a", "b"]).where(F.slice("suffix", 1, F.size("block")) == F.col("block"))
        return held.select("id", F.explode(F.slice("numbers", 1, F.size("block"))).alias("line_no")).distinct()


def repeated_line_places(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, **columns: str) -> DataFrame:
    """(id, line_no) of every line that a repeated block of its host covers, counted from 1, once for each id."""
    return RepeatedLines(df, min_rows, **columns).places(min_share)


def repeated_line_blocks(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, **columns: str) -> DataFrame:
    """(site, host, block, docs, rows): blocks of one and more lines, as hashes of their letters, with their exact numbers of documents."""
    return RepeatedLines(df, min_rows, **columns).spanning(min_share)


def remove_repeated_lines(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, block_share: float | None = BLOCK_SHARE, id_col: str = "id", url_col: str = "url", text_col: str = "content_text") -> DataFrame:
    """(id, clean_text, removed): every text without its host's repeated lines, and without its blocks of lines that span
    `block_share` of the host's rows (None: lines only). Null texts stay null; rows are kept."""
    found = RepeatedLines(df, min_rows, id_col=id_col, url_col=url_col, text_col=text_col)
    places = found.places(min_share)
    if block_share is not None:
        places = places.unionByName(found.block_places(block_share))
    drop = places.groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drop, "id", "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("drop", (i + 1).cast("int")))
    clean = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return texts.select("id", clean.alias("clean_text"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))
