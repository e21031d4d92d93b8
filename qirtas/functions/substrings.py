"""Counting of words as substrings of texts, in a grid of blocks, with the best texts of each query."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that are held in a task, and bytes of texts that are searched at once.
QUERY_BLOCK, TEXT_BLOCK = 4096, 16 << 20
#: As in split_simple.
WHITE_SPACE = r"[\s\x0b\x{85}\p{Z}]+"


def top_k_counts(words: DataFrame, texts: DataFrame, n_bytes: int, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): occurrences of the (query_id, word) of a query in each (doc_id, text) that has any.

    A word has no white space and isn't empty; it counts as often as a query has it. With `k` only what can be among the k best
    of a query comes out, ties going to the lower doc_id. Queries and texts meet in the cells of a grid, one task a cell: blocks
    of about QUERY_BLOCK queries times slices of the texts, of which there are n_bytes. So a text goes once to each block of
    queries, and neither the pairs of words and texts nor those of queries and texts go over the network.
    """
    spark = words.sparkSession
    blocks = -(-words.select("query_id").distinct().count() // QUERY_BLOCK) or 1
    slices = max(1, spark.sparkContext.defaultParallelism // blocks, -(-n_bytes // TEXT_BLOCK))
    cell = lambda block, part: (block * slices + part).cast("int").alias("cell")
    block, own = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), F.pmod(F.xxhash64("doc_id"), F.lit(slices))
    left = words.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "query_id", "word").select(cell(block, F.col("slice")), "query_id", "word")
    right = texts.where("text <> ''").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "doc_id", "text").select(cell(F.col("block"), own), "doc_id", "text")
    kinds = f"query_id {words.schema['query_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double"
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell(k), kinds)


class _Chunks:
    """What stands between white space in the texts, each different chunk once, with the texts that hold it."""

    def __init__(self, rows: np.ndarray, texts: pa.Array):
        split = pc.split_pattern_regex(texts, pattern=WHITE_SPACE)
        coded = split.flatten().dictionary_encode()
        code, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self.rows = np.repeat(rows, pc.list_value_length(split).to_numpy())[np.argsort(code, kind="stable")]
        self.size = np.bincount(code, minlength=len(chunks))
        self.first = np.cumsum(self.size) - self.size
        self.joined = "\n".join(chunks)  # no chunk and no word has white space
        self.starts = np.cumsum([0, *(len(c) + 1 for c in chunks[:-1])])
        self.n_rows = int(rows.max()) + 1

    def count(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have the word, and how often; no occurrences overlap."""
        places, at = [], self.joined.find(word)
        while at >= 0:
            places.append(at)
            at = self.joined.find(word, at + len(word))
        held, n = np.unique(np.searchsorted(self.starts, places, "right") - 1, return_counts=True)
        size = self.size[held]
        at = np.repeat(self.first[held] - np.cumsum(size) + size, size) + np.arange(size.sum())
        total = np.bincount(self.rows[at], np.repeat(n, size), self.n_rows)
        found = np.flatnonzero(total)
        return found, total[found]


def _cell(k: int | None):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, docs, scores = [], [], []
        if len(left) and len(right):
            right = right.take(pc.sort_indices(right, [("doc_id", "ascending")], null_placement="at_start"))
            # Rows of one id are one text; numbers are in the order of the ids.
            ids = right.column("doc_id").combine_chunks().dictionary_encode("encode")
            asked = left.column("query_id").combine_chunks().dictionary_encode("encode")
            chunks = _Chunks(ids.indices.to_numpy(), right.column("text").combine_chunks())
            wanted: dict[int, Counter] = defaultdict(Counter)
            for query, word in zip(asked.indices.to_pylist(), left.column("word").to_pylist()):
                wanted[query][word] += 1
            counts = {word: chunks.count(word) for word in set().union(*wanted.values())}
            for query, own in wanted.items():
                total = np.zeros(chunks.n_rows)
                for word, times in own.items():
                    total[counts[word][0]] += times * counts[word][1]
                found = np.flatnonzero(total)
                if k and len(found) > k:
                    found = found[total[found] >= np.partition(total[found], -k)[-k]]
                    found = found[np.argsort(-total[found], kind="stable")[:k]]
                queries.append(np.full(len(found), query))
                docs.append(found)
                scores.append(total[found])
        if not queries:
            return pa.table({"query_id": left.column("query_id")[:0], "doc_id": right.column("doc_id")[:0], "score": pa.array([], pa.float64())})
        return pa.table({"query_id": asked.dictionary.take(pa.array(np.concatenate(queries))), "doc_id": ids.dictionary.take(pa.array(np.concatenate(docs))), "score": pa.array(np.concatenate(scores))})

    return best
