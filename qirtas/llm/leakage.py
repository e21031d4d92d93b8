"""Evaluation texts that leak into training texts, by latent semantic retrieval of passages (problem 8).

Texts are cut into overlapping passages. A randomised SVD, computed over all passages of the corpus that can hold an item's
wording, gives the latent space of their TF-IDF vectors. Passages near an item's passage in that space are candidates; they
are checked for runs of equal words, and for paraphrases by their longest common subsequence and the item's figures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_batches, words

#: Words of a run that counts as leaked; passages hold twice as many and begin every so many words, so one holds any run whole.
RUN = 10
#: Dimensions of the latent space, extra ones while it is computed, and the least cosine of a candidate.
LATENT, EXTRA, COSINE = 128, 16, 0.5
#: Share of an item passage's words, in order, and of its figures that a paraphrase must have.
SUBSEQUENCE, FIGURES = 0.6, 0.5
#: The items are held on the driver and sent to every task in slices of so many words, one slice after the other.
ITEM_WORDS = 200_000

_FOLD = str.maketrans({c: "ا" for c in "أإآٱ"} | {"ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "ی": "ي"} | {chr(z + i): str(i) for z in (0x660, 0x6F0) for i in range(10)})
_FIGURE = re.compile(r"\d+")


def fold_words(text: str) -> list[str]:
    """Words without regard to digit shapes and Arabic spelling variants."""
    return words(text.translate(_FOLD)) if text else []


def run_hashes(ids: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the run of words that begins at each position."""
    n = len(ids) - run + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for k in range(run):
        out = (out ^ x[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    row = (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit) | (row - hit)
    return len(a) - bin(row & ((1 << len(a)) - 1)).count("1")


class Items:
    """The held-out items: vocabulary, passages, runs."""

    def __init__(self, rows: list[tuple[int, list[str]]], run: int = RUN):
        folded = [(i, [fold_words(t) for t in texts if t]) for i, texts in rows]
        self.run = run
        self.words = sorted({w for _, texts in folded for t in texts for w in t})
        self.vocabulary = {w: k for k, w in enumerate(self.words)}
        self.figures = frozenset(k for k, w in enumerate(self.words) if _FIGURE.fullmatch(w))
        self.runs: dict[int, list[int]] = {}
        passages, owners = [], []
        for item, texts in folded:
            for t in texts:
                ids = np.array([self.vocabulary[w] for w in t], dtype=np.int64)
                for h in set(run_hashes(ids, run).tolist()):
                    self.runs.setdefault(h, []).append(item)
                for at in range(0, max(1, len(ids) - run - run // 2), run // 2):
                    passages.append(ids[at : at + 2 * run])
                    owners.append(item)
        self.passages, self.owners = passages, np.array(owners, dtype=np.int64)
        self.runs = {h: sorted(set(v)) for h, v in self.runs.items()}

    def rows(self, idf: np.ndarray) -> _Rows:
        sizes = np.array([len(p) for p in self.passages], dtype=np.int64)
        end = np.cumsum(sizes)
        return _Rows(np.concatenate(self.passages) if len(sizes) else np.empty(0, np.int64), end - sizes, end, idf)


def _passages(ids: np.ndarray, offsets: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the passages of `2 * run` words that begin every `run` words of each text.

    ids holds the words of all texts, text k from offsets[k] to offsets[k + 1]. Passages with fewer than `run` item words are
    left out: neither a run nor a paraphrase of an item fits into them.
    """
    size = np.diff(offsets)
    n = np.where(size >= run, size // run, 0)
    text = np.repeat(np.arange(len(size)), n)
    start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * run
    end = np.minimum(start + 2 * run, offsets[text + 1])
    total = np.r_[0, np.cumsum(ids >= 0)]
    keep = total[end] - total[start] >= run
    return start[keep], end[keep], text[keep]


class _Rows:
    """Unit TF-IDF rows of passages as (row, column, value), sorted by row."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray, idf: np.ndarray):
        self.n, size = len(start), end - start
        row = np.repeat(np.arange(self.n), size)
        word = ids[np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(row))] if self.n else np.empty(0, np.int64)
        known = word >= 0
        pair, tf = np.unique(row[known] * len(idf) + word[known], return_counts=True)
        self.row, self.column = np.divmod(pair, max(1, len(idf)))
        value = tf * idf[self.column]
        norm = np.sqrt(np.bincount(self.row, weights=value**2, minlength=self.n))
        self.value = (value / np.where(norm > 0, norm, 1)[self.row]).astype(np.float32)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """rows @ matrix"""
        out = np.zeros((self.n, matrix.shape[1]), dtype=np.float32)
        if len(self.row):
            first = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
            out[self.row[first]] = np.add.reduceat(matrix[self.column] * self.value[:, None], first, axis=0)
        return out

    def transposed_times(self, matrix: np.ndarray, height: int) -> np.ndarray:
        """rows.T @ matrix"""
        out = np.zeros((height, matrix.shape[1]))
        if len(self.row):
            order = np.argsort(self.column, kind="stable")
            column = self.column[order]
            first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
            out[column[first]] = np.add.reduceat(matrix[self.row[order]] * self.value[order, None], first, axis=0)
        return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


class Leakage:
    """Leaks of one slice of items `(item_id, texts)` into a table of texts; leaks() takes a table of items of any size.

    Null texts and ids give nothing; texts and items shorter than a run can't leak one. Repeated rows count as one document;
    an empty table on either side gives no rows; other columns are ignored.
    """

    def __init__(self, docs: DataFrame, items: list[tuple[int, list[str]]], id_col: str = "doc_id", text_col: str = "text", run: int = RUN, latent: int = LATENT, cosine: float = COSINE):
        self.spark, self.run, self.cosine = docs.sparkSession, run, cosine
        self.items = Items(items, run)
        self.shared = self.spark.sparkContext.broadcast(self.items)
        shared = self.shared
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

        def make():
            vocabulary = shared.value.vocabulary
            seen: dict[str, int] = {}  # folding letters one by one never changes where words end, so words are folded once

            def number(w):
                if len(seen) > 300_000:
                    seen.clear()
                i = seen[w] = vocabulary.get(w.translate(_FOLD), -1)
                return i

            def step(batch):
                get = seen.get
                found = [[i if (i := get(w)) is not None else number(w) for w in words(t)] for t in batch.column(1).to_pylist()]
                return batch.column(0), found

            return step

        #: The words of each text as numbers of item words; all others are -1. Read by all later passes instead of the texts.
        self.coded = materialise(map_batches(texts, make, "doc_id bigint, ids array<int>"), "coded-texts")
        self.idf = self._document_frequencies()
        self.space = self._latent_space(latent)

    def _per_task(self, make, ddl: str) -> DataFrame:
        """A table of what make() gives for each task, from an object with add(ids) and rows()."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .common import schema_of

        schema = schema_of(ddl)
        target = to_arrow_schema(schema)

        def run(batches):
            add, rows = make()
            for batch in batches:
                for low in range(0, batch.num_rows, 2000):
                    add(*_flat(batch.column(0).slice(low, 2000)))
            columns = rows()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

        # Each task adds up what it reads, and there are no more tasks than the cluster runs twice over, whatever the input.
        return self.coded.select("ids").coalesce(2 * self.spark.sparkContext.defaultParallelism).mapInArrow(run, schema)

    def _document_frequencies(self) -> np.ndarray:
        size, run = len(self.items.words), self.run

        def make():
            counts = np.zeros(size + 1, dtype=np.int64)

            def add(ids, offsets):
                length = np.diff(offsets)
                text = np.repeat(np.arange(len(length)), length)
                part = (np.arange(len(ids)) - offsets[text]) // run
                counts[size] += ((length + run - 1) // run).sum()
                known = ids >= 0
                most = int(part.max(initial=0)) + 1
                pairs = np.unique((text[known] * most + part[known]) * size + ids[known]) if size else np.empty(0, np.int64)
                counts[:size] += np.bincount(pairs % max(1, size), minlength=size)[:size]

            return add, lambda: (np.arange(size + 1), counts)

        rows = self._per_task(make, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(size + 1)
        for r in rows:
            counts[r["term"]] = r["n"]
        return np.log1p((counts[size] + 1) / (counts[:size] + 1)).astype(np.float32)

    def _sum_of(self, function, height: int, width: int) -> np.ndarray:
        """The sum over all tasks of the matrix function(passages), added up by Spark."""
        idf, run = self.spark.sparkContext.broadcast(self.idf), self.run

        def make():
            total = np.zeros((height, width))

            def add(ids, offsets):
                start, end, _ = _passages(ids, offsets, run)
                total[:] += function(_Rows(ids, start, end, idf.value))

            return add, lambda: (np.arange(height), *total.T)

        names = [f"c{k}" for k in range(width)]
        parts = self._per_task(make, "term int, " + ", ".join(f"{c} double" for c in names))
        out = np.zeros((height, width))
        for r in parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)).collect():
            out[r["term"]] = r[1:]
        return out

    def _latent_space(self, latent: int) -> np.ndarray:
        """Right singular vectors (vocabulary x latent) of the TF-IDF matrix of passages, of items and corpus."""
        size = len(self.items.words)
        if not size:
            return np.zeros((0, 0), dtype=np.float32)
        width = min(size, latent + EXTRA)
        own = self.items.rows(self.idf)
        probe = np.random.default_rng(7).standard_normal((size, width)).astype(np.float32)
        ranged = self._sum_of(lambda a: a.transposed_times(a.times(probe), size), size, width) + own.transposed_times(own.times(probe), size)
        basis = np.linalg.qr(ranged)[0].astype(np.float32)
        small = self._sum_of(lambda a: (b := a.times(basis)).T @ b, width, width) + (b := own.times(basis)).T @ b
        values, vectors = np.linalg.eigh(small)
        return (basis @ vectors[:, np.argsort(-values)[: min(latent, width)]]).astype(np.float32)

    def candidates(self, checked: bool = True) -> DataFrame:
        """(doc_id, item_id, cosine, words_in_row, subsequence, figures) of each document and item with near passages.

        words_in_row tells if a run of `run` equal words was found in a near passage; subsequence and figures are the largest
        shares of an item passage. With `checked` only leaks stay: verbatim runs and paraphrases.
        """
        shared, bound, run = self.shared, self.cosine, self.run
        sent = self.spark.sparkContext.broadcast((self.idf, self.space))

        def make():
            items, (idf, space) = shared.value, sent.value

            def unit(a):
                norm = np.sqrt((a**2).sum(1, keepdims=True))
                return a / np.where(norm > 0, norm, 1)

            queries = unit(items.rows(idf).times(space))

            def step(batch):
                out = [[] for _ in range(6)]
                ids, offsets = _flat(batch.column(1))
                start, end, owner = _passages(ids, offsets, run)
                if not len(start) or not len(queries):
                    return None
                best: dict[tuple[int, int], list] = {}
                doc_ids = batch.column(0).to_pylist()
                near_space = unit(_Rows(ids, start, end, idf).times(space))
                for low in range(0, len(start), 500):
                    cosine = near_space[low : low + 500] @ queries.T
                    for k, q in zip(*np.nonzero(cosine >= bound)):
                        key = (doc_ids[owner[low + k]], int(items.owners[q]))
                        row = best.setdefault(key, [0.0, set(), {}])
                        row[0] = max(row[0], float(cosine[k, q]))
                        row[1].add(low + k)
                        if cosine[k, q] > row[2].get(low + k, (0.0, 0))[0]:
                            row[2][low + k] = (float(cosine[k, q]), int(q))
                hashes: dict[int, set[int]] = {}
                for (doc, item), (cos, near, top) in best.items():
                    exact, share, figures = False, 0.0, 0.0
                    for k in near:
                        if k not in hashes:
                            hashes[k] = {i for h in run_hashes(ids[start[k] : end[k]], run).tolist() for i in items.runs.get(h, ())}
                        exact = exact or item in hashes[k]
                        q = items.passages[top[k][1]]
                        if not exact:
                            share = max(share, common_subsequence(q.tolist(), ids[start[k] : end[k]].tolist()) / len(q))
                            own = set(q.tolist()) & items.figures
                            figures = max(figures, len(own & set(ids[start[k] : end[k]].tolist())) / len(own) if own else 1.0)
                    for column, v in zip(out, (doc, item, cos, exact, 1.0 if exact else share, 1.0 if exact else figures)):
                        column.append(v)
                return out

            return step

        found = map_batches(self.coded, make, "doc_id bigint, item_id bigint, cosine double, words_in_row boolean, subsequence double, figures double")
        best = found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "words_in_row", "subsequence", "figures")))
        leaked = F.col("words_in_row") | ((F.col("subsequence") >= SUBSEQUENCE) & (F.col("figures") >= FIGURES))
        return best.where(leaked) if checked else best


def item_slices(items: DataFrame, id_col: str = "item_id", text_cols: tuple[str, ...] = ("context", "question"), most: int = ITEM_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items (item_id, texts) in slices of about `most` words, at least one item each, read one partition at a time."""
    part, words_ = [], 0
    for r in items.where(F.col(id_col).isNotNull()).select(id_col, *text_cols).toLocalIterator():
        texts = [t for t in r[1:] if t]
        size = sum(len(t.split()) for t in texts)
        if part and words_ + size > most:
            yield part
            part, words_ = [], 0
        part.append((r[0], texts))
        words_ += size
    if part:
        yield part


def leaks(docs: DataFrame, items: DataFrame, checked: bool = True, most: int = ITEM_WORDS, **options) -> DataFrame:
    """(doc_id, item_id, cosine, words_in_row, subsequence, figures) of a table of items; see Leakage.candidates().

    Every slice of items has its own vocabulary and latent space; all documents are searched for each.
    """
    found = None
    for part in item_slices(items, most=most):
        own = Leakage(docs, part, **options).candidates(checked)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return Leakage(docs.limit(0), [], **options).candidates(checked)
    best = found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "words_in_row", "subsequence", "figures")))
    return best
