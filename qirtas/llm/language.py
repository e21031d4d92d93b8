"""Languages of documents and of their paragraphs by character language models (problem 10).

One interpolated Kneser-Ney model per language, its n-gram probabilities and back-off weights in sorted arrays of hashes. A
paragraph gets the language of the lowest cross-entropy per character; one that no model expects is rejected as `und`.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches

#: Documents per delivered label that the models are fitted on, and the least number for a model of a language.
TRAIN_DOCUMENTS, LEAST_DOCUMENTS = 400, 3
#: Longer texts are left out of the fitting sample, which bounds it; they are identified like all others.
TRAIN_LENGTH = 100_000
ORDER = 5
#: Bits per character beyond which a word says nothing about a language (names, foreign words, codes).
CAP_BITS = 9.0
#: Standard deviations above the mean cross-entropy of held-out paragraphs at which a paragraph is rejected.
REJECT_SIGMAS = 6.0

# Three-letter codes that the platform's table of languages lacks: bibliographic ones, and of single languages of a group.
MORE_CODES = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
    "arb": "ar", "cmn": "zh", "pes": "fa", "prs": "fa", "zsm": "ms", "ind": "id", "heb": "he", "yid": "yi",
}
# Codes for an unknown language.
UNDETERMINED = ("", "und", "unknown", "unk", "xx", "xxx", "zxx", "mis", "mul", "none", "null", "nan", "n/a", "na", "-", "?", "undefined", "undetermined")

_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")


@lru_cache(1)
def three_letters() -> dict[str, str]:
    """Three-letter to two-letter codes: all of ISO 639, as the platform has them, and MORE_CODES."""
    jvm = SparkSession.active()._jvm
    found = {}
    for code in jvm.java.util.Locale.getISOLanguages():
        try:
            found[jvm.java.util.Locale(code).getISO3Language()] = code
        except Exception:  # noqa: BLE001, S112
            continue  # a language without such a code
    return found | MORE_CODES


def label_code(label: Column) -> Column:
    """Two-letter code of a delivered label, without regard to case, spaces and region; null where it names no language."""
    plain = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    base = F.regexp_replace(plain, r"[-_].*$", "")
    pairs = [x for k, v in three_letters().items() for x in (F.lit(k), F.lit(v))]
    code = F.coalesce(F.create_map(*pairs)[base], base)
    return F.when(plain.isin(*UNDETERMINED) | base.isin(*UNDETERMINED), F.lit(None)).otherwise(code)


def paragraphs(text: str) -> list[str]:
    return [p for p in _BREAK.split(text) if p.strip()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: list[str], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each predicted character, for n from 1 on; 0 where a word is too short for them.

    A word stands between a start and an end mark; n-grams don't cross words. Also the word of each character, and the hash
    of the n-gram that ends at the character before, for n from 1 on (the context).
    """
    text = "".join(f"\x02{w}\x03" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    start = cp == 2
    word = np.cumsum(start) - 1
    offset = np.arange(len(cp)) - np.flatnonzero(start)[word]
    grams, h = [], np.zeros(len(cp), dtype=np.uint64)
    for k in range(order):
        shifted = np.r_[np.zeros(k, dtype=np.uint64), cp[: len(cp) - k]] if k else cp
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1))
        grams.append(np.where(offset >= k, h, np.uint64(0)))
    contexts = [np.r_[np.uint64(0), g[:-1]] for g in grams]
    keep = ~start
    return [g[keep] for g in grams], word[keep], [np.where(offset[keep] >= k + 1, c[keep], np.uint64(0)) for k, c in enumerate(contexts)]


class KneserNey:
    """Interpolated modified Kneser-Ney over the characters of words; sorted hash arrays with log2 values."""

    def __init__(self, counts: dict[str, int], order: int = ORDER, alphabet: int = 500):
        grams: list[dict[str, int]] = [defaultdict(int) for _ in range(order)]
        for word, n in counts.items():
            marked = f"\x02{word}\x03"
            for end in range(1, len(marked)):
                for k in range(1, order + 1):
                    if end - k + 1 >= 0:
                        grams[k - 1][marked[end - k + 1 : end + 1]] += n
        # Below the highest order, and unless it begins a word, an n-gram counts by its distinct predecessors.
        for k in range(order - 1):
            before: dict[str, int] = Counter(g[1:] for g in grams[k + 1])
            grams[k] = {g: n if g[0] == "\x02" else before.get(g, 1) for g, n in grams[k].items()}
        lower: dict[str, float] = {}
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoffs: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order):
            table = grams[k]
            n1, n2, n3, n4 = (sum(1 for c in table.values() if c == r) or 1 for r in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            discount = [0.0, *(min(max(r - (r + 1) * y * b / a, 0.1), r - 0.1) for r, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
            total: dict[str, int] = defaultdict(int)
            mass: dict[str, float] = defaultdict(float)
            for g, c in table.items():
                total[g[:-1]] += c
                mass[g[:-1]] += discount[min(c, 3)]
            probs = {g: (c - discount[min(c, 3)]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * (lower.get(g[1:], 1.0 / alphabet) if k else 1.0 / alphabet) for g, c in table.items()}
            self.tables.append(self._sorted(probs))
            self.backoffs.append(self._sorted({h: mass[h] / t for h, t in total.items()}))
            lower = probs
        self.floor = math.log2(float(2.0 ** self.backoffs[0][1][0]) / alphabet) if len(self.backoffs[0][1]) else -math.log2(alphabet)

    @staticmethod
    def _hash(gram: str) -> int:
        h = 0
        for ch in reversed(gram):
            h = (h * 0x9E3779B97F4A7C15 + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 31
        return h

    def _sorted(self, values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([self._hash(g) for g in values], dtype=np.uint64)
        logs = np.log2(np.array(list(values.values()), dtype=np.float64)).astype(np.float32)
        order = np.argsort(keys)
        return keys[order], logs[order]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def log2(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log2 P of each predicted character."""
        found, value = self._look(self.tables[0], grams[0])
        out = np.where(found, value, self.floor)
        for k in range(1, len(self.tables)):
            found, value = self._look(self.tables[k], grams[k])
            known, weight = self._look(self.backoffs[k], contexts[k - 1])
            out = np.where(found, value, out + np.where(known, weight, 0.0))
        return out


class Identifier:
    """Models of several languages and their calibration; word scores are kept, as words repeat."""

    def __init__(self, models: dict[str, KneserNey], reject: dict[str, float] | None = None):
        self.codes = sorted(models)
        self.models = [models[c] for c in self.codes]
        self.reject = np.array([(reject or {}).get(c, 1e9) for c in self.codes])
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.codes)), dtype=np.float32)
        self.lengths = np.zeros(0, dtype=np.float32)

    def __getstate__(self):
        return {"codes": self.codes, "models": self.models, "reject": self.reject}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def _score(self, new: list[str]) -> None:
        grams, word, contexts = ngram_hashes(new)
        sums = np.zeros((len(new), len(self.codes)), dtype=np.float32)
        size = np.bincount(word, minlength=len(new)).astype(np.float32)
        for k, model in enumerate(self.models):
            sums[:, k] = np.minimum(np.bincount(word, weights=-model.log2(grams, contexts), minlength=len(new)), CAP_BITS * size)
        self.scores, self.lengths = np.concatenate([self.scores, sums]), np.concatenate([self.lengths, size])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text by each model, and the number of characters; nan without a letter."""
        if len(self.ids) > 300_000:
            self.clear()
        ids, seen, new, sizes = [], self.ids, [], []
        for text in texts:
            found = _WORD.findall(text.lower())
            sizes.append(len(found))
            for w in found:
                i = seen.get(w)
                if i is None:
                    i = seen[w] = len(seen)
                    new.append(w)
                ids.append(i)
        if new:
            self._score(new)
        at = np.array(ids, dtype=np.int64)
        size = np.array(sizes, dtype=np.int64)
        bits, chars = np.zeros((len(texts), len(self.codes))), np.zeros(len(texts))
        some = size > 0
        if some.any():
            starts = np.r_[0, np.cumsum(size[some])[:-1]]
            bits[some] = np.add.reduceat(self.scores[at], starts, axis=0)
            chars[some] = np.add.reduceat(self.lengths[at], starts)
        with np.errstate(invalid="ignore", divide="ignore"):
            return bits / chars[:, None], chars

    def languages(self, texts: list[str]) -> list[tuple[str, float]]:
        """(code, confidence) of each text; ("und", 0.0) for one without letters or that every model rejects."""
        if not texts or not self.codes:
            return [("und", 0.0)] * len(texts)
        entropy, chars = self.entropies(texts)
        out = []
        none = np.isnan(entropy).any(1)
        entropy[none] = 0.0
        best = entropy.argmin(1)
        # The likelihood ratio of at most 40 characters: more of them are no independent evidence.
        odds = np.exp2(-(entropy - entropy.min(1, keepdims=True)) * np.minimum(chars, 40.0)[:, None] / 4)
        sure = 1.0 / odds.sum(1)
        low = entropy.min(1) > self.reject[best]
        for k in range(len(texts)):
            out.append(("und", 0.0) if none[k] or low[k] else (self.codes[best[k]], round(float(sure[k]), 4)))
        return out


def fit_identifier(samples: list[tuple[str, str]], rounds: int = 2) -> Identifier:
    """Models from (label, text) pairs, some of them wrongly labelled.

    After each round, paragraphs go to the language whose model expects them, so that wrong labels and mixed documents stop
    spoiling the models. The rejection bound comes from every tenth paragraph, which the models are not fitted on.
    """
    parts = [(label, p) for label, text in samples for p in paragraphs(text)]
    train, held = [p for k, p in enumerate(parts) if k % 10], [p for k, p in enumerate(parts) if k % 10 == 0]
    languages = {c for c, n in Counter(label for label, _ in samples).items() if n >= LEAST_DOCUMENTS}
    models: dict[str, KneserNey] = {}
    for _ in range(rounds):
        counts: dict[str, Counter] = defaultdict(Counter)
        for label, text in train:
            if label in languages:
                counts[label].update(_WORD.findall(text.lower()))
        models = {c: KneserNey(n) for c, n in counts.items() if n}
        if not models:
            break
        found = Identifier(models).languages([t for _, t in train])
        train = [(code if sure > 0.6 else label, t) for (label, t), (code, sure) in zip(train, found)]
    if not models:
        return Identifier({})
    known = Identifier(models)
    reject = {}
    entropy, _ = known.entropies([t for _, t in held])
    entropy = entropy[~np.isnan(entropy).any(1)]
    best = entropy.argmin(1)
    for k, c in enumerate(known.codes):
        own = entropy[best == k, k]
        reject[c] = float(own.mean() + max(REJECT_SIGMAS * own.std(), 2.0)) if len(own) > 4 else CAP_BITS - 0.5
    return Identifier(models, reject)


def training_samples(df: DataFrame, id_col: str, text_col: str, label_col: str, most: int = TRAIN_DOCUMENTS) -> list[tuple[str, str]]:
    """At most `most` labelled texts of each delivered language, drawn by a hash of the id. Bounded by languages times `most`."""
    labelled = df.select(F.col(id_col).alias("id"), label_code(F.col(label_col)).alias("code")).where(F.col("code").rlike("^[a-z]{2}$"))
    ranked = labelled.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("id"), "id"))).where(F.col("n") <= most)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, TRAIN_LENGTH))
    rows = texts.join(F.broadcast(ranked.select("id", "code")), "id").select("code", "text").collect()
    return sorted((r["code"], r["text"]) for r in rows)


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Identifier | None = None) -> DataFrame:
    """(doc_id, label, lang, confidence, segments): per row its delivered label's code and the found languages.

    segments has (no, lang, confidence) of each paragraph; lang is that of most characters. Null and texts without a letter
    get `und` and no language; a missing label is null. Repeated rows stay; other columns are ignored.
    """
    spark = df.sparkSession
    fitted = spark.sparkContext.broadcast(model or fit_identifier(training_samples(df, id_col, text_col, label_col)))
    texts = df.select(F.col(id_col).alias("doc_id"), label_code(F.col(label_col)).alias("label"), F.col(text_col).alias("text"))

    def make():
        known = fitted.value

        def step(batch):
            parts, sizes = [], []
            for text in batch.column(2).to_pylist():
                found = paragraphs(text) if text else []
                parts += found
                sizes.append(len(found))
            said = known.languages(parts)
            langs, sure, segments, at = [], [], [], 0
            for n in sizes:
                own = said[at : at + n]
                weight: dict[str, int] = Counter()
                for (code, _), p in zip(own, parts[at : at + n]):
                    if code != "und":
                        weight[code] += len(p)
                at += n
                top = min(weight, key=lambda c: (-weight[c], c)) if weight else "und"
                langs.append(top)
                shares = [c for code, c in own if code == top]
                sure.append(round(sum(shares) / len(shares) * weight[top] / sum(weight.values()), 4) if weight else 0.0)
                segments.append([{"no": k + 1, "lang": code, "confidence": c} for k, (code, c) in enumerate(own)])
            return batch.column(0), batch.column(1), langs, sure, segments

        return step

    ddl = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label string, lang string, confidence double, segments array<struct<no:int,lang:string,confidence:double>>"
    return map_batches(texts, make, ddl, rows=2000)


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of every document whose label is missing, names another language, or isn't the only one."""
    languages = F.array_distinct(F.filter(F.transform("segments", lambda s: s["lang"]), lambda c: c != "und"))
    listed = found.select("doc_id", "label", languages.alias("languages")).where(F.size("languages") > 0)
    wrong = F.col("label").isNull() | (F.size("languages") > 1) | (F.get("languages", F.lit(0)) != F.col("label"))
    return listed.where(wrong).select("doc_id", F.explode("languages").alias("lang")).distinct()
