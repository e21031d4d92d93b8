"""Error pages, script notices, filler and unfilled fields in place of content (problem 7).

Normalised lines are counted by host; those that recur on many of its pages are boilerplate and are subtracted. What a page
without content says is learned from the residuals of the whole table: words and pairs of words that stand, over all hosts, in
short residuals far more often than in long ones are evidence, as messages, notices and filler recur where nothing else is said;
the HTTP status is a weak label beside it. A page is flagged if its residual is evidence but for a heading. An unfilled field
anywhere is evidence by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import host, map_batches
from .lookalikes import clean_line

#: A boilerplate line recurs on this share of its host's pages, and on so many of them.
MIN_ROWS, MIN_SHARE = 5, 0.05
#: A residual of fewer words is short. A word is evidence from this share of all short residuals on, and from so many of them.
SHORT, EVIDENCE_SHARE, EVIDENCE_ROWS = 40, 0.001, 2
#: Pseudo-counts of the odds of a word, the score of a word without odds, and the mean score from which a line is evidence.
PRIOR, UNKNOWN, LEAST = 2.0, -0.3, 0.4

# Syllables of Latin filler.
SYLLABLES = frozenset("adipiscing consectetur dolor lorem ipsum amet elit sed lor rem ip sum do am et sit con sec te tur ad pis ci eiu smod tem por in ut la bo re mag na al qui nos mco ul ve ni nia lo no li au um".split())
_LONGEST = max(map(len, SYLLABLES))


@lru_cache(1 << 15)
def latin_filler(word: str) -> bool:
    """True if the word is made of the syllables of Latin filler."""
    reached = {0}
    for end in range(1, len(word) + 1):
        if any(end - n in reached and word[end - n : end] in SYLLABLES for n in range(2, min(_LONGEST, end) + 1)):
            reached.add(end)
    return len(word) in reached


_FIELD = re.compile(
    r"\{\{\s*[\w.]+\s*\}\}|[$#]\{\s*[\w.]+\s*\}|\[\[%\s*\w+\s*%\]\]|%[A-Za-z]+_[A-Za-z_]+%|%[A-Z]{3,}%|@@\w+@@|<%=?[^%>]*%>"
    r"|(?i:\[insert [^\[\]]+\])|\[(?:أدخل|ادخل|أدرج|ضع|اكتب)\s[^\[\]]+\]|(?<![\[\]\w])\[(?!\[)(?:[\u0621-\u064a]+ ){1,4}[\u0621-\u064a]+\](?![\](\[])"
    r"|\bX{3,}\b|(?i:\bTODO\b\s*:)|(?i:\bFIXME\b)|(?i:\[object object\])|(?<![\w.])NaN(?![\w.])|(?<![\w\"'])undefined(?![\w\"'])|(?:^|[:=]\s*)(?:null|NULL|None|nil)(?=\s*$)",
    re.M,
)
_WORDS = re.compile(r"[^\W\d_]+")


def is_filler(found: list[str]) -> bool:
    """True for a line in the syllables of Latin filler."""
    if len(found) < 4:
        return False
    allowed = 0.15 * len(found)
    for w in found:
        if not (w.isascii() and latin_filler(w)):
            allowed -= 1
            if allowed < 0:
                return False
    return True


def grams(found: list[str]) -> list[str]:
    """Words and pairs of neighbours."""
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


class Evidence:
    """Log odds of words and pairs to stand in short residuals, learned from counts (gram -> (in short ones, in all))."""

    def __init__(self, counts: dict[str, tuple[int, int]], short: int, residuals: int, bad_short: int = 0, bad: int = 0):
        base = (short + 1) / (residuals + 2)
        odds = lambda yes, no: (yes + PRIOR * base) / (no + PRIOR * (1 - base)) / (base / (1 - base))
        self.scores = {g: float(np.log(odds(t, n - t))) for g, (t, n) in counts.items()}
        #: A line without one of these words has no word or pair with a positive score.
        self.hot = frozenset(w for g, x in self.scores.items() if x > 0 for w in g.split())
        #: What a bad status adds to each line of a short residual.
        rate_short, rate = (bad_short + 1) / (short + 20), (bad - bad_short + 1) / (residuals - short + 20)
        self.bonus = float(min(max(np.log(rate_short / rate), 0.0), 0.5))

    def score(self, found: list[str]) -> float:
        """Mean over the words and pairs of a line; some value below 0 where no part is positive."""
        if self.hot.isdisjoint(found):
            return min(UNKNOWN, 0.0)
        get, all_ = self.scores.get, grams(found)
        return sum(get(g, UNKNOWN) for g in all_) / len(all_) if all_ else 0.0


def judge(lines: list[str], evidence: Evidence, bad: bool = False) -> str | None:
    """Why a residual is no content: "message" or "filler"; None if it is content or nothing.

    The first line that is no evidence may be the heading; more of such words than of evidence are content.
    """
    found = [w for line in lines if (w := _WORDS.findall(line.lower()))]
    bonus = evidence.bonus if bad and sum(map(len, found)) < SHORT else 0.0
    kinds: Counter[str] = Counter()
    heading, other, left = True, 0, sum(map(len, found))
    for w in found:
        score = evidence.score(w)
        kind = "message" if score >= LEAST or (score > 0 and score + bonus >= LEAST) else "filler" if is_filler(w) else None
        left -= len(w)
        if kind:
            kinds[kind] += len(w)
        elif heading:
            heading = False
        else:
            other += len(w)
        if other and other >= kinds.total() + left:
            return None  # whatever the rest is
    return kinds.most_common(1)[0][0] if kinds else None


class Residuals:
    """The residual lines of a table's pages and the evidence learned from them. The table is read once."""

    def __init__(self, df: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "content_text", status_col: str = "http_status", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE):
        status = F.col(status_col).cast("int") if status_col in df.columns else F.lit(None).cast("int")
        docs = df.select(F.col(id_col).alias("id"), F.xxhash64(host(F.col(url_col))).alias("hash"), host(F.col(url_col)).alias("host"), (status.isNotNull() & ((status < 200) | (status >= 400))).alias("bad"), F.col(text_col).alias("text")).where("text is not null")
        docs = docs.select("id", F.when(F.col("host").isNotNull(), F.col("hash")).alias("site"), "bad", "text")
        self.id_type = docs.schema["id"].dataType.simpleString()

        def make():
            def step(batch):
                fields, lines, keys, sizes = [], [], [], []
                for text in batch.column(3).to_pylist():
                    shown = [clean_line(x) for x in text.split("\n") if x.strip()]
                    found = [_WORDS.findall(x.lower()) for x in shown]
                    fields.append(bool(_FIELD.search(text))), lines.append(shown), sizes.append(list(map(len, found)))
                    keys.append([xxhash.xxh3_64_intdigest("".join(w)) - 2**63 if w else None for w in found])
                return batch.column(0), batch.column(1), batch.column(2), fields, lines, keys, sizes

            return step

        pages = materialise(map_batches(docs, make, f"id {self.id_type}, site bigint, bad boolean, field boolean, lines array<string>, keys array<bigint>, sizes array<int>", rows=500), "page-residue-lines")
        placed = pages.where("site is not null")
        # The null key stands for the page itself; counted before the shuffle, so a hot host costs its distinct lines.
        counted = placed.select("site", F.explode(F.array_union(F.array(F.lit(None).cast("long")), F.filter("keys", lambda k: k.isNotNull()))).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n"))
        rows = counted.where("key is null").select("site", F.col("n").alias("rows"))
        often = counted.where(F.col("key").isNotNull() & (F.col("n") >= min_rows)).join(rows, "site").where(F.col("n") >= F.lit(min_share) * F.col("rows"))
        often = materialise(often.groupBy("site").agg(F.collect_list("key").alias("often")), "recurrent-lines")
        marked = pages.join(often, "site", "left").withColumn("recurrent", F.coalesce(F.array_intersect("keys", "often"), F.array().cast("array<bigint>")))
        rest = F.filter(F.arrays_zip("lines", "keys", "sizes"), lambda x: x["keys"].isNotNull() & ~F.array_contains("recurrent", x["keys"]))
        kept = marked.select("id", "bad", "field", rest.alias("rest")).select("id", "bad", "field", F.col("rest.lines").alias("lines"), F.aggregate("rest.sizes", F.lit(0), lambda s, n: s + n).alias("words"))
        self.residuals = materialise(kept, "residuals")
        self._evidence: Evidence | None = None

    def evidence(self) -> Evidence:
        """Learned from all residuals. It holds the words of at least EVIDENCE_SHARE of the short residuals: at most the mean number
        of different words and pairs of a short residual, which is below 2 x SHORT, divided by that share, in any table."""
        if self._evidence is None:
            some = self.residuals.where("words > 0")
            short = F.col("words") < SHORT
            total = some.agg(F.count("*"), F.count_if(short), F.count_if("bad"), F.count_if(F.col("bad") & short)).first()
            least = max(EVIDENCE_ROWS, int(np.ceil(EVIDENCE_SHARE * total[1])))
            frequent = self._counts(some.where(short), None).where(F.col("n") >= least).collect()
            known = {r["gram"]: r["n"] for r in frequent}
            everywhere = {r["gram"]: r["n"] for r in self._counts(some, known).collect()} if known else {}
            self._evidence = Evidence({g: (n, everywhere[g]) for g, n in known.items()}, total[1], total[0], total[3], total[2])
        return self._evidence

    @staticmethod
    def _counts(residuals: DataFrame, known: dict[str, int] | None) -> DataFrame:
        """(gram, n): residuals with each word and pair, added up in each task first; of the known ones only, if given."""
        sent = residuals.sparkSession.sparkContext.broadcast(None if known is None else frozenset(known))

        def run(batches):
            import pyarrow as pa

            wanted, counts = sent.value, Counter()
            for batch in batches:
                for lines in batch.column(0).to_pylist():
                    own = set()
                    for line in lines:
                        found = _WORDS.findall(line.lower())
                        own.update(found)
                        # A pair can be frequent only if both of its words are.
                        own.update(f"{a} {b}" for a, b in zip(found, found[1:]) if wanted is None or (a in wanted and b in wanted))
                    counts.update(own if wanted is None else own & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

        return residuals.select("lines").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))

    def flagged(self) -> DataFrame:
        sent = self.residuals.sparkSession.sparkContext.broadcast(self.evidence())

        def make():
            def step(batch):
                ids, reasons = [], []
                for i, bad, field, lines in zip(*(c.to_pylist() for c in batch.columns)):
                    if why := "field" if field else judge(lines, sent.value, bad):
                        ids.append(i), reasons.append(why)
                return ids, reasons

            return step

        return map_batches(self.residuals.select("id", "bad", "field", "lines"), make, f"id {self.id_type}, reason string")


def template_residue(df: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "content_text", status_col: str = "http_status", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, reason) of the rows that hold a message, a notice, filler or an unfilled field.

    `http_status` only tips the scales of short residuals; without the column, or where it is null, it says nothing. Null and
    empty texts give nothing, as there is no text that stands in place of content. Rows without a host have no boilerplate.
    Repeated rows come out as often as they occur; other columns are ignored. A message must recur: what two rows at least say
    can be learned, a message that occurs once in the table is not found unless it is made of words of others.
    """
    return Residuals(df, id_col, url_col, text_col, status_col, min_rows, min_share).flagged()
