"""Sources mixed to target shares of all tokens (problem 9).

Each source gets whole copies of all its records as far as its target and its cap allow; what is left of the target comes
from a Pareto order sample: records ranked by random odds divided by inclusion odds, the least ranks taken until the tokens
are reached. Inclusion probabilities are proportional to tokens.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import map_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Ranks are cut into so many intervals of each source; only the records of one interval of a source are sorted.
INTERVALS = 4096
#: Pieces of text longer than this are tokenised each time; token counts of shorter ones are kept.
LONGEST_KEPT = 64

#: The pre-tokeniser of the byte-level vocabularies, unless the folder of the vocabulary gives one.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _pattern(path: str) -> str:
    try:
        found = re.search(r"PATTERN\s*=\s*r?(\"{3}|'{3}|\"|')(.*?)\1\s*$", open(path.rsplit("/", 1)[0] + "/__init__.py").read(), re.M | re.S)
    except OSError:
        found = None
    return found[2] if found else PATTERN


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Exact token counts. A token never holds a blank before a letter but at its beginning, so a text may be cut there, and
    the counts of the parts, which repeat, are kept."""

    def __init__(self, path: str = TOKENIZER, keep: int = 400_000, pattern: str | None = None):
        self.encode, self.most, self.seen = _encoding(path, pattern or _pattern(path)).encode_ordinary, keep, {}

    def count(self, text: str) -> int:
        if "  " in text:
            parts = re.split(r"(?=(?<!\s) \S)", text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *(" " + p for p in rest)]
        total, seen = 0, self.seen
        for part in parts:
            n = seen.get(part)
            if n is None:
                n = len(self.encode(part))
                if len(part) <= LONGEST_KEPT:
                    if len(seen) >= self.most:
                        seen.clear()
                    seen[part] = n
            total += n
        return total


def count_tokens(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each row; 0 tokens for a null or empty text."""
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))

    # The vocabulary is read where the job is started and sent to the workers, which need no path to it.
    df.sparkSession.sparkContext.addFile(tokenizer)
    name, pattern = tokenizer.rsplit("/", 1)[-1], _pattern(tokenizer)

    def make():
        counter = TokenCounter(SparkFiles.get(name), pattern=pattern)

        def step(batch):
            return batch.column(0), batch.column(1), [counter.count(t) if t else 0 for t in batch.column(2).to_pylist()]

        return step

    return map_batches(texts, make, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, source string, tokens bigint")


class Mix:
    """A mix of about `total_tokens` (by default as many as all records of the sources with a target have).

    A record without tokens, with a null source or a source without a target is never taken. A source's shares add up over
    its target rows and its least cap holds; a null share counts as 0, a null cap as 1, a cap of 0 takes nothing. Repeated
    rows are records of their own. A shortfall is reported, not made up for by other sources.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER, **columns: str):
        self.tokenizer, self.seed = tokenizer.rsplit("/", 1)[-1], seed
        self.counted = materialise(count_tokens(docs, tokenizer=tokenizer, **columns), "token-counts")
        wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
        t = F.col("tokens").cast("double")
        sizes = self.counted.where("source is not null").groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("available"), F.sum(t * t).alias("squares"))
        known = sizes.join(wanted, "source", "full").select("source", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("squares", F.lit(0.0)).alias("squares"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
        whole_corpus = known.agg(F.coalesce(F.sum(F.when(F.col("target_share") > 0, F.col("available"))), F.lit(0)).alias("wanted_total"))
        total = known.join(F.broadcast(whole_corpus)) if total_tokens is None else known.withColumn("wanted_total", F.lit(total_tokens).cast("long"))  # one row
        need = total.withColumn("needed", F.col("target_share") * F.col("wanted_total"))
        whole = F.when(F.col("available") > 0, F.least(F.floor(F.col("needed") / F.col("available")), F.col("max_repeats"))).otherwise(0).cast("int")
        rest = F.when((F.col("whole") < F.col("max_repeats")) & (F.col("available") > 0), F.col("needed") - F.col("whole") * F.col("available")).otherwise(0.0)
        # One row a source, written once, so that every later join knows its size.
        self.plan = materialise(need.withColumn("whole", whole).withColumn("rest", rest), "mix-plan")

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, copies) of every record that is taken at least once."""
        joined = self.counted.where("tokens > 0").join(self.plan.where("target_share > 0").select("source", "available", "squares", "whole", "rest"), "source")
        t = F.col("tokens").cast("double")
        # Proportional to tokens, and such that the expected tokens are the rest.
        chance = F.least(F.col("rest") * t / F.col("squares"), F.lit(1.0))
        u = (F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        odds = F.when(chance >= 1, F.lit(0.0)).otherwise(u / (1 - u) * (1 - chance) / chance)
        ranked = joined.withColumn("rank", F.when(F.col("rest") > 0, odds / (1 + odds)).otherwise(F.lit(1.0))).withColumn("interval", F.least(F.floor(F.col("rank") * INTERVALS), F.lit(INTERVALS - 1)).cast("int"))
        drawn = ranked.where("rest > 0")
        # At most INTERVALS rows a source, however many records it has.
        heights = drawn.groupBy("source", "interval", "rest").agg(F.sum("tokens").alias("tokens"))
        order = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
        below = heights.withColumn("below", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
        cut = materialise(below.where((F.col("below") < F.col("rest")) & (F.col("below") + F.col("tokens") >= F.col("rest"))).select("source", F.col("interval").alias("at"), "below"), "mix-cuts")
        placed = ranked.join(cut, "source", "left")
        # A source without a cut has fewer tokens than its rest, which rounding alone can bring about: all are taken.
        sure = placed.where("rest > 0 and (at is null or interval < at)").select("doc_id", "source", "tokens", "whole", F.lit(1).alias("extra"))
        never = placed.where("rest <= 0 or interval > at").select("doc_id", "source", "tokens", "whole", F.lit(0).alias("extra"))
        by_rank = Window.partitionBy("source").orderBy("rank", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("below") + F.coalesce(F.sum("tokens").over(by_rank), F.lit(0))
        edge = placed.where("rest > 0 and interval = at").select("doc_id", "source", "tokens", "whole", F.when(before + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0).alias("extra"))
        taken = sure.unionByName(never).unionByName(edge)
        return taken.select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        """One row a source of either table: target and achieved share, tokens and shortfall, largest number of copies.

        achieved_share is of what the mix holds in the end, share_of_wanted_total of what it was to hold: where sources fall
        short of their target, all others have more than theirs of the first, and just theirs of the second.
        """
        took = self.copies().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"), F.count("*").alias("records_taken"))
        rows = self.plan.join(took, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        mixed = took.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("everything"))
        everything = F.col("everything")
        return rows.join(F.broadcast(mixed)).select(  # one row
            "source", F.round("target_share", 6).alias("target_share"), F.round(F.when(everything > 0, F.col("taken") / everything).otherwise(0.0), 6).alias("achieved_share"), F.round(F.when(F.col("wanted_total") > 0, F.col("taken") / F.col("wanted_total")).otherwise(0.0), 6).alias("share_of_wanted_total"), "max_repeats",
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "records", F.coalesce("records_taken", F.lit(0)).alias("records_taken"), F.col("available").alias("tokens_available"), F.round("needed").cast("long").alias("tokens_wanted"), F.col("taken").alias("tokens_taken"),
            F.greatest(F.round(F.col("needed") - F.col("taken")).cast("long"), F.lit(0)).alias("shortfall"), F.lit(self.tokenizer).alias("tokenizer"),
        )
