"""Oversized texts cut into overlapping pieces at natural boundaries (problem 1)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LIMIT, OVERLAP, SLACK = 4000, 200, 60

#: Separators from the coarsest to the finest; a part ends where a match ends (sections: where a heading begins).
LEVELS = (
    ("section", re.compile(r"(?m)(?<=\n)(?=[ \t]*(?:#{1,6} |={1,6} ?[^=\n]+=+[ \t]*$|<h[1-6][ >]|\\(?:sub)*section\*?\{))")),
    ("paragraph", re.compile(r"\n[ \t]*\n+(?=\S)|\n+")),
    ("sentence", re.compile(r"[.!?؟۔।…]+[»\"')\]]*\s+|[;؛]\s+")),
    ("word", re.compile(r"\s+")),
)


def _joined(text: str, at: int) -> bool:
    """True if a cut at `at` would part a mark or a joiner from its letter."""
    return 0 < at < len(text) and (unicodedata.combining(text[at]) != 0 or text[at] in "\u200d\ufe0e\ufe0f" or text[at - 1] == "\u200d")


def _ends(text: str, low: int, high: int, level: int, most: int) -> list[tuple[int, str]]:
    """Ends of the parts of text[low:high], each at most `most` long, by the recursive separator hierarchy."""
    if high - low <= most:
        return [(high, LEVELS[level - 1][0] if level else "text")]
    if level == len(LEVELS):
        out, at = [], low
        while high - at > most:
            to = at + most
            while to > at + most // 2 and _joined(text, to):
                to -= 1
            at = at + most if to <= at + most // 2 else to
            out.append((at, "character"))
        return [*out, (high, "character")]
    out, at = [], low
    cuts = [m.end() for m in LEVELS[level][1].finditer(text, low, high) if low < m.end() < high]
    for to in [*cuts, high]:
        if to - at > most:
            out += _ends(text, at, to, level + 1, most)
        else:
            out.append((to, LEVELS[level][0]))
        at = to
    return out


def _restart(text: str, start: int, end: int, overlap: int, slack: int) -> int:
    """Where the next piece begins: `overlap` characters before `end`, or up to `slack` later at the first boundary of the
    coarsest kind there is, a sentence before a word. A place that already is such a boundary stays."""
    at = max(start + 1, end - overlap)
    for _, pattern in LEVELS[2:] if overlap else ():
        for m in pattern.finditer(text, max(start, at - 8), min(end, at + slack)):
            if at <= m.end() < end:
                return m.end()
    while at < end and _joined(text, at):
        at += 1
    return at


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of each piece. A text within the limit is one piece.

    Atoms from the separator hierarchy are packed greedily; every atom leaves room for the overlap, so no piece is longer
    than `limit`. text[start:end] of consecutive pieces overlap by at most `overlap` and cover the text without a gap.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text), "text")] if text else []
    atoms = _ends(text, 0, len(text), 0, limit - overlap)
    pieces, start, end, kind = [], 0, 0, "text"
    for to, how in atoms:
        if to - start > limit:
            pieces.append((start, end, kind))
            start = _restart(text, start, end, overlap, slack) if overlap else end
        end, kind = to, how
    return [*pieces, (start, end, "text")]


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "content_text", limit: int = LIMIT, overlap: int = OVERLAP, all_texts: bool = False) -> DataFrame:
    """Pieces `(id, piece_no, start_at, end_at, cut, piece)` of the texts longer than `limit` code points.

    Only rows with such a text leave the JVM. Null and short texts give no rows, or with `all_texts` one piece each
    (empty texts none). Other columns are ignored; repeated rows give repeated pieces.
    """
    wanted = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if not all_texts:
        wanted = wanted.where(F.length("text") > limit)

    def make():
        def step(batch):
            ids, no, start, end, cut, piece = [], [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b, kind) in enumerate(split_text(text, limit, overlap)):
                    ids.append(i), no.append(k + 1), start.append(a), end.append(b), cut.append(kind), piece.append(text[a:b])
            return ids, no, start, end, cut, piece

        return step

    id_type = wanted.schema["id"].dataType.simpleString()
    return map_batches(wanted, make, f"id {id_type}, piece_no int, start_at int, end_at int, cut string, piece string", rows=200)
