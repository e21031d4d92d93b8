"""Main body of web pages by line-block distribution (problem 5).

Markup is stripped to a sequence of text blocks. Text lengths are summed over sliding windows of blocks; between the first and
the last peak of these sums, the surge and the dive, lies main text. Over all pages this tells how often blocks at one place of
a template lie there, and so how much a word counts at each place: next to nothing where no page has main text around. The
windows are then summed again over these effective lengths, and the body lies between their surge and their dive, without the
blocks that are silent themselves. The lines of the extracted text follow the blocks of their page that show them; a line that
the page's markup doesn't show is weighed by what the markup of all other pages says about the same line.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_batches
from .lookalikes import clean_line

#: Blocks in a window; words a window must hold for a surge, and a block not to be silent.
WINDOW, SURGE, SILENT = 3, 8, 0.4
#: Characters that count as a word at least, where a block has no spaces.
LONG_WORD = 12
#: A window is a peak with so many words and this share of the page's fullest window, where its middle block is the longest.
PEAK, PEAK_SHARE = 20, 1 / 3
#: Places of templates with this share of all blocks have a weight of their own, so there are at most 1 / PLACE_SHARE; others weigh 0.5.
PLACE_SHARE = 1e-5
#: A line counts as furniture of other pages from so many pages on, and with such a share of all pages that show it.
MIN_PAGES, MIN_FURNITURE = 2, 0.8
#: The same for the first two words of a line, which decide where nothing is known of the whole line.
MIN_OPENINGS, MIN_OPENING_SHARE = 20, 0.95

_TAG = re.compile(r"<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_BLOCKS = frozenset("html head body title p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table tr nav header footer aside section article main noscript form br hr pre blockquote".split())
_VOID = frozenset("br hr img input meta link".split())
_LINKS = re.compile(r"[·›»]|\s\|\s")
_LETTERS = re.compile(r"[\W\d_]+")
_MARKUP = re.compile(r"<[^<>]{1,80}>|\\[a-zA-Z]+\*?|[\[\]{}*=~`#|]")
_MARKED = re.compile(r"\s*(?:[•‣▪◦*+\-#:;>|]|\d+[.)]|<|\\|\{|=|```)")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I)


@lru_cache(1 << 14)
def letters_of(text: str) -> str:
    """The letters of a line in order, in one consistent form and without case; a page's markup and text ask for the same lines."""
    return _LETTERS.sub("", clean_line(text).lower())


def key_of(letters: str) -> int:
    """Identifier of the letters of a line; 0 for none."""
    return xxhash.xxh3_64_intdigest(letters) - 2**63 if letters else 0


def line_key(text: str) -> int:
    return key_of(letters_of(text))


def opening_key(text: str) -> int:
    """Identifier of the first two words of a line of three words and more; 0 for other lines."""
    found = text.split(None, 3)
    return key_of("^" + letters_of(" ".join(found[:2]))) if len(found) >= 3 else 0


def is_link_list(text: str) -> bool:
    """True for entries between separators; a row of a pipe table is none."""
    return bool(_LINKS.search(text)) and not text.lstrip().startswith("|")


def raw_blocks(raw: str) -> list[tuple[str, str]]:
    """(text, place) of each text block; the place is the chain of its elements, with their names."""
    blocks, stack, text, pos = [], [], [], 0

    def flush():
        joined = html.unescape("".join(text)).strip()
        text.clear()
        if joined:
            blocks.append((joined, "/".join([s[1] for s in stack])))

    for m in _TAG.finditer(raw):
        text.append(raw[pos : m.start()])
        pos = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            flush()
        elif name in ("td", "th", "span"):
            text.append("\n")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in _VOID and (name in _BLOCKS or name in ("td", "th")) and not m[4].endswith("/"):
            found = _NAMES.search(m[4])
            stack.append((name, f"{name}.{found[1].strip().lower()}" if found else name))
    text.append(raw[pos:])
    flush()
    return blocks


def windows(lengths: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Sums over the window around each position."""
    total = np.r_[0, np.cumsum(lengths)]
    at = np.arange(len(lengths))
    return total[np.minimum(at + size // 2 + 1, len(lengths))] - total[np.maximum(at - size // 2, 0)]


def main_text(lengths: np.ndarray) -> np.ndarray | None:
    """Which blocks lie between the first and the last peak of the window sums; None for a page without a peak."""
    sums = windows(lengths)
    if not len(sums) or sums.max() < PEAK:
        return None
    padded = np.r_[0, lengths, 0]
    longest = np.maximum(padded[:-2], padded[2:]) <= lengths
    peaks = np.flatnonzero((sums >= max(PEAK, PEAK_SHARE * sums.max())) & longest)
    at = np.arange(len(lengths))
    return (at >= peaks[0]) & (at <= peaks[-1]) if len(peaks) else None


def body_blocks(lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which blocks are body: between surge and dive of the windows over effective lengths, and not silent."""
    effective = lengths * weights
    sounds = effective >= SILENT
    loud = np.flatnonzero((windows(effective) >= SURGE) & sounds)
    surge, dive = (loud[0], loud[-1]) if len(loud) else (0, len(lengths) - 1)
    # A short block next to the body, with nothing silent between, belongs to it.
    while surge > 0 and sounds[surge - 1]:
        surge -= 1
    while dive + 1 < len(lengths) and sounds[dive + 1]:
        dive += 1
    at = np.arange(len(lengths))
    return sounds & (at >= surge) & (at <= dive)


BODY, FURNITURE, UNKNOWN, EMPTY, SHOWN = 1, 2, 0, 3, 4


def read_page(text: str, raw: str | None) -> tuple[list, ...]:
    """What later steps need of a page: (keys, sizes, kinds, openings, hits, parts) of the lines of its text, (places, lengths,
    keys, openings) of its blocks, and the key of its title.

    A line of kind SHOWN has the numbers of the blocks that show it in hits; parts tells if it is but a part of them. Only lines
    of an unknown kind have an opening. Main headings have no place of their own, as they stand before all main text.
    """
    blocks = raw_blocks(raw) if raw else []
    lengths = np.array([0 if is_link_list(t) else max(len(t.split()), len(t) // LONG_WORD) for t, _ in blocks], dtype=np.int64)
    places = [0 if p.rpartition("/")[2].partition(".")[0] == "h1" else xxhash.xxh3_64_intdigest(p) - 2**63 for _, p in blocks]
    by_key: dict[int, list[int]] = {}
    block_keys, block_openings, whole = [], [], []
    for k, (shown, _) in enumerate(blocks):
        letters = letters_of(shown)
        pieces = {shown, *shown.split("\n")}
        if is_link_list(shown):
            pieces |= {p for line in shown.split("\n") for p in re.split(r"[·|]", line)}
        keys = {key_of(letters), *(line_key(p) for p in pieces if p is not shown)} - {0}
        for key in keys:
            by_key.setdefault(key, []).append(k)
        block_keys.append(list(keys)), block_openings.append(list({opening_key(p) for p in pieces} - {0})), whole.append(letters)
    starts = np.cumsum([0] + [len(w) + 1 for w in whole]).tolist()
    everything = "\n".join(whole)
    keys, sizes, kinds, openings, hits, parts = [], [], [], [], [], []
    crumb = ""
    for line in text.split("\n"):
        if not line.strip():
            keys.append(0), sizes.append(0), kinds.append(EMPTY), openings.append(0), hits.append([]), parts.append(False)
            continue
        letters, bare = letters_of(line), line
        key = key_of(letters)
        if key not in by_key and _MARKUP.search(line):
            bare = _MARKUP.sub(" ", line)
            letters = letters_of(bare) or letters
            key = key_of(letters)
        found, part = by_key.get(key, []), False
        if not found and everything and letters and len(bare.split()) > 1:
            at = everything.find(letters)
            while at >= 0:
                found = [*found, bisect_right(starts, at) - 1]
                at = everything.find(letters, starts[found[-1] + 1])
            part = bool(found)
        kind = SHOWN if found else UNKNOWN
        if kind == UNKNOWN:
            if is_link_list(line):
                kind = FURNITURE
                crumb = re.split("[›»]", line)[-1] if re.search("[›»]", line) else crumb
            elif (crumb and line_key(crumb) == key) or not key or _MARKED.match(line):
                kind = BODY
        # A line with many words or with digits and punctuation isn't an entry of a side box.
        size = len(bare.split())
        if kind == UNKNOWN and re.search(r"[.:؟?!=]|\d", bare):
            size = max(size, SURGE)
        keys.append(key), sizes.append(size), kinds.append(kind), openings.append(opening_key(bare) if kind == UNKNOWN else 0), hits.append(found), parts.append(part)
    title = _TITLE.search(raw) if raw else None
    return keys, sizes, kinds, openings, hits, parts, places, lengths.tolist(), block_keys, block_openings, line_key(html.unescape(title[1])) if title else 0


def weigh_page(kinds, keys, hits, parts, lengths, weights, block_keys, block_openings, title) -> tuple[list, ...]:
    """Final kinds of a page's lines by its own markup, and the keys and openings of its furniture and of its body."""
    is_body = body_blocks(np.array(lengths, dtype=np.float64), np.array(weights)).tolist()
    sets = [set(), set(), set(), set()]
    for yes, ks, os in zip(is_body, block_keys, block_openings):
        sets[yes].update(ks), sets[2 + yes].update(os)
    if title:
        sets[1].add(title)
    out = []
    for kind, key, at, part in zip(kinds, keys, hits, parts):
        if key and key == title:
            kind = BODY
        elif kind == SHOWN:
            said = [is_body[k] for k in at]
            # Whole lines that stand in the body as well are body; a part of a line of furniture is furniture.
            kind = BODY if (all(said) if part else any(said)) else FURNITURE
        out.append(kind)
    return out, sorted(sets[0] - sets[1]), sorted(sets[1]), sorted(sets[2]), sorted(sets[3])


def furniture_lines(keys: list[int], sizes: list[int], kinds: list[int], openings: list[int], known: dict[int, bool]) -> list[int]:
    """Numbers of the lines that are not main body. known: what other pages say of a line or opening, True for furniture."""
    said = [known.get(key, known.get(opening)) if k == UNKNOWN else None for k, key, opening in zip(kinds, keys, openings)]
    kinds = [k if x is None else FURNITURE if x else BODY for k, x in zip(kinds, said)]
    shown = [i for i, k in enumerate(kinds) if k != EMPTY]
    lengths = np.array([0 if kinds[i] == FURNITURE else sizes[i] + (SURGE if kinds[i] == BODY else 0) for i in shown], dtype=np.int64)
    out = {i for i in shown if kinds[i] == FURNITURE}
    # The first line that isn't furniture is the title; a run of short lines unknown to all markup, between furniture, is a side box.
    first = next((n for n, i in enumerate(shown) if kinds[i] != FURNITURE), None)
    n = 0
    while n < len(shown):
        if lengths[n] == 0:
            n += 1
            continue
        end = n
        while end < len(shown) and lengths[end] > 0:
            end += 1
        run = lengths[n:end]
        quiet = run.max() < SURGE and all(kinds[i] == UNKNOWN for i in shown[n:end])
        if quiet and n != first and n > 0:
            out.update(shown[n:end])
        n = end
    return sorted(i + 1 for i in out)


class MainBody:
    """Body and furniture of a table of pages.

    Rows with a null text give nothing. Rows with null or empty markup rely on what other pages show. Empty lines are
    neither; repeated rows give their lines once; other columns are ignored. An empty table gives no rows.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", raw_col: str = "content_raw", text_col: str = "content_text"):
        self.id_type = df.schema[id_col].dataType.simpleString()
        pages = df.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

        def read():
            def step(batch):
                rows = [read_page(t, r) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                return [batch.column(0), *([r[k] for r in rows] for k in range(11))] if rows else None

            return step

        lines = "keys array<bigint>, sizes array<int>, kinds array<int>, openings array<bigint>"
        blocks = "places array<bigint>, lengths array<int>, block_keys array<array<bigint>>, block_openings array<array<bigint>>, title bigint"
        self.read = materialise(map_batches(pages, read, f"id {self.id_type}, {lines}, hits array<array<int>>, parts array<boolean>, {blocks}", rows=500), "page-blocks")
        sent = df.sparkSession.sparkContext.broadcast(self.place_weights())

        def weigh():
            get = sent.value.get

            def step(batch):
                cols = {n: batch.column(n).to_pylist() for n in ("kinds", "keys", "hits", "parts", "places", "lengths", "block_keys", "block_openings", "title")}
                rows = [weigh_page(k, ks, h, p, n, [get(x, 0.5) for x in at], bk, bo, t) for k, ks, h, p, at, n, bk, bo, t in zip(*cols.values())]
                return [batch.column("id"), batch.column("keys"), batch.column("sizes"), [r[0] for r in rows], batch.column("openings"), *([r[k] for r in rows] for k in range(1, 5))] if rows else None

            return step

        self.pages = materialise(map_batches(self.read, weigh, f"id {self.id_type}, {lines}, furniture array<bigint>, body array<bigint>, opens_furniture array<bigint>, opens_body array<bigint>", rows=500), "page-lines")

    def place_weights(self, rounds: int = 2) -> dict[int, float]:
        """How often the blocks of each frequent place lie in the main text of their page; at most 1 / PLACE_SHARE places.

        The first round takes all words alike, each next one the words at the weights of the one before: a side box that is
        the longest among its neighbours once is not again.
        """
        weights: dict[int, float] = {}
        for k in range(rounds):
            seen = self._places(None if k == 0 else weights)
            total = seen.agg(F.sum("n")).first()[0] or 0
            weights = {r["place"]: (r["inside"] + 0.5) / (r["n"] + 1) for r in seen.where(F.col("n") >= PLACE_SHARE * total).collect()}
        return weights

    def _places(self, weights: dict[int, float] | None) -> DataFrame:
        """(place, n, inside): blocks of each place and how many lie in main text, on pages with a peak; added up in each task first."""
        sent = self.read.sparkSession.sparkContext.broadcast(weights)

        def run(batches):
            import pyarrow as pa

            known, counts = sent.value, {}
            for batch in batches:
                for places, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                    sizes = np.array(lengths, dtype=np.float64)
                    within = main_text(sizes if known is None else sizes * [known.get(p, 0.5) for p in places])
                    if within is not None:
                        for p, yes in zip(places, within.tolist()):
                            n = counts.setdefault(p, [0, 0])
                            n[0] += 1
                            n[1] += yes
            counts.pop(0, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), *(pa.array([n[k] for n in counts.values()], pa.int64()) for k in (0, 1))], names=["place", "n", "inside"])

        return self.read.select("places", "lengths").where("size(places) > 0").mapInArrow(run, "place bigint, n bigint, inside bigint").groupBy("place").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))

    def line_numbers(self) -> DataFrame:
        """(id, line_no) of every non-empty line that is not main body."""
        shows = [self.pages.select(F.explode(c).alias("key"), F.lit(f).alias("f"), F.lit(1 - f).alias("b"), F.lit(o).alias("opening")) for c, f, o in (("furniture", 1, False), ("body", 0, False), ("opens_furniture", 1, True), ("opens_body", 0, True))]
        seen = shows[0].unionByName(shows[1]).unionByName(shows[2]).unionByName(shows[3]).groupBy("key", "opening").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
        n, o = F.col("f") + F.col("b"), F.col("opening")
        yes = F.when(o, (F.col("f") >= MIN_OPENINGS) & (F.col("f") >= MIN_OPENING_SHARE * n)).otherwise((F.col("f") >= MIN_PAGES) & (F.col("f") >= MIN_FURNITURE * n))
        no = F.when(o, (F.col("b") >= MIN_OPENINGS) & (F.col("b") >= MIN_OPENING_SHARE * n)).otherwise(F.col("b") > 0)
        said = seen.select("key", F.when(yes, True).when(no, False).alias("is_furniture")).where("is_furniture is not null")
        unknown = F.filter(F.arrays_zip("keys", "kinds", "openings"), lambda x: x["kinds"] == UNKNOWN)
        wanted = F.array_distinct(F.concat(F.transform(unknown, lambda x: x["keys"]), F.transform(unknown, lambda x: x["openings"])))
        asked = self.pages.select("id", F.explode(F.filter(wanted, lambda x: x != 0)).alias("key"))
        answers = asked.join(said, "key").groupBy("id").agg(F.collect_list("key").alias("known"), F.collect_list("is_furniture").alias("says"))
        ready = self.pages.select("id", "keys", "sizes", "kinds", "openings").join(answers, "id", "left")

        def make():
            def step(batch):
                ids, numbers = [], []
                for i, keys, sizes, kinds, openings, known, says in zip(*(c.to_pylist() for c in batch.columns)):
                    found = furniture_lines(keys, sizes, kinds, openings, dict(zip(known, says)) if known else {})
                    ids += [i] * len(found)
                    numbers += found
                return ids, numbers

            return step

        return map_batches(ready, make, f"id {self.id_type}, line_no int").distinct()


def main_body(df: DataFrame, id_col: str = "id", raw_col: str = "content_raw", text_col: str = "content_text") -> DataFrame:
    """(id, body_text): the lines of each text that are main body, in order. Null texts stay null; rows are kept."""
    places = MainBody(df, id_col, raw_col, text_col).line_numbers().groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(places, "id", "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("drop", (i + 1).cast("int")))
    return texts.select("id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("body_text"))
