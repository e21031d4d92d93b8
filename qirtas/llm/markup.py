"""Markup residue to clean text that keeps its structure (problem 6).

A scanner proposes every mark that HTML, Markdown, wiki or LaTeX use, in a construct or bare. A mark by itself says little: its
cost of being markup or text is that of its character wherever it stands. The shape around it is a node of its own with costs of
its own, and both are tied by an edge; further edges tie neighbouring marks of one kind, and the two ends of a paired construct,
be they lines, environments or elements. These costs are terminal capacities, a minimum cut labels all nodes together, and what
is markup is converted. Costs are learned from pages whose own HTML shows what of their text is residue.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .main_body import raw_blocks
from .min_cut import label
from .template_residue import _FIELD

KINDS = ("html", "markdown", "wiki", "latex")

_SCAN = re.compile(
    r"""
    (?P<html_script><(?P<sc>script|style)\b[^<>]*>.*?</(?P=sc)\s*>)
  | (?P<html_comment><!--.*?-->)
  | (?P<html_tag></?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z:-]+(?:\s*=\s*(?:"[^"\n]*"|'[^'\n]*'|[^\s"'<>]+))?)*\s*/?>)
  | (?P<html_escaped>&lt;/?[a-zA-Z][a-zA-Z0-9]*(?:\s[^&\n]*?)?/?&gt;)
  | (?P<html_entity>&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6});)
  | (?P<markdown_fence>^[ ]{0,3}(?:```|~~~)[\w+-]*[ ]*$)
  | (?P<markdown_heading>^[ ]{0,3}\#{1,6}[ ]+(?=\S))
  | (?P<markdown_setext>^[ ]{0,3}(?:={3,}|-{3,})[ ]*$)
  | (?P<markdown_rule>^[ ]{0,3}(?:\*[ ]?){3,}$)
  | (?P<markdown_table>^[ ]*\|(?:[^|\n]*\|)+[ ]*$)
  | (?P<markdown_quote>^[ ]{0,3}(?:>[ ]?)+(?=\S))
  | (?P<markdown_bullet>^[ ]{0,8}[*+-][ ]+(?=\S))
  | (?P<markdown_number>^[ ]{0,8}\d{1,4}\.[ ]+(?=\S))
  | (?P<markdown_image>!\[[^\]\n]*\]\([^)\n]*\))
  | (?P<markdown_link>(?<![\[!\w])\[[^\[\]\n]+\]\([^()\s]*(?:\s"[^"\n]*")?\))
  | (?P<markdown_strong>(?<![*\w])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![*\w])|(?<![_\w])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![_\w]))
  | (?P<markdown_emphasis>(?<![*\w\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![*\w.]))
  | (?P<markdown_strike>~~(?=\S)[^~\n]+?(?<=\S)~~)
  | (?P<markdown_code>(?<!`)`[^`\n]+`(?!`))
  | (?P<wiki_heading>^[ ]*(?P<eq>={1,6})[ ]?[^=\n]+?[ ]?(?P=eq)[ ]*$)
  | (?P<wiki_quotes>'{2,5}(?=[^'\s])[^'\n]+?(?<=[^'\s])'{2,5})
  | (?P<wiki_template>\{\{\s*[^{}|\n]+\|[^{}]*\}\})
  | (?P<wiki_link>\[\[(?!%)[^\[\]\n]+\]\])
  | (?P<wiki_external>\[https?://[^\s\]]+(?:\s[^\]\n]*)?\])
  | (?P<wiki_list>^[ ]*(?:[:;]+[*\#:;]*|[*\#]{2,}:*|[*\#]+:[*\#:]*)[ ]+(?=\S))
  | (?P<wiki_table>^[ ]*(?:\{\|.*|\|\}|\|-+[ ]*)$)
  | (?P<wiki_switch>__[A-Z]{3,}__)
  | (?P<latex_verbatim>\\begin\{(?:verbatim|lstlisting)\}.*?\\end\{(?:verbatim|lstlisting)\})
  | (?P<latex_environment>\\(?:begin|end)\{[a-zA-Z*]+\}(?:\{[^{}\n]*\}|\[[^\]\n]*\])*)
  | (?P<latex_section>\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{[^{}\n]*\})
  | (?P<latex_item>\\item(?:\[[^\]\n]*\])?[ ]*)
  | (?P<latex_command>\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})+)
  | (?P<latex_row>[ ]*\\\\[ ]*(?:\\hline[ ]*)?$)
  | (?P<latex_word>\\(?:hline|centering|noindent|newpage|maketitle|par|ldots|item)\b)
  | (?P<bare_html>[<>])
  | (?P<bare_wiki>\[\[[^\[\]\n]*\]\]|\{\{?[^{}\n]*\}\}?|=+)
  | (?P<bare_markdown>\[[^\[\]\n]*\]|\#+\w*|\*+|~~|`)
  | (?P<bare_latex>\$|\\[a-zA-Z]+)
    """,
    re.X | re.M | re.S,
)
#: Marks that open or close a formula; an escaped character is none, and a blank line ends what `\[`, `\(` and `$` opened.
_MARKS = re.compile(r"\\(?:(begin|end)\{([a-zA-Z]+\*?)\}|[^\n])|\$\$?|\n[ \t]*(?=\n)")
_FORMULAS = frozenset("math displaymath equation eqnarray align alignat flalign xalignat gather multline split aligned alignedat gathered cases array matrix pmatrix bmatrix vmatrix smallmatrix dmath".split())
_PAIRS = {r"\]": r"\[", r"\)": r"\("}
_IN_MATH, _WHOLE = re.compile(r"\\[a-zA-Z]|[_^]"), re.compile(".*", re.S)
_MAYBE = re.compile(r"[<&*`~\\$\[{']|^[ ]{0,8}(?:[#=>+:;|-]|\d+\.)|__", re.M)

#: Edges: between a mark and its shape, to the next mark of the same kind within so many characters, and between two ends of a pair.
SHAPE, NEAR, ADJACENT, PAIRED = 3.0, 400, 0.4, 1.0
#: Costs are log odds, smoothed by these counts (markup, text): of whole constructs, of bare marks and odd shapes. They end at these values.
WHOLE, BARE, DEFINITION = (25.0, 1.0), (1.0, 25.0), (10.0, 13.5)
MOST_SHAPE, MOST_MARK = 4.0, 1.5
#: Labelled pages that the costs are learned from at most, and the lengths of their texts and of their markup.
TRAIN_PAGES, TRAIN_TEXT, TRAIN_MARKUP = 1000, 10_000, 40_000
_TAGS = frozenset(
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del details dfn div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol option p param pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
_BLOCK_TAGS = frozenset("ul ol table tbody thead tr div p br hr section article blockquote".split())


def _shape(kind: str, m: re.Match, text: str) -> str:
    """The construct a mark stands in, with `:odd` where what stands in it or around it doesn't fit."""
    found, odd = m[0], False
    if kind == "html_tag":
        odd = re.match(r"</?([a-zA-Z0-9]+)", found)[1].lower() not in _TAGS
    elif kind == "html_entity":
        odd = html.unescape(found) == found
    elif kind == "markdown_setext":
        # An underline belongs to a line of text above it.
        above = text[: m.start()].rstrip("\n").rsplit("\n", 1)[-1].strip()
        odd = not above or above.startswith("|")
    elif kind == "markdown_table":
        odd = found.count("|") < 3 and not re.search(r"[^\s|]", found)
    elif kind == "markdown_bullet":
        end = text.find("\n", m.end())
        odd = bool(re.match(r"\s*[-+*]\s*[\d.,]+\s*$", text[m.start() : end if end >= 0 else len(text)]))
    elif kind == "markdown_number":
        odd = len(found.strip(" .")) > 2  # a year or a code
    elif kind == "markdown_strong":
        odd = found[0] == "_" and found.isascii() and found.isidentifier()  # a name of a program
    elif kind == "wiki_list":
        odd = not any(c in found for c in "*#")
    elif kind == "wiki_heading":
        odd = not re.search(r"[^\W\d_]", found)
    elif kind.startswith("bare"):
        kind += _mark(m)
    return kind + ":odd" if odd else kind


def _mark(m: re.Match) -> str:
    """The character that makes a span suspect."""
    first = m[0].lstrip()[:1]
    return "1" if first.isdigit() else "-" if first in "-+" else "'" if first == "'" else first or " "


class Costs:
    """Costs of marks and shapes from counts (name -> (markup, text)); without counts, marks cost nothing and shapes their prior."""

    def __init__(self, counts: dict[str, tuple[int, int]] | None = None):
        self.counts = counts or {}
        self.kept: dict[str, float] = {}

    def __call__(self, name: str) -> float:
        cost = self.kept.get(name)
        if cost is None:
            yes, no = self.counts.get(name, (0, 0))
            mark = len(name) == 1
            p, q = (1.0, 1.0) if mark else DEFINITION if name == "wiki_list:odd" else BARE if name.startswith("bare") or name.endswith(":odd") else WHOLE
            most = MOST_MARK if mark else MOST_SHAPE
            cost = self.kept[name] = min(max(math.log((yes + p) / (no + q)), -most), most)
        return cost


PRIOR = Costs()


def weak_labels(text: str, shown: str) -> list[tuple[str, str, bool]]:
    """(mark, shape, is markup) of the marks of a text, given what the page's own HTML shows, with single blanks: a mark that a
    reader of the page would see where the text has it is text, all others are residue."""
    out = []
    for m, kind in _candidates(text):
        low, high = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        around = " ".join(text[max(low, m.start() - 10) : min(high if high >= 0 else len(text), m.end() + 10)].split())
        out.append((_mark(m), _shape(kind, m, text), around not in shown))
    return out


def _dollars(text: str, start: int, end: int, width: int) -> bool:
    """Whether text[start:end], from `$` to `$` or `$$` to `$$`, is a formula and no prices, variables or rating."""
    body, after = text[start + width : end - width], text[end : end + 1]
    if width == 2:
        alone = "\n" not in body or not (text[text.rfind("\n", 0, start) + 1 : start].strip() or text[end : (text + "\n").index("\n", end)].strip())
        return bool(body.strip()) and (alone or bool(_IN_MATH.search(body)))
    if not body or body[0].isspace() or body[0].isdigit() or after.isdigit() or not _IN_MATH.search(body):
        return False
    return "\n" not in body or not (body[-1].isspace() or re.match(r"\w", after))


def formulas(text: str) -> list[tuple[int, int, str]]:
    """(start, end, construct) of formulas of any length between their marks, by start, found in one pass; they may overlap."""
    found, opened, inside = [], {}, {}
    for m in _MARKS.finditer(text):
        mark, start, end = m[0], m.start(), m.end()
        if mark[0] == "\n":
            opened.clear()
        elif m[1]:
            if m[2].rstrip("*") in _FORMULAS:
                if m[1] == "begin":
                    inside.setdefault(m[2], []).append(start)
                elif inside.get(m[2]):
                    found.append((inside[m[2]].pop(), end, "latex_display"))
        elif mark in _PAIRS.values():
            opened[mark] = start
        elif mark in _PAIRS:
            if (first := opened.pop(_PAIRS[mark], None)) is not None:
                found.append((first, end, "latex_display"))
        elif mark[0] == "$":
            first = opened.pop(mark, None)
            if mark == "$$":
                opened.pop("$", None)
            if first is not None and _dollars(text, first, end, len(mark)):
                found.append((first, end, "latex_math" if mark == "$" else "latex_display"))
            elif mark == "$$" or not re.match(r"[\w$]", text[start - 1 : start]):
                opened[mark] = start
    return sorted(found, key=lambda x: (x[0], -x[1]))


def _candidates(text: str) -> list[tuple[re.Match, str]]:
    """What may be markup, in order and without overlap: the first to start counts, a formula before anything else."""
    found, at, m = [], 0, _SCAN.search(text)
    for start, end, kind in [*formulas(text), (len(text) + 1, 0, "")]:
        while m and m.start() < start and start >= at:
            found.append((m, {"eq": "wiki_heading", "sc": "html_script"}.get(m.lastgroup, m.lastgroup)))
            at = m.end()
            m = _SCAN.search(text, at)
        if at <= start <= len(text):
            found.append((_WHOLE.match(text, start, end), kind))
            at = end
            if m and m.start() < at:
                m = _SCAN.search(text, at)
    return found


def graph(text: str, costs: Costs = PRIOR) -> tuple[list[tuple[re.Match, str]], list[tuple[float, float]], list[tuple[int, int, float]]]:
    """The candidates of a text; the costs (as text, as markup) of their marks and, after these, of their shapes; the edges."""
    found = _candidates(text)
    n = len(found)
    wanted = [costs(_mark(m)) for m, _ in found] + [costs(_shape(k, m, text)) for m, k in found]
    edges, last, opened = [(i, n + i, SHAPE) for i in range(n)], {}, {}
    for i, (m, k) in enumerate(found):
        kind = kind_of(k)
        if kind in last and m.start() - found[last[kind]][0].end() <= NEAR:
            edges.append((last[kind], i, ADJACENT))
        last[kind] = i
        if k in ("html_tag", "markdown_fence", "latex_environment"):
            name = re.sub(r"[^\w]+.*", "", m[0].lstrip("</")).lower() if k == "html_tag" else m[0].replace("\\end", "\\begin") if k == "latex_environment" else "fence"
            closing = m[0].startswith("</") or m[0].startswith("\\end") or (k == "markdown_fence" and opened.get("fence"))
            if closing and opened.get(name):
                edges.append((opened[name].pop(), i, PAIRED))
            else:
                opened.setdefault(name, []).append(i)
    return found, [(c, 0.0) if c > 0 else (0.0, -c) for c in wanted], edges


def kind_of(construct: str) -> str:
    """html, markdown, wiki or latex."""
    return construct.removeprefix("bare_").split("_")[0]


def spans(text: str, costs: Costs = PRIOR) -> list[tuple[int, int, str]]:
    """(start, end, construct) of the markup in a text, in order."""
    if not _MAYBE.search(text):
        return []
    found, nodes, edges = graph(text, costs)
    return [(m.start(), m.end(), k) for (m, k), yes in zip(found, label(nodes, edges)) if yes]


def kinds_of(text: str) -> list[str]:
    """Which of html, markdown, wiki and latex the text has constructs of."""
    found = {kind_of(k) for _, _, k in spans(text)}
    return [k for k in KINDS if k in found]


def _convert(kind: str, s: str, at_line_start: bool) -> str:
    if kind == "html_tag":
        name, closing = re.match(r"</?([a-zA-Z0-9]+)", s)[1].lower(), s.startswith("</")
        if re.fullmatch("h[1-6]", name):
            return "" if closing else "#" * int(name[1]) + " "
        if name in ("pre",):
            return "\n```" if closing else "```\n"
        if name in ("td", "th"):
            return " | " if closing else ""
        if name == "li":
            return "\n" if closing else "- "
        if name in _BLOCK_TAGS:
            return "" if at_line_start and not closing else "\n"
        return ""
    if kind == "html_entity":
        return html.unescape(s).replace("\u00a0", " ")
    if kind in ("html_script", "html_comment", "html_escaped", "markdown_image", "markdown_setext", "wiki_table", "wiki_switch", "latex_environment", "latex_word", "latex_row", "markdown_rule"):
        return re.match(r"!\[([^\]]*)", s)[1] if kind == "markdown_image" else ""
    if kind == "markdown_link":
        return re.match(r"\[([^\]]*)", s)[1]
    if kind in ("markdown_strong", "markdown_emphasis", "markdown_strike"):
        return s.strip("*_~")
    if kind == "markdown_quote":
        return ""
    if kind == "markdown_bullet":
        return "- "
    if kind == "markdown_table":
        cells = [c.strip() for c in s.strip().strip("|").split("|")]
        return "" if all(re.fullmatch(":?-*:?", c) for c in cells) else " | ".join(cells)
    if kind == "wiki_heading":
        level = len(re.match(r"\s*(=+)", s)[1])
        return "#" * level + " " + s.strip().strip("=").strip()
    if kind == "wiki_quotes":
        return s.strip("'")
    if kind == "wiki_template":
        return "\n".join(re.sub(r"\s*=\s*", ": ", p.strip(), count=1) for p in s[2:-2].split("|")[1:])
    if kind == "wiki_link":
        return s[2:-2].split("|")[-1]
    if kind == "wiki_external":
        return s[1:-1].partition(" ")[2] or s[1:-1]
    if kind == "wiki_list":
        return "1. " if s.rstrip().endswith("#") else "- "
    if kind == "latex_verbatim":
        return "```\n" + re.sub(r"\\(?:begin|end)\{[a-z]+\}", "", s).strip() + "\n```"
    if kind == "latex_section":
        return ("## " if "sub" in s.partition("{")[0] else "# ") + s.partition("{")[2].rstrip("}")
    if kind == "latex_item":
        return "- "
    if kind == "latex_command":
        inner = re.findall(r"\{([^{}]*)\}", s)
        return f" ({inner[0]})" if s.startswith("\\footnote") else " ".join(inner[-1:])
    return s  # headings, numbers, fences, code and formulas already have the form that stays


def clean_text(text: str, costs: Costs = PRIOR) -> tuple[str, list[str]]:
    """Clean text with `#` headings, `-` and `1.` lists, ` | ` table cells, fenced code and `$` formulas; the kinds found."""
    found = spans(text, costs)
    if not found:
        return text, []
    # Formulas stay as they are: a character that the text has not stands for them until all else is clean.
    taken = text + html.unescape(text)
    stand_in = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in taken)
    out, at, kept = [], 0, []
    for start, end, kind in found:
        out.append(text[at:start])
        line_start = not text[text.rfind("\n", 0, start) + 1 : start].strip() or "".join(out[-3:]).endswith("\n")
        new = stand_in if kind in ("latex_display", "latex_math") else _convert(kind, text[start:end], line_start)
        if new == stand_in:
            kept.append(text[start:end])
        if kind == "markdown_setext":  # the line above is the heading
            joined = "".join(out).rstrip("\n")
            head = joined.rfind("\n") + 1
            out = [joined[:head], "# " if "=" in text[start:end] else "## ", joined[head:], "\n"]
        else:
            out.append(new)
        at = end
        if not new and line_start and text[end : end + 1] == "\n" and kind not in ("html_tag", "html_entity"):
            at += 1  # nothing is left of the line
    out.append(text[at:])
    clean = "".join(out)
    if any(k.startswith("latex") for _, _, k in found):
        clean = re.sub(r"(?m)^([^&\n]{1,200}) & ([^\n]*)$", lambda m: m[1] + " | " + m[2].replace(" & ", " | "), clean)
    clean = re.sub(r"(?m)[ \t]*\|[ \t]*$|[ \t]+$", "", clean)
    clean = re.sub(r"\n{3,}", "\n\n", clean).strip("\n")
    if kept:
        clean = "".join(a + b for a, b in zip(clean.split(stand_in), [*kept, ""]))
    return clean, [k for k in KINDS if any(kind_of(x[2]) == k for x in found)]


def learn_costs(df: DataFrame, raw_col: str = "content_raw", text_col: str = "content_text") -> Costs:
    """Costs from at most TRAIN_PAGES pages with markup, of bounded lengths and without unfilled fields, as their first rows come.
    Where there are none, the costs are the prior ones."""
    raw, text = F.col(raw_col), F.col(text_col)
    sample = df.select(raw.alias("raw"), text.alias("text")).where((F.length("text") <= TRAIN_TEXT) & (F.length("raw") <= TRAIN_MARKUP)).limit(TRAIN_PAGES)
    counts: dict[str, list[int]] = {}
    for page in sample.collect():
        if _FIELD.search(page["text"]):
            continue  # a field may have been put into the text alone
        shown = " ".join(" ".join(block.split()) for block, _ in raw_blocks(page["raw"]))
        for mark, shape, yes in weak_labels(page["text"], shown):
            for name in (mark, shape):
                counts.setdefault(name, [0, 0])[not yes] += 1
    return Costs({k: (a, b) for k, (a, b) in counts.items()})


def clean_markup(df: DataFrame, id_col: str = "id", text_col: str = "content_text", raw_col: str = "content_raw") -> DataFrame:
    """(id, clean_text, markup): each text without markup and the kinds it had.

    A null text stays null with no kinds, an empty one stays empty; repeated rows stay; other columns are ignored. Without the
    column of the pages' own markup the prior costs hold.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    costs = learn_costs(df, raw_col, text_col) if raw_col in df.columns else PRIOR

    def make():
        def step(batch):
            done = [(None, []) if t is None else clean_text(t, costs) for t in batch.column(1).to_pylist()]
            return batch.column(0), [d[0] for d in done], [d[1] for d in done]

        return step

    return map_batches(texts, make, f"id {texts.schema['id'].dataType.simpleString()}, clean_text string, markup array<string>")
