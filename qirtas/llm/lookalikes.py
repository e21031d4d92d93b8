"""One consistent form for text that looks the same but differs in its characters (problem 4).

A transducer compiled from a conflict-checked mapping rewrites each affected line in one pass over grapheme clusters: a letter with
its accents, and the invisible characters among them. The mapping for widths, styles, presentation forms, split accents, spaces
and invisible characters always holds; that for look-alike letters and digits, from the public table of confusable characters
that the platform's ICU has, depends on the alphabet of the word and the line they stand in.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

# Characters without a shape, spaces, and letters of one shape in two alphabets.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CYRILLIC_AS_LATIN = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅУ", "aeopcyxijsdhqwABEKMHOPCTXIJSY"))
GREEK_AS_LATIN = dict(zip("ονυαιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovuaiABEZHIKMNOPTYX"))
LATIN_AS_LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ȷ": "j", "ſ": "s"}
PERSIAN_AS_ARABIC = {"ی": "ي", "ې": "ي", "ک": "ك", "ڪ": "ك", "ہ": "ه", "ە": "ه", "ھ": "ه", "ۃ": "ة"} | dict(zip("۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"))
_ARABIC_ONLY, _PERSIAN_ONLY = frozenset("يكةىأإؤ٠١٢٣٤٥٦٧٨٩"), frozenset("پچژگٹڈڑےںۓ")


def compatibility_forms() -> dict[str, str]:
    """Full-width and half-width forms, Arabic presentation forms, letters and digits of other styles, in circles and as Roman
    numerals, by rule: what NFKC makes of each of them."""
    out = {}
    for low, high in ((0x2160, 0x217F), (0x24B6, 0x24E9), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFE), (0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0x1D400, 0x1D7FF)):
        for code in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if plain != chr(code) and (unicodedata.category(chr(code))[0] in "LNPZ" or not 0x2000 < code < 0x2FFF and unicodedata.category(chr(code))[0] == "S" or 0x24B6 <= code <= 0x24E9):
                out[chr(code)] = plain.replace(" ", "") if len(plain) > 1 and plain[0] == " " else plain
    return out


def split_accents() -> dict[str, str]:
    """A letter and its accent or hamza, as two characters, to the composed letter: all canonical pairs of the BMP."""
    out = {}
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(code)) == chr(code):
            out["".join(chr(int(p, 16)) for p in parts)] = chr(code)
    return out


class Transducer:
    """Longest-match rewriting by a trie. Raises ValueError for conflicting rules, and for a result that is rewritten again."""

    def __init__(self, *mappings: dict[str, str]):
        rules: dict[str, str] = {}
        for mapping in mappings:
            for key, value in mapping.items():
                if not key or rules.get(key, value) != value:
                    raise ValueError(f"conflicting rules for {key!r}: {rules.get(key)!r} and {value!r}")
                rules[key] = value
        self.trie: dict = {}
        for key, value in rules.items():
            node = self.trie
            for ch in key:
                node = node.setdefault(ch, {})
            node[""] = value
        for key, value in list(rules.items()):
            settled = self.apply(value)
            if settled != value:
                if self.apply(settled) != settled:
                    raise ValueError(f"the rule for {key!r} doesn't settle")
                node = self.trie
                for ch in key:
                    node = node[ch]
                node[""] = settled

    def apply(self, text: str, keep=()) -> str:
        """The rewritten text; positions in `keep` are copied as they are."""
        out, at, n = [], 0, len(text)
        while at < n:
            node, to, best = self.trie, at, None
            while to < n and to not in keep and (node := node.get(text[to])) is not None:
                to += 1
                if "" in node:
                    best = (node[""], to)
            if best:
                out.append(best[0])
                at = best[1]
            else:
                out.append(text[at])
                at += 1
        return "".join(out)


COMPATIBLE, PAIRS = compatibility_forms(), split_accents()
#: All rules that always hold, compiled together, so that conflicts and results that would be rewritten again are found at once.
PLAIN = Transducer(COMPATIBLE, PAIRS, dict.fromkeys(INVISIBLE, ""), dict.fromkeys(SPACES, " "))

_ACCENTS = "\u0300-\u036f\u0653-\u0655"
_SUSPECT = re.compile(f"[{INVISIBLE}{SPACES}{_ACCENTS}\u2160-\u217f\u24b6-\u24e9\ufb00-\ufb06\ufb1d-\ufdff\ufe70-\ufefe\uff01-\uffee\u0250-\u02af\u0370-\u058f\u10a0-\u13ff\u1c80-\u1cbf\u1d00-\u1dbf\u2c00-\u2dff\ua4d0-\ua4ff\ua640-\ua69f\ua720-\uabbf\U00010000-\U000119ff\U0001d400-\U0001d7ff{''.join(LATIN_AS_LATIN)}{''.join(PERSIAN_AS_ARABIC)}]")
_EMOJI = "[\u00a9\u00ae\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u23ff\u25a0-\u27ff\u2900-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff]"
_SEQUENCE = re.compile(f"{_EMOJI}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]?(?:\u200d{_EMOJI}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]?)*")
_CLUSTER = re.compile(f"(?P<emoji>{_SEQUENCE.pattern})|[^{_ACCENTS}\u064b-\u0652\u0670{INVISIBLE}]?[{_ACCENTS}\u064b-\u0652\u0670{INVISIBLE}]*", re.S)
_HIDDEN = str.maketrans(dict.fromkeys(INVISIBLE))


def compose(letters: str, marks: str) -> tuple[str, str]:
    """A letter, or what stands for it, with its accents as one, and the marks that stay."""
    rest = []
    for m in marks:
        joined = PAIRS.get(letters[-1:] + m)
        if joined is None:
            rest.append(m)
        else:
            letters = letters[:-1] + joined
    return letters, "".join(rest)


def _alphabet(c: str) -> str:
    """The script of a letter, as its name begins; styles of Latin letters are Latin."""
    return unicodedata.name(c, "").partition(" ")[0]


class Forms:
    """The transducer: rules that always hold, look-alikes by the alphabet of the word.

    confusables: letter or digit -> the plain one that it looks like, beyond the tables above, which come first. names: words
    that stand for themselves, as the names of languages in their own spelling.
    """

    def __init__(self, confusables: dict[str, str] | None = None, names: frozenset[str] = frozenset()):
        own = Transducer(CYRILLIC_AS_LATIN, GREEK_AS_LATIN, LATIN_AS_LATIN) and CYRILLIC_AS_LATIN | GREEK_AS_LATIN | LATIN_AS_LATIN
        self.latin = {k: v for k, v in (confusables or {}).items() if k not in COMPATIBLE} | own
        self.cyrillic = {v: k for k, v in CYRILLIC_AS_LATIN.items()}
        self.names = names
        self.seen: dict[str, tuple[str, str]] = {}

    def cluster(self, text: str) -> tuple[str, str]:
        """(letters, marks) of a cluster; what was seen is kept."""
        found = self.seen.get(text)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            plain = text.translate(_HIDDEN)
            base = plain[:1] if plain and not re.match(f"[{_ACCENTS}\u064b-\u0652\u0670]", plain) else ""
            letters = " " if base in SPACES and base else COMPATIBLE.get(base, base)
            found = self.seen[text] = compose(letters, plain[len(base) :]) if letters else (plain, "")
        return found

    def word(self, word: str, persian: bool, latin_line: bool) -> str:
        """The word with its look-alikes replaced, letter for letter."""
        if word.isascii() or word in self.names:
            return word
        letters = [c for c in word if not c.isascii() and c.isalpha()]
        if re.search("[A-Za-z]", word) or any(_alphabet(c) == "LATIN" for c in letters):
            other = [c for c in letters if _alphabet(c) != "LATIN"]
            if other and all(c in self.latin for c in other):
                return "".join(self.latin.get(c, c) for c in word)
            if other and all(_alphabet(c) == "CYRILLIC" for c in other) and all(c in self.cyrillic for c in word if c.isascii() and c.isalpha()):
                return "".join(self.cyrillic.get(c, c) for c in word)
            if all(c in self.latin for c in letters):  # in a word with other accents these may be right
                return "".join(self.latin.get(c, c) for c in word)
            return word
        if letters and latin_line and len(letters) > 1 and all(c in self.latin for c in letters):
            return "".join(self.latin.get(c, c) for c in word)
        return word if persian else "".join(PERSIAN_AS_ARABIC.get(c, c) for c in word)


DEFAULT = Forms()


def _is_persian(found: list[str], names: frozenset[str]) -> bool:
    """True for a line wholly in Persian or Urdu: it has letters only these have, and none that only Arabic has."""
    letters = set("".join(w for w in found if w not in names))
    return bool(letters & _PERSIAN_ONLY) and not letters & _ARABIC_ONLY


def clean_line(line: str, forms: Forms = DEFAULT) -> str:
    """The line in its consistent form; the same object if nothing stands for anything else."""
    if not _SUSPECT.search(line):
        return line
    parts: list[tuple[str, str, bool]] = []  # letters, marks, part of a word
    hidden: list[bool] = []
    for m in _CLUSTER.finditer(line):
        if m["emoji"]:
            letters, marks = m[0], ""
        elif m[0]:
            letters, marks = forms.cluster(m[0])
        else:
            continue
        hidden.append("\u200c" in m[0])
        parts.append((letters, marks, bool(letters) and letters.isalnum()))
    words, at = [], 0
    while at < len(parts):
        end = at
        while end < len(parts) and parts[end][2]:
            end += 1
        if end > at:
            words.append((at, end, "".join(x[0] for x in parts[at:end])))
        at = max(end, at + 1)
    found = [w for _, _, w in words]
    persian = _is_persian(found, forms.names)
    news = [forms.word(w, persian, False) for w in found]
    # A word of another alphabet, all of it look-alikes, is disguised where all other words are Latin.
    if any(w.isascii() and w.isalpha() for w in news) and all(w.isascii() or all(c in forms.latin or _alphabet(c) == "LATIN" for c in w if c.isalpha()) for w in news):
        news = [forms.word(w, persian, True) for w in news]
    out = [letters + marks for letters, marks, _ in parts]
    for (low, high, word), new in zip(words, news):
        if new != word:
            at = 0
            for k in range(low, high):
                size = len(parts[k][0])
                out[k] = "".join(compose(new[at : at + size], parts[k][1]))
                at += size
    if persian:  # a non-joiner inside a Persian word is spelling
        for k in range(len(parts) - 1):
            if hidden[k] and parts[k][0][-1:].isalpha() and parts[k + 1][0][:1].isalpha():
                out[k] += "\u200c"
    new = "".join(out)
    return line if new == line else new


def clean_text(text: str, forms: Forms = DEFAULT) -> tuple[str, list[int]]:
    """The text in its consistent form, and the numbers of its affected lines, from 1."""
    if not _SUSPECT.search(text):
        return text, []
    lines = text.split("\n")
    changed = [clean_line(x, forms) for x in lines]
    return "\n".join(changed), [k + 1 for k, (a, b) in enumerate(zip(lines, changed)) if a is not b and a != b]


@lru_cache(1)
def platform_forms() -> Forms:
    """The transducer with the public table of confusable characters and the names of languages, both from the session's ICU."""
    jvm = SparkSession.active()._jvm
    letters = [chr(c) for low, high in ((0x00C0, 0x05FF), (0x10A0, 0x13FF), (0x1C80, 0x1DBF), (0x1E00, 0x1FFF), (0x2C00, 0x2DFF), (0xA4D0, 0xA4FF), (0xA640, 0xABBF), (0x10280, 0x1059F), (0x118A0, 0x118FF)) for c in range(low, high + 1) if chr(c).isalnum()]
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join([*plain, *letters])).split("\n")
    if len(skeletons) != len(plain) + len(letters):
        raise RuntimeError("the table of confusable characters has another form")
    by_shape: dict[tuple[str, bool], str] = {}
    for c, shape in zip(plain, skeletons):
        by_shape.setdefault((shape, c.isupper()), c)
    confusables = {}
    for c, shape in zip(letters, skeletons[len(plain) :]):
        like = by_shape.get((shape, c.isupper())) or by_shape.get((shape, not c.isupper()))
        if like and _alphabet(c) != "LATIN":
            confusables[c] = like
        elif small := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, "")):
            confusables[c] = small[1].lower()
    names = set()
    locale = jvm.com.ibm.icu.util.ULocale
    for code in jvm.java.util.Locale.getISOLanguages():
        names.update(locale.getDisplayLanguage(code, code).split())
    return Forms(confusables, frozenset(names))


def unify_lookalikes(df: DataFrame, id_col: str = "id", text_col: str = "content_text") -> DataFrame:
    """(id, clean_text, lines): each text in one consistent form and the numbers of its affected lines.

    Rows with a null text keep it and have no lines; an empty text stays empty. Repeated rows stay; other columns are ignored.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    forms = platform_forms()

    def make():
        def step(batch):
            done = [(None, []) if t is None else clean_text(t, forms) for t in batch.column(1).to_pylist()]
            return batch.column(0), [d[0] for d in done], [d[1] for d in done]

        return step

    return map_batches(texts, make, f"id {texts.schema['id'].dataType.simpleString()}, clean_text string, lines array<int>")
