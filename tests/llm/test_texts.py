"""Functions of the training-data operators on single texts, against brute force and invariants."""

import itertools
import random
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qirtas.llm import language, leakage, lookalikes, main_body, markup, min_cut, splitting, template_residue
from qirtas.llm.gray_index import gray_rank, near_pairs
from qirtas.llm.near_duplicates import hamming_bound, shingle_hashes, sketch, word_hashes


# ---- splitting
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#é́‍", max_size=200), st.integers(10, 40), st.integers(0, 9))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap, 3)
    assert "".join(text[a:b] for a, b, _ in pieces[:1]) == text[: pieces[0][1]] if pieces else text == ""
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert b - a <= limit and a < c <= b < d and b - c <= overlap
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][1] - pieces[-1][0] <= limit


def test_pieces_end_at_the_coarsest_boundary():
    text = "# one\n" + "word " * 30 + "\n# two\n" + "word " * 30
    assert [k for _, _, k in splitting.split_text(text, 200, 20)][0] == "section"
    assert {k for _, _, k in splitting.split_text("x" * 1000, 100, 10)[:-1]} == {"character"}
    assert splitting.split_text("", 100, 10) == []
    with pytest.raises(ValueError):
        splitting.split_text("x", 10, 10)


def test_the_next_piece_begins_at_a_sentence_or_a_word():
    text = "".join(f"Sentence number {k} is here. " for k in range(100))
    pieces = splitting.split_text(text, 400, 80, 40)
    assert len(pieces) > 5 and all(text[a:].startswith("Sentence") and end - a <= 80 for (_, end, _), (a, _, _) in zip(pieces, pieces[1:]))
    words = "word " * 400
    pieces = splitting.split_text(words, 400, 80, 40)
    assert all(end - a == 80 for (_, end, _), (a, _, _) in zip(pieces, pieces[1:]))  # a word begins there already


# ---- Gray index
def test_gray_neighbours_differ_in_one_bit():
    codes = np.array([[0, g ^ (g >> 1)] for g in range(64)], dtype=np.uint64)
    high, low = gray_rank(codes)
    assert low.tolist() == list(range(64)) and not high.any()


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 200, 1500])
def test_index_finds_all_near_pairs(n):
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
    if n > 4:
        bits[n // 2 : n // 2 * 2] = bits[: n // 2] ^ (np.uint64(1) << rng.integers(0, 63, (n // 2, 4), dtype=np.uint64))
        bits[-1] = bits[0]
    i, j = near_pairs(bits, 40)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    distance = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=np.int64)
    assert found == {(a, b) for a, b in zip(*np.nonzero(distance <= 40)) if a < b} and len(i) == len(found)


@pytest.mark.parametrize("n", [2, 9, 40, 700])
def test_leading_bits_must_agree(n):
    rng = np.random.default_rng(n)
    bits, lead = rng.integers(0, 2**63, (n, 4), dtype=np.uint64), rng.integers(0, max(2, n // 4), (n, 2), dtype=np.uint64)
    i, j = near_pairs(bits, 128, lead)
    distance = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=np.int64)
    want = {(a, b) for a, b in zip(*np.nonzero((distance <= 128) & (lead[:, None] == lead[None]).all(2))) if a < b}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_fingerprints_of_similar_texts_are_near():
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    a = sketch(shingle_hashes(word_hashes(words, {}), 3))
    b = sketch(shingle_hashes(word_hashes(words[:300] + [f"v{i}" for i in range(60)], {}), 3))
    far = sum(bin(x ^ y).count("1") for x, y in zip(a[1], b[1]))
    assert far <= hamming_bound(0.55) and set(a[0].tolist()) & set(b[0].tolist())


# ---- look-alikes
NAMED = lookalikes.Forms(names=frozenset(["فارسی", "اردو"]))


@pytest.mark.parametrize(
    "line, clean",
    [
        ("ｂｏｏｋｉｎｇ ４２１", "booking 421"), ("خﻻل", "خلال"), ("cafe\u0301", "café"), ("ا\u0654حمد", "أحمد"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), ("\u0440ermit of", "permit of"),
        ("التدریب", "التدريب"), ("مدة ۱۱۹ أيام", "مدة ١١٩ أيام"), ("العربية · English · فارسی", None), ("👨\u200d👩\u200d👧", None), ("Русский", None), ("الطَّلب", None), ("این نامه‌ها را بپذیرید چون گم شد", None), ("plain", None), ("", None),
    ],
)
def test_lines_in_one_form(line, clean):
    assert lookalikes.clean_line(line, NAMED) == (line if clean is None else clean)


@pytest.mark.parametrize("line, clean", [("\U0001d41a\U0001d41b", "ab"), ("ⓐⓑ", "ab"), ("ⅷ", "viii"), ("Ꭺbc", "Abc"), ("ʜello", "hello"), ("сора of the town", "copa of the town"), ("e\u200b\u0301", "é"), ("ﻻ\u0654", "لأ"), ("cafе\u0301", "café"), ("a\u3000b", "a b"), ("© Русский", None), ("العربية · English · فارسی · اردو · Русский", None), ("naïve Müller ﬁne", "naïve Müller fine"), ("x² ½ ①", None)])
def test_lines_by_the_public_table(spark, line, clean):
    found = lookalikes.clean_line(line, lookalikes.platform_forms())
    assert found == (line if clean is None else clean) and lookalikes.clean_line(found, lookalikes.platform_forms()) == found


def test_conflicting_rules_are_refused():
    with pytest.raises(ValueError):
        lookalikes.Transducer({"a": "b"}, {"a": "c"})
    assert lookalikes.Transducer({"ab": "x", "a": "y"}).apply("abaa") == "xyy"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abеоﻻا\u0654ｂ\u200b\u00a0\u0301 یيk\n", max_size=40))
def test_the_form_is_stable(text):
    once, lines = lookalikes.clean_text(text)
    assert lookalikes.clean_text(once) == (once, []) and bool(lines) == (once != text)


# ---- main body
PAGE = """<html><head><title>Permit</title></head><body><nav><ul><li>Home</li><li>News</li></ul></nav><main><h1>Permit</h1>
<p>The permit of the market is given after ten days by the office of the town.</p><ul><li>bring the form</li></ul></main>
<div class="zone-b">Copyright 12 the office.</div><footer><p>Follow us</p></footer><script>var x="</p>"</script></body></html>"""


def weighed(text, raw, weight):
    keys, sizes, kinds, openings, hits, parts, places, lengths, block_keys, block_openings, title = main_body.read_page(text, raw)
    weights = [weight(p) for _, p in main_body.raw_blocks(raw or "")]
    return keys, sizes, main_body.weigh_page(kinds, keys, hits, parts, lengths, weights, block_keys, block_openings, title)[0], openings


def test_body_and_furniture_of_a_page():
    text = "Home\nNews\nPermit\nThe permit of the market is given after ten days by the office of the town.\n\nCopyright 99 the office.\nbring the form\nFollow us"
    own = weighed(text, PAGE, lambda place: 0.9 if "/main/" in place else 0.01)
    assert main_body.furniture_lines(*own, {}) == [1, 2, 6, 8]


def test_windows_find_the_main_text():
    lengths = np.array([2, 2, 3, 30, 6, 7, 40, 5, 4, 3])
    assert main_body.main_text(lengths).tolist() == [False] * 3 + [True] * 4 + [False] * 3
    assert main_body.main_text(np.array([3, 2, 4])) is None and main_body.main_text(np.empty(0, dtype=int)) is None
    # Words between surge and dive that count for nothing are silent; body words away from the windows are not body.
    assert main_body.body_blocks(np.array([5, 30, 20, 30, 9, 1]), np.array([0.01, 0.8, 0.01, 0.8, 0.01, 0.8])).tolist() == [False, True, False, True, False, False]


def test_a_page_without_markup_asks_the_others():
    text = "Permit\nThe permit of the market is given after ten days by the office of the town.\nFollow us"
    own = weighed(text, None, None)
    assert main_body.furniture_lines(*own, {main_body.line_key("follow us!"): True}) == [3]
    for raw in ("", "<", "<p", "no markup", "<html></html>"):
        main_body.read_page(text, raw)


# ---- minimum cut, markup
@settings(max_examples=150, deadline=None)
@given(st.data())
def test_labels_cost_least(data):
    n = data.draw(st.integers(0, 6))
    weight = st.integers(0, 9).map(lambda x: x / 3)
    costs = data.draw(st.lists(st.tuples(weight, weight), min_size=n, max_size=n))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), weight), max_size=10)) if n else []
    total = lambda labels: sum(c[x] for c, x in zip(costs, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])
    assert total(min_cut.label(costs, edges)) == pytest.approx(min(total(x) for x in itertools.product((0, 1), repeat=n)))


@pytest.mark.parametrize(
    "text, clean, kinds",
    [
        ("<h2>Fees</h2>\n<ul><li>one</li><li>two</li></ul>", "## Fees\n- one\n- two", ["html"]), ("a &amp; b", "a & b", ["html"]), ("# T\n\n**b** and [x](/y)", "# T\n\nb and x", ["markdown"]),
        ("Title\n=====\ntext", "# Title\ntext", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n1 | 2", ["markdown"]), ("== T ==\n'''b''' [[p|q]]\n:* one", "## T\nb q\n- one", ["wiki"]), ("{{box|fee=3|time=4}}", "fee: 3\ntime: 4", ["wiki"]),
        ("\\section{T}\n\\begin{itemize}\n\\item one\n\\end{itemize}\nx \\textbf{y}", "# T\n- one\nx y", ["latex"]), ("take $x_{1} \\le 3$", "take $x_{1} \\le 3$", ["latex"]),
        ("• a\n1) b #12 < 3 $ 5 [1] {x} {{ name }} [[%n%]] 4 * 5", None, []), ("", None, []), ("age < 9 or > 3", None, []),
    ],
)
def test_markup_becomes_clean_text(text, clean, kinds):
    assert markup.clean_text(text) == (text if clean is None else clean, kinds)


@pytest.mark.parametrize("text, clean", [("call __init__ of it", None), ("2024. Annual report", None), ("a<script>alert(1)</script>b", "ab"), ("**a phrase that is in bold and of more than eighty characters, as it goes on and on and on**", "a phrase that is in bold and of more than eighty characters, as it goes on and on and on"), ("*" + "word " * 40 + "end*", "word " * 40 + "end")])
def test_names_years_scripts_and_long_emphasis(text, clean):
    assert markup.clean_text(text)[0] == (text if clean is None else clean)


LEARNED = markup.Costs({"[": (900, 100), "#": (900, 30), "$": (90, 20), "<": (5000, 80), "*": (700, 20), "bare_markdown[": (0, 90), "bare_markdown#": (1, 30), "bare_latex$": (0, 20), "bare_html<": (0, 40), "bare_html>": (0, 40), "bare_markdown*": (0, 20)})
BARE = "file #516 costs $ 203 [1] if age < 18 *."


def test_the_cut_decides_what_marks_are(monkeypatch):
    assert markup.clean_text(BARE + "\n# Fees\n[x](/y) and <b>z</b>", LEARNED) == (BARE + "\n# Fees\nx and z", ["html", "markdown"])
    assert markup.clean_text(BARE + "\n`x`", LEARNED)[1] == ["markdown"]
    monkeypatch.setattr(markup, "label", lambda nodes, edges: [a > b for a, b in nodes])
    assert markup.clean_text(BARE + "\n`x`", LEARNED)[1] == ["html", "markdown", "latex"]


def test_weak_labels_tell_residue_from_text():
    said = {(mark, shape): yes for mark, shape, yes in markup.weak_labels("pay [1] and then come back **now**", "pay [1] and then come back now")}
    assert said == {("[", "bare_markdown["): False, ("*", "markdown_strong"): True}


LONG = " + ".join([r"\frac{a}{b}"] * 300)


@pytest.mark.parametrize(
    "formula",
    [
        rf"\[{LONG}\]", rf"\({LONG}\)", f"${LONG}$", "$" + "x_1 + " * 200 + "y$", "\\[\n\\frac{a}{b}  \\\\[2pt]\n|x|\n\\]", "$$\n\\frac{a}{b}\n$$", "$\\frac{a}{b} +\nc$",
        "\\begin{align*}\na & = \\frac{a}{b} \\\\\n|b| & = |c|\n\\end{align*}", "\\begin{equation}\n\\begin{array}{ll}\\frac{a}{b} & \\begin{array}{l}c\\end{array}\\end{array}\n\n\n\n\\end{equation}", r"$$\frac{a}{b}$$",
    ],
)
def test_formulas_of_any_length_and_over_lines_stay(formula):
    clean, kinds = markup.clean_text(f"The \\textbf{{fee}} &#xE000;is\n{formula}\nfor \\emph{{all}} \\footnote{{note}}.\na & b")
    assert clean == f"The fee \ue000is\n{formula}\nfor all  (note).\na | b" and kinds == ["html", "latex"]


@pytest.mark.parametrize("text", ["from $5 to $7_000", "$HOME_DIR\nand\n$OTHER_DIR", "$$ or\nmore $$ a night", "\\begin{equation} is\n\\] not \\[ closed", "$a_1\n\nb$"])
def test_single_marks_are_no_formulas(text):
    assert markup.formulas(text) == []


def test_formula_marks_take_linear_time():
    for part in ("\\[", "\\(", "$x_", "$$", "\\[ \\( $", "\\begin{align}", "$ a_1 $\n", "\\] \\)"):
        began = time.process_time()
        markup.clean_text(part * 20_000)
        assert time.process_time() - began < 10


# ---- template residue
@pytest.mark.parametrize("text", ["الرسم: {{ fee_owner }}", "[اسم الخدمة] للسكان", "fee: undefined", "Pay [INSERT FEE HERE] units", "phone: null", "at %CITY_NAME% now"])
def test_unfilled_fields(text):
    assert template_residue._FIELD.search(text)


@pytest.mark.parametrize("text", ["{{box|fee=3}} \\textbf{x} [1] [text](url)", "A permit.", "", "none of them", "the null hypothesis"])
def test_no_fields(text):
    assert not template_residue._FIELD.search(text)


def test_evidence_is_weighed_against_content():
    known = template_residue.Evidence({"page": (9, 10), "not": (9, 9), "found": (9, 9), "page not": (9, 9), "not found": (9, 9), "market": (1, 300), "of": (5, 500)}, 20, 1000)
    assert template_residue.judge(["Permit", "page not found"], known) == "message"
    assert template_residue.judge(["page not found", "Permit", "of market of market of market of market"], known) is None
    assert template_residue.judge(["Permit"], known) is None and template_residue.judge([], known) is None


# ---- leakage, language
def test_common_subsequence_is_the_longest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert leakage.common_subsequence(a, b) == table[-1][-1]


def test_words_in_all_spellings():
    assert leakage.fold_words("إلى ٱلمدرسة ٣ Ｘ") == leakage.fold_words("الي المدرسه 3 x")
    assert leakage.fold_words(None) == [] == leakage.fold_words("")


def test_probabilities_add_up():
    model = language.KneserNey({"banana": 3, "band": 2, "can": 5, "nab": 1}, order=3, alphabet=10)
    for context in ("", "b", "ba", "n", "xx"):
        letters = [c for c in "abcdn\x03efgh"]
        total = 0.0
        for c in letters:
            gram = "\x02" + context + c
            grams, _, contexts = language.ngram_hashes([gram[1:-1] + ("" if c == "\x03" else c)], 3)
            at = len(context) if c != "\x03" else -1
            total += 2 ** float(model.log2([g[[at]] for g in grams], [x[[at]] for x in contexts])[0])
        assert total == pytest.approx(1.0, abs=0.02)


def test_wrong_labels_do_not_spoil_the_models():
    rng = random.Random(1)
    english, turkish = "the permit of market and office is given with form".split(), "pazar için ruhsat başvurusu ile kurum yanıt verir gün".split()
    samples = [("en" if rng.random() < 0.85 else "tr", " ".join(rng.choices(english, k=12))) for _ in range(60)] + [("tr" if rng.random() < 0.85 else "en", " ".join(rng.choices(turkish, k=12))) for _ in range(60)]
    known = language.fit_identifier(samples)
    said = known.languages(["the form is given", "kurum ruhsat verir", "12 34", "ωψχ φθη ξζδ πσρ βγκ"])
    assert [c for c, _ in said] == ["en", "tr", "und", "und"] and said[0][1] > 0.9


# ---- very long texts end in time
@pytest.mark.parametrize("unit", ["*", "[", "$x_", "{{a|", "<b ", "&lt;p ", "\\begin{x}", "dolor", "word ", "سطر\n", "`", "== ", "a\u0301", "١٢", "<div>"])
def test_very_long_texts(unit):
    text = unit * (60_000 // len(unit))
    began = time.time()
    markup.clean_text(text), lookalikes.clean_text(text), splitting.split_text(text), template_residue.judge(text.split("\n"), template_residue.Evidence({}, 0, 0)), main_body.read_page(text, text), leakage.fold_words(text)
    assert time.time() - began < 30
    assert unicodedata.normalize("NFC", text[:3]) is not None
