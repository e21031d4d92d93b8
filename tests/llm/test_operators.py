"""Operators of the training-data pipeline on small tables: brute force, dirty rows, empty tables, clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qirtas.llm import language, leakage, main_body, markup, mixing, near_duplicates, repeated_lines, splitting, template_residue
from qirtas.llm.common import words
from qirtas.llm.lookalikes import unify_lookalikes

#: Names that the operators use themselves, as columns of their input.
EXTRA = ("text", "key", "site", "host", "rep", "lines", "line", "at", "tokens", "copies", "rank", "lang", "label", "n", "raw", "own", "piece")
PAGES = "id bigint, url string, content_raw string, content_text string, http_status int, " + ", ".join(f"{c} string" for c in EXTRA)
DOCS = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in EXTRA if c not in ("text", "lang"))


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], PAGES)


def docs(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * (len(EXTRA) - 2)) for r in rows], DOCS)


BODY = "The permit of the harbour market number {} is given after ten working days by the office of the town and its clerk."
DIRTY = [
    (None, None, None, None, None), (1, None, None, "", 200), (2, "", "", None, 404), (3, "no host", "<p", "text only", None), (4, "https://a.example/1", "<html></html>", "\n\n \n", 200), (4, "https://a.example/1", "<html></html>", "\n\n \n", 200),
    (5, "https://a.example/2", "<p>" * 500, "word " * 30_000, 200), (6, "https://a.example/3", None, "x" * 50_000, 200), (7, "https://b.example/1", "", "\x00\u200b\ufeff", 0), (8, "//", "\x00", "404", 404),
]
PAGE_OPERATORS = {
    "split": splitting.split_oversized, "split_all": lambda d: splitting.split_oversized(d, all_texts=True), "places": repeated_lines.repeated_line_places, "clean_lines": repeated_lines.remove_repeated_lines,
    "links": lambda d: near_duplicates.NearDuplicates(d).links(), "documents": lambda d: near_duplicates.NearDuplicates(d).documents(), "groups": lambda d: near_duplicates.NearDuplicates(d).groups(), "pairs": lambda d: near_duplicates.NearDuplicates(d).pairs(),
    "lookalikes": unify_lookalikes, "furniture": lambda d: main_body.MainBody(d).line_numbers(), "body": main_body.main_body, "markup": markup.clean_markup, "residue": template_residue.template_residue,
}


@pytest.mark.parametrize("name", PAGE_OPERATORS)
def test_page_operators_take_dirty_and_empty_tables(spark, name):
    run = PAGE_OPERATORS[name]
    dirty = run(pages(spark, DIRTY))
    rows = dirty.collect()
    empty = run(pages(spark, []))
    assert empty.columns == dirty.columns and (empty.collect() == [])
    if name in ("lookalikes", "body", "markup", "clean_lines"):
        assert len(rows) == len(DIRTY)
    if name == "split":
        assert {r["id"] for r in rows} == {5, 6} and all(len(r["piece"]) <= 4000 for r in rows)


DOC_OPERATORS = {
    "languages": lambda d: language.identify_languages(d), "mislabelled": lambda d: language.mislabelled(language.identify_languages(d)), "tokens": mixing.count_tokens,
    "leaks": lambda d: leakage.Leakage(d, [(1, [BODY.format(9)])]).candidates(), "leaks_of_nothing": lambda d: leakage.Leakage(d, []).candidates(),
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_document_operators_take_dirty_and_empty_tables(spark, name):
    rows = [(None, None, None, None), (1, "", "", ""), (2, None, "en", "s"), (3, "12 34 \n\n 5", "xx", None), (3, "12 34 \n\n 5", "xx", None), (4, "word " * 20_000, " EN-us ", "s"), (5, BODY.format(9), None, "s")]
    dirty = DOC_OPERATORS[name](docs(spark, rows))
    found = dirty.collect()
    assert DOC_OPERATORS[name](docs(spark, [])).collect() == []
    if name in ("languages", "tokens"):
        assert len(found) == len(rows)
    if name == "leaks":
        assert [(r["doc_id"], r["item_id"], r["words_in_row"]) for r in found] == [(5, 1, True)]
    if name == "leaks_of_nothing":
        assert found == []


def brute_repeated(rows, least=5, share=0.2):
    letters = lambda s: re.sub(r"[\W\d_]+", "", s.lower())
    seen, sizes = defaultdict(set), Counter()
    for i, url, text in rows:
        if text is not None and (host := (re.search("//([^/]*)", url) or [0, ""])[1]):
            sizes[host] += 1
            for line in text.split("\n"):
                if letters(line):
                    seen[host, letters(line)].add(i)
    return {(i, k + 1) for i, url, text in rows if text is not None for k, line in enumerate(text.split("\n")) if len(s := seen.get((url.split("/")[2], letters(line)), ())) >= least and len(s) >= share * sizes[url.split("/")[2]]}


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(2)
    notices = ["Legal notice 1", "share   this", "By A", "LEGAL NOTICE 2!", "Share this", "...", "", "Rare"]
    rows = []
    for i in range(120):
        host = rng.choice(["a.example", "a.example", "b.example", "c.example" if i < 4 else "a.example"])
        lines = [rng.choice(notices) if rng.random() < 0.5 else f"body {chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(1, 9))]
        rows.append((i, f"https://{host}/{i}", "\n".join(lines) if i % 17 else None))
    table = pages(spark, [(i, u, None, t, 200) for i, u, t in rows])
    found = {tuple(r) for r in repeated_lines.repeated_line_places(table).collect()}
    assert found == brute_repeated(rows) and found
    clean = {r["id"]: r["clean_text"] for r in repeated_lines.remove_repeated_lines(table, block_share=None).collect()}
    for i, _, text in rows:
        assert clean[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k + 1) not in found))


def test_blocks_of_several_lines(spark):
    table = pages(spark, [(i, f"https://a.example/{i}", None, f"own {'abcdefghij'[i]}\nfirst notice\n12\nsecond notice\nthird notice", 200) for i in range(10)])
    blocks = {len(r["block"]): r["docs"] for r in repeated_lines.repeated_line_blocks(table).collect()}
    assert blocks == {1: 10, 2: 10, 3: 10}


def test_blocks_are_removed_though_their_lines_be_rare_alone(spark):
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèáíóúñçßøåæœðþ"
    rows = [(i, f"https://a.example/{i}", None, f"own {a}{b}\nalpha notice\nbeta notice\nend {b}{a}" if n < 8 else f"own {a}{b}\nalpha notice\nend {b}{a}", 200) for i, (n, a, b) in enumerate((k, x, y) for k, (x, y) in enumerate((x, y) for x in letters[:10] for y in letters[:10]))]
    table = pages(spark, rows)
    clean = {r["id"]: r["clean_text"] for r in repeated_lines.remove_repeated_lines(table, min_share=1.01).collect()}
    assert all("notice" not in clean[i] for i in range(8)) and all("alpha notice" in clean[i] for i in range(8, 100))


def test_suffixes_longer_than_their_depth_cover_all_lines(spark):
    long = "\n".join(f"line {chr(0x4E00 + k)}" for k in range(150)) + "\nsame" * 3000
    table = pages(spark, [(i, "https://a.example/x", None, long, 200) for i in range(6)])
    assert repeated_lines.repeated_line_places(table).count() == 6 * 3150


def edited(rng, found, share):
    return " ".join(rng.choice(["alpha", "beta", "gamma", w]) if rng.random() < share else w for w in found)


def near_rows(rng, bases=12, size=150):
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for k in range(rng.randrange(1, 5)):
            rows.append((i, edited(rng, base, 0.03 * k)))
            i += 1
    return rows + [(i, rows[0][1]), (i + 1, rows[0][1].upper()), (i + 2, "short text"), (i + 3, None)]


@pytest.mark.parametrize("block", [4096, 2])
@pytest.mark.parametrize("size, similarity", [(3, 0.55), (5, 0.8)])
def test_near_duplicates_match_brute_force(spark, size, similarity, block):
    rows = near_rows(random.Random(size))
    sets = {i: frozenset(zip(*(w[k:] for k in range(size)))) for i, t in rows if t and len(w := words(t)) >= 100}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    found = near_duplicates.NearDuplicates(pages(spark, [(i, None, None, t, 200) for i, t in rows]), shingle=size, similarity=similarity, min_words=100, block=block)
    assert {tuple(r) for r in found.pairs().collect()} == want and len(want) > 5
    groups = {r["id"]: r["group_id"] for r in found.groups().collect()}
    parent = {i: i for i in sets}
    for _ in sets:
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert groups == {i: p for i, p in parent.items() if any(i in pair for pair in want)}
    classes = {r["id"]: r["class_id"] for r in found.documents().collect()}
    assert classes.keys() == sets.keys() and all(sets[c] == sets[i] for i, c in classes.items())


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"term{k}" for k in range(400)]
    items = [(k, [" ".join(rng.choices(vocabulary, k=45)), " ".join(rng.choices(vocabulary, k=22))]) for k in range(20)]
    rows = []
    for i in range(150):
        text = [f"plain{rng.randrange(5000)}" for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            source = rng.choice(rng.choice(items)[1]).split()
            at, n = rng.randrange(len(source) - 8), rng.randrange(6, 22)
            where = rng.randrange(len(text) + 1)
            text[where:where] = [w.upper() for w in source[at : at + n]]
        rows.append((i, "  ".join(text), None, None))
    runs = {(k, tuple(t.split()[a : a + 10])) for k, texts in items for t in texts for a in range(len(t.split()) - 9)}
    by_run = defaultdict(set)
    for k, r in runs:
        by_run[r].add(k)
    want = {(i, k) for i, w in ((r[0], r[1].lower().split()) for r in rows) for a in range(len(w) - 9) for k in by_run.get(tuple(w[a : a + 10]), ())}
    found = leakage.Leakage(docs(spark, rows), items).candidates().where("words_in_row").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 10
    table = spark.createDataFrame([(k, *t) for k, t in items] + [(None, "x", "y"), (99, None, "")], "item_id bigint, context string, question string")
    sliced = leakage.leaks(docs(spark, rows), table, most=500)
    assert len(list(leakage.item_slices(table, most=500))) > 2 and {(r["doc_id"], r["item_id"]) for r in sliced.where("words_in_row").collect()} == want
    assert leakage.leaks(docs(spark, rows), table.limit(0)).collect() == []


def test_token_counts_are_those_of_the_tokenizer():
    rng = random.Random(6)
    counter = mixing.TokenCounter()
    for _ in range(3000):
        text = "".join(rng.choice("ab1 \n\t.'s  عé   ") for _ in range(rng.randrange(30)))
        assert counter.count(text) == len(counter.encode(text))


def test_mix_keeps_caps_and_reports_shortfalls(spark):
    rows = [(i, BODY.format(i), "en", "big") for i in range(300)] + [(1000 + i, BODY.format(i), "en", "small") for i in range(5)] + [(2000 + i, BODY.format(i) * (i + 1), "en", "mid") for i in range(12)] + [(3000, BODY.format(1), "en", None), (3001, None, "en", "big"), (3002, BODY.format(1), "en", "untargeted")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.2, 6), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(docs(spark, rows), targets)
    shares = {r["source"]: r for r in mix.shares().collect()}
    taken = mix.copies().collect()
    assert max(r["copies"] for r in taken if r["source"] == "small") == 3 == shares["small"]["most_copies"] and shares["small"]["shortfall"] > 0 and shares["absent"]["shortfall"] > 0
    assert {r["source"] for r in taken} == {"big", "small", "mid"} and len({r["doc_id"] for r in taken}) == len(taken)
    for s in ("big", "mid"):
        assert abs(shares[s]["tokens_taken"] - shares[s]["tokens_wanted"]) <= 400, shares[s]
    assert sum(r["achieved_share"] for r in shares.values()) == pytest.approx(1, abs=1e-5)
    assert sorted(map(tuple, mix.copies().collect())) == sorted(map(tuple, taken))
    empty = mixing.Mix(docs(spark, []), targets)
    assert empty.copies().collect() == [] and {r["achieved_share"] for r in empty.shares().collect()} == {0.0}
    assert mixing.Mix(docs(spark, rows), targets.limit(0)).copies().collect() == []


def test_pareto_sampling_has_its_inclusion_probabilities(spark):
    rows = [(i, " ".join(["word"] * (1 + i % 4)), "en", "s") for i in range(2000)]
    targets = spark.createDataFrame([("s", 0.4, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(docs(spark, rows), targets, seed=3)
    size = {r["doc_id"]: r["tokens"] for r in mix.counted.collect()}
    got = {r["doc_id"] for r in mix.copies().collect()}
    by = defaultdict(list)
    for i, t in size.items():
        by[t].append(i in got)
    rates = {t: sum(v) / len(v) for t, v in by.items()}
    step = 0.4 * sum(size.values()) / sum(t * t for t in size.values())
    assert all(abs(rates[t] - min(1, step * t)) < 0.08 for t in rates), (rates, step)


def test_labels_and_paragraphs(spark):
    english, turkish = "The permit of the market is given after ten days by the office.", "Pazar izni için başvuru on gün içinde kurum tarafından yanıtlanır."
    rows = [(i, english, "en", "s") for i in range(20)] + [(100 + i, turkish, "tr", "s") for i in range(20)]
    rows += [(200, english, "tur", "s"), (201, turkish, None, "s"), (202, english + "\n\n" + turkish, "en", "s"), (203, english, " ENG", "s"), (204, turkish, "tr-XX", "s"), (205, english + " pazar izni", "und", "s")]
    found = language.mislabelled(language.identify_languages(docs(spark, rows)))
    assert {tuple(r) for r in found.collect()} == {(200, "en"), (201, "tr"), (202, "en"), (202, "tr"), (205, "en")}


def furniture_rows(classes=("side", "legal"), hide=4):
    rng, side, legal = random.Random(8), *classes
    raw = "<html><title>Permit {0}</title><body><nav><li>Home · News</li></nav><main><h1>Permit {0}</h1><p>{1}</p><ul><li>bring the form {0}</li></ul><p>{2}</p><div class='" + side + "'><li>Renew the {3} card</li><li>Cancel the {3} card</li></div><div class='" + legal + "'>All rights kept by the office</div></main><footer><p>Follow us</p></footer></body></html>"
    text = "Home\nNews\nPermit {0}\nAll rights kept by the office\n{1}\nbring the form {0}\n{2}\nRenew the {3} card\nCancel the {3} card\nFollow us"
    rows = []
    for i in range(40):
        words = f"{'abcdefghij'[i % 10]}{'klmn'[i // 10]}", *(BODY.format("xyzw"[rng.randrange(4)]) for _ in range(2)), "boat"
        rows.append((i, "https://a.example/x", raw.format(*words) if i % hide else None, text.format(*words), 200))
    return rows


def furniture_of(spark, rows):
    found = defaultdict(list)
    for r in main_body.MainBody(pages(spark, rows)).line_numbers().collect():
        found[r["id"]].append(r["line_no"])
    return {i: sorted(v) for i, v in found.items()}


def test_three_letter_labels(spark):
    labels = [("dan", "da"), ("fin", "fi"), ("NOR ", "no"), ("cat", "ca"), ("fre", "fr"), ("fra", "fr"), ("per", "fa"), ("en-GB", "en"), ("ind", "id"), ("und", None), ("", None), (None, None)]
    got = spark.createDataFrame([(x,) for x, _ in labels], "x string").select("x", language.label_code(F.col("x")).alias("code")).collect()
    assert {r["x"]: r["code"] for r in got} == dict(labels)


@pytest.mark.parametrize("classes", [("side", "legal"), ("zone-b", "x7")])
def test_furniture_of_pages(spark, classes):
    rows = furniture_rows(classes)
    assert furniture_of(spark, rows) == {i: [1, 2, 4, 8, 9, 10] for i in range(40)}
    body = {r["id"]: r["body_text"] for r in main_body.main_body(pages(spark, rows)).collect()}
    assert body[1].split("\n")[0] == "Permit bk" and len(body[1].split("\n")) == 4


def test_windows_decide_what_is_furniture(spark, monkeypatch):
    monkeypatch.setattr(main_body, "windows", lambda lengths, size=3: np.full(len(lengths), 1000.0))
    monkeypatch.setattr(main_body, "main_text", lambda lengths: np.full(len(lengths), True))
    assert furniture_of(spark, furniture_rows()) != {i: [1, 2, 4, 8, 9, 10] for i in range(40)}


PLACES = "harbour market valley bridge tower garden library museum station theatre airport hospital school castle forest island".split()
PROBES = ["404 - We can't find that page", "Connection timed out", "Page introuvable", "Under construction", "الصفحة قيد الإنشاء", "You need to turn scripts on!", "Sample words to fill the room. A heading stands here."]


def content(rng, title="Permit"):
    return title + "\n" + "\n".join(f"The {rng.choice(PLACES)} of the {rng.choice(PLACES)} number {k} is open after {rng.randrange(90)} working days by the office of the town and its clerk near the {rng.choice(PLACES)}." for k in range(3))


def test_messages_outside_any_list_are_learned(spark):
    rng = random.Random(9)
    rows = [(i, f"https://{'ab'[i % 2]}.example/{i}", None, f"Subscribe to the bulletin\n{content(rng)}", 200) for i in range(150)]
    rows += [(1000 + 10 * k + n, f"https://{'ab'[n % 2]}.example/p{k}{n}", None, f"Subscribe to the bulletin\n{'Permit' if n else ''}\n{probe}\n", 404 if n == 1 else 200) for k, probe in enumerate(PROBES) for n in range(3)]
    rows += [(2000, "https://a.example/t", None, f"Errors\nIf under construction stands on a page, or a connection timed out, ask the office.\n{content(rng)}", 500)]
    rows += [(2001, "https://a.example/f", None, f"{content(rng)}\nfee: undefined", 200), (2002, "https://a.example/l", None, "Lorem ipsum dolor sit amet elit.\nSed do lorem ipsum sit amet.", 200), (2003, "https://a.example/s", None, "Permit", 404)]
    found = {r["id"]: r["reason"] for r in template_residue.template_residue(pages(spark, rows)).collect()}
    assert found == {1000 + 10 * k + n: "message" for k in range(len(PROBES)) for n in range(3)} | {2001: "field", 2002: "filler"}
    without_status = {r["id"] for r in template_residue.template_residue(pages(spark, rows).drop("http_status")).collect()}
    assert without_status == set(found)


def test_recurrent_fields_are_no_boilerplate(spark):
    rng, menu = random.Random(3), "Subscribe to the bulletin: news, dates and all the offers of the town"
    rows = [(i, f"https://a.example/{i}", None, f"{menu}\n{content(rng)}", 200) for i in range(40)]
    rows += [(200 + i, f"https://a.example/f{i}", None, f"{menu}\nphone: {{{{phone}}}}\n{content(rng)}", 200) for i in range(10)]
    rows += [(300 + i, f"https://a.example/l{i}", None, f"phone: phone\n{content(rng)}", 200) for i in range(10)]
    found = {r["id"]: r["reason"] for r in template_residue.template_residue(pages(spark, rows)).collect()}
    assert found == {200 + i: "field" for i in range(10)}


def test_groups_are_whole_or_an_error(spark):
    text = [f"word{i}" for i in range(60)]
    chain = near_duplicates.NearDuplicates(pages(spark, [(i, None, None, " ".join(text[i : i + 30]), 200) for i in range(30)]), shingle=3)
    with pytest.raises(RuntimeError):
        chain.groups(rounds=1)
    assert {tuple(r) for r in chain.groups().collect()} == {(i, 0, 30) for i in range(30)}


def test_blocks_count_documents(spark):
    rng = random.Random(5)
    letters = [[rng.choice("abc") for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    table = pages(spark, [(i, "https://a.example/x", None, "\n".join(x), 200) for i, x in enumerate(letters)])
    want = Counter(b for x in letters for b in {tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)})
    name = {r["key"]: c for c in "abc" for r in spark.createDataFrame([(c,)], "c string").select(repeated_lines.line_key(F.col("c")).alias("key")).collect()}
    found = {tuple(name[k] for k in r["block"]): r["docs"] for r in repeated_lines.repeated_line_blocks(table, min_share=0).collect()}
    assert found == {b: n for b, n in want.items() if n >= 5}
