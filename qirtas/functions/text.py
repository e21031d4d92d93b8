"""Text functions as columns: Arabic normalisation, tokens, snippets, titles, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the normaliser, and the stop words.
DIACRITICS = "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0640"
FOLD_FROM, FOLD_TO = "أإآٱىة", "اااايه"
STOP_WORDS = ("في", "من", "إلى", "على", "عن", "هذا", "هذه", "ذلك", "التي", "الذي", "أن", "إن", "لا", "ما", "هل", "أو", "لكن", "ثم", "قد", "لقد", "كان", "يكون")
NO_TITLE = "No title"
SCRIPTS = {"arabic": r"(?U)[^\x{0600}-\x{06FF}\x{0750}-\x{077F}\s\d]", "any": r"(?U)[^\p{L}\p{M}\p{N}\s]"}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def remove_diacritics(text: Column) -> Column:
    return F.translate(text, DIACRITICS, "")


def fold_letters(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def keep_script(text: Column, script: str = "arabic") -> Column:
    """Everything outside the script, white space and digits becomes a blank. `any` keeps letters, marks and numbers."""
    return F.regexp_replace(text, SCRIPTS[script], " ")


def strip_article(text: Column) -> Column:
    """Without the article at the beginning of each longer word."""
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_])ال(?=[\p{L}\p{N}_])", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, script: str = "arabic") -> Column:
    """Lower case, marks removed, letter forms folded, script kept, article stripped, white space collapsed; null becomes ''."""
    return collapse(strip_article(keep_script(fold_letters(remove_diacritics(F.lower(F.coalesce(text, F.lit(""))))), script)))


def tokenize(text: Column, script: str = "arabic", remove_stop_words: bool = False) -> Column:
    """Array of the words of the normalised text, with repeats."""
    tokens = F.filter(F.split(normalize(text, script), " "), lambda t: t != "")
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS)) if remove_stop_words else tokens


def split_simple(text: Column) -> Column:
    """Array of the lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x{0B}\x{85}\p{Z}]+"), lambda t: t != "")


def occurrences(text: Column, word: Column) -> Column:
    """Number of occurrences of a word as a substring, none overlapping; 0 for an empty word."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")).otherwise(F.lit(0).cast("long"))


def snippet(text: Column, style: str) -> Column:
    """`keyword`: 200 characters, stripped, `...` if cut; `bm25`: 200 characters; `vector`: 200 and `...` if cut."""
    head, cut = F.substring(text, 1, 200), F.length(text) > 200
    if style == "bm25":
        return head
    head = strip(head) if style == "keyword" else head
    return F.when(cut, F.concat(head, F.lit("..."))).otherwise(head)


def title(text: Column) -> Column:
    """The first heading of one `#` or more, anywhere in the text."""
    found = strip(F.regexp_extract(text, r"#(?U:\s)+(.+?)(?:\n|$)", 1))
    return F.when(found == "", F.lit(NO_TITLE)).otherwise(found)


def cut_to_marker(text: Column, marker: str) -> Column:
    """From the first occurrence of the marker on; all of it without one."""
    return F.substring(text, F.greatest(F.instr(text, marker), F.lit(1)), F.length(text))


def dummy_parse(html: Column, url: Column) -> Column:
    """`Parsed from {url}: ` and the first 100 characters without angle brackets; null for nothing."""
    return F.when(F.length(html) > 0, F.concat(F.lit("Parsed from "), url, F.lit(": "), F.substring(F.translate(html, "<>", ""), 1, 100)))


def think_part(text: Column) -> Column:
    """What stands in the first closed <think> block; null without one."""
    return F.when(text.rlike(r"(?s)<think>.*?</think>"), strip(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)))


def answer_part(text: Column) -> Column:
    """The text without closed <think> blocks, stripped."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def after_thinking(text: Column) -> Column:
    """What follows the last </think>, stripped; the text as it is without one."""
    return F.when(text.contains("</think>"), strip(F.element_at(F.split(text, "</think>"), -1))).otherwise(text)


def context_prompt(context: Column, question: Column, limit: int = 3000) -> Column:
    return F.concat(F.lit("السياق:\n"), F.substring(context, 1, limit), F.lit("\n\nالسؤال:\n"), question)


def teacher_prompt(context: Column, ask: str, limit: int = 3500, name: Column | None = None, question: Column | None = None) -> Column:
    """What a teacher model is asked: the context, up to `limit` characters, with the file's name, a question if given, and the
    task. The limits in use are 3500 for a pair from a file, 3000 for an answer, 2000 for a refusal, 800 and 1500 for short ones."""
    head = F.concat(F.lit("CONTEXT FROM FILE ("), name, F.lit("):\n")) if name is not None else F.lit("CONTEXT:\n")
    asked = [F.lit('\n\nUSER QUESTION:\n"'), question, F.lit('"')] if question is not None else []
    return F.concat(head, F.substring(context, 1, limit), *asked, F.lit(f"\n\nINSTRUCTION:\n{ask}"))


def chat_text(system: Column, user: Column, assistant: Column, eos: str = "<|im_end|>") -> Column:
    """System, user and assistant turns in the chat template, with the end-of-string token."""
    turn = lambda role, content: F.concat(F.lit(f"<|im_start|>{role}\n"), content, F.lit("<|im_end|>"))
    return F.concat(turn("system", system), F.lit("\n"), turn("user", user), F.lit("\n"), turn("assistant", assistant), F.lit(eos))


# Opening and instruction of the summary template.
QFS_OPENING = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request."
QFS_INSTRUCTION = "You are a Query-Focused Summarization engine. Extract relevant information from the provided document to answer the user query. Output ONLY the summary. Do not use internal reasoning or conversational filler."


def qfs_text(text: Column, summary: Column, eos: str = "<|im_end|>", instruction: str = QFS_INSTRUCTION, opening: str = QFS_OPENING) -> Column:
    """Opening, instruction, input and response sections, with the end-of-string token."""
    return F.concat(F.lit(f"{opening}\n\n### Instruction:\n{instruction}\n\n### Input:\n"), text, F.lit("\n\n### Response:\n"), summary, F.lit(eos))


def sampled(key: Column, percent: int, seed: int = 0) -> Column:
    """True for about `percent` of the keys, the same ones in every run and in any engine that has MD5."""
    return F.pmod(digest(key, seed), F.lit(100)) < percent


def digest(key: Column, seed: int = 0) -> Column:
    """The first 32 bits of the MD5 of the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def elapsed(ms: Column) -> Column:
    """A time in µs, ms or s."""
    return F.when(ms < 1, F.format_string("%.2f μs", ms * 1000)).when(ms < 1000, F.format_string("%.2f ms", ms)).otherwise(F.format_string("%.2f s", ms / 1000))
