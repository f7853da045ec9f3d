"""Texts as Column expressions: white space, scripts, repair, markup, and what else reads or rewrites a string."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.profiles import ASSAMESE, DANDAS, HINDI, SINGLE_WORDS, SPACE, ScriptProfile

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: inside a lambda, and where filters are pushed down, an expression would be evaluated wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# ---------------------------------------------------------------- white space and words


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends; a null stays null."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    """Words between white space; no words give an empty array."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_of(text: Column, piece: str) -> Column:
    """How often a literal string stands in a text."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


# ---------------------------------------------------------------- scripts


def script_filter(text: Column, profile: ScriptProfile) -> Column:
    """Without characters that are neither of the script nor white space. The block is tested first, as nearly all characters are in it: a class of many ranges is slow."""
    return F.regexp_replace(text, f"[[^{profile.block} ]&&[^{DANDAS}{SPACE}]]+", "")


def in_script(text: Column, profile: ScriptProfile, dandas: bool = True) -> Column:
    inside = profile.script if dandas else profile.block
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{inside}]+", ""))


def not_space(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[{SPACE}]", ""))


def script_fraction(text: Column, profile: ScriptProfile, dandas: bool = True) -> Column:
    """Share of the script among characters that are not white space; 0 where there are none."""
    return let(not_space(text), lambda total: F.when(total == 0, F.lit(0.0)).otherwise(in_script(text, profile, dandas) / total))


def letters(text: Column) -> Column:
    """Characters of the categories letter and mark."""
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))


def letters_in(text: Column, profile: ScriptProfile) -> Column:
    return F.char_length(F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}]|[^{profile.block}]", ""))


# ---------------------------------------------------------------- what needs Python: Unicode forms and entities


def _forms(form: str):
    @F.pandas_udf("string")
    def normal(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal


#: Characters that alone can make a text differ from its composed form (marks and what is behind them), and from its compatibility form (also the compatibility letters of Latin blocks).
_MAY_COMPOSE = r"[^\u0000-\u02ff]"
_MAY_CHANGE = r"[[^\u0000-\u007f]&&[^\u0080-\u009f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0\u01f4-\u02af]]"


def _where_needed(text: Column, form: str, test: str) -> Column:
    """The normal form by Python of the texts that a test on the JVM does not clear; the others cross as nulls."""
    return F.coalesce(_forms(form)(let(text, lambda t: F.when(t.rlike(test), t))), text)


def nfc(text: Column) -> Column:
    return _where_needed(text, "NFC", _MAY_COMPOSE)


def nfkc(text: Column) -> Column:
    return _where_needed(text, "NFKC", _MAY_CHANGE)


def unescape(text: Column) -> Column:
    """Character references decoded; texts without an ampersand are left alone."""

    @F.pandas_udf("string")
    def decoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: t if t is None or "&" not in t else html.unescape(t))

    return decoded(text)


# ---------------------------------------------------------------- repair of damaged Indic text

#: A mark boundary as "no letter, mark, digit or underscore follows" (combining marks count as a boundary where they are not letters).
_AFTER = r"(?![\p{L}\p{Nd}_])"
_SP = f"[{SPACE}]"


# The patterns of repair(), quality_reason() and html_lines() are fixed values, as is their order.


def repair(text: Column, profile: ScriptProfile) -> Column:
    """Undoes what scanners and crawlers do to Indic words.

    Order of the rules: compatibility form; tags and addresses to spaces; control and invisible characters out; a sign split off inside a word; signs split off a
    word (twice); broken conjuncts; for Assamese also detached case and verb endings; stacked vowel signs; signs without a letter; white space.
    """
    c, m, h, d = (f"[{x}]" for x in (profile.consonants, profile.matras, profile.halant, profile.diacritics))
    t = nfkc(text)
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"[\u200b-\u200f\ufeff]", "")
    if profile.consonants:
        t = F.regexp_replace(t, f"([{profile.block}]{{2,}}{c}){_SP}+({d}){_SP}+({c}){_AFTER}", "$1$2$3")
        for _ in range(2):
            t = F.regexp_replace(t, f"([^{SPACE}]){_SP}+({d})", "$1$2")
        t = F.regexp_replace(t, f"({c}){_SP}*({h}){_SP}*({c})", "$1$2$3")
        if profile is ASSAMESE:
            ending = f"(?:{_SP}|[{DANDAS}]|\\z)"
            t = F.regexp_replace(t, f"([{profile.block}]+){_SP}+ৰ{ending}", "$1ৰ ")
            t = F.regexp_replace(t, f"([{profile.block}]+){_SP}+(ছে|ছিল|লে|ছেন){ending}", "$1$2 ")
        t = F.regexp_replace(t, f"({m}){m}+", "$1")
        t = F.regexp_replace(t, f"(?:^|{_SP}){d}+", " ")
    return F.coalesce(collapse(t), F.lit(""))


def quality_reason(text: Column, profile: ScriptProfile) -> Column:
    """Why a cleaned document is too damaged to keep, or null: the first rule that it breaks."""
    def rules(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        singles = F.size(F.filter(w, lambda x: (F.char_length(x) == 1) & ~x.isin(*SINGLE_WORDS)))
        reason = F.when(F.size(w) < 5, "too_short")
        if profile.diacritics:
            reason = reason.when(occurrences(text, f"(?:^|{_SP})[{profile.diacritics}]") / n > 0.03, "high_orphan_diacritics")
        reason = reason.when(singles / n > 0.15, "excessive_single_char_fragments")
        if profile.matras:
            reason = reason.when(occurrences(text, f"[{profile.matras}]{{2,}}|[{profile.halant}]{{2,}}") / n > 0.02, "invalid_diacritic_stacking")
        return reason

    return let(words(text), rules)


# ---------------------------------------------------------------- markup


def _wiki_rules(category: str, rounds: int) -> list[tuple[str, str]]:
    """Patterns of wiki markup in the order in which they go, and what stays of them."""
    return [
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<ref[^>]*>.*?</ref>", ""),
        (r"(?i)<ref[^/>]*/>", ""),
        (r"<[^>]+>", ""),
        (r"(?iu)\[\[(?:File|Image|%s):[^\]]+\]\]" % ("चित्र|ফাইল" if rounds == 5 else "চিত্র|ফাইল"), ""),
        (r"(?iu)\[\[(?:Category|%s):[^\]]+\]\]" % category, ""),
        *[(r"\{\{[^{}]*\}\}", "")] * rounds,
        (r"(?s)\{\|.*?\|\}", ""),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
        (rf"\[https?://[^{SPACE}\]]+(?:[{SPACE}]+([^\]]+))?\]", "$1"),
        (r"={2,6}(.*?)(?:={2,6})", "$1"),
        (r"'{2,5}", ""),
        (rf"\([{SPACE}]*\)", ""),
        (rf"\[[{SPACE}]*\]", ""),
    ]


def _applied(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, stays in rules:
        text = F.regexp_replace(text, pattern, stays)
    return text


def wikitext(text: Column) -> Column:
    """Prose of wiki markup: markup out, lines of less than 20 characters out."""
    plain = _applied(text, _wiki_rules("श्रेणी|শ্রেণী", 5))
    lines = F.transform(F.split(plain, "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: F.char_length(x) >= 20), "\n")


def wiki_markup(text: Column) -> Column:
    """As wikitext(), for dumps: all on one line, none left out."""
    return collapse(_applied(text, _wiki_rules("শ্ৰেণী", 4)))


#: Elements that go with their content, tags that end a line, and fragments of lines that are not prose.
DROPPED_ELEMENTS = ("script", "style", "noscript", "svg", "nav", "header", "footer", "iframe", "form", "aside")
LINE_TAGS = r"(?i)</?(?:p|div|br|h[1-6]|li|tr|blockquote|section|article|dt|dd)[^>]*>"
BOILERPLATE = (
    "cookie policy", "terms of use", "privacy policy", "all rights reserved", "copyright ©", "follow us on", "subscribe to", "whatsapp group", "click here to read",
    "share this article", "advertisement", "sponsored link", "published by", "comment below", "latest news", "breaking news", "trending now",
)


def boilerplate(line: Column) -> Column:
    """Whether a line is a site's own phrase: one of the fragments in less than 80 characters."""
    return F.lower(line).rlike("|".join(BOILERPLATE)) & (F.char_length(line) < 80)


def html_lines(page: Column) -> Column:
    """Lines of a page's text before those that are short or boilerplate go."""
    t = page
    for tag in DROPPED_ELEMENTS:
        t = F.regexp_replace(t, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, LINE_TAGS, "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return F.transform(F.split(unescape(t), "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))


def html_text(page: Column) -> Column:
    """The lines of a page with at least 10 characters that are not boilerplate."""
    return F.array_join(F.filter(html_lines(page), lambda x: (F.char_length(x) >= 10) & ~boilerplate(x)), "\n")


# ---------------------------------------------------------------- addresses, answers, pieces


def distinctive(text: Column) -> Column:
    """Whether a text has a letter that Assamese has and Bengali does not: the fixed values ra and va."""
    return text.rlike("[ৰৱ]")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "^/+|/+$", ""), "/"), -1)


def cache_name(url: Column) -> Column:
    """A file name for an address: its last segment without odd characters, and the start of its hash."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    segment = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^A-Za-z0-9._-]+", "_")
    return F.concat(segment, F.lit("-"), F.substring(F.sha2(url, 256), 1, 8))


def sniff(content: Column) -> Column:
    """What bytes are by their first ones: pdf, zip, html or other."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "zip").when(F.lower(F.substring(content, 1, 512).cast("string")).rlike("<html|<!doctype html"), "html").otherwise("other")


def to_assamese(text: Column) -> Column:
    """Devanagari letters to the Eastern Nagari ones 0x80 further on; ra and va have letters of their own, and dandas stay."""
    source = [c for c in range(HINDI.first, HINDI.last + 1) if c not in (0x0964, 0x0965)]
    own = {0x0930: 0x09F0, 0x0935: 0x09F1}
    return F.translate(text, "".join(map(chr, source)), "".join(chr(own.get(c, c + 0x80)) for c in source))


REASON_WORDS = {"hindi": "कारण", "assamese": "কাৰণ|কারণ"}


def answer(text: Column, language: str = "hindi") -> Column:
    """A prediction without its bracketed rationale."""
    return strip(F.regexp_replace(text, rf"\[(?:{REASON_WORDS[language]}):[^\]]*\][{SPACE}]*", ""))


def rationale(text: Column, language: str = "hindi") -> Column:
    return strip(F.regexp_extract(text, rf"\[(?:{REASON_WORDS[language]}):[{SPACE}]*([^\]]*)\]", 1))


# What stands between steps, and before a conclusion (in one of two spellings in Assamese), in either language.
AND_WORDS, SO_WORDS = "और|আৰু", "इसलिए|সে(?:\u09df|\u09af\u09bc)ে"
_BRACKET = rf"\[(?:{'|'.join(REASON_WORDS.values())}):[{SPACE}]*([^\]]*)(\]?)"


def rationale_parts(text: Column) -> Column:
    """Struct of a rationale's steps, its conclusion (null if it has none), the answer, and whether the bracket is closed, in either language.

    An open bracket goes to the text's end. The answer is the text without the first rationale, bracket included. A text without one is all answer, with no steps, and counts as closed. Null for a null text.
    """
    whole = F.regexp_extract(text, _BRACKET, 0)
    parts = F.split(strip(F.regexp_extract(text, _BRACKET, 1)), rf"[{SPACE}]+(?:{SO_WORDS})[{SPACE}]+")
    steps = F.filter(F.split(F.get(parts, F.lit(0)), rf"[{SPACE}]+(?:{AND_WORDS})[{SPACE}]+"), lambda s: s != "")
    at = F.position(whole, text)
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.char_length(whole), F.char_length(text)))
    found = F.struct(steps.alias("steps"), F.get(parts, F.lit(1)).alias("conclusion"), strip(rest).alias("answer"), (F.regexp_extract(text, _BRACKET, 2) == "]").alias("closed"))
    none = F.struct(F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("conclusion"), strip(text).alias("answer"), F.lit(True).alias("closed"))
    return F.when(whole != "", found).when(text.isNotNull(), none)


def shown_piece(piece: Column) -> Column:
    """A subword piece as a reader sees it: the word mark to a space, <0xNN> to its character."""
    code = F.regexp_extract(piece, "^<0x([0-9A-F]{2})>$", 1)
    return F.when(code != "", F.chr(F.conv(code, 16, 10).cast("int"))).otherwise(F.replace(piece, F.lit("▁"), F.lit(" ")))


# ---------------------------------------------------------------- estimates


def tokens_estimate(text: Column, per_word: float = 1.2, rounded: bool = True) -> Column:
    """Tokens by words: rounded, or cut off, and one at least."""
    n = word_count(text) * F.lit(float(per_word))
    return F.greatest(F.lit(1), (F.round(n) if rounded else F.floor(n)).cast("int"))
