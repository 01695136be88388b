"""Text columns: normal forms, words, sentences and terms.

Everything is a built-in expression except Unicode NFKC, which Spark lacks: it
is one Arrow function that is handed NULL for the rows that are plain ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space, as a character class body.
SPACE = (r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same as one class that turns plain letters away by a range before it looks at the list.
BLANK = f"[[^!-~]&&[{SPACE}]]"
# A word of any script, and an ASCII token / compound.
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[A-Za-z0-9]+"
COMPOUND = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+"
# Characters folded before quotes are compared.
QUOTE_FOLD = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "–": "-", "—": "-", "−": "-", " ": " ", "…": "...", "|": " ",
}
# Characters folded before titles are compared.
TITLE_FOLD = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "–": "-", "—": "-",
    "‘": "", "’": "", "“": "", "”": "", "`": "", "'": "", '"': "",
}
# A section number in front of a title.
LEADING_NUMBER = r"(?i)^(?:chapter|section|appendix)?\s*(?:[A-Z]\.?)?\d+(?:\.\d+)*\.?\s+"
# Words that end in a full stop without ending a sentence.
ABBREVIATIONS = (
    "al", "app", "approx", "art", "cf", "cl", "co", "corp", "dr", "e.g",
    "ex", "etc", "fig", "figs", "i.e", "inc", "llc", "llp", "ltd", "max",
    "min", "mr", "mrs", "ms", "no", "nos", "para", "paras", "p", "pp",
    "sched", "sec", "sect", "st", "tab", "u.s", "vs", "vol",
)
# Hedging language, in lexicon order.
HEDGES = (
    "commercially reasonable", "reasonable efforts", "reasonable endeavours",
    "reasonable endeavors", "best efforts", "best endeavours", "best endeavors",
    "where feasible", "where practicable", "as appropriate", "industry standard",
    "industry best practice", "endeavour", "endeavor", "may", "should",
    "from time to time", "substantially", "materially",
)
# Words that are no evidence of a topic.
STOPWORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "by", "each", "every",
    "for", "from", "has", "have", "in", "is", "it", "its", "least", "must", "not",
    "of", "on", "or", "shall", "that", "the", "their", "there", "this", "to", "via",
    "with", "within",
    "contract", "supplier", "vendor", "customer", "party", "parties", "agreement",
)
CHARS_PER_TOKEN = 4


def _suspects() -> str:
    """Characters NFKC may change, as a class body: exact for Latin and general
    punctuation, and every other character from Greek on."""
    exact = [c for block in (range(0x80, 0x370), range(0x2000, 0x2070)) for c in block
             if unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    return "".join(rf"\x{{{c:X}}}" for c in exact) + r"\x{370}-\x{1FFF}\x{2070}-\x{10FFFF}"


SUSPECT = rf"(?=[^\x00-\x7F])[{_suspects()}]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; only rows it may change leave the JVM as text."""
    odd = F.when(text.rlike(SUSPECT), text)
    return F.coalesce(_nfkc(odd), text)


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def fold(text: Column, table: dict[str, str]) -> Column:
    """Character replacement: one ``translate`` plus the longer replacements."""
    single = {k: v for k, v in table.items() if len(v) <= 1}
    source = [k for k, v in single.items() if v] + [k for k, v in single.items() if not v]
    out = F.translate(text, "".join(source), "".join(single[k] for k in source))
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def normal_quote(text: Column, *, unicode_form: bool = True) -> Column:
    """The form in which a quote and a passage are compared."""
    base = nfkc(text) if unicode_form else text
    return casefold(collapse(fold(base, QUOTE_FOLD)))


def normal_title(text: Column, *, unicode_form: bool = True) -> Column:
    base = nfkc(text) if unicode_form else text
    return casefold(collapse(fold(base, TITLE_FOLD)))


def without_number(title: Column) -> Column:
    return strip(F.regexp_replace(title, LEADING_NUMBER, ""))


def token_count(text: Column) -> Column:
    """Tokens by the offline rule: characters over four, rounded up."""
    return F.floor((F.char_length(text) + (CHARS_PER_TOKEN - 1)) / CHARS_PER_TOKEN).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _sentence_break() -> str:
    stops = "|".join(re.escape(a) for a in ABBREVIATIONS)
    veto = rf"(?<!(?<![A-Za-z.])\.{{0,20}}(?i:[a-z]|{stops})\.)"
    return rf"(?<=[.!?]){veto}[\"')\]]*{BLANK}+"


SENTENCE_BREAK = _sentence_break()


def sentences(text: Column) -> Column:
    """Sentences, not broken after an abbreviation or an initial."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_BREAK, -1), strip), lambda s: s != "")
    return bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(text))))


def hedge_terms(normal_text: Column) -> Column:
    """Hedges found on word boundaries of a normal form, in lexicon order."""
    def found(text: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.contains(text, F.lit(t)) & text.rlike(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])"), F.lit(t))
            for t in HEDGES]))

    return bind(normal_text, found)


def stem(word: Column) -> Column:
    """Four suffix rules: plural s, then ing / ion / ed, else a final e."""
    return bind(F.regexp_replace(word, r"^(.{3,}[^s])s$", "$1"), lambda singular: F.when(
        singular.rlike(r"^.{4,}(?:ing|ion|ed)$"), F.regexp_replace(singular, r"(?:ing|ion|ed)$", "")
    ).otherwise(F.regexp_replace(singular, r"^(.{4,})e$", "$1")))


def content_terms(text: Column) -> Column:
    """The distinct stemmed content words of a text."""
    found = F.regexp_extract_all(casefold(text), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    kept = F.filter(found, lambda w: (F.char_length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, stem))


def safe_filename(name: Column, suffix: str = ".pdf", *, unicode_form: bool = True) -> Column:
    """A client's file name reduced to a name: no folders, a small alphabet, one suffix."""
    raw = strip(F.coalesce(name, F.lit("")))
    raw = F.replace(nfkc(raw) if unicode_form else raw, F.lit("\\"), F.lit("/"))
    base = F.split_part(F.regexp_replace(raw, r"/+(?:\./*)*$", ""), F.lit("/"), F.lit(-1))
    base = F.when(base == ".", "").otherwise(base)
    base = F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_")
    base = F.regexp_replace(base, r"^[.\s_-]+", "")
    base = F.regexp_replace(base, rf"(?i){re.escape(suffix)}$", "")
    base = F.regexp_replace(F.substring(base, 1, 100), r"[._-]+$", "")
    return F.when(base != "", F.concat(base, F.lit(suffix))).otherwise(f"upload{suffix}")
