"""Clause labels: parse one, find all in a text, order them.

A label is a struct (label, kind, key, parent, ordinal, end): what is printed,
its family, the key children refer to, the key it nests under, its place among
its siblings and the offset just past it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# The shapes of labels and what must follow one that opens a clause.
OPENER = r'(?=[A-Z“"(\[])'
EXHIBIT = r"(Exhibit|Schedule|Annex|Appendix|Attachment)\s+([A-Z]|\d{1,2})\b"
DECIMAL = r"(\d{1,3}(?:\.\d{1,3})+)\.?\s+" + OPENER
INTEGER = r"(\d{1,3})\.\s+" + OPENER
ALNUM = r"([A-Z]{1,3})(\d{1,3})([A-Z]?)\.\s+" + OPENER
ROMAN = r"\(([ivxlcdm]{2,})\)\s+"
LETTERED = r"\(([a-z])\)\s+"
AFTER = r"""[.;:!?”"’')\]]"""
ANY = "(?:" + "|".join((EXHIBIT, DECIMAL, INTEGER, ALNUM, ROMAN, LETTERED)) + ")"
SECTIONAL = ("integer", "decimal", "alnum", "exhibit")
PARAGRAPH_SECTIONS = ("integer", "decimal", "alnum")
MAX_TITLE = 80
MARK = "\u0001"
NUMERALS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(numeral: Column) -> Column:
    """Value of a lower-case numeral: smaller digits before a larger one subtract."""
    table = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    digits = F.transform(F.reverse(F.split(numeral, "")), lambda ch: F.try_element_at(table, ch))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    return F.aggregate(
        F.filter(digits, lambda d: d.isNotNull()), start,
        lambda s, d: F.struct(
            (s["total"] + F.when(d >= s["top"], d).otherwise(-d)).alias("total"),
            F.greatest(s["top"], d).alias("top")),
        lambda s: s["total"])


def _letter(c: Column, base: str) -> Column:
    return F.ascii(c) - F.lit(ord(base) - 1)


def label_at_start(text: Column) -> Column:
    """The label a text opens with, or NULL.

    One pattern takes the label and the character behind it off the text; only
    these few characters are then looked at by kind, the whole text once.
    """
    return bind(F.regexp_extract(text, rf"^{ANY}(?s:.?)", 0), lambda head: F.when(head != "", _label(head)))


def _label(text: Column) -> Column:
    """The label that opens a text, by kind."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, "^" + pattern, group)

    def length(pattern: str) -> Column:
        return F.char_length(part(pattern, 0))

    def label(kind, name, key, parent, ordinal, pattern) -> Column:
        return F.struct(
            name.alias("label"), F.lit(kind).alias("kind"), key.alias("key"), parent.alias("parent"),
            F.array(*[o.cast("int") for o in ordinal]).alias("ordinal"), length(pattern).alias("end"))

    none = F.lit("")
    ident = part(EXHIBIT, 2)
    digits = F.when(ident.rlike(r"^\d+$"), ident).cast("int")
    exhibit_no = F.coalesce(digits, _letter(ident, "A"))
    decimal = part(DECIMAL, 1)
    integer = part(INTEGER, 1)
    alnum = F.concat(part(ALNUM, 1), part(ALNUM, 2), part(ALNUM, 3))
    suffix = F.when(part(ALNUM, 3) != "", _letter(part(ALNUM, 3), "A")).otherwise(0)
    roman = F.concat(F.lit("("), part(ROMAN, 1), F.lit(")"))
    letter = F.concat(F.lit("("), part(LETTERED, 1), F.lit(")"))

    def number(c: Column) -> Column:
        return F.when(c != "", c).cast("int")

    return (
        F.when(text.rlike("^" + EXHIBIT), label(
            "exhibit", F.concat(part(EXHIBIT, 1), F.lit(" "), ident), ident, none, [exhibit_no], EXHIBIT))
        .when(text.rlike("^" + DECIMAL), label(
            "decimal", decimal, decimal, F.regexp_replace(decimal, r"\.\d+$", ""),
            [number(F.regexp_extract(decimal, r"(\d+)$", 1))], DECIMAL))
        .when(text.rlike("^" + INTEGER), label("integer", integer, integer, none, [number(integer)], INTEGER))
        .when(text.rlike("^" + ALNUM), label(
            "alnum", alnum, alnum, part(ALNUM, 1), [number(part(ALNUM, 2)), suffix], ALNUM))
        .when(text.rlike("^" + ROMAN), label(
            "roman", roman, roman, F.lit("(roman)"), [roman_value(part(ROMAN, 1))], ROMAN))
        .when(text.rlike("^" + LETTERED), label(
            "lettered", letter, letter, F.lit("(letter)"), [_letter(part(LETTERED, 1), "a")], LETTERED))
    )


def candidates(text: Column) -> Column:
    """Every (offset, label) at the start of a text or after a sentence end.

    A marker is set before each place a label could open; the pieces between
    markers are the candidates and their running length is the offset.
    """
    marked = F.regexp_replace(text, rf"((?<={AFTER})\s+)(?={ANY})", "$1" + MARK)
    pieces = F.split(marked, MARK, -1)
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<offset:int, piece:string>>").alias("out"))
    placed = F.aggregate(
        pieces, start,
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p)).alias("at"),
            F.concat(s["out"], F.array(F.struct(s["at"].alias("offset"), p.alias("piece")))).alias("out")),
        lambda s: s["out"])
    found = F.transform(placed, lambda c: F.struct(
        c["offset"].alias("offset"), label_at_start(c["piece"]).alias("label")))
    return F.filter(found, lambda c: c["label"].isNotNull())


def follows(a: Column, b: Column) -> Column:
    """Whether label ``b`` comes right after ``a`` in the same sequence."""
    same = (a["parent"] == b["parent"]) & (a["kind"] == b["kind"])
    one = (F.size(b["ordinal"]) == 1) & (b["ordinal"][0] == a["ordinal"][0] + 1)
    two = ((b["ordinal"][0] == a["ordinal"][0]) & (F.get(b["ordinal"], F.lit(1)) == F.get(a["ordinal"], F.lit(1)) + 1)) | (
        (b["ordinal"][0] == a["ordinal"][0] + 1) & (F.get(b["ordinal"], F.lit(1)) == 0))
    return same & F.when(a["kind"] == "alnum", two).otherwise(one)


def depth(label: Column) -> Column:
    kind = label["kind"]
    return (
        F.when(kind == "decimal", F.size(F.split(label["label"], r"\.")))
        .when(kind == "alnum", 2).when(kind.isin("integer", "exhibit"), 1).otherwise(0)
    )


def clause_title(text: Column, label: Column) -> Column:
    """``6.6 Password Management Standard`` of a clause that opens so."""
    rest = F.substr(text, label["end"] + 1)
    quoted = F.regexp_extract(rest, r"""^[“"'‘].+?[”"'’]""", 0)
    plain = F.split(rest, r"[.;:](?:\s|$)", 2)[0]
    body = F.trim(F.when(quoted != "", quoted).otherwise(plain))
    cut = F.concat(F.regexp_replace(F.substring(body, 1, MAX_TITLE), r" [^ ]*$", ""), F.lit("…"))
    return F.trim(F.concat_ws(" ", label["label"], F.when(F.char_length(body) > MAX_TITLE, cut).otherwise(body)))
