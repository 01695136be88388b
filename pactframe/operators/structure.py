"""Layout blocks to sectioned elements, for all documents at once.

A block row is (doc_id, page, block_no, x0, y0, x1, y1, page_height, n_lines,
font, size, italic, text). Counting steps aggregate with a map-side combine;
order-dependent steps use windows over one document or page, whose rows all
come out of one source row, so no window can grow past what a row may hold.
The few sequential folds see the sections or the lines of one document.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import labels as lb
from ..functions import text as tx
from ..session import materialize
from . import ordered

# Thresholds of the layout rules.
TOLERANCE = 8.0
FLUSH = 2.0
HEADER_BAND, FOOTER_BAND = 0.06, 0.85
REPEAT_MIN, REPEAT_SHARE = 3, 0.20
INDENT_MIN, INDENT_SHARE = 3, 0.10
HEADING_MARGIN = 0.5
MATH_SHARE = 0.4
PANEL_GAP, CAPTION_GAP = 90.0, 80.0
MIN_PIXELS, MIN_PAGE_SHARE = 100, 0.01
MAX_PARAGRAPH, MAX_LINE_GAP, INDENT_SLACK = 4000, 36.0, 6.0
MIN_ROWS, MIN_COLS, MIN_FILL = 2, 2, 0.6
# Patterns of captions, page numbers, mathematics and dot leaders.
CAPTION = r"(?i)^\s*(Figure|Table)\s+(?:[A-Z]\.?)?\d+(?:\.\d+)*\s*[.:](?=\s|$)"
ARABIC_PAGE = r"^\d{1,5}$"
ROMAN_PAGE = r"(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
MATH_FONT = r"(?i)CM(MI|SY|EX)|MSAM|MSBM|STIX|Math"
DOT_LEADER = r"\.\s?\.\s?\."
# Table qualities from most to least trusted.
QUALITY = ("ruled", "recovered", "text-fallback")
# Element types that end a stitched table.
BREAKS_TABLE = ("heading", "paragraph", "caption", "equation")
# The most Latin letters that a section number in front of a title has, as in "appendix A.1".
NUMBER_LETTERS = 9


def reading_order(blocks: DataFrame) -> DataFrame:
    """1-based place of a block on its page: rows of 3 points, then left to right."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.rint(F.col("y0") / 3), "x0", "block_no")
    return blocks.withColumn("reading", F.row_number().over(w))


# -- the document profile ---------------------------------------------------


def mode(df: DataFrame, keys: list[str], value: Column, weight: Column, name: str) -> DataFrame:
    """The heaviest value per key; equal weights go to the one seen first."""
    counted = df.groupBy(*keys, value.alias("_v")).agg(
        F.sum(weight).alias("_n"), F.min(F.struct("page", "block_no")).alias("_first"))
    earliest = F.struct("_n", (-F.col("_first.page")).alias("a"), (-F.col("_first.block_no")).alias("b"))
    return counted.groupBy(*keys).agg(F.max_by("_v", earliest).alias(name))


def body_size(blocks: DataFrame) -> DataFrame:
    chars = F.char_length(F.trim("text"))
    return mode(blocks, ["doc_id"], F.round("size", 1), chars, "body_size")


def extents(blocks: DataFrame) -> DataFrame:
    """Blocks counted by rounded horizontal extent: the narrow table every edge
    measurement reads, built in one pass with a map-side combine."""
    tall = F.when(F.col("n_lines") >= 3, 3).otherwise(0)
    return blocks.groupBy(
        "doc_id", F.rint("x0").alias("x0"), F.rint("x1").alias("x1"), tall.alias("n_lines")
    ).agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("page", "block_no")).alias("f")).select(
        "doc_id", "x0", "x1", "n_lines", "weight", "f.page", "f.block_no")


def _weight(blocks: DataFrame) -> Column:
    return F.col("weight") if "weight" in blocks.columns else F.lit(1)


def column_right(blocks: DataFrame) -> DataFrame:
    """Right edge of the commonest extent of blocks with three lines or more."""
    extent = F.struct(F.rint("x0").alias("l"), F.rint("x1").alias("r"))
    return mode(blocks.where(F.col("n_lines") >= 3), ["doc_id"], extent, _weight(blocks), "e").select(
        "doc_id", F.col("e.r").alias("body_right"))


def full_width(blocks: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks that run out to the right margin."""
    return blocks.join(right, "doc_id").where(
        (F.col("body_right") != 0) & (F.abs(F.rint("x1") - F.col("body_right")) <= TOLERANCE))


def text_left(blocks: DataFrame, right: DataFrame) -> DataFrame:
    return mode(full_width(blocks, right), ["doc_id"], F.rint("x0"), _weight(blocks), "body_left")


def margin_bands(blocks: DataFrame, right: DataFrame) -> DataFrame:
    """Top and bottom of the body text as page fractions, with fixed fallbacks."""
    tall = F.col("n_lines") >= 2
    found = blocks.groupBy("doc_id").agg(
        F.min(F.when(tall, F.col("y0") / F.col("page_height"))).alias("top"),
        F.max(F.when(tall, F.col("y1") / F.col("page_height"))).alias("bottom"))
    usable = F.col("top").isNotNull() & (F.coalesce("body_right", F.lit(0.0)) != 0)
    return found.join(right, "doc_id", "left").select(
        "doc_id",
        F.when(usable, F.col("top")).otherwise(HEADER_BAND).alias("header_band"),
        F.when(usable, F.col("bottom")).otherwise(FOOTER_BAND).alias("footer_band"))


def paragraph_indent(blocks: DataFrame, right: DataFrame) -> DataFrame:
    """The second left-edge mode when it is a habit of the document, else 0."""
    left = text_left(blocks, right)
    offset = F.rint("x0") - F.col("body_left")
    room = (F.col("body_right") - F.col("body_left")) / 4
    shifted = full_width(blocks, right).join(left, "doc_id").withColumn(
        "_off", F.when((offset > FLUSH) & (offset <= room) & (F.col("body_left") != 0), offset))
    counts = shifted.groupBy("doc_id", "_off").agg(
        F.sum(_weight(blocks)).alias("n"), F.min(F.struct("page", "block_no")).alias("f"))
    best = F.max_by(F.struct("_off", "n"), F.when(F.col("_off").isNotNull(), F.struct(
        "n", (-F.col("f.page")).alias("a"), (-F.col("f.block_no")).alias("b"))))
    ok = (F.col("b.n") >= INDENT_MIN) & (F.col("b.n") / F.col("total") >= INDENT_SHARE)
    return counts.groupBy("doc_id").agg(best.alias("b"), F.sum("n").alias("total")).select(
        "doc_id", F.when(ok, F.col("b._off")).otherwise(0.0).alias("paragraph_indent"))


def masked(text: Column) -> Column:
    return F.regexp_replace(tx.collapse(text), r"\d+", "#")


def in_band(top: Column) -> Column:
    return (top >= F.col("footer_band")) | (top <= F.col("header_band"))


def furniture_patterns(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Digit-masked margin texts seen on enough pages of a document."""
    pages = blocks.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    texts = blocks.join(bands, "doc_id").where(
        in_band(F.col("y0") / F.col("page_height")) & (tx.collapse(F.col("text")) != ""))
    counts = texts.groupBy("doc_id", masked(F.col("text")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    threshold = F.greatest(F.lit(REPEAT_MIN), F.floor(F.col("pages") * REPEAT_SHARE))
    return counts.join(pages, "doc_id").where(F.col("n") >= threshold).select("doc_id", "pattern", "n")


def boilerplate_lines(lines: DataFrame, least: int = REPEAT_MIN) -> DataFrame:
    """Digit-masked lines shared by at least ``least`` documents."""
    once = lines.select("doc_id", masked(F.col("line")).alias("pattern")).where("pattern != ''").distinct()
    return once.groupBy("pattern").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least)


def vocabulary(lines: DataFrame) -> DataFrame:
    """(doc_id, word, n, hyphenated): tokens and hyphenated compounds, case folded, the words of a document together.

    The lines are searched once, for tokens and compounds together; the tokens of
    a compound are its parts. A task counts the lines of a document it reads, and
    one text with its words and their counts leaves it, not a row for each.
    """
    found = F.regexp_extract_all(F.lower("line"), F.lit(f"({tx.TOKEN}(?:-{tx.TOKEN})*)"), F.lit(1))
    doc = f"doc_id {lines.schema['doc_id'].dataType.simpleString()}"

    def searched(total: Counter, runs: list[str] | None) -> None:
        total.update(runs or ())

    def parted(doc_id: Any, total: Counter) -> Iterator[tuple]:
        for run in [r for r in total if "-" in r]:
            for word in run.split("-"):
                total[word] += total[run]
        return _listed(doc_id, total)

    def spelt(doc_id: Any, counts: Counter) -> Iterator[tuple]:
        for word, n in counts.items():
            yield (doc_id, word, 0, n) if "-" in word else (doc_id, word, n, 0)

    counted = lines.select("doc_id", found.alias("runs")).mapInArrow(_by_document(searched, parted, f"{doc}, known string"), f"{doc}, known string")
    together = counted.repartition("doc_id").sortWithinPartitions("doc_id")
    schema = f"{doc}, word string, n long, hyphenated long"
    return together.mapInArrow(_by_document(_add, spelt, schema), schema)


def _listed(doc_id: Any, counts: Counter) -> Iterator[tuple]:
    """A document's words and counts as one text."""
    if counts:
        yield doc_id, " ".join(f"{word} {n}" for word, n in counts.items())


def _entries(known: str) -> Iterator[tuple[str, int]]:
    """The words and counts of such a text."""
    parts = known.split(" ")
    return zip(parts[::2], map(int, parts[1::2]))


def _add(total: Counter, known: str) -> None:
    """Add the counts of such a text."""
    if not total:
        total.update(dict(_entries(known)))
        return
    for word, n in _entries(known):
        total[word] += n


def _by_document(count: Callable[..., None], rows: Callable[[Any, Counter], Iterator[tuple]], schema: str) -> Callable[[Iterator], Iterator]:
    """What ``count`` sums up over neighbouring rows of one document, written out as ``rows`` of ``schema``; one document is in memory."""
    fields = StructType.fromDDL(schema)
    kinds, names = [to_arrow_type(f.dataType) for f in fields], fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total, out = None, Counter(), []

        def written() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            out.clear()
            return made

        for batch in batches:
            for doc_id, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id != of:
                    out.extend(rows(of, total))
                    of, total = doc_id, Counter()
                    if len(out) >= 10_000:
                        yield written()
                count(total, *values)
        out.extend(rows(of, total))
        yield written()

    return run


def _known(vocab: DataFrame) -> DataFrame:
    """(doc_id, known): the words of a document with their counts as one text; a few texts where its rows are apart.

    A word with a hyphen is a compound, so one count says either.
    """
    n = F.when(F.contains("word", F.lit("-")), F.col("hyphenated")).otherwise(F.col("n"))
    rows = vocab.where("doc_id IS NOT NULL").select("doc_id", F.concat_ws(" ", "word", n.cast("string")).alias("entry"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = batch.column(0), batch.num_rows
            if n:
                changes = pc.not_equal(doc.slice(1), doc.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), batch.column(1).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(starts)), pc.binary_join(lists, " ")], ["doc_id", "known"])

    return rows.mapInArrow(pack, f"doc_id {vocab.schema['doc_id'].dataType.simpleString()}, known string")


def line_breaks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(head, tail) of every line that ends in a hyphen and its successor; only the ends of lines are put in order."""
    ends = lines.select(*keys, "line_no", F.regexp_extract("line", r"([A-Za-z0-9]+)-$", 1).alias("head"), F.regexp_extract("line", r"^([A-Za-z0-9]+)", 1).alias("_opens"))
    pairs = ordered.neighbour(ends, keys, ["line_no"], None, {"tail": F.col("_opens")}, following=True)
    return pairs.select(*keys, "line_no", "head", "tail").where((F.col("head") != "") & (F.col("tail") != ""))


def breaks_hyphenate(breaks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Whether a document hyphenates at line ends: merged words beat compounds. Both are looked up in the document's words, one row a side."""
    own = breaks.groupBy("doc_id").agg(F.collect_list(F.concat_ws("-", F.lower("head"), F.lower("tail"))).alias("breaks"))
    words = _known(vocab).groupBy("doc_id").agg(F.collect_list("known").alias("known"))
    schema = f"doc_id {breaks.schema['doc_id'].dataType.simpleString()}, merged long, compound long"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[tuple[int, int]] = []
            for pairs, texts in zip(batch.column("breaks").to_pylist(), batch.column("known").to_pylist()):
                known = {word for text in texts or () for word, n in _entries(text) if n > 0}
                counts.append((sum(p.replace("-", "") in known for p in pairs), sum(p in known for p in pairs)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], ["doc_id", "merged", "compound"])

    total = own.join(words, "doc_id", "left").select("doc_id", "breaks", "known").mapInArrow(look_up, schema)
    return total.withColumn("breaks_hyphenate", F.col("merged") > F.col("compound"))


def profile(blocks: DataFrame) -> DataFrame:
    """One row of measurements per document."""
    edges = extents(blocks)
    right = column_right(edges)
    out = blocks.groupBy("doc_id").agg((F.max("page") + 1).alias("page_count"))
    parts = (body_size(blocks), right, text_left(edges, right), margin_bands(blocks, right),
             paragraph_indent(edges, right))
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out.na.fill({"body_size": 12.0, "body_right": 0.0, "body_left": 0.0, "paragraph_indent": 0.0})


# -- classification ---------------------------------------------------------


def is_page_number(text: Column) -> Column:
    bare = F.trim(text)
    return (bare != "") & (bare.rlike(ARABIC_PAGE) | bare.rlike(ROMAN_PAGE))


def classify(blocks: DataFrame, profiles: DataFrame, furniture: DataFrame) -> DataFrame:
    """``kind`` of each block; furniture first, so a page number is never a heading.

    ``math_share`` is the share of characters set in a mathematics font; with
    one font per block it is 0 or 1.
    """
    text = F.col("text")
    joined = tx.collapse(text)
    share = F.col("math_share") if "math_share" in blocks.columns else F.col("font").rlike(MATH_FONT).cast("double")
    # A pattern is seen on a fifth of the pages, so a document has few; only texts of the margins are masked.
    known = furniture.groupBy("doc_id").agg(F.collect_set("pattern").alias("_known"))
    rows = blocks.join(profiles, "doc_id").join(known, "doc_id", "left")
    margin = in_band(F.col("y0") / F.col("page_height"))
    kind = (
        F.when(~text.rlike(f"[^{tx.SPACE}]"), "furniture")
        .when(margin & (is_page_number(joined) | F.coalesce(F.array_contains("_known", masked(text)), F.lit(False))), "furniture")
        .when(text.rlike(rf"(?i)^[{tx.SPACE}]*(?:Figure|Table)") & joined.rlike(CAPTION), "caption")
        .when(share >= MATH_SHARE, "equation")
        .when((F.col("size") > F.col("body_size") + HEADING_MARGIN) & (F.col("italic") == 0), "heading")
        .otherwise("paragraph")
    )
    return rows.withColumn("type", kind).select(*blocks.columns, "type")


def drop_claimed(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks whose centre lies in no region (doc_id, page, rx0, ry0, rx1, ry1)."""
    b, r = blocks.alias("b"), regions.alias("r")
    cx, cy = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = (
        (F.col("b.doc_id") == F.col("r.doc_id")) & (F.col("b.page") == F.col("r.page"))
        & (cx >= F.col("r.rx0")) & (cx < F.col("r.rx1")) & (cy >= F.col("r.ry0")) & (cy < F.col("r.ry1")))
    return b.join(r, inside, "left_anti")


def captions(blocks: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_extract("text", CAPTION, 1))
    return blocks.where(F.col("text").rlike(CAPTION)).select(
        "doc_id", "page", "block_no", kind.alias("kind"), F.col("text").alias("caption"), "x0", "y0", "x1", "y1")


def pair_captions(regions: DataFrame, caps: DataFrame) -> DataFrame:
    """The caption of each region (doc_id, page, region_id, kind, rx0..ry1).

    A figure looks below first, a table above; the other side is the fallback
    and the nearest caption on a side wins. Page and kind key the join.
    """
    c = caps.select("doc_id", "page", "kind", "block_no", "caption", "y0", "y1")
    below, above = F.col("y0") >= F.col("ry1") - 2, F.col("y1") <= F.col("ry0") + 2
    sides = regions.join(c, ["doc_id", "page", "kind"]).select(
        "doc_id", "page", "region_id", "caption", "block_no",
        F.inline(F.array(
            F.struct(below.alias("hit"), F.when(F.col("kind") == "figure", 0).otherwise(1).alias("side"), (F.col("y0") - F.col("ry1")).alias("gap")),
            F.struct(above.alias("hit"), F.when(F.col("kind") == "figure", 1).otherwise(0).alias("side"), (F.col("ry0") - F.col("y1")).alias("gap")))))
    best = sides.where("hit").groupBy("doc_id", "page", "region_id").agg(
        F.min_by("caption", F.struct("side", "gap", "block_no")).alias("caption"))
    return regions.join(best, ["doc_id", "page", "region_id"], "left")


def nearest_table_caption(tables: DataFrame, caps: DataFrame) -> DataFrame:
    """The table caption that overlaps a table sideways and lies within 80 points."""
    c = caps.where("kind = 'table'").select("doc_id", "page", "block_no", "caption", "x0", "y0", "x1", "y1")
    near = tables.join(c, ["doc_id", "page"]).where((F.col("x1") > F.col("rx0")) & (F.col("x0") < F.col("rx1")))
    touch = (F.col("y1") > F.col("ry0")) & (F.col("y0") < F.col("ry1"))
    gap = F.least(F.abs(F.col("y1") - F.col("ry0")), F.abs(F.col("ry1") - F.col("y0")))
    apart = F.greatest(F.lit(0.0), F.col("ry0") - F.col("y1"), F.col("y0") - F.col("ry1"))
    best = near.where(touch | (gap < CAPTION_GAP)).groupBy("doc_id", "page", "region_id").agg(
        F.min_by("caption", F.struct(apart, F.col("block_no"))).alias("caption"))
    return tables.join(best, ["doc_id", "page", "region_id"], "left")


def group_adjacent(df: DataFrame, keys: list[str], order: list[str], segment: Column | None, same: Column,
                   previous: dict[str, Column], out: str = "group_no") -> DataFrame:
    """Number runs of neighbours for which ``same`` holds against the previous row."""
    starts = ~F.coalesce(same, F.lit(False))
    return ordered.islands(df, keys, order, segment, starts, previous, out)


def group_panels(panels: DataFrame) -> DataFrame:
    """Panels of one figure: the same caption and at most 90 points apart."""
    same = (F.col("_cap") == F.col("caption")) & (F.col("y0") - F.col("_y1") <= PANEL_GAP)
    runs = group_adjacent(panels, ["doc_id", "page"], ["y0", "x0"], None, same,
                          {"_cap": F.col("caption"), "_y1": F.col("y1")})
    return runs.groupBy("doc_id", "page", "group_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("width").alias("width"), F.max("height").alias("height"), F.min_by("caption", F.struct("y0", "x0")).alias("caption"),
        F.array_sort(F.collect_list("path")).alias("paths"))


def dedupe_assets(images: DataFrame) -> DataFrame:
    """Images large enough to matter, with the first path holding the same bytes."""
    big = images.where(
        (F.col("width") >= MIN_PIXELS) & (F.col("height") >= MIN_PIXELS) & (F.col("page_share") >= MIN_PAGE_SHARE))
    first = big.groupBy("content_hash").agg(F.min_by("path", "seq").alias("asset_path"))
    return big.join(first, "content_hash")


# -- tables -----------------------------------------------------------------


def _header_key(row: Column) -> Column:
    return F.transform(row, lambda c: tx.casefold(tx.collapse(c)))


def stitch_tables(tables: DataFrame) -> DataFrame:
    """Tables a page break split, rejoined: rows (doc_id, ord, page, y0, y1,
    page_height, rows, quality, breaks_before)."""
    rank = F.array_position(F.array(*[F.lit(q) for q in QUALITY]), F.col("quality"))
    previous = {
        "_page": F.col("page"), "_y1": F.col("y1"), "_h": F.col("page_height"),
        "_key": _header_key(F.get("rows", F.lit(0))), "_n": F.size("rows")}
    same = (
        (F.col("breaks_before") == 0) & (F.col("_n") > 0) & (F.size("rows") > 0)
        & (F.col("page") == F.col("_page") + 1) & (_header_key(F.get("rows", F.lit(0))) == F.col("_key"))
        & (F.col("_y1") > F.col("_h") / 2) & (F.col("y0") < F.col("page_height") / 2))
    runs = group_adjacent(tables, ["doc_id"], ["ord"], None, same, previous)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("ord", "rows"))), lambda t: t["rows"])
    joined = F.concat(F.col("pieces")[0], F.flatten(F.transform(
        F.slice("pieces", 2, F.size("pieces")), lambda r: F.slice(r, 2, F.size(r)))))
    return runs.withColumn("_q", rank).groupBy("doc_id", "group_no").agg(
        F.min("page").alias("page"), F.max("page").alias("last_page"), F.max_by("quality", "_q").alias("quality"),
        pieces.alias("pieces"),
    ).select("doc_id", "page", F.when(F.col("last_page") > F.col("page"), F.col("last_page")).alias("page_end"),
             "quality", joined.alias("rows"))


def compact_grid(rows: Column) -> Column:
    """A grid without empty rows and columns, padded to one width."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(tx.collapse(c), F.lit(""))))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))

    def pad(grid: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
        return tx.bind(width, lambda w: F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))

    def columns_kept(padded: Column) -> Column:
        width = F.greatest(F.coalesce(F.size(F.try_element_at(padded, F.lit(1))), F.lit(0)), F.lit(1))
        keep = F.filter(F.sequence(F.lit(1), width), lambda i: F.exists(padded, lambda r: F.try_element_at(r, i) != ""))
        return tx.bind(keep, lambda k: F.transform(padded, lambda r: F.transform(k, lambda i: F.element_at(r, i))))

    return tx.bind(tx.bind(full, pad), columns_kept)


def grid_is_valid(rows: Column) -> Column:
    def judged(grid: Column) -> Column:
        width = F.size(F.get(grid, F.lit(0)))
        filled = F.size(F.filter(F.flatten(grid), lambda c: c != ""))
        return F.coalesce(
            (F.size(grid) >= MIN_ROWS) & (width >= MIN_COLS) & F.forall(grid, lambda r: F.size(r) == width)
            & (filled / (F.size(grid) * width) >= MIN_FILL), F.lit(False))

    return tx.bind(rows, judged)


def markdown_line(row: Column) -> Column:
    """One table row with its cells escaped."""
    cells = F.transform(row, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    return F.concat(F.lit("|"), F.array_join(cells, "|"), F.lit("|"))


def markdown_lines(rows: Column) -> Column:
    """The lines of a grid as a markdown table: its first row, a rule, the rest."""
    head = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(head, lambda _: F.lit("---")), "|"), F.lit("|"))
    lines = tx.bind(F.transform(rows, markdown_line), lambda each: F.concat(F.slice(each, 1, 1), F.array(rule), F.slice(each, 2, F.greatest(F.size(each), F.lit(1)))))
    return F.when(F.size(rows) == 0, F.array().cast("array<string>")).otherwise(lines)


def markdown(rows: Column) -> Column:
    """A grid as a markdown table, its first row the header."""
    return F.array_join(markdown_lines(rows), "\n")


# -- labels and sections ----------------------------------------------------


def label_candidates(elements: DataFrame) -> DataFrame:
    """(doc_id, ord, offset, label) of paragraphs and headings."""
    usable = elements.where(F.col("type").isin("paragraph", "heading"))
    return usable.select("doc_id", "ord", F.explode(lb.candidates(F.col("text"))).alias("c")).select(
        "doc_id", "ord", "c.offset", "c.label")


def corroborated(found: DataFrame) -> DataFrame:
    """Labels whose neighbour in the same sequence is their predecessor or successor."""
    base = found.withColumn("parent", F.col("label.parent"))
    segment = None
    keys, order = ["doc_id", "parent"], ["ord", "offset"]
    near = ordered.neighbour(base, keys, order, segment, {"before": F.col("label")})
    near = ordered.neighbour(near, keys, order, segment, {"after": F.col("label")}, following=True)
    here = F.col("label")
    ok = F.coalesce(lb.follows(F.col("before"), here), F.lit(False)) | F.coalesce(lb.follows(here, F.col("after")), F.lit(False))
    return near.where(ok).select("doc_id", F.col("label.label").alias("label")).distinct()


def split_welded(elements: DataFrame, found: DataFrame, proven: DataFrame) -> DataFrame:
    """Paragraphs cut at proven sectional labels inside them; y follows the text."""
    cuts = (
        found.where((F.col("offset") > 0) & F.col("label.kind").isin(*lb.SECTIONAL))
        .select("doc_id", "ord", "offset", F.col("label.label").alias("label"))
        .join(proven, ["doc_id", "label"], "left_semi")
        .groupBy("doc_id", "ord").agg(F.array_sort(F.collect_set("offset")).alias("cuts"))
    )
    cuts = cuts.withColumn("_t", F.lit("paragraph"))
    rows = elements.join(cuts, (elements["doc_id"] == cuts["doc_id"]) & (elements["ord"] == cuts["ord"]) & (elements["type"] == cuts["_t"]), "left").drop(cuts["doc_id"]).drop(cuts["ord"])
    size = F.char_length("text")
    starts = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")))
    spans = F.transform(starts, lambda s, i: F.struct(
        s.alias("a"), F.coalesce(F.get(starts, i + 1), size).alias("b")))
    height = F.col("y1") - F.col("y0")
    part = rows.withColumn("_size", size).select(
        *elements.columns, "_size", F.posexplode(spans).alias("piece", "_s"))
    text = tx.strip(F.substr("text", F.col("_s.a") + 1, F.col("_s.b") - F.col("_s.a")))
    whole = F.greatest(F.col("_size"), F.lit(1))
    return part.withColumns({
        "text": F.when((F.col("_s.a") == 0) & (F.col("_s.b") == F.col("_size")), F.col("text")).otherwise(text),
        "y0": F.col("y0") + height * F.col("_s.a") / whole,
        "y1": F.col("y0") + height * F.col("_s.b") / whole,
    }).where((F.col("text") != "") | (F.col("_size") == 0)).drop("_s", "_size")


def synthesize_spine(elements: DataFrame, proven: DataFrame) -> DataFrame:
    """Sections from headings and proven clause labels, nested by label key.

    The sections of a document pass by in order once; what is kept of them is
    the newest one of each key and of each level.
    """
    heading = F.col("type") == "heading"
    cand = elements.where(F.col("type").isin("heading", "paragraph")).withColumn("lab", lb.label_at_start(F.col("text"))).where(
        heading | F.col("lab.kind").isin(*lb.PARAGRAPH_SECTIONS))
    title = F.when(heading, F.col("text")).otherwise(lb.clause_title(F.col("text"), F.col("lab")))
    sectional = F.coalesce(F.col("lab.kind").isin(*lb.SECTIONAL), F.lit(False))
    rows = cand.select(
        "doc_id", "ord", "page", "y0", title.alias("title"),
        F.when(sectional, F.col("lab.key")).alias("key"), F.col("lab.parent").alias("parent"),
        F.when(sectional, lb.depth(F.col("lab"))).otherwise(1).alias("depth"), heading.alias("_heading"), F.col("lab.label").alias("_l"))
    # A heading needs no proof; the titles, not the texts, meet the proven labels.
    ok = proven.select("doc_id", F.col("label").alias("_l"), F.lit(True).alias("_ok"))
    rows = rows.join(ok, ["doc_id", "_l"], "left").where(F.col("_heading") | F.col("_ok").isNotNull()).drop("_heading", "_ok", "_l")
    return _fold_sections(rows)


class _Outline:
    """The newest section of every key and of every level of one document, as (number, level, path)."""

    def __init__(self) -> None:
        self.n = 0
        self.of_key: dict[str, tuple[int, int, list[str]]] = {}
        self.of_level: dict[int, tuple[int, int, list[str]]] = {}

    def place(self, title: str, key: str | None, parent: str | None, depth: int) -> tuple[int, list[str]]:
        """A section hangs below the newest one its label names, else below the newest of a lesser level than its depth."""
        above = self.of_key.get(parent) if parent is not None else None
        if above is None and depth > 1:
            above = max((self.of_level[k] for k in range(1, depth) if k in self.of_level), default=None)
        level, path = (above[1] + 1, [*above[2], title]) if above else (1, [title])
        self.n += 1
        self.of_level[level] = (self.n, level, path)
        if key is not None:
            self.of_key[key] = self.of_level[level]
        return level, path


def _fold_sections(rows: DataFrame) -> DataFrame:
    """``doc_id, ord, page, y0, title, key, level, path`` of sections with ``key``, ``parent`` and ``depth``; linear in them."""
    typed = rows.select("doc_id", *[F.col(c).cast(t).alias(c) for c, t in (("ord", "bigint"), ("page", "bigint"), ("y0", "double"))], "title", "key", "parent", "depth")
    return ordered.stepwise(typed, ["doc_id"], ["ord", "page", "y0", "title"], ["title", "key", "parent", "depth"], _Outline, _Outline.place, {
        "level": "int", "path": "array<string>"}).drop("parent", "depth")


def outline_paths(outline: DataFrame) -> DataFrame:
    """Paths of an outline list (doc_id, seq, level, title, page); pages become 0-based."""
    clean = outline.withColumn("title", tx.collapse(F.col("title"))).where("title != ''")
    listed = clean.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("seq", F.col("level").cast("int").alias("level"), "title", F.col("page").cast("bigint").alias("page")))).alias("s"))
    item = "array<struct<seq:bigint,level:int,title:string,page:bigint,path:array<string>>>"
    start = F.struct(F.array().cast("array<string>").alias("above"), F.array().cast(item).alias("out"))

    def add(state: Column, x: Column) -> Column:
        path = F.concat(F.slice(state["above"], 1, x["level"] - 1), F.array(x["title"]))
        return F.struct(path.alias("above"), F.concat(state["out"], F.array(F.struct(
            x["seq"].cast("bigint").alias("seq"), x["level"].alias("level"), x["title"].alias("title"),
            F.greatest(x["page"] - 1, F.lit(0).cast("bigint")).alias("page"), path.alias("path")))).alias("out"))

    return listed.select("doc_id", F.inline(F.aggregate("s", start, add, lambda s: s["out"])))


def locate_headings(outline: DataFrame, elements: DataFrame) -> DataFrame:
    """Outline entries (doc_id, seq, page, title) with the element that prints them.

    Titles are offered by every element and by every neighbouring pair on a
    page, with and without a section number; the first offer of a title wins.
    A normal form keeps every Latin letter and a number in front holds at most
    nine, so a text with more letters than that and the longest title wanted on
    its page is no title, alone or in a pair, and is not put into normal form.
    """
    title = F.col("title")
    wanted = outline.select("doc_id", "seq", "page", F.posexplode(F.array(
        tx.normal_title(title), tx.normal_title(tx.without_number(title)))).alias("form", "key"))
    room = wanted.groupBy("doc_id", "page").agg((F.max(F.char_length("key")) + NUMBER_LETTERS).alias("_room"))
    usable = elements.where(~F.col("type").isin("table", "figure", "furniture")).join(room, ["doc_id", "page"])
    begin = F.col("text").substr(F.lit(1), 2 * F.col("_room"))
    short = F.coalesce(F.char_length(F.regexp_replace(begin, "[^A-Za-z]+", "")) <= F.col("_room"), F.lit(True))
    texts = usable.select("doc_id", "page", "ord", "y0", short.alias("_short"), F.when(short, F.col("text")).alias("text"))
    pairs = ordered.neighbour(texts, ["doc_id", "page"], ["ord"], None, {"next_text": F.col("text")}, following=True).where("_short")
    text, nxt = F.col("text"), F.col("next_text")
    joined = F.when(text.endswith("-"), F.concat(F.regexp_replace(text, "-$", ""), nxt)).otherwise(F.concat_ws(" ", text, nxt))
    pair = F.when(nxt.isNotNull(), joined)
    offered = pairs.select("doc_id", "page", "ord", "y0", F.posexplode(F.array(
        tx.normal_title(text), tx.normal_title(tx.without_number(text)),
        tx.normal_title(pair), tx.normal_title(tx.without_number(pair)))).alias("variant", "key"))
    first = offered.where(F.col("key").isNotNull()).groupBy("doc_id", "page", "key").agg(
        F.min_by(F.struct("ord", "y0", "variant"), F.struct("ord", "variant")).alias("hit"))
    found = wanted.join(first, ["doc_id", "page", "key"]).groupBy("doc_id", "seq").agg(
        F.min_by("hit", "form").alias("hit"))
    return outline.join(found, ["doc_id", "seq"], "left").select(
        *outline.columns, F.col("hit.ord").alias("heading_ord"), F.col("hit.y0").alias("start_y"),
        (F.col("hit.variant") >= 2).alias("absorbs_next"))


def assign_sections(elements: DataFrame, spine: DataFrame) -> DataFrame:
    """Each element with the last section (title, path) starting at or before it."""
    marks = spine.select(
        "doc_id", "page", F.coalesce("start_y", F.lit(-1.0)).alias("y"), F.lit(0).alias("after"),
        F.col("seq").cast("bigint").alias("tie"), F.struct("title", "path").alias("section_row"), F.lit(None).cast("bigint").alias("ord"))
    rows = elements.select(
        "doc_id", "page", F.col("y0").alias("y"), F.lit(1).alias("after"), F.col("ord").cast("bigint").alias("tie"),
        F.lit(None).cast("struct<title:string,path:array<string>>").alias("section_row"), F.col("ord").cast("bigint").alias("ord"))
    carried = ordered.carry_forward(
        marks.unionByName(rows), ["doc_id"], ["page", "y", "after", "tie"], None, F.col("section_row"), "found")
    placed = carried.where(F.col("ord").isNotNull()).select(
        "doc_id", "ord", F.coalesce("found.title", F.lit("")).alias("section"),
        F.coalesce("found.path", F.array().cast("array<string>")).alias("section_path"))
    return elements.join(placed, ["doc_id", "ord"])


def figure_text(caption: Column, section: Column, page_label: Column) -> Column:
    """A figure without a caption is named after its section and page."""
    where = F.when(F.coalesce(section, F.lit("")) != "", section).otherwise("the document")
    named = F.concat(F.lit("Figure in "), where, F.lit(" (page "), page_label, F.lit(")"))
    return F.when(F.coalesce(caption, F.lit("")) == "", named).otherwise(caption)


def type_counts(elements: DataFrame, types: tuple[str, ...] = (
        "paragraph", "heading", "table", "figure", "caption", "equation", "furniture")) -> DataFrame:
    return elements.groupBy("doc_id").agg(*[
        F.count(F.when(F.col("type") == t, 1)).alias(t) for t in types])


def spine_source(documents: DataFrame, outline: DataFrame, headings: DataFrame) -> DataFrame:
    """Where a document's sections come from: outline, headings or none."""
    a = outline.select("doc_id").distinct().withColumn("_o", F.lit(True))
    b = headings.select("doc_id").distinct().withColumn("_h", F.lit(True))
    source = F.when(F.col("_o"), "outline").when(F.col("_h"), "headings").otherwise("none")
    return documents.join(a, "doc_id", "left").join(b, "doc_id", "left").withColumn("spine_source", source).drop("_o", "_h")


def page_label(printed: Column, page: Column) -> Column:
    return F.coalesce(F.nullif(printed, F.lit("")), (page + 1).cast("string"))


# -- lines into text ---------------------------------------------------------

_WHOLE_RUN = re.compile(r"[A-Za-z0-9]+-?")
_RUNS, _LETTERS = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z]+")
_RUN = string.ascii_letters + string.digits
_DOTS = re.compile(DOT_LEADER)
#: How two lines meet: one word, a compound, one word without a hyphen between, or two words.
_MERGED, _COMPOUND, _GLUED = "m", "k", "g"


def end_run(line: str) -> str:
    """The run a line ends in, a last hyphen aside; looked for from the end, so that long lines cost no more."""
    body = line.removesuffix("-")
    return body[len(body.rstrip(_RUN)):]


class _Words:
    """The words and compounds of a document with their counts, and whether it hyphenates at line ends."""

    def __init__(self, facts: list[tuple[str | None, bool | None]]) -> None:
        self.counts: Counter = Counter()
        self.merges = False
        for known, merges in facts:
            self.merges = self.merges or bool(merges)
            for word, n in _entries(known) if known else ():
                self.counts[word] += n

    def verdict(self, left: str, hyphen: bool, line: str) -> str | None:
        """How a line meets a text that ends in the run ``left``, None for a space.

        A hyphen at the break is kept where the document writes the compound and
        not the word, between a digit and a letter, or where neither the word nor
        the document's habit speaks for merging. Without a hyphen two halves are
        one word where the document has that word more often than the longer half.
        """
        if hyphen:
            right = _RUNS.match(line)
            if not left or not right:
                return None
            whole = self.counts.get((left + right[0]).lower(), 0) > 0
            written = self.counts.get(f"{left}-{right[0]}".lower(), 0) > 0
            mixed = left[-1].isdigit() != right[0][0].isdigit()
            return _COMPOUND if mixed or not whole and (written or not self.merges) else _MERGED
        tail, head = left[len(left.rstrip(string.ascii_letters)):], _LETTERS.match(line)
        if not tail or not head:
            return None
        longer = tail if len(tail) >= len(head[0]) else head[0]
        return _GLUED if self.counts.get((tail + head[0]).lower(), 0) > self.counts.get(longer.lower(), 0) else None


class _Text:
    """The end of the text built so far, in the words of its document."""

    def __init__(self, words: _Words) -> None:
        self.words = words
        self.run, self.hyphen = "", False

    def join(self, line: str) -> str | None:
        """How ``line`` meets the text, None for a space; the text then ends as the line does."""
        how = self.words.verdict(self.run, self.hyphen, line)
        own = end_run(line)
        self.run = self.run + own if how in (_MERGED, _GLUED) and _WHOLE_RUN.fullmatch(line) else own
        self.hyphen = line.endswith("-")
        return how


class _Once:
    """The facts of a document made up once for all of its blocks, which come one after the other."""

    def __init__(self, make: Callable[[list[tuple]], Any]) -> None:
        self.make, self.of, self.made = make, None, None

    def __call__(self, facts: list[tuple]) -> Any:
        if self.of is not facts:
            self.of, self.made = facts, self.make(facts)
        return self.made


def joined_text(rows: DataFrame, keys: list[str], order: list[str], line: Callable[[Column], Column], met: str, **more: Column) -> DataFrame:
    """The text of each key from its lines and how each one meets the text before; ``more`` are further aggregates.

    ``line`` is what of ``text`` stands in the paragraph; it is worked out behind the shuffle.
    """
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(met).alias("_met"), F.col("text")))).alias("_found"),
        *[c.alias(n) for n, c in more.items()])

    def piece(row: Column, i: Column) -> Column:
        own = line(row["text"])
        body = F.when(F.get(F.col("_found"), i + 1)["_met"] == _MERGED, F.regexp_replace(own, "-$", "")).otherwise(own)
        return F.concat(F.when((i == 0) | row["_met"].isNotNull(), "").otherwise(" "), body)

    return found.select("*", F.size("_found").alias("_lines"), F.array_join(F.transform("_found", piece), "").alias("text"))


def join_lines(lines: DataFrame, vocab: DataFrame, habits: DataFrame) -> DataFrame:
    """Paragraph text per (doc_id, block) from its lines.

    A document's words and habit come in front of its lines, in one pass in order.
    """
    rows = lines.select("doc_id", "block", "line_no", F.col("line").alias("text"))
    keys = ["doc_id", "block"]
    facts = _known(vocab).withColumn("merges", F.lit(None).cast("boolean")).unionByName(
        habits.where("doc_id IS NOT NULL").select("doc_id", F.lit(None).cast("string").alias("known"), F.col("breaks_hyphenate").alias("merges")))
    words = _Once(_Words)
    met = ordered.stepwise(rows, keys, ["line_no"], [tx.collapse(F.col("text"))], lambda facts: _Text(words(facts)), lambda text, line: (text.join(line),), {"met": "string"}, facts)
    return joined_text(met, keys, ["line_no"], tx.collapse, "met").select("doc_id", "block", tx.collapse(F.col("text")).alias("text"))


class _Layout(_Words):
    """The words of a document, the edges of its text and the elements that open a clause."""

    def __init__(self, facts: list[tuple]) -> None:
        super().__init__([f[:2] for f in facts])
        self.profiled, self.opens = False, set()
        self.left = self.right = self.indent = None
        for _, _, left, right, indent, opens, profiled in facts:
            if opens is not None:
                self.opens.add(opens)
            if profiled:
                self.profiled, self.left, self.right, self.indent = True, left, right, indent

    def edges(self, no: int, kind: str | None, x0: float | None, x1: float | None) -> tuple[bool, bool, bool]:
        """Whether an element can start a paragraph, can go on with one, and fills its line."""
        text = kind == "paragraph" and bool(self.left) and x0 is not None
        offset = abs(x0 - self.left) if text else 0.0
        slack = self.indent + INDENT_SLACK if self.indent and self.indent > 0 else FLUSH
        full = bool(self.right) and x1 is not None and abs(x1 - self.right) <= TOLERANCE
        return text and offset <= slack, text and offset <= FLUSH and no not in self.opens, full


class _Paragraph(_Text):
    """The paragraph that lines are being added to."""

    def __init__(self, layout: _Layout) -> None:
        super().__init__(layout)
        self.no, self.starts, self.full, self.dots = -1, False, False, False
        self.size, self.tail, self.first = 0, "", None
        self.opened, self.page, self.bottom, self.box = None, None, 0.0, True

    def place(self, text: str, line: str, no: int, kind: str | None, page: int, x0: float, y0: float, x1: float, y1: float, dots: bool) -> tuple:
        """Whether a line goes on with the paragraph, how it meets it, and whether it is on the page the paragraph's box is on."""
        if not self.words.profiled:
            return None, None, None
        starts, follows, full = self.words.edges(no, kind, x0, x1)
        near = page != self.opened or y0 - self.bottom <= MAX_LINE_GAP
        goes_on = (self.no >= 0 and follows and self.starts and self.full and not (self.dots or dots) and near
                   and self.size + len(text) <= MAX_PARAGRAPH)
        if not goes_on:
            self.no += 1
            self.starts, self.full, self.dots = starts, full, dots
            self.size, self.tail, self.run, self.hyphen = len(text), text[-8:], end_run(text), line.endswith("-")
            self.opened, self.page, self.bottom, self.box, self.first = page, page, y1, True, line
            return self.no, None, True
        how = self.join(line)
        if self.first is not None:  # the first line's own white space counts until it is joined
            self.size, self.tail, self.first = len(self.first), self.first[-8:], None
        kept = self.tail[:-1] if how == _MERGED else self.tail
        self.size += len(line) + (how is None) - (how == _MERGED)
        self.dots = bool(_DOTS.search(kept + ("" if how else " ") + line))
        self.tail = (kept + ("" if how else " ") + line)[-8:]
        self.full = full
        if page != self.page:
            self.page, self.box = page, False
        elif self.box:
            self.bottom = y1
        return self.no, how, self.box


def join_wrapped_lines(elements: DataFrame, profiles: DataFrame, opens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Paragraphs rebuilt from lines a layout hands out as separate blocks.

    A document's words, the edges of its text and the clauses it opens come in
    front of its elements; one pass in order says which lines a paragraph takes
    and how they meet, and paragraphs are aggregates of their lines. ``opens``
    lists (doc_id, ord) that start a clause.
    """
    facts = {"known": "string", "merges": "boolean", "body_left": "double", "body_right": "double", "paragraph_indent": "double",
             "opens": elements.schema["ord"].dataType.simpleString(), "profiled": "boolean"}

    def about(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select("doc_id", *[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in facts.items()])

    given = about(_known(vocab), known=F.col("known")).unionByName(
        about(profiles, merges=F.col("breaks_hyphenate"), profiled=F.lit(True), **{c: F.col(c) for c in ("body_left", "body_right", "paragraph_indent")})).unionByName(
        about(opens, opens=F.col("ord")))
    rows = elements.where("doc_id IS NOT NULL").select("doc_id", "ord", "type", "text", "page", "x0", "y0", "x1", "y1")
    text = F.col("text")
    layout = _Once(_Layout)
    placed = ordered.stepwise(
        rows, ["doc_id"], ["ord"], ["text", tx.collapse(text), "ord", "type", "page", "x0", "y0", "x1", "y1", text.rlike(DOT_LEADER)],
        lambda facts: _Paragraph(layout(facts)), _Paragraph.place, {"_no": "int", "_how": "string", "_box": "boolean"}, given.where("doc_id IS NOT NULL")).where("_no IS NOT NULL")
    own = F.struct("ord", "type", "page", "x0", "y0", "x1", "y1")
    in_box = lambda c: F.when(F.col("_box"), F.col(c))
    folded = joined_text(
        placed, ["doc_id", "_no"], ["ord"], tx.collapse, "_how", first=F.min_by(own, "ord"), last_page=F.max_by("page", "ord"),
        left=F.min(in_box("x0")), right=F.max(in_box("x1")), bottom=F.max_by("y1", F.when(F.col("_box"), F.col("ord"))), over=F.min(F.col("_box").cast("int")))
    alone = F.get("_found", F.lit(0))["text"]
    return folded.select(
        "doc_id", "first.ord", "first.type", F.when(F.col("_lines") == 1, alone).otherwise(tx.collapse(text)).alias("text"), F.col("first.page").cast("long").alias("page"),
        F.when(F.col("over") == 0, F.col("last_page")).cast("long").alias("page_end"),
        F.col("left").cast("double").alias("x0"), F.col("first.y0").cast("double").alias("y0"), F.col("right").cast("double").alias("x1"), F.col("bottom").cast("double").alias("y1"))
