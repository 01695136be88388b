"""Text, labels, joins of lines and layout rules on literal rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from pactframe.functions import labels as lb
from pactframe.functions import text as tx
from pactframe.functions.stemmer import porter
from pactframe.operators import structure as st


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def plain_sentences(text):
    """Brute force: cut after . ! ? unless the word before is an abbreviation or an initial."""
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?])[\"')\]]*\s+", text):
        head = text[start:m.start()]
        word = re.search(r"([A-Za-z][A-Za-z.]*)\.$", head)
        if word and (len(word[1]) == 1 or word[1].lower() in tx.ABBREVIATIONS):
            continue
        out.append(head.strip())
        start = m.end()
    tail = text[start:].strip()
    return out + [tail] if tail else out


@pytest.mark.parametrize("text", [
    "See Ex. 3 for more. It ends here! \"Quoted.\" Next one? Yes.",
    "Acme Holdings, Inc. shall pay. J. Smith signs. i.e. this. End", "One two", "A. B. C. done. (See above.) Then x.y. z.",
    "...p. q", "U.S. law applies vs. others. No. 5 is fine.\nNew line.", "no stop here  "])
def test_sentences(spark, text):
    assert one(spark, text, tx.sentences) == plain_sentences(text)


def test_normal_forms(spark):
    assert one(spark, "  “Smart”  |  ﬁt… – Straße ", tx.normal_quote) == '"smart" fit... - strasse'
    assert one(spark, "Section 2.1 “Air” Tightness", lambda c: tx.normal_title(tx.without_number(c))) == "air tightness"


def test_hedges_are_word_bounded(spark):
    assert one(spark, "maybe the vendor may use reasonable efforts", tx.hedge_terms) == ["reasonable efforts", "may"]


@pytest.mark.parametrize("text,want", [
    ("Passwords are rotated every 90 days", {"password", "rotat", "days"}), ("the supplier shall", set()), ("rotation", {"rotat"})])
def test_content_terms(spark, text, want):
    assert set(one(spark, text, tx.content_terms)) == want


@pytest.mark.parametrize("name,want", [
    ("../../etc/passwd", "passwd.pdf"), ("Sample Contract.PDF", "Sample_Contract.pdf"), ("..", "upload.pdf"), (None, "upload.pdf"),
    ("a\\b\\c.pdf", "c.pdf"), ("x" * 200, "x" * 100 + ".pdf")])
def test_safe_filename(spark, name, want):
    assert one(spark, name, tx.safe_filename) == want


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("electriciti", "electr"), ("adjustment", "adjust"), ("probate", "probat"), ("rate", "rate"),
    ("controll", "control"), ("generalizations", "gener"), ("agreed", "agre"), ("conflated", "conflat")])
def test_porter(word, stem):
    assert porter(word) == stem


@pytest.mark.parametrize("text,label,kind,parent,ordinal", [
    ("6.6 Password", "6.6", "decimal", "6", [6]), ("12. Terms", "12", "integer", "", [12]), ("G3A. Access", "G3A", "alnum", "G", [3, 1]),
    ("Exhibit G requires", "Exhibit G", "exhibit", "", [7]), ("(iv) if", "(iv)", "roman", "(roman)", [4]), ("(b) the", "(b)", "lettered", "(letter)", [2])])
def test_labels(spark, text, label, kind, parent, ordinal):
    got = one(spark, text, lb.label_at_start)
    assert (got["label"], got["kind"], got["parent"], got["ordinal"]) == (label, kind, parent, ordinal)
    assert text[got["end"]:] != text and (kind == "exhibit" or text[got["end"] - 1] == " ")


def test_lower_case_is_no_label(spark):
    assert one(spark, "1.2 is the minimum version", lb.label_at_start) is None


def test_candidate_offsets(spark):
    text = "6.6 Password rule. 6.7 Access rule; (a) one (b) two. Section 6.4 for. 6.8 Keys"
    found = one(spark, text, lb.candidates)
    assert [(c["offset"], c["label"]["label"]) for c in found] == [
        (0, "6.6"), (text.index("6.7"), "6.7"), (text.index("(a)"), "(a)"), (text.index("6.8"), "6.8")]


def test_lone_reference_is_not_corroborated(spark):
    rows = [(1, 0, "paragraph", "6.6 One. 6.7 Two."), (1, 1, "paragraph", "Stop. 9.4 Stray.")]
    df = spark.createDataFrame(rows, "doc_id long, ord long, type string, text string")
    found = st.label_candidates(df)
    assert {r["label"] for r in st.corroborated(found).collect()} == {"6.6", "6.7"}


def test_split_welded(spark):
    rows = [(1, 0, "paragraph", "6.6 One goes. 6.7 Two goes.", 0.0, 100.0)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, type string, text string, y0 double, y1 double")
    found = st.label_candidates(df)
    parts = st.split_welded(df, found, st.corroborated(found)).orderBy("piece").collect()
    assert [p["text"] for p in parts] == ["6.6 One goes.", "6.7 Two goes."]
    assert parts[0]["y1"] == parts[1]["y0"]


WORDS = {"building": 2, "pass": 1, "alerting": 8, "alertin": 2, "special": 5, "handling": 5, "again": 9, "gain": 9}


BREAKS = [
    ("the build-", "ing stands", False, "the building stands"), ("a single-", "family home", True, "a single-family home"),
    ("see GOV-", "01 here", True, "see GOV-01 here"), ("an unknown-", "word", True, "an unknownword"), ("an unknown-", "word", False, "an unknown-word"),
    ("Monitoring/Alertin", "g", False, "Monitoring/Alerting"), ("Special", "Handling", False, "Special Handling"), ("a", "gain", False, "a gain")]


def vocabulary_of(spark, words, compounds, docs):
    rows = [(d, w, words.get(w, 0), compounds.get(w, 0)) for d in docs for w in {**words, **compounds}]
    return spark.createDataFrame(rows, "doc_id long, word string, n long, hyphenated long")


def test_line_breaks(spark):
    docs = range(len(BREAKS))
    lines = spark.createDataFrame([(d, 0, k, BREAKS[d][k]) for d in docs for k in (0, 1)], "doc_id long, block long, line_no long, line string")
    habits = spark.createDataFrame([(d, BREAKS[d][2]) for d in docs], "doc_id long, breaks_hyphenate boolean")
    got = st.join_lines(lines, vocabulary_of(spark, WORDS, {"single-family": 1}, docs), habits)
    assert {r.doc_id: r.text for r in got.collect()} == {d: BREAKS[d][3] for d in docs}


def read_on(lines, words, compounds, merges):
    """A block's text by joining one line after the other to all that stands before."""
    text = lines[0]
    for line in lines[1:]:
        left, right = re.search(r"([A-Za-z0-9]+)-$", text), re.match(r"[A-Za-z0-9]+", line)
        a, b = re.search(r"[A-Za-z]+$", text), re.match(r"[A-Za-z]+", line)
        if left and right:
            x, y = left[1], right[0]
            merged = words.get((x + y).lower(), 0) > 0
            apart = compounds.get(f"{x}-{y}".lower(), 0) > 0 and not merged or x[-1].isdigit() != y[0].isdigit() or not merged and not merges
            text = text + line if apart else text[:-1] + line
        elif a and b and words.get((a[0] + b[0]).lower(), 0) > words.get(max(a[0], b[0], key=len).lower(), 0):
            text += line
        else:
            text = f"{text} {line}"
    return " ".join(text.split())


def test_chains_of_fragments_match_reading_on(spark):
    rng = random.Random(5)
    parts = ["ab", "cd", "e", "x1", "2", "ab-", "cd-", "e-", "x1-", "2-", "one ab-", "ab two", "e.", "-", "", "(cd", "ab-cd-", "de-ab"]
    words = {"".join(c): rng.randrange(0, 4) for c in itertools.product(["ab", "cd", "e", "x1", "2"], repeat=2)} | {"abcde": 3, "abcd2": 2, "ab": 1, "e": 2, "cde": 4}
    compounds = {f"{a}-{b}": 1 for a in ("ab", "cd", "e") for b in ("cd", "e", "2") if rng.random() < 0.5}
    blocks = [(d, k, [" ".join(rng.choice(parts).split()) for _ in range(rng.randrange(1, 9))]) for d in range(2) for k in range(200)]
    lines = spark.createDataFrame([(d, k, i, x) for d, k, b in blocks for i, x in enumerate(b)], "doc_id long, block long, line_no long, line string")
    habits = spark.createDataFrame([(0, True), (1, False)], "doc_id long, breaks_hyphenate boolean")
    got = {(r.doc_id, r.block): r.text for r in st.join_lines(lines, vocabulary_of(spark, words, compounds, range(2)), habits).collect()}
    assert got == {(d, k): read_on(b, words, compounds, d == 0) for d, k, b in blocks}


def test_chain_of_broken_words(spark):
    lines = spark.createDataFrame([(1, 0, 0, "mis-"), (1, 0, 1, "un-"), (1, 0, 2, "der"), (1, 1, 3, "misunder")], "doc_id long, block long, line_no long, line string")
    vocab = st.vocabulary(lines)
    habits = spark.createDataFrame([(1, True)], "doc_id long, breaks_hyphenate boolean")
    assert st.join_lines(lines, vocab, habits).where("block = 0").first()["text"] == "misunder"


def test_wrapped_lines(spark):
    cols = "doc_id long, ord long, type string, text string, page long, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 0, "paragraph", "starts here and", 0, 36.0, 10.0, 577.0, 20.0), (1, 1, "paragraph", "goes on", 0, 36.0, 30.0, 300.0, 40.0),
            (1, 2, "paragraph", "a new one", 0, 36.0, 50.0, 577.0, 60.0), (1, 3, "paragraph", "over the page", 1, 36.0, 10.0, 577.0, 20.0),
            (1, 4, "paragraph", "7. Clause", 1, 36.0, 30.0, 577.0, 40.0), (1, 5, "heading", "Head", 1, 36.0, 50.0, 577.0, 60.0)]
    prof = spark.createDataFrame([(1, 36.0, 577.0, 0.0, False)], "doc_id long, body_left double, body_right double, paragraph_indent double, breaks_hyphenate boolean")
    opens = spark.createDataFrame([(1, 4)], "doc_id long, ord long")
    elements = spark.createDataFrame(rows, cols)
    got = st.join_wrapped_lines(elements, prof, opens, st.vocabulary(elements.select("doc_id", F.col("text").alias("line")))).orderBy("ord").collect()
    assert [(r["text"], r["page_end"]) for r in got] == [
        ("starts here and goes on", None), ("a new one over the page", 1), ("7. Clause", None), ("Head", None)]


def test_grids(spark):
    df = spark.createDataFrame([([["a", "", "b "], ["", "", ""], ["c|d", ""]],), ([],)], "g array<array<string>>")
    got = df.select(st.compact_grid(F.col("g")).alias("c"), st.grid_is_valid(st.compact_grid(F.col("g"))).alias("ok"),
                    st.markdown(st.compact_grid(F.col("g"))).alias("m")).collect()
    assert got[0]["c"] == [["a", "b"], ["c|d", ""]] and got[0]["ok"] and got[0]["m"] == "|a|b|\n|---|---|\n|c\\|d||"
    assert got[1]["c"] == [] and not got[1]["ok"] and got[1]["m"] == ""


def test_stitched_over_three_pages(spark):
    h, t = [["Ref", "Text"]], "doc_id long, ord long, page long, y0 double, y1 double, page_height double, rows array<array<string>>, quality string, breaks_before int"
    rows = [(1, 0, 0, 500.0, 780.0, 800.0, h + [["1", "a"]], "ruled", 0), (1, 1, 1, 20.0, 780.0, 800.0, [["ref ", "TEXT"], ["2", "b"]], "recovered", 0),
            (1, 2, 2, 20.0, 200.0, 800.0, h + [["3", "c"]], "ruled", 0), (1, 3, 3, 20.0, 200.0, 800.0, h + [["4", "d"]], "ruled", 1)]
    got = st.stitch_tables(spark.createDataFrame(rows, t)).orderBy("page").collect()
    assert [(r["page"], r["page_end"], r["quality"], len(r["rows"])) for r in got] == [(0, 2, "recovered", 4), (3, None, "ruled", 2)]
