"""Small tests for the findings of the fourth look."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pactframe.operators import assess, embed, ordered
from pactframe.operators import retrieval as rt
from pactframe.operators import structure as st
from pactframe.plans import load
from pactframe.plans.registry import PLANS, Source
from pactframe.session import SHUFFLE_CLEANUP, materialize


def _exchanged(df):
    """The column lists of the shuffles in a plan, as Spark prints them."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in line or "Window" in line]


def test_only_the_ends_of_lines_are_put_in_order(spark):
    lines = spark.createDataFrame([(1, 0, "a long text that is co-"), (1, 1, "lour all over"), (1, 2, "x-"), (2, 0, "y")], "doc_id long, line_no long, line string")
    breaks = st.line_breaks(lines, ["doc_id"])
    assert [(r.doc_id, r.line_no, r.head, r.tail) for r in breaks.collect()] == [(1, 0, "co", "lour")]
    window = next(line for line in _exchanged(breaks) if "Window" in line)
    assert "line#" not in window and "_opens#" in window, window


def test_vocabulary_leaves_a_task_as_one_row_a_document(spark):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choice(["a", "b-c", "B", "dd-e-f", "gg", "--", "1x"]) for _ in range(rng.randrange(0, 9)))) for d in range(20) for _ in range(30)]
    lines = spark.createDataFrame(rows, "doc_id long, line string").repartition(3)
    vocab = st.vocabulary(lines)
    plan = vocab._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "known#" in next(line for line in plan.splitlines() if "MapInArrow counts" in line or "RepartitionByExpression" in line or "known#" in line)
    got = {(r.doc_id, r.word): (r.n, r.hyphenated) for r in vocab.collect()}
    once = lines.select("doc_id", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).groupBy("doc_id", "word").count()
    twice = lines.select("doc_id", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+(?:-[a-z0-9]+)+"), F.lit(0))).alias("word")).groupBy("doc_id", "word").count()
    assert got == {(r.doc_id, r.word): (r["count"], 0) for r in once.collect()} | {(r.doc_id, r.word): (0, r["count"]) for r in twice.collect()}


def test_facts_come_in_front_of_the_rows_of_their_key(spark):
    rows = spark.createDataFrame([(d, b, i) for d in (1, 2, None, 3) for b in range(3) for i in range(40)], "d long, b long, i long").repartition(5)
    facts = spark.createDataFrame([(1, 10), (1, 5), (3, 7), (9, 99)], "d long, add long")

    def step(state, i):
        state[0] += i
        return (state[0],)

    got = ordered.stepwise(rows, ["d", "b"], ["i"], ["i"], lambda known: [sum(k for k, in known)], step, {"total": "long"}, facts).collect()
    assert {(r.d, r.b, r.i): r.total for r in got} == {(d, b, i): {1: 15, 3: 7}.get(d, 0) + i * (i + 1) // 2 for d in (1, 2, None, 3) for b in range(3) for i in range(40)}
    assert len(got) == 480


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_texts_are_not_joined_to_the_words_of_their_document(spark):
    lines = spark.createDataFrame([(1, 0, 0, "re-"), (1, 0, 1, "use it"), (2, 0, 0, "a-"), (2, 1, 0, "b")], "doc_id long, block long, line_no long, line string")
    vocab = st.vocabulary(lines)
    habits = spark.createDataFrame([(1, True)], "doc_id long, breaks_hyphenate boolean")
    got = st.join_lines(lines, vocab, habits)
    assert _joins(got) == 0 and {(r.doc_id, r.block): r.text for r in got.collect()} == {(1, 0): "reuse it", (2, 0): "a-", (2, 1): "b"}
    cols = "doc_id long, ord long, type string, text string, page long, x0 double, y0 double, x1 double, y1 double"
    elements = spark.createDataFrame([(1, i, "paragraph", t, 0, x, 10.0 * i, 577.0, 10.0 * i + 8) for i, (t, x) in enumerate(
        [("one  re- ", 36.0), ("use", 36.0), ("4. new", 36.0), ("far", None), ("in", 50.0)])] + [(7, 0, "paragraph", "no profile", 0, 36.0, 0.0, 577.0, 8.0)], cols)
    prof = spark.createDataFrame([(1, 36.0, 577.0, 0.0, True)], "doc_id long, body_left double, body_right double, paragraph_indent double, breaks_hyphenate boolean")
    opens = spark.createDataFrame([(1, 2)], "doc_id long, ord long")
    joined = st.join_wrapped_lines(elements, prof, opens, vocab)
    assert _joins(joined) == 0
    assert [(r.ord, r.text) for r in joined.orderBy("ord").collect()] == [(0, "one re- use"), (2, "4. new"), (3, "far"), (4, "in")]


def test_words_of_a_corpus_are_cut_once_and_put_together_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(rt, "WORDS_HELD", 3)
    texts = ["One two one", None, "", "Élan two-three", "three, FOUR five 6", "one " * 50]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(3)
    words = rt.distinct_words(chunks)
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("regexp_extract_all") == 1, plan
    assert sorted(r.word for r in words.collect()) == ["6", "elan", "five", "four", "one", "three", "two"]


def test_modes_share_the_vectors_of_the_chunks(spark, monkeypatch):
    load()
    made, real = [], embed.hashed_vectors

    def counted(texts, key, *rest):
        made.append(key)
        return real(texts, key, *rest)

    monkeypatch.setattr(embed, "hashed_vectors", counted)
    out = PLANS["r9_modes"](Source(spark, "/root/testdata/sf0.001"))
    assert sorted(made) == ["chunk_id", "query_id"]
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
    return {f for f in files if "/shuffle_" in f}


def test_a_written_table_gives_its_shuffle_files_back(spark):
    counts = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 700).alias("k")).count()
    before, setting = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    stored = materialize(counts, "counts")
    assert not _shuffle_files(spark) - before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert stored.count() == 700 and counts.count() == 700


def test_checked_quotes_go_to_their_run_without_their_texts(spark):
    evidence = spark.createDataFrame([(1, "E1", "The Supplier  shall deliver"), (2, "E1", "x")], "run_id long, evidence_id string, text string")
    quotes = spark.createDataFrame(
        [(1, 0, 0, "E1", "the supplier shall"), (1, 0, 1, "E1", "The  supplier shall"), (1, 0, 2, "E1", "  "), (1, 0, 3, "E9", "shall"), (1, 1, 0, "E1", "deliver" * 50), (2, 0, 0, "E1", None)],
        "run_id long, criterion_id int, idx int, evidence_id string, text string")
    drafts = spark.createDataFrame([(1, 0, "Q", "Non-Compliant", "r", 0.5)], "run_id long, criterion_id int, question string, state string, rationale string, raw_confidence double")
    subs = spark.createDataFrame([(1, 0, 0, "s0", "missing", [])], "run_id long, criterion_id int, pos int, sub_id string, status string, quote_indexes array<int>")
    criteria = spark.createDataFrame([(0, "Q", ["s0"])], "criterion_id int, question string, sub_ids array<string>")
    errors = assess.validate_structure(drafts, quotes, subs, evidence, criteria)
    assert "_passage" not in errors._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.run_id, r.criterion_id, r.path, r.code) for r in errors.collect()} == {
        (1, 0, "relevant_quotes[1]", "duplicate"), (1, 0, "relevant_quotes[2].text", "not_verbatim"), (1, 0, "relevant_quotes[2].text", "empty"),
        (1, 0, "relevant_quotes[3].evidence_id", "unknown_evidence"), (1, 1, "relevant_quotes[0].text", "not_verbatim"), (1, 1, "relevant_quotes[0].text", "too_long"),
        (2, 0, "relevant_quotes[0].text", "not_verbatim")}
    kept = assess.keep_quotes(quotes, errors, evidence)
    assert [(r.run_id, r.criterion_id, r.idx, r.new_idx, r.verified) for r in kept.collect()] == [(1, 0, 0, 0, True)]
