"""Confidence, decisions, lifecycle, keyed tables and sources."""

import json

import pytest
from pyspark.sql import functions as F

from pactframe.operators import assess, spans
from pactframe.sources.criteria import read_criteria
from pactframe.sources.files import list_files, read_files
from pactframe.sources.logs import read_log
from pactframe.sources.tables import CorpusTables, RowCountMismatch
from pactframe.streaming import jobs
from pactframe.streaming.sink import KeyedTable, run_to_end


@pytest.mark.parametrize("raw,verified,claimed,nd,review,ended,critic,support,agreed,want", [
    (0.9, 3, 3, 0, False, "model", None, None, True, 0.9), (0.9, 0, 0, 0, False, "model", None, None, True, 0.9),
    (0.9, 2, 3, 0, False, "model", None, None, True, 0.6), (1.4, 3, 3, 0, False, "model", None, None, True, 0.95),
    (0.9, 3, 3, 0, True, "model", None, None, True, 0.5), (0.9, 3, 3, 0, False, "cap", None, None, True, 0.5),
    (0.9, 0, 3, 0, False, "model", None, None, True, 0.05), (0.9, 0, 3, 0, False, "model", 0.8, 1.0, True, 0.8),
    (0.8, 3, 3, 2, False, "model", 0.9, 1.0, False, 0.24)])
def test_confidence(spark, raw, verified, claimed, nd, review, ended, critic, support, agreed, want):
    row = spark.createDataFrame([(raw, verified, claimed, nd, review, ended, critic, support, agreed)],
                                "raw double, v int, c int, nd int, r boolean, e string, critic double, s double, a boolean")
    got = row.withColumns(assess.confidence(
        F.col("raw"), verified=F.col("v"), claimed=F.col("c"), not_determined=F.col("nd"), total=F.lit(4), needs_review=F.col("r"),
        ended_by=F.col("e"), critic=F.col("critic"), support=F.col("s"), agreed=F.col("a"))).first()
    assert got["confidence"] == want
    assert ("critic" in got["components"]) == (critic is not None)


def test_decisions(spark):
    key = "run_id long, criterion_id int, round int"
    f = spark.createDataFrame([(1, 1, 0, "agree", .9), (2, 1, 0, "disagree", .9), (3, 1, 1, "agree", .9), (4, 1, 0, "agree", .9)], key + ", state_agreement string, critic_confidence double")
    s = spark.createDataFrame([(3, 1, 1, 0, 0, "a", "irrelevant"), (4, 1, 0, 0, 0, "a", "contradicts")], key + ", pos int, quote_index int, sub_id string, support string")
    a = spark.createDataFrame([(4, 1, 0, 0, "a", "too_strong")], key + ", pos int, sub_id string, agreement string")
    m = spark.createDataFrame([(4, 1, 0, 0, "b")], key + ", pos int, sub_id string")
    got = {r["run_id"]: (r["verdict"], r["mode"], r["reasons"]) for r in assess.decide(f, s, a, m).collect()}
    assert got == {1: ("accept", None, []), 2: ("revise", "redraft", ["state_disagreement"]), 3: ("fallback", None, ["quote_irrelevant"]),
                   4: ("revise", "research", ["quote_contradicts", "status_too_strong", "unsearched_requirement"])}
    assert assess.instructions(s, a).count() == 3


def test_distinctive_terms_fall_back(spark):
    rows = [("c", "vault", "Vaulting of passwords", "Password rules"), ("c", "rot", "Rotation of passwords", "Password rules"),
            ("d", "x", "Same words", ""), ("d", "y", "Same words", "")]
    df = spark.createDataFrame(rows, "criterion_id string, sub_id string, requirement string, criterion_requirement string")
    got = {r["sub_id"]: r["terms"] for r in assess.distinctive_terms(df).collect()}
    assert got == {"vault": ["vault"], "rot": ["rotat"], "x": ["same", "word"], "y": ["same", "word"]}


def test_tree_of_a_deep_chain(spark):
    rows = [("r", i, i - 1 if i else None) for i in range(70)] + [("r", 100, 100), ("r", 101, 999), ("q", 5, 4), ("r", 200, 201), ("r", 201, 200)]
    df = spark.createDataFrame(rows, "run_id string, span_id long, parent_span_id long")
    got = {(r["run_id"], r["span_id"]): (r["root_span_id"], r["depth"]) for r in spans.span_tree(df).collect()}
    assert got[("r", 69)] == (0, 69) and got[("r", 100)] == (100, 0) and got[("r", 101)] == (101, 0) and got[("q", 5)] == (5, 0)
    assert ("r", 200) not in got and len(got) == 73


EVENTS = [  # (analysis, seq, event, surface, filename, trace, error)
    ("a", 0, "queued", "ui", "", "t1", None), ("a", 1, "running", "cli", "f.pdf", None, None), ("a", 2, "done", None, None, None, None), ("a", 3, "failed", None, None, None, "late"),
    ("b", 0, "running", "cli", "g.pdf", "t2", None), ("b", 1, "failed", None, None, None, "boom"), ("b", 2, "interrupted", None, None, None, None),
    ("c", 0, "queued", "api", "h.pdf", None, None), ("c", 1, "interrupted", None, None, None, None), ("c", 2, "running", "cli", "x.pdf", "t3", None),
    ("d", 0, "failed", None, None, None, "no row"), ("e", 0, "done", None, None, None, None), ("e", 1, "queued", "mcp", "i.pdf", None, None)]
WANT = {"a": ("done", "ui", "f.pdf", "t1", None), "b": ("failed", "cli", "g.pdf", "t2", "boom"), "c": ("running", "api", "h.pdf", "t3", None),
        "e": ("queued", "mcp", "i.pdf", None, None)}


def _events(spark, rows):
    df = spark.createDataFrame(rows, "analysis_id string, seq long, event string, surface string, filename string, trace_id string, error string")
    return df.withColumn("ts", F.timestamp_seconds("seq"))


def _state(df):
    return {r["analysis_id"]: (r["status"], r["surface"], r["filename"], r["trace_id"], r["error"]) for r in df.collect()}


def test_lifecycle(spark):
    assert _state(jobs.fold_lifecycle(jobs.as_events(_events(spark, EVENTS)))) == WANT


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_lifecycle_goes_on_from_stored_rows(spark, cut):
    folded = jobs.fold_lifecycle(jobs.as_events(_events(spark, [e for e in EVENTS if e[1] < cut])))
    first = spark.createDataFrame(folded.collect(), folded.schema)  # the stored table
    rest = jobs.as_events(_events(spark, [e for e in EVENTS if e[1] >= cut])).unionByName(jobs.as_state(first))
    assert _state(jobs.fold_lifecycle(rest)) == WANT


def test_keyed_table_replay(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], [])
    batch = lambda rows: spark.createDataFrame(rows, "k int, v string")
    table.write_batch(batch([(1, "a"), (2, "b")]), 0)
    table.write_batch(batch([(2, "c")]), 1)
    table.write_batch(batch([(2, "c")]), 1)
    assert {r["k"]: r["v"] for r in table.read().collect()} == {1: "a", 2: "c"}
    assert table.compact(str(tmp_path / "one")).count() == 2


def test_newest_row_wins_whatever_the_batch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], ["seq"])
    batch = lambda rows: spark.createDataFrame(rows, "k int, seq int, v string")
    table.write_batch(batch([(1, 9, "new")]), 0)
    table.write_batch(batch([(1, 3, "old"), (2, 1, "only")]), 1)
    assert {r["k"]: r["v"] for r in table.read().collect()} == {1: "new", 2: "only"}


def test_an_old_file_last_loses_no_row(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("n").alias("name"), F.lit("ok").alias("status"), F.lit(1.0).alias("value"))
    for part in (3, 2, 1, 0):  # the newest hundred rows come first
        rows.where(F.floor(F.unix_timestamp("ts") / 60000) == part).coalesce(1).write.mode("append").parquet(folder)
    for keys, count in ((["start"], lambda b: jobs.tumbling_counts(b, "6 hours")), (["start", "name"], lambda b: jobs.sliding_counts(b, "5 minutes", "5 minutes"))):
        table = KeyedTable(spark, str(tmp_path / f"out{len(keys)}"), keys, [])
        run_to_end(jobs.folder_stream(spark, folder, rows.schema, 1), table, each=jobs.partial_sums(table, count))
        assert table.batches().select("batch_id").distinct().count() == 4
        assert table.read_sums().agg(F.sum("n")).first()[0] == 400


def test_lifecycle_events_in_any_order_of_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["analysis_id"], [])
    for batch_id, seq in enumerate((3, 1, 0, 2, 2)):  # the last batch is delivered again
        table.write_batch(_events(spark, [e for e in EVENTS if e[1] == seq] or EVENTS[:1]), batch_id)
    assert _state(jobs.read_lifecycle(table)) == WANT


def test_a_load_replaces_documents_in_all_tables(spark, tmp_path):
    tables = CorpusTables(spark, str(tmp_path), buckets=4)
    docs = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "document_id long, path string")
    lines = lambda rows: spark.createDataFrame(rows, "document_id long, line string")
    tables.create({"documents": docs, "chunks": lines([(i, "x") for i in range(40)]), "vectors": lines([(i, "v") for i in range(40)])})
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    change = docs.where("document_id = 7").withColumn("path", F.lit("new"))
    fresh = {"documents": change, "chunks": lines([(7, "a"), (7, "b")]), "vectors": lines([(7, "c")])}
    with pytest.raises(RowCountMismatch, match="7"):
        tables.load(fresh, change, paired=("chunks", "vectors"))
    assert {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")} == before
    fresh["vectors"] = lines([(7, "c"), (7, "d")])
    for _ in range(2):  # a load that is run again changes nothing more
        assert tables.load(fresh, change, paired=("chunks", "vectors")) == {"documents": 1, "chunks": 2, "vectors": 2}
        assert sorted(map(tuple, tables.read("documents").collect())) == [(i, "new" if i == 7 else f"p{i}") for i in range(40)]
        assert sorted(r.line for r in tables.read("chunks").where("document_id = 7").collect()) == ["a", "b"]
        assert tables.read("vectors").count() == 41
    left = [f for f in before if f.exists()]
    assert len(left) == len(before) * 3 // 4  # one bucket of four was written
    everything = docs.select("document_id")
    tables.load({n: tables.read(n).limit(0) for n in ("documents", "chunks", "vectors")}, everything)
    assert all(tables.read(n).count() == 0 for n in ("documents", "chunks", "vectors"))
    tables.load({n: f for n, f in fresh.items()}, everything)
    assert tables.read("chunks").count() == 2


def test_files_logs_criteria(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"one")
    (tmp_path / "in" / "deep" / "b.PDF").write_bytes(b"two")
    (tmp_path / "in" / "c.doc").write_bytes(b"no")
    root = str(tmp_path / "in")
    assert list_files(spark, [root, root], [".pdf"]).count() == 2
    assert read_files(spark, [root], [".pdf"]).select("content_hash").distinct().count() == 2
    (tmp_path / "log.jsonl").write_text('{"msg": "span.end", "span_id": "s", "x": 1}\nbroken\n')
    rows = read_log(spark, str(tmp_path / "log.jsonl")).orderBy("span_id").collect()
    assert rows[0]["bad"] == "broken" and rows[1]["extras"] == {"x": "1"}
    item = {"id": "c1", "compliance_requirement": "R", "description": "Q?", "sub_requirements": [{"id": "a", "requirement": "x"}], "compliance_state_options": []}
    (tmp_path / "ok.json").write_text(json.dumps([item]))
    assert read_criteria(spark, str(tmp_path / "ok.json")).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps([{**item, "sub_requirements": item["sub_requirements"] * 2}]))
    with pytest.raises(ValueError):
        read_criteria(spark, str(tmp_path / "bad.json"))


def test_distinctive_terms_join_nothing(spark):
    """Counts alone tell a criterion's own terms; exploded terms are shuffled once."""
    df = spark.createDataFrame([("c", "a", "green paint", "paint"), ("c", "b", "green door", ""), ("d", "a", None, None)],
                               "criterion_id string, sub_id string, requirement string, criterion_requirement string")
    found = assess.distinctive_terms(df)
    assert "Join " not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.criterion_id, r.sub_id): r.terms for r in found.collect()}[("c", "b")] == ["door"]
