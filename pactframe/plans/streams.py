"""Streaming queries; each is compared with the SQL of its batch twin."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..session import work_dir
from ..sources.follow import opened, stream_growing
from ..sources.logs import parse_log_lines, stream_log
from ..streaming import jobs
from ..streaming.sink import KeyedTable, run_to_end
from . import oracle as o
from .registry import plan


def _table(src, name: str, keys: list[str], order: list[str]) -> KeyedTable:
    return KeyedTable(src.spark, work_dir(src.spark, name), keys, order)


def _records(events):
    """Events as the log lines a process would write."""
    key = F.col("event_id")
    line = F.to_json(F.struct(
        F.col("ts").cast("string").alias("ts"), F.lit("INFO").alias("level"), F.lit("app").alias("logger"),
        F.when(key % 3 == 0, "span.start").otherwise("span.end").alias("msg"),
        key.cast("string").alias("span_id"), (key % 64).cast("string").alias("run_id"), F.col("event_type").alias("span"),
        F.when(key % 7 == 0, "error").otherwise("ok").alias("status"), F.when(key % 10 == 0, "fast").otherwise(F.col("value").cast("string")).alias("latency_ms"),
        F.when(key % 4 == 0, "many").otherwise((key % 90).cast("string")).alias("input_tokens"), F.col("props").alias("note")))
    return events.select(key.alias("event_id"), F.when(key % 50 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value"))


@plan("t1_span_stream", sql="""
SELECT CAST(event_id AS STRING) AS span_id, event_type AS name, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_id % 10 <> 0 THEN value END AS latency_ms, CASE WHEN event_id % 4 <> 0 THEN event_id % 90 END AS input_tokens,
  concat('{"note":"', replace(props, '"', '\\"'), '"}') AS attrs FROM @events WHERE event_id % 3 <> 0 AND event_id % 50 <> 0""")
def t1(src):
    lines = _records(jobs.table_stream(src.spark, src.folder, "events"))
    rows = jobs.span_rows(parse_log_lines(lines))
    table = run_to_end(rows, _table(src, "spans", ["span_id"], ["ts"]))
    return table.read().select("span_id", "name", "status", "latency_ms", "input_tokens", "attrs")


def _cut(src, df, name: str, parts: int = 4):
    """A table written as several files, then read as a stream of small batches."""
    folder = work_dir(src.spark, name)
    df.repartition(parts).write.parquet(folder)
    return jobs.folder_stream(src.spark, folder, df.schema, 2)


def _newest_first(src, df, table, count, parts: int = 6):
    """Land a table slice by slice of its time, the newest first, as one resumed stream.

    Every slice is written by as many tasks as it has input for, and is one
    micro-batch of many files.
    """
    folder = work_dir(src.spark, "slices")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    step = ((high or 0) - (low or 0)) // parts + 1
    for part in reversed(range(parts)):
        df.where(F.floor((ts - F.lit(low)) / step) == part).write.parquet(f"{folder}/slice-{part}")
        run_to_end(jobs.folder_stream(src.spark, f"{folder}/*", df.schema), table, each=jobs.partial_sums(table, count))
    return table


@plan("t2_keyed_replace", sql="""
SELECT span_id, seq, value FROM (SELECT CAST((event_id - event_id % 3) / 3 AS BIGINT) AS span_id, event_id AS seq, value FROM @events)
 QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY seq DESC) = 1""")
def t2(src):
    key = F.col("event_id")
    rows = src.table("events").select(((key - key % 3) / 3).cast("long").alias("span_id"), key.alias("seq"), "value")
    table = _table(src, "replayed", ["span_id"], ["seq"])
    run_to_end(_cut(src, rows, "cut"), table)
    return table.read().select("span_id", "seq", "value")


@plan("t3_intake_counts", sql="""
SELECT CASE WHEN event_id % 50 = 0 THEN 'unreadable' ELSE 'written' END AS outcome, count(*) AS n FROM @events GROUP BY 1""")
def t3(src):
    lines = _records(src.table("events"))
    counts = jobs.intake_counts(parse_log_lines(_cut(src, lines, "lines"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return run_to_end(counts, _table(src, "intake", ["outcome"], ["n"]), "update").read().select("outcome", "n")


@plan("t4_host_samples", sql="""
SELECT minute, rss_mb FROM (SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, seq, rss_mb FROM v_samples) QUALIFY row_number() OVER (PARTITION BY minute ORDER BY seq DESC) = 1""")
def t4(src):
    events = jobs.table_stream(src.spark, src.folder, "events")
    samples = events.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.col("event_id").alias("seq"), F.col("value").alias("rss_mb"))
    return run_to_end(samples, _table(src, "samples", ["minute"], ["seq"])).read().select("minute", "rss_mb")


SPAN = """SELECT ts, CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'agent.tool' ELSE 'other' END AS name, event_id % 7 = 0 AS bad, value FROM @events"""


def _spans(src):
    name = F.when(F.col("event_type") == "view", "retrieve").when(F.col("event_type") == "click", "agent.tool").otherwise("other")
    status = F.when(F.col("event_id") % 7 == 0, "error").otherwise("ok")
    return src.table("events").select("ts", name.alias("name"), status.alias("status"), "value")


@plan("t5_live_windows", sql=f"""
WITH s AS ({SPAN}), w AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS i FROM s)
SELECT strftime(make_timestamp((epoch_us(ts) // 60000000 - i) * 60000000), {o.LABEL}) AS start, name, count(*) AS n, count(*) FILTER (bad) AS errors FROM w GROUP BY 1, 2""")
def t5(src):
    table = _newest_first(src, _spans(src), _table(src, "live", ["start", "name"], []), jobs.sliding_counts)
    return table.read_sums().select(F.date_format("start", tl.LABEL).alias("start"), "name", "n", "errors")


@plan("t6_tumbling", sql=f"SELECT {o.bucket('ts', '6h')} AS start, count(*) AS n, round(sum(value), 4) AS value FROM @events GROUP BY 1")
def t6(src):
    table = _newest_first(src, _spans(src), _table(src, "tumbling", ["start"], []), lambda batch: jobs.tumbling_counts(batch, "6 hours"))
    return table.read_sums().select(F.date_format("start", tl.LABEL).alias("start"), "n", F.round("value", 4).alias("value"))


def _lifecycle(src):
    """Up to five events per order: queued, running, an end, late failures."""
    o_ = src.table("orders")
    k = F.col("o_orderkey")
    kinds = F.array_compact(F.array(
        F.when(k % 4 != 0, "queued"), F.when(k % 11 != 0, "running"),
        F.when(k % 5 == 0, "failed").when(k % 5 == 1, "cancelled").when(k % 5 < 4, "done"),
        F.when(k % 3 == 0, "failed").when(k % 7 == 0, "interrupted"), F.when(k % 13 == 0, "running")))
    rows = o_.select("o_orderkey", "o_orderdate", "o_orderpriority", F.posexplode(kinds).alias("pos", "event"))
    pos = F.col("pos")
    return rows.select(
        F.col("o_orderkey").alias("analysis_id"), pos.cast("long").alias("seq"), F.timestamp_add("HOUR", pos, F.col("o_orderdate").cast("timestamp")).alias("ts"), "event",
        F.when(F.col("event") == "queued", F.col("o_orderpriority")).otherwise("cli").alias("surface"),
        F.when((F.col("o_orderkey") % 2 == 0) & (pos == 0), "").otherwise(F.concat(F.lit("f"), pos.cast("string"))).alias("filename"),
        F.when(pos % 2 == 0, F.concat(F.lit("t"), pos.cast("string"))).alias("trace_id"),
        F.when(F.col("event") == "failed", F.concat(F.lit("e"), pos.cast("string"))).alias("error"))


LIFE = """ev AS (SELECT k, prio, i - 1 AS seq, kinds[i] AS event FROM (SELECT o_orderkey AS k, o_orderpriority AS prio, list_filter([CASE WHEN k % 4 <> 0 THEN 'queued' END, CASE WHEN k % 11 <> 0 THEN 'running' END,
  CASE WHEN k % 5 = 0 THEN 'failed' WHEN k % 5 = 1 THEN 'cancelled' WHEN k % 5 < 4 THEN 'done' END, CASE WHEN k % 3 = 0 THEN 'failed' WHEN k % 7 = 0 THEN 'interrupted' END,
  CASE WHEN k % 13 = 0 THEN 'running' END], lambda x: x IS NOT NULL) AS kinds, unnest(range(1, len(kinds) + 1)) AS i FROM @orders)),
r AS (SELECT k, 0::BIGINT AS seq, CASE WHEN event IN ('queued', 'running') THEN event END AS status, CASE WHEN event = 'queued' THEN prio WHEN event = 'running' THEN 'cli' END AS surface,
   CASE WHEN event IN ('queued', 'running') THEN CASE WHEN k % 2 = 0 THEN '' ELSE 'f0' END END AS filename, CASE WHEN event IN ('queued', 'running') THEN 't0' END AS trace, NULL::VARCHAR AS error FROM ev WHERE seq = 0
 UNION ALL SELECT r.k, r.seq + 1, CASE WHEN event IN ('queued', 'running') THEN event WHEN r.status IS NULL THEN NULL WHEN event IN ('done', 'cancelled') THEN event WHEN r.status IN ('queued', 'running') THEN event ELSE r.status END,
   CASE WHEN r.surface IS NOT NULL THEN r.surface WHEN event = 'queued' THEN prio WHEN event = 'running' THEN 'cli' END,
   CASE WHEN event IN ('queued', 'running') AND coalesce(r.filename, '') = '' THEN concat('f', ev.seq) ELSE r.filename END,
   CASE WHEN event IN ('queued', 'running') AND ev.seq % 2 = 0 THEN concat('t', ev.seq) ELSE r.trace END,
   CASE WHEN event = 'failed' AND r.status IN ('queued', 'running') THEN concat('e', ev.seq) WHEN event IN ('running', 'done', 'cancelled') THEN NULL ELSE r.error END
   FROM r JOIN ev ON ev.k = r.k AND ev.seq = r.seq + 1),
fin AS (SELECT * FROM r WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)"""


@plan("t7_lifecycle", sql=f"WITH RECURSIVE {LIFE} SELECT k AS analysis_id, status, surface, coalesce(filename, '') AS filename, trace AS trace_id, error FROM fin")
def t7(src):
    events = _lifecycle(src)
    # The later events of every run arrive first; each slice is a micro-batch of one resumed stream.
    folder = work_dir(src.spark, "lifecycle")
    table = _table(src, "runs", ["analysis_id"], [])
    for n, part in enumerate(("seq >= 3", "seq = 1", "seq = 2", "seq = 0")):
        events.where(part).write.parquet(f"{folder}/slice-{n}")
        run_to_end(jobs.folder_stream(src.spark, f"{folder}/*", events.schema), table)
    return jobs.read_lifecycle(table).select("analysis_id", "status", "surface", "filename", "trace_id", "error")


@plan("t7_lifecycle_batch", sql=f"WITH RECURSIVE {LIFE} SELECT k AS analysis_id, status, surface, coalesce(filename, '') AS filename, trace AS trace_id, error FROM fin")
def t7_batch(src):
    return jobs.fold_lifecycle(jobs.as_events(_lifecycle(src))).select("analysis_id", "status", "surface", "filename", "trace_id", "error")


@plan("t8_reconcile", sql="""
SELECT CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status, count(*) AS n, count(*) FILTER (status IN ('queued', 'running')) AS closed FROM v_runs GROUP BY 1""")
def t8(src):
    runs = src.view("runs").withColumn("completed_at", F.lit(None).cast("timestamp"))
    closed = jobs.reconcile(runs, F.lit(src.latest(runs, "created_at")).cast("timestamp"))
    return closed.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("completed_at").alias("closed"))


KINDS = "CASE event_type WHEN 'purchase' THEN 'result' WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'evaluating' WHEN 'view' THEN 'revising' ELSE 'decision' END"


@plan("t9_progress", sql=f"""
WITH c AS (SELECT user_id AS run_id, event_id % 5 AS criterion, max(CASE {KINDS} WHEN 'result' THEN 2 WHEN 'skipped' THEN 1 ELSE 0 END) AS outcome, max_by({KINDS}, event_id) AS stage, max(event_id) AS seq FROM @events GROUP BY 1, 2)
SELECT run_id, count(*) AS total, count(*) FILTER (outcome = 2) AS done, count(*) FILTER (outcome = 1) AS skipped, max_by(stage, seq) AS stage FROM c GROUP BY 1""")
def t9(src):
    events = jobs.table_stream(src.spark, src.folder, "events")
    rows = events.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 5).alias("criterion"), F.expr(KINDS).alias("type"), F.col("event_id").alias("seq"))
    table = _table(src, "progress", ["run_id", "criterion"], ["seq"])
    run_to_end(rows, table, each=jobs.partial_sums(table, jobs.criterion_progress))
    return jobs.run_progress(jobs.merged_progress(table.batches()))


@plan("t10_rotated_log", sql="""
SELECT count(*) AS lines, count(*) FILTER (event_id % 50 = 0) AS bad FROM @events""")
def t10(src):
    folder = work_dir(src.spark, "log")
    lines = _records(src.table("events"))
    table = _table(src, "followed", ["span_id"], [])
    for half in (0, 1):
        # The log is rotated: new files appear beside the ones already read.
        lines.where(F.col("event_id") % 2 == half).select("value").write.mode("append").text(folder)
        run_to_end(stream_log(src.spark, folder), table)
    rows = src.spark.read.parquet(table.rows)
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count("bad").alias("bad"))


def _write_logs(lines, folder: str, *thirds: int) -> None:
    """One log file per input partition, holding these thirds of its lines one after the other.

    Files are written whole, so a task that runs again changes nothing.
    """

    def write(batches):
        store, root = opened(folder)
        store.create_dir(root)
        path, n = f"{root}/app-{TaskContext.get().partitionId()}.log", 0
        with store.open_output_stream(f"{path}.new") as out:
            for batch in batches:
                out.write("".join(f"{v}\n" for v in batch.column(0).to_pylist()).encode())
                n += batch.num_rows
        store.move(f"{path}.new", path)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    third = F.col("event_id") % 3
    rows = lines.where(third.isin(*thirds)).sortWithinPartitions(third, "event_id").select("value")
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


@plan("t10_growing_log", sql="""
SELECT CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE event_type END AS span, count(*) AS lines, CAST(sum(CASE WHEN event_id % 50 <> 0 THEN event_id END) AS BIGINT) AS ids FROM @events GROUP BY 1""")
def t10_growing(src):
    folder = work_dir(src.spark, "growing")
    table = _table(src, "grown", ["span_id"], [])
    lines = _records(src.table("events"))
    # Every file grows, then is truncated and starts again.
    for thirds in ((0,), (0, 1), (2,)):
        _write_logs(lines, folder, *thirds)
        run_to_end(parse_log_lines(stream_growing(src.spark, folder)), table)
    span = F.when(F.col("bad").isNotNull(), "bad").otherwise(F.try_element_at("extras", F.lit("span")))
    return table.batches().groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("span_id").cast("long")).alias("ids"))
