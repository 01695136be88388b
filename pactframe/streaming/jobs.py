"""Streams of spans, samples, lifecycle and progress events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sink import KeyedTable, newest

# Attributes of a span that have columns of their own.
PROMOTED = {"surface": "string", "criterion": "string", "document_id": "bigint", "model": "string",
            "input_tokens": "bigint", "output_tokens": "bigint", "cost_usd": "double"}
SPAN_END = "span.end"
# Run statuses by what may still happen to them.
LIVE = ("queued", "running")
OVERWRITES = ("running", "done", "cancelled", "state")
CLOSES = ("failed", "interrupted")


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """One of the given tables as a file stream, be it one file or a folder of part files.

    A stream's path has to be a folder or a pattern; the pattern here names the
    table alone, whichever of the two it is.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return folder_stream(spark, f"{folder}/{name}.parque[t]", schema, files_per_batch)


def folder_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files under a folder or pattern, all there are or a bounded number of them per micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def span_rows(records: DataFrame) -> DataFrame:
    """Finished spans of parsed log records: promoted columns, the rest as JSON.

    A value of the wrong type costs that value and not the row.
    """
    bag = F.col("extras")
    own = F.array(*[F.lit(c) for c in (*PROMOTED, "span", "status", "latency_ms")])
    rest = F.map_filter(bag, lambda k, v: ~F.array_contains(own, k))

    def attr(name: str, kind: str = "string") -> Column:
        return F.try_element_at(bag, F.lit(name)).try_cast(kind).alias(name)

    return records.where(F.col("msg") == SPAN_END).select(
        "span_id", "parent_span_id", "trace_id", "run_id", F.coalesce(F.try_element_at(bag, F.lit("span")), F.col("logger")).alias("name"),
        attr("status"), attr("latency_ms", "double"), F.col("ts").try_cast("timestamp").alias("ts"),
        *[attr(n, kind) for n, kind in PROMOTED.items()],
        F.when(F.size(rest) > 0, F.to_json(rest)).alias("attrs"))


def intake_counts(records: DataFrame) -> DataFrame:
    """Rows kept and rows that were not readable; nothing is dropped unseen."""
    return records.select(F.when(F.col("bad").isNull(), "written").otherwise("unreadable").alias("outcome"))


def sliding_counts(spans: DataFrame, size: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Live view: calls and errors per name in sliding windows, of a table or a micro-batch.

    The counts of a micro-batch are partial sums: written under its batch id and
    added up by ``KeyedTable.read_sums``, they need no watermark and lose no row.
    """
    timed = spans.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.window("ts", size, step).alias("w"), "name").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "error", 1)).alias("errors")
    ).select(F.col("w.start").alias("start"), "name", "n", "errors")


def tumbling_counts(spans: DataFrame, size: str) -> DataFrame:
    """Rows and values per tumbling window, of a table or a micro-batch; partial sums like ``sliding_counts``."""
    timed = spans.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.window("ts", size).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "n", "value")


def partial_sums(table: KeyedTable, count: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the counts of each micro-batch, under its own id."""
    return lambda batch, batch_id: table.write_batch(count(batch), batch_id)


# -- lifecycle --------------------------------------------------------------


def fold_lifecycle(events: DataFrame) -> DataFrame:
    """The current row of every run after its events, in ``seq`` order.

    ``queued`` and ``running`` create a row; ``running``, ``done`` and
    ``cancelled`` overwrite the status; ``failed`` and ``interrupted`` close a
    row only while it is live. The first surface stays, as does the first
    non-empty file name and the last known trace. ``state`` is an earlier
    result of this function, so the fold can go on from a stored row. Written
    as aggregates and joins to one row per run: a run with very many events is
    combined on the map side, never collected.
    """
    key = "analysis_id"
    event, seq = F.col("event"), F.col("seq")
    born = events.where(event.isin("queued", "running", "state")).groupBy(key).agg(F.min("seq").alias("_born"))
    alive = events.join(born, key).where(seq >= F.col("_born"))
    makes = event.isin("queued", "running", "state")
    status = F.when(event == "state", F.col("status")).otherwise(event)
    name, trace = F.coalesce("filename", F.lit("")), F.col("trace_id")
    head = alive.groupBy(key).agg(
        F.max_by(F.struct("seq", status.alias("status"), "ts"), F.when(event.isin(*OVERWRITES), seq)).alias("_last"),
        F.min_by(F.struct(F.coalesce("created_at", "ts").alias("ts"), "surface"), F.when(makes, seq)).alias("_first"),
        F.min_by(name, F.when(makes & (name != ""), seq)).alias("filename"),
        F.max_by("trace_id", F.when(makes & trace.isNotNull(), seq)).alias("trace_id"),
        F.max(F.when(event == "running", F.col("ts")).otherwise(F.col("started_at"))).alias("started_at"),
        F.max_by("error", F.when(event == "state", seq)).alias("_error"),
        F.max_by("completed_at", F.when(event == "state", seq)).alias("_completed"))
    base = head.withColumns({
        "_status": F.coalesce("_last.status", F.lit("queued")), "_at": F.coalesce("_last.seq", F.lit(-1).cast("long"))})
    open_ = base.where(F.col("_status").isin(*LIVE)).select(key, "_at")
    closing = (
        events.where(event.isin(*CLOSES)).join(born, key).where(seq >= F.col("_born")).join(open_, key).where(seq > F.col("_at"))
        .groupBy(key).agg(F.min_by(F.struct("event", "ts", "error"), "seq").alias("_close")))
    done = base.join(closing, key, "left")
    closed, ended = F.col("_close").isNotNull(), ~F.col("_status").isin(*LIVE)
    return done.select(
        key, F.when(closed, F.col("_close.event")).otherwise(F.col("_status")).alias("status"),
        F.col("_first.surface").alias("surface"), F.coalesce("filename", F.lit("")).alias("filename"), "trace_id",
        F.col("_first.ts").alias("created_at"), "started_at",
        F.when(closed, F.col("_close.ts")).when(ended, F.coalesce("_completed", F.col("_last.ts"))).alias("completed_at"),
        F.when(closed, F.col("_close.error")).when(ended, F.col("_error")).alias("error"))


def as_state(rows: DataFrame) -> DataFrame:
    """Stored rows as the opening event of the next fold."""
    return rows.select(
        "analysis_id", F.lit(-1).cast("long").alias("seq"), F.lit("state").alias("event"), F.col("created_at").alias("ts"),
        "surface", "filename", "trace_id", "error", "status", "created_at", "started_at", "completed_at")


def as_events(events: DataFrame) -> DataFrame:
    """Plain events (analysis_id, seq, ts, event, surface, filename, trace_id, error) with empty state columns."""
    ts = events.schema["ts"].dataType
    return events.select(
        "analysis_id", F.col("seq").cast("long").alias("seq"), "event", "ts", "surface", "filename", "trace_id", "error",
        F.lit(None).cast("string").alias("status"), *[F.lit(None).cast(ts).alias(c) for c in ("created_at", "started_at", "completed_at")])


def read_lifecycle(table: KeyedTable) -> DataFrame:
    """The current row of every run from the events a stream has landed.

    Micro-batches only append their events, under their own ids. The fold runs
    once, on reading, over all of them: no batch looks at stored rows, and an
    event that arrives after later ones still takes its place.
    """
    rows = table.batches()
    once = newest(rows, ["analysis_id", "seq", "event"], ["batch_id"]).drop("batch_id")
    return fold_lifecycle(as_events(once))


def reconcile(runs: DataFrame, now: Column) -> DataFrame:
    """Runs a dead process left open are closed as interrupted."""
    live = F.col("status").isin(*LIVE)
    return runs.withColumns({
        "completed_at": F.when(live, now).otherwise(F.col("completed_at")),
        "status": F.when(live, "interrupted").otherwise(F.col("status"))})


def criterion_progress(events: DataFrame) -> DataFrame:
    """Latest stage and outcome per (run, criterion), of a table or a micro-batch.

    The rows of a micro-batch are partial states: ``merged_progress`` folds
    those of all batches in any order, so no run stays in a state store and an event
    that comes long after its run ended still counts.
    """
    at = F.struct("seq")
    return events.groupBy("run_id", "criterion").agg(
        F.max(F.when(F.col("type") == "result", 2).when(F.col("type") == "skipped", 1).otherwise(0)).alias("outcome"),
        F.max_by("type", at).alias("stage"), F.max("seq").alias("seq"))


def merged_progress(parts: DataFrame) -> DataFrame:
    """Partial states of (run, criterion) as one state each."""
    return parts.groupBy("run_id", "criterion").agg(
        F.max("outcome").alias("outcome"), F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))


def run_progress(criteria: DataFrame) -> DataFrame:
    """Done and skipped of all criteria seen, and the newest stage of each run."""
    return criteria.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("outcome") == 2, 1)).alias("done"),
        F.count(F.when(F.col("outcome") == 1, 1)).alias("skipped"), F.max_by("stage", "seq").alias("stage"))
