"""Structured logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields every record carries; anything else is an extra.
FIELDS = ("ts", "level", "logger", "msg", "trace_id", "span_id", "parent_span_id", "run_id")


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Named fields as columns and free extras as a map; an unreadable line is dropped
    into ``bad`` with everything else NULL."""
    bag = F.from_json(column, "map<string,string>")
    named = F.array(*[F.lit(f) for f in FIELDS])
    parsed = lines.withColumn("_bag", F.when(F.col(column).rlike(r"^\s*\{"), bag))
    return parsed.select(
        *[c for c in lines.columns if c != column],
        *[F.try_element_at("_bag", F.lit(f)).alias(f) for f in FIELDS],
        F.map_filter("_bag", lambda k, v: ~F.array_contains(named, k)).alias("extras"),
        F.when(F.col("_bag").isNull(), F.col(column)).alias("bad"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def stream_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of rotated log files as a stream; files are never tailed in place."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_log_lines(reader.load(path))
