"""Windows, buckets and the continuous axis of every chart."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which bucket a window is drawn with.
BUCKETS = {"30m": "1m", "1h": "1m", "24h": "1h", "7d": "6h", "30d": "1d"}
DEFAULT_BUCKET = "1h"
LIVE = "5m"
MAX_HOST_POINTS = 180
LABEL = "yyyy-MM-dd'T'HH:mm:ss'Z'"

_SPEC = re.compile(r"(\d+)([smhd])")
_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(spec: str) -> int:
    """``24h`` as seconds; anything but a positive count and a unit is refused."""
    found = _SPEC.fullmatch(spec.strip().lower())
    if not found or int(found[1]) == 0:
        raise ValueError(f"not a window: {spec!r} (write 24h, 7d, 5m or 30s)")
    return int(found[1]) * _UNIT_SECONDS[found[2]]


def bucket_for(window: str) -> str:
    return BUCKETS.get(window.strip().lower(), DEFAULT_BUCKET)


def host_bucket(window: str, interval_s: float) -> str:
    """Sampler grain, unless the chart would pass 180 points."""
    grain = max(1, round(interval_s))
    return bucket_for(window) if seconds(window) / grain > MAX_HOST_POINTS else f"{grain}s"


def since(window: str, now: datetime) -> datetime:
    return (now - timedelta(seconds=seconds(window))).replace(microsecond=0)


def in_window(df: DataFrame, column: str, window: str, now: datetime) -> DataFrame:
    """Rows at or after the bound; a literal, so it reaches the file scan."""
    return df.where(F.col(column) >= F.lit(since(window, now)))


def epoch(column: Column) -> Column:
    return F.unix_seconds(column.cast("timestamp"))


def label(epoch_s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_s), LABEL)


def bucket_epoch(column: Column, bucket: str) -> Column:
    size = seconds(bucket)
    return F.floor(epoch(column) / size) * size


def bucket_start(column: Column, bucket: str) -> Column:
    """Label of the bucket a timestamp falls in, floored on the epoch."""
    return label(bucket_epoch(column, bucket))


def axis(spark: SparkSession, window: str, bucket: str, now: datetime) -> DataFrame:
    """Every bucket of the window, empty ones included."""
    size = seconds(bucket)
    end = int(now.replace(tzinfo=timezone.utc).timestamp())
    first = (end - seconds(window)) // size * size
    last = end // size * size
    return spark.range(first, last + 1, size, 1).select(label(F.col("id")).alias("bucket"))
