"""Registered queries: a Spark plan and the SQL it is compared with."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, work_dir, write_table
from . import views

Builder = Callable[["Source"], DataFrame]

PLANS: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


#: Tables whose rows are long texts, where a task's work is far out of
#: proportion to its bytes.
TEXTS = ("documents", "pages", "conversations")
_STORED: dict[tuple[str, str, str], str] = {}


class Source:
    """The given tables and the views derived from them, for one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self._tag = f"pf_{zlib.crc32(self.folder.encode()):08x}_"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return spread(df) if name in TEXTS else df

    def view(self, name: str) -> DataFrame:
        view = f"v_{name}"
        return self._stored(view) if view in views.STORED else self._derive(view)

    def _derive(self, view: str) -> DataFrame:
        stored = {}
        for kept in views.STORED:
            if kept != view and kept in views.needed(view, duck=False):
                stored[kept] = self._tag + kept
                self._stored(kept).createOrReplaceTempView(stored[kept])
        return self._sql(views.spark_sql(view, stored))

    def _sql(self, text: str) -> DataFrame:
        for table in sorted(set(views._TABLE.findall(text))):
            self.table(table).createOrReplaceTempView(self._tag + table)
        return self.spark.sql(views._TABLE.sub(lambda m: self._tag + m.group(1), text))

    def _stored(self, view: str) -> DataFrame:
        """A costly view, written to the shared folder once per application."""
        key = (self.spark.sparkContext.applicationId, self.folder, view)
        if key in _STORED:
            try:
                return self.spark.read.parquet(_STORED[key])
            except AnalysisException:
                pass  # the scratch folder was cleared: write it again
        path = work_dir(self.spark, view)
        write_table(self._derive(view), path)
        _STORED[key] = path
        return self.spark.read.parquet(path)

    def latest(self, df: DataFrame, column: str) -> datetime:
        """The newest time of a table: the clock of every windowed query."""
        return df.agg(F.max(column)).first()[0]


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table with fewer scan partitions than cores.

    A small file is one partition whatever its texts cost to process. A table
    of many files already has more partitions than cores and is left alone, so
    nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def plan(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(fn: Builder) -> Builder:
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = views.duck_sql(sql)
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Builder) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Source(spark, folder))

    return {name: bind(fn) for name, fn in PLANS.items()}
