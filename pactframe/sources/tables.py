"""The tables of a corpus: partitioned Parquet, changed by whole partitions of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

BUCKET = "doc_bucket"
#: Partitions of every table: what a load of a few documents rewrites is a few of them.
BUCKETS = 64


class RowCountMismatch(RuntimeError):
    """Tables that must have a row for a row differ."""


class CorpusTables:
    """Tables that hold a document's rows under the same key, partitioned by a hash of it.

    A load replaces documents in all tables by dynamic partition overwrite:
    partitions without one of its documents are neither read nor written.
    Everything is worked out and checked in the shared folder before the first
    table is touched, and what is written there holds whole partitions, so a
    load that was broken off is finished by running it again. A bucket that a load
    empties keeps one row without a key, which no reader sees.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "document_id", buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name)).where(F.col(self.key).isNotNull()).drop(BUCKET)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, name: str) -> None:
        # A hot bucket is split into files by the rebalance; small ones are one file.
        (rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(self.path(name)))

    def create(self, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            self._write(self._bucketed(rows), name)

    def load(self, fresh: dict[str, DataFrame], replaced: DataFrame, paired: Sequence[str] = ()) -> dict[str, int]:
        """Put the rows of ``fresh`` in place of those of the ``replaced`` keys, in every table of the load.

        Tables named in ``paired`` must have as many rows of every document; if
        not, nothing is changed. Returns the new rows per table.
        """
        gone = materialize(replaced.select(self.key).distinct(), "replaced")
        new = {name: materialize(rows, f"fresh-{name}") for name, rows in fresh.items()}
        self._check({name: new[name] for name in paired})
        keys = gone
        for rows in new.values():
            keys = keys.unionByName(rows.select(self.key))
        touched = materialize(self._bucketed(keys.distinct()).select(BUCKET).distinct(), "buckets")
        staged = {}
        for name, rows in new.items():
            # The bucket list has at most ``buckets`` rows; joined, it prunes the partitions that are read.
            there = self.spark.read.parquet(self.path(name)).join(F.broadcast(touched), BUCKET, "left_semi")
            kept = there.where(F.col(self.key).isNotNull()).join(gone, self.key, "left_anti").select(*there.columns)
            both = kept.unionByName(self._bucketed(rows))
            empty = touched.join(both.select(BUCKET).distinct(), BUCKET, "left_anti")
            staged[name] = materialize(both.unionByName(empty, allowMissingColumns=True), f"staged-{name}")
        for name, rows in staged.items():
            self._write(rows, name)
        return {name: rows.count() for name, rows in new.items()}

    def _check(self, tables: dict[str, DataFrame]) -> None:
        counts = [rows.groupBy(self.key).agg(F.count(F.lit(1)).alias(name)) for name, rows in tables.items()]
        for left, right in zip(counts, counts[1:]):
            both = left.join(right, self.key, "full")
            a, b = (F.coalesce(F.col(c.columns[1]), F.lit(0)) for c in (left, right))
            wrong = both.where(a != b).limit(5).collect()
            if wrong:
                raise RowCountMismatch(f"rows per document differ: {', '.join(str(r.asDict()) for r in wrong)}")
