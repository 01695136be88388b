"""Where streams land: a keyed table in which the newest row of a key wins.

Every micro-batch is written under its own batch folder in overwrite mode, so a
batch that is run again after a lost driver or executor replaces itself and
adds nothing. A row of any age may be replaced: the newest row per key, by the
table's order and then by batch, is picked when the table is read, by a partial
aggregate. Counts land as partial sums per batch and are added up on reading,
so rows may arrive in any order and none is late. ``compact`` folds the batches
into one when they grow many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str]) -> None:
        self.spark, self.keys, self.order = spark, keys, order
        self.rows = f"{root}/rows"
        self.checkpoint = f"{root}/checkpoint"
        self.schema = None

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.rows}/{BATCH}={batch_id}")

    def read(self) -> DataFrame:
        """The newest row of every key; of equally new ones, that of the later batch."""
        return newest(self.batches(), self.keys, [*self.order, BATCH]).drop(BATCH)

    def batches(self) -> DataFrame:
        """Every row of every batch, with its batch."""
        return self.spark.read.option("basePath", self.rows).parquet(self.rows)

    def read_sums(self) -> DataFrame:
        """Partial sums of all batches added up per key."""
        rows = self.batches()
        rest = [c for c in rows.columns if c not in (*self.keys, BATCH)]
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in rest])

    def compact(self, path: str) -> DataFrame:
        self.read().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def compact_batches(self, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Fold what has landed into one batch; ``merge`` makes one partial row of several.

        The folded rows replace the newest batch, which is written aside first;
        then the older ones go. Run it between two runs of the stream.
        """
        ids = [r[0] for r in self.batches().select(BATCH).distinct().collect()]  # one row per batch
        if len(ids) < 2:
            return
        aside = f"{self.rows}-folded"
        merge(self.batches().drop(BATCH)).write.mode("overwrite").parquet(aside)
        self.write_batch(self.spark.read.parquet(aside), max(ids))
        for old in sorted(ids)[:-1]:
            self.write_batch(self.spark.read.parquet(aside).limit(0), old)


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(pick).select(*keys, "_r.*")


def run_to_end(stream: DataFrame, table: KeyedTable, mode: str = "append",
               each: Callable[[DataFrame, int], None] | None = None) -> KeyedTable:
    """Process everything available and stop; the checkpoint makes it resumable.

    An empty batch comes before the first one, so a table that nothing has
    arrived for reads as an empty one.
    """
    land = each or table.write_batch
    land(table.spark.createDataFrame([], stream.schema), -1)
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", table.checkpoint)
        .trigger(availableNow=True).foreachBatch(land).start())
    query.awaitTermination()
    return table
