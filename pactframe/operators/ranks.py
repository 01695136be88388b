"""Top-k and exact percentiles without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """The best ``k`` rows per key with their 1-based rank.

    The ``row_number() <= k`` filter is planned as a group limit on both sides
    of the shuffle, so each map task ships at most ``k`` rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def newest_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """The row with the greatest ``order`` per key, by a partial aggregate."""
    pick = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*")


def nearest_rank(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    percents: Sequence[int],
    *,
    bounded_groups: bool = False,
    cells: int = 16384,
    bend: float = 1e6,
    rounds: int = 2,
) -> DataFrame:
    """Exact nearest-rank percentiles per key: rank = ceil(n * p / 100).

    All ``values`` are worked out together, as columns ``<value>_p<percent>``.
    Equal values are counted first (map-side combine); then the target rank is
    narrowed to one of ``cells`` monotone cells between the smallest and the
    largest value, spaced logarithmically because latencies and costs have long
    right tails. The next of ``rounds`` narrows between the smallest and the
    largest value of that cell, so outliers that pressed everything into one
    cell are gone from it, and only the last cell is sorted. ``bounded_groups`` says the number of groups has a bound of its
    own (the buckets of a window), which makes the targets safe to broadcast.
    """
    grp = [*keys, "_x"]
    pairs = F.array(*[
        F.struct(F.lit(i).alias("_x"), F.col(v).cast("double").alias("_v"))
        for i, v in enumerate(values)
    ])
    hist = (
        df.select(*keys, F.inline(pairs)).where(F.col("_v").isNotNull())
        .groupBy(*grp, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    ranks = F.array(*[
        F.struct(F.lit(p).alias("_p"), F.expr(f"(_total * {p} + 99) div 100").alias("_rank"))
        for p in percents
    ])
    targets = (
        hist.groupBy(*grp)
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
        .select(*grp, "_lo", "_hi", F.inline(ranks))
    )

    def scoped(bounds: DataFrame) -> DataFrame:
        side = F.broadcast(bounds) if bounded_groups or not keys else bounds
        return hist.join(side, grp).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    cell = F.floor(F.log1p(share * bend) * (cells / math.log1p(bend)))
    cum = F.col("_cum")
    w = Window.partitionBy(*grp, "_p").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    chosen = targets.withColumn("_before", F.lit(0).cast("long"))
    for _ in range(rounds):
        counted = (
            scoped(chosen)
            .withColumn("_c", F.when(F.col("_hi") > F.col("_lo"), F.least(cell, F.lit(cells - 1))).otherwise(0))
            .groupBy(*grp, "_p", "_rank", "_before", "_c")
            .agg(F.sum("_n").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        )
        chosen = (
            counted.withColumn("_cum", F.col("_before") + F.sum("_m").over(w))
            .where((cum >= F.col("_rank")) & (cum - F.col("_m") < F.col("_rank")))
            .select(*grp, "_p", "_rank", (cum - F.col("_m")).alias("_before"), "_lo", "_hi")
        )
    w = Window.partitionBy(*grp, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        scoped(chosen)
        .withColumn("_cum", F.col("_before") + F.sum("_n").over(w))
        .where((cum >= F.col("_rank")) & (cum - F.col("_n") < F.col("_rank")))
    )
    return picked.groupBy(*keys).agg(*[
        F.max(F.when((F.col("_x") == i) & (F.col("_p") == p), F.col("_v"))).alias(f"{v}_p{p}")
        for i, v in enumerate(values) for p in percents
    ])
