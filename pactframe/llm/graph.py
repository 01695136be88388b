"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``links(a, b)``: nodes share a label when linked.

    Contraction: every node hooks to its smallest neighbour, hooks are followed
    to their end, and the links between the trees are what the next round sees.
    Each round at least halves the nodes left, and each is written out, so no
    lineage grows and a lost executor costs one round. The driver only learns
    whether links are left. A node with very many links is an aggregate with
    map-side combine and a join the adaptive rule can split.
    """
    spark = links.sparkSession
    edges = save(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("above"))
            once = hooks.join(up, "label").select("node", F.col("above").alias("label"))
            twice = once.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved"))
            jumped = save(twice, "hooks")
            hooks = jumped.drop("moved")
            if not jumped.filter("moved").limit(1).count():
                break
        if labels is None:
            labels = hooks
        else:
            new = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = save(labels.join(new, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        to_a = hooks.select(F.col("node").alias("a"), F.col("label").alias("ra"))
        to_b = hooks.select(F.col("node").alias("b"), F.col("label").alias("rb"))
        edges = save(edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if not edges.limit(1).count():
            return labels if labels is not None else spark.createDataFrame([], "node long, label long")
