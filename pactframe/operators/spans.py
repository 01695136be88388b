"""The span tree of every run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize


def roots_and_parents(spans: DataFrame) -> DataFrame:
    """(run_id, span_id, parent): parent NULL for roots, orphans and self-parents."""
    here = spans.select("run_id", F.col("span_id").alias("known"))
    child = spans.select("run_id", "span_id", F.col("parent_span_id").alias("known"))
    hit = child.where(F.col("known") != F.col("span_id")).join(here, ["run_id", "known"], "left_semi")
    return spans.select("run_id", "span_id").join(
        hit.select("run_id", "span_id", F.col("known").alias("parent")), ["run_id", "span_id"], "left")


def span_tree(spans: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """Root, depth and path of every span, by pointer doubling.

    Round ``i`` jumps 2^i ancestors, so a tree of depth d needs log2(d) joins on
    (run_id, ancestor). The ancestor side is unique, which lets the adaptive
    skew join split a parent with very many children. Spans caught in a cycle
    reach no root and are left out, as an unreachable branch is.
    """
    ensure_checkpoint_dir(spans.sparkSession)
    state = roots_and_parents(spans).select(
        "run_id", "span_id", F.col("parent").alias("jump"),
        F.array("span_id").alias("path"),
    ).checkpoint()
    for _ in range(max_rounds):
        if state.where(F.col("jump").isNotNull()).isEmpty():
            break
        up = state.select(
            "run_id", F.col("span_id").alias("jump"), F.col("jump").alias("next"),
            F.col("path").alias("above"))
        joined = state.join(up, ["run_id", "jump"], "left")
        # A path that meets a span twice runs in a circle; it and whatever hangs
        # below it never reach a root.
        whole = F.when(F.col("jump").isNull(), F.col("path")).otherwise(F.concat("above", "path"))
        state = (
            joined.where(F.col("jump").isNull() | F.col("above").isNotNull())
            .select("run_id", "span_id", F.col("next").alias("jump"), whole.alias("path"))
            .where(F.size("path") == F.size(F.array_distinct("path"))).checkpoint())
    else:
        if not state.where(F.col("jump").isNotNull()).isEmpty():
            raise ValueError(f"span trees deeper than 2 ** {max_rounds} levels")
    return state.where(F.col("jump").isNull()).select(
        "run_id", "span_id", F.element_at("path", 1).alias("root_span_id"),
        (F.size("path") - 1).alias("depth"), "path")


def waterfall(spans: DataFrame) -> DataFrame:
    """Spans with their place in the tree, in reading order within a run."""
    tree = span_tree(spans.select("run_id", "span_id", "parent_span_id"))
    return spans.join(tree, ["run_id", "span_id"])


def _doubled(links: DataFrame, keys: list[str], add: list[Column], rounds: int) -> DataFrame:
    """Pointer doubling: every row's ``next`` is followed to its end, ``add`` combines the values ``v`` on the way.

    A row has a constant size in every round. Rows on a circle never end; their
    ``next`` stays set after ``rounds``.
    """
    state = materialize(links, "pointers")
    for _ in range(rounds):
        if state.where(F.col("next").isNotNull()).isEmpty():
            break
        ahead = state.select(keys[0], F.col("id").alias("next"), F.col("next").alias("beyond"), *[F.col(c).alias(f"_{c}") for c in keys[1:]])
        state = materialize(state.join(ahead, [keys[0], "next"], "left").select(keys[0], "id", F.col("beyond").alias("next"), *add), "pointers")
    return state


def preorder(spans: DataFrame) -> DataFrame:
    """``run_id, span_id, root_span_id, depth, position``: reading order of every run's span trees, numbered from 0.

    Depth and root come from doubling the parent pointers. For the position the
    trees of a run become one list, the Euler tour: entering a span leads to
    entering its first child, leaving it to its next sibling or to leaving its
    parent, roots follow each other. Ranking that list by doubling counts the
    spans entered from each place on. Rows hold numbers only, so a chain of any
    depth takes a logarithm of rounds over rows of constant size. Spans on or
    below a circle are left out.
    """
    nodes = roots_and_parents(spans)
    most = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = max(most, 1).bit_length() + 1
    climbing = nodes.select("run_id", F.col("span_id").alias("id"), F.col("parent").alias("next"), F.col("parent").isNotNull().cast("long").alias("up"), F.coalesce("parent", "span_id").alias("top"))
    climbed = _doubled(climbing, ["run_id", "up", "top"], [(F.col("up") + F.coalesce("_up", F.lit(0))).alias("up"), F.coalesce("_top", "top").alias("top")], rounds)
    placed = climbed.where(F.col("next").isNull()).select("run_id", F.col("id").alias("span_id"), F.col("up").alias("depth"), F.col("top").alias("root_span_id"))
    tree = materialize(nodes.join(placed, ["run_id", "span_id"]), "span-tree")

    order = Window.partitionBy("run_id", "parent").orderBy("span_id")
    with_next = tree.select("run_id", "span_id", "parent", F.lead("span_id").over(order).alias("sibling"))
    first = tree.where(F.col("parent").isNotNull()).groupBy("run_id", "parent").agg(F.min("span_id").alias("child")).withColumnRenamed("parent", "span_id")
    there = lambda span, enter: F.when(span.isNotNull(), F.struct(span.alias("span"), F.lit(enter).alias("enter")))
    own = F.col("span_id")
    enters = with_next.join(first, ["run_id", "span_id"], "left").select(
        "run_id", there(own, True).alias("id"), F.coalesce(there(F.col("child"), True), there(own, False)).alias("next"), F.lit(1).cast("long").alias("rest"))
    leaves = with_next.select(
        "run_id", there(own, False).alias("id"), F.coalesce(there(F.col("sibling"), True), there(F.col("parent"), False)).alias("next"), F.lit(0).cast("long").alias("rest"))
    ranked = _doubled(enters.unionByName(leaves), ["run_id", "rest"], [(F.col("rest") + F.coalesce("_rest", F.lit(0))).alias("rest")], rounds + 1)
    sizes = tree.groupBy("run_id").agg(F.count(F.lit(1)).alias("all"))
    at = ranked.where("id.enter").select("run_id", F.col("id.span").alias("span_id"), "rest")
    return tree.join(at, ["run_id", "span_id"]).join(sizes, "run_id").select(
        "run_id", "span_id", "root_span_id", F.col("depth").cast("int").alias("depth"), (F.col("all") - F.col("rest")).alias("position"))
