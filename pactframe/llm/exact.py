"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, fresh, key_filter, may_contain, save, same


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, prefix_chars: int = 128, digests: bool = False) -> DataFrame:
    """Which documents repeat another one: ``doc_id, text_hash, keep_id, group_size, kept, text_sha256``.

    The first scan takes only the length and the hash of a prefix of every
    normalised text. Lengths that occur once are settled; of the others, so are
    prefixes that occur once. The keys still open travel to the second scan as
    a bitmap of fixed size, and only texts under a set bit are hashed whole; a
    false positive costs one hash and changes nothing. Texts never shuffle.

    The smallest ``doc_id`` of a group stays. ``text_hash`` (64 bits of the
    normalised text) tells apart rows that share a ``doc_id``. ``text_sha256`` is
    null for texts settled early unless ``digests`` asks for it.

    Defined results: a null text is empty; rows with null ids are counted in
    their group, which keeps the smallest id there is, or null; rows repeating
    both id and text are one document, each of them reported alike. Other
    columns of ``docs`` are not looked at.
    """
    texts = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("t"))
    keyed = texts.select(
        "doc_id", "t", F.length("t").cast("long").alias("n"),
        F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix"))
    first = save(keyed.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("rows")), "exact-prefixes")
    lengths = first.groupBy("n").agg(F.sum("rows").alias("of_length")).filter("of_length > 1")
    open_ = first.filter("rows > 1").join(lengths, "n", "left_semi")
    pages = key_filter(open_.select(F.xxhash64("n", "prefix").alias("k")))

    second = may_contain(keyed.withColumn("k", F.xxhash64("n", "prefix")), pages, "k", "hit")
    whole = F.sha2(F.col("t"), 256)
    rows = save(second.select(
        "doc_id", "n", "hit", F.xxhash64("t").alias("text_hash"),
        (whole if digests else F.when(F.col("hit"), whole)).alias("text_sha256")), "exact-rows")
    groups = save(
        rows.filter("hit").groupBy("n", "text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"), "exact-groups")
    # Both sides are written tables, so a group with most of the rows is split
    # at run time by the adaptive skew join.
    return (rows.join(groups, ["n", "text_sha256"], "left")
            .select("doc_id", "text_hash",
                    F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def drop_documents(docs: DataFrame, dropped: DataFrame, text_hash: Column) -> DataFrame:
    """``docs`` without the rows named by ``dropped(doc_id, text_hash)``, columns unchanged."""
    mark = fresh(docs, "text_hash")
    gone = dropped.select(F.col("doc_id"), F.col("text_hash").alias(mark)).distinct()
    marked = docs.withColumn(mark, text_hash)
    return marked.join(gone, same(marked, gone, "doc_id", mark), "left_anti").drop(mark)


def exact_dedup(docs: DataFrame, prefix_chars: int = 128) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Rows that repeat both id and text leave one row: an arbitrary one, as their
    other columns are not compared. An empty table stays empty.
    """
    found = save(exact_groups(docs, prefix_chars), "exact-found")
    text_hash = F.xxhash64(normalised(F.col("text")))
    rows = drop_documents(docs, found.filter("not kept"), text_hash)
    again = found.filter("kept and group_size > 1").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    mark = fresh(docs, "text_hash")
    again = save(again.select("doc_id", F.col("text_hash").alias(mark)), "exact-again")
    rows = rows.withColumn(mark, text_hash)
    once = rows.join(again, same(rows, again, "doc_id", mark), "left_anti")
    more = rows.join(again, same(rows, again, "doc_id", mark), "left_semi").dropDuplicates(["doc_id", mark])
    return once.unionByName(more).drop(mark)
