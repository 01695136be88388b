"""Incremental corpus load: list, classify, replace, delete, report.

Documents are keyed by path and never grouped into one task: hashing is a
column, classification one join on the path, and every change to a stored table
is an anti join plus a union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ModelMismatch(RuntimeError):
    """The corpus holds vectors of another embedding model."""


class DimensionMismatch(ValueError):
    """A vector does not have the width of the corpus."""


def known_sources(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Paths with a known suffix, each once however often it was given."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(suffix.isin(*suffixes)).dropDuplicates(["path"])


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def classify(incoming: DataFrame, stored: DataFrame, *, force: bool = False, dry_run: bool = False) -> DataFrame:
    """``skipped``, ``replaced`` or ``ingested`` per incoming (path, content_hash).

    The join reads two narrow columns of the catalogue and runs before anything
    expensive, so unchanged documents cost one hash.
    """
    have = stored.select("path", F.col("content_hash").alias("_stored"))
    same = (F.col("_stored") == F.col("content_hash")) & F.lit(not force)
    status = (
        F.lit("dry-run") if dry_run
        else F.when(F.col("_stored").isNull(), "ingested").when(same, "skipped").otherwise("replaced")
    )
    return incoming.join(have, "path", "left").withColumn("status", status).drop("_stored")


def to_load(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status").isin("ingested", "replaced"))


def replace_documents(stored: DataFrame, changed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """A table with the rows of changed documents exchanged whole."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(fresh)


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id",
                     keep: tuple[str, ...] = ("spans", "analyses")) -> dict[str, DataFrame]:
    """Documents with everything derived from them; runs and spans outlive them."""
    ids = gone.select(key)
    return {name: df if name in keep else df.join(ids, key, "left_anti") for name, df in tables.items()}


def rename(documents: DataFrame, names: DataFrame) -> DataFrame:
    """New display names; a blank one is refused and the path never moves."""
    new = F.trim(F.col("_new"))
    asked = names.select("document_id", F.col("filename").alias("_new"))
    return documents.join(asked, "document_id", "left").withColumn(
        "filename", F.when(new != "", new).otherwise(F.col("filename"))).drop("_new")


def isolate_failures(documents: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """An ``error`` column of ``Type: message`` for the first failing check.

    ``checks`` maps an error type to (condition that fails, message).
    """
    error = F.coalesce(*[
        F.when(bad, F.concat(F.lit(f"{kind}: "), message)) for kind, (bad, message) in checks.items()
    ])
    return documents.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNotNull(), "failed").otherwise("ok"))


def split_failures(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = checked.where(F.col("error").isNull()).drop("error")
    return good, checked.where(F.col("error").isNotNull())


def load_report(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: pages, chunks and the token total, median (cut to int) and maximum.

    A group is the chunks of one document, so at most one source row's worth.
    """
    return chunks.groupBy(key).agg(
        F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("chunks"),
        F.sum("token_count").alias("tokens"),
        F.floor(F.median("token_count")).cast("int").alias("median_tokens"),
        F.max("token_count").alias("max_tokens"))


def add_missing_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows written before a column existed read it as NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def embedding_models(chunks: DataFrame) -> DataFrame:
    return chunks.select("embedding_model").distinct()


def check_model(chunks: DataFrame, model: str) -> None:
    """Raise before anything is embedded or scored if another model is stored."""
    others = embedding_models(chunks.where(F.col("embedding_model") != model)).limit(20).collect()
    if others:
        names = ", ".join(sorted(r[0] for r in others))
        raise ModelMismatch(f"the corpus was embedded by {names}, not by {model}")


def wrong_width(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return vectors.where(F.size(column) != dim)


def check_width(vectors: DataFrame, dim: int, column: str = "embedding") -> None:
    bad = wrong_width(vectors, dim, column).select(F.size(column)).limit(1).collect()
    if bad:
        raise DimensionMismatch(f"a vector of width {bad[0][0]} in a corpus of width {dim}")


def prune(spans: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) spans around a time bound; the bound reaches the file scan."""
    return spans.where(F.col("ts") >= before), spans.where(F.col("ts") < before)


def flatten_criteria(criteria: DataFrame) -> DataFrame:
    """One row per sub-requirement with its place in the definition order."""
    return criteria.select(
        "criterion_id", "requirement", F.posexplode_outer("sub_requirements").alias("pos", "s")
    ).select("criterion_id", "requirement", "pos", F.col("s.id").alias("sub_id"), F.col("s.requirement").alias("sub_requirement"))


def criteria_errors(flat: DataFrame) -> DataFrame:
    """Repeated (criterion, sub-requirement) ids and criteria without any."""
    twice = flat.where(F.col("sub_id").isNotNull()).groupBy("criterion_id", "sub_id").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    none = flat.where(F.col("sub_id").isNull()).select(
        "criterion_id", "sub_id", F.lit(0).cast("long").alias("n"))
    return twice.unionByName(none)
