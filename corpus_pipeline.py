"""A corpus pipeline: language, exact copies, near copies, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactframe.llm import exact, langid, minhash, mixing, packing
from pactframe.llm.common import save


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose windows are, on average, surely enough in some language the network knows.

    The network learns from the labelled training folds of ``docs``. A text in
    several of its languages stays. Where nothing is labelled no language can be
    ruled out, and all texts with a letter stay. Null, empty and letterless texts
    go; columns stay as they are.
    """
    net = langid.fit(docs)
    found = langid.predict(docs, net).filter(F.col("confidence") < langid.least_confidence(net))
    gone = save(found.select("doc_id", "text_hash").distinct(), "rejected")
    return exact.drop_documents(docs, gone, F.xxhash64(F.coalesce("text", F.lit(""))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest id."""
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word shingle similarity of 0.8 or more, whatever its ids."""
    found = minhash.near_duplicates(docs, width=5)
    return exact.drop_documents(docs, found.filter("not keeper").select("doc_id", F.col("h").alias("text_hash")),
                                F.xxhash64(F.coalesce("text", F.lit(""))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: no document is lost, small sources repeat at most twice."""
    return mixing.mix_documents(docs, max_repeats=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences."""
    return packing.pack_documents(docs, extra={"ids_crc32": F.crc32("ids")})


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packed", packed)]

#: Predictions, signatures and token ids have no SQL; ``tests/llm`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
