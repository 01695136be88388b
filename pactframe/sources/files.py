"""Files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import content_hash, known_sources


def list_files(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """Files under the roots, walked recursively; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return known_sources(found.select("path", "length", "modificationTime"), suffixes)


def read_files(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """Path, bytes and content hash of every known file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return known_sources(found, suffixes).withColumn("content_hash", content_hash(F.col("content")))
