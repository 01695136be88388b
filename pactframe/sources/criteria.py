"""The criteria dimension from its JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import criteria_errors, flatten_criteria

SCHEMA = ("id string, compliance_requirement string, description string, "
          "sub_requirements array<struct<id:string, requirement:string>>, compliance_state_options array<string>")


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """One row per criterion in definition order; repeated ids are refused."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    criteria = raw.select(
        F.col("id").alias("criterion_id"), F.col("compliance_requirement").alias("requirement"),
        F.col("description").alias("question"), "sub_requirements",
        F.monotonically_increasing_id().alias("position"))
    repeated = criteria.groupBy("criterion_id").count().where("count > 1").limit(5).collect()
    bad = criteria_errors(flatten_criteria(criteria)).limit(5).collect()
    if repeated or bad:
        raise ValueError(f"criteria must have unique ids: {[r[0] for r in repeated + bad]}")
    return criteria
