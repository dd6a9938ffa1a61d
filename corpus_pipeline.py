"""The corpus pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import stages
from cloakframe.llm.common import passing, stored

STAGES = [
    ("language_id", stages.keep_languages),
    ("quality", stages.keep_quality),
    ("near_duplicates", stages.keep_one_of_each),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and what its stage wrote beside it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *most, (_, last) = STAGES
    for _, stage in most:
        with passing(spark):
            docs = stored(stage(spark, docs, sf_dir), keep=True)
    return last(spark, docs, sf_dir)


#: Models and similarity search are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
