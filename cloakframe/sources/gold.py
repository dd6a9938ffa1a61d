"""Reading annotated corpora from JSON lines with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPAN = "text STRING, `start` INT, `end` INT, type STRING"
SCHEMAS = {
    "multilingual": f"id STRING, language STRING, text STRING, entities ARRAY<STRUCT<{_SPAN}>>",
    "contextual": (
        "id STRING, language STRING, category STRING, context_class STRING, text STRING, "
        f"entities ARRAY<STRUCT<{_SPAN}>>, should_redact BOOLEAN, notes STRING"
    ),
    "layered": (
        "id STRING, language STRING, length_class STRING, domain STRING, text STRING, "
        f"entities ARRAY<STRUCT<{_SPAN}, should_redact BOOLEAN, context_class STRING>>, "
        f"semantic_privacy ARRAY<STRUCT<{_SPAN}, sensitive BOOLEAN, context_class STRING>>, "
        "pii_free BOOLEAN, risk_group STRING, notes STRING"
    ),
    "negative": "id STRING, category STRING, text STRING, expect_detection BOOLEAN",
}


def read_gold(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per annotated text; lines without one are skipped."""
    return spark.read.schema(SCHEMAS[kind]).json(path).filter(F.col("text").isNotNull()).withColumnRenamed("id", "doc_id")


def gold_spans(corpus: DataFrame, layer: str = "entities") -> DataFrame:
    """One row per gold span, with ``should_redact`` defaulting to true."""
    out = corpus.select("doc_id", F.explode_outer(layer).alias("g")).filter("g IS NOT NULL").select("doc_id", "g.*")
    if layer == "entities" and "should_redact" not in out.columns:
        out = out.withColumn("should_redact", F.lit(True))
    return out
