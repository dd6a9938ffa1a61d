"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.

A stage reads nothing of an input column but id, text, language and source. Language and quality are judged row by row in the pass that writes
the stage's output. Near copies and benchmark passages need a number of each row, which is written with the stage's input once; so null and
repeated ids are plain data everywhere. What a stage wrote on its way to a decision is deleted when the decision is written.
Empty input gives empty output, with the columns of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, jaccard_join, language_id, mixing, quality
from cloakframe.llm.common import crc_mod, keep_rows, passing, stored, string_bytes, table
from cloakframe.llm.membership import matching, without

#: A text of the learned languages has this share of words that their training texts hold, or is told apart between them with this certainty
#: (texts of a few rare words). Neither depends on how many languages there are; mixed texts pass by the first.
LEAST_KNOWN, CERTAIN = 0.3, 0.9


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and the name of that column."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), keep=True), name


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those of none of the learned languages, go; if no row could be learned from, only the former."""
    model = spark.sparkContext.broadcast(language_id.train(docs.filter(crc_mod("doc_id", 4) != 2)))

    def decide(texts: pa.Array) -> np.ndarray:
        if not model.value.labels:
            return pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        lang, score, known, _ = language_id.predict_slice(texts, model.value)
        sure = (score >= CERTAIN) & (len(model.value.labels) > 1)
        return (np.array(lang, object) != "und") & ((known >= LEAST_KNOWN) | sure)

    return keep_rows(docs, "text", decide)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality model does not predict to be good go."""
    net = spark.sparkContext.broadcast(quality.train(docs.filter(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels")))
    return keep_rows(docs, "text", lambda texts: quality.scores(net.value, *string_bytes(texts)) >= quality.THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays; one without an id only if no other has one."""
    with passing(spark):
        rows, row = _numbered(docs)
        plain = rows.select(F.col(row).alias("id"), F.col("text").cast("string").alias("text"), F.col(row).alias("doc"))
        groups = stored(jaccard_join.near_classes(plain).filter("n_links > 0").select(F.col("id").alias(row), "class_id"))
        near = stored(matching(rows.select(row, "doc_id"), groups, row))
        first = near.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("first"))).alias("x"))
        gone = stored(without(near, first.select(F.col("x.first").alias(row)), row).select(row), keep=True)
    return without(rows, gone, row).drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with few edits, go."""
    with passing(spark):
        rows, row = _numbered(docs)
        hits = decontaminate.find_items(rows, table(spark, sf_dir, "benchmark"), row)
        gone = stored(hits.select(F.col("doc_id").alias(row)).distinct(), keep=True)
    return without(rows, gone, row).drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by Poisson replication to the production weights, with their number."""
    return mixing.replicate(docs)
