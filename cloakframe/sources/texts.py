"""Reading documents and guarding the intake."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.spans import clean_text

_FIELD = {
    "documents": ("doc_id", "text", "lang", "source"),
    "conversations": ("concat_ws('-', conv_id, turn)", "text", "cast(NULL AS string)", "role"),
    "pages": ("page_id", "html", "cast(NULL AS string)", "url"),
    "benchmark": ("item_id", "text", "cast(NULL AS string)", "cast(NULL AS string)"),
}
_BLANK = r"(?U)^\s*$"


#: Session setting: deal the texts of a scan over this many partitions. For tables kept in fewer row groups than there
#: are cores; unset (the default), a text is never shuffled just to be scanned.
SCAN_PARTITIONS = "cloakframe.scan.partitions"


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out as the session's ``SCAN_PARTITIONS`` says."""
    wanted = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def read_texts(spark: SparkSession, directory: str, name: str = "documents") -> DataFrame:
    """Canonical (doc_id, text, lang, source) rows of a table or JSON-lines file, those with a blank text or none among them."""
    base = os.path.join(directory, name)
    key, text, lang, source = _FIELD.get(name, _FIELD["documents"])
    if name.endswith((".jsonl", ".json")):
        raw = spark.read.schema("doc_id STRING, id STRING, text STRING, lang STRING, language STRING, source STRING").json(base)
        key, lang = "coalesce(doc_id, id)", "coalesce(lang, language)"
    else:
        raw = spark.read.parquet(base if name.endswith(".parquet") else base + ".parquet")
    return raw.selectExpr(f"{key} AS doc_id", f"{text} AS text", f"{lang} AS lang", f"{source} AS source")


def scan_texts(spark: SparkSession, directory: str, name: str = "documents") -> DataFrame:
    """``read_texts`` without blank texts."""
    rows = read_texts(spark, directory, name)
    return rows.filter(F.col("text").isNotNull() & ~F.col("text").rlike(_BLANK))


def reject_reason(text: str = "text", limit: int | None = None) -> str:
    """Why a text is not scanned; length is no reason unless the caller sets a limit."""
    long = "" if limit is None else f"WHEN length({text}) > {int(limit)} THEN 'too_long' "
    return f"CASE WHEN {text} IS NULL THEN 'null_text' WHEN rlike({text}, '(?U)^\\\\s*$') THEN 'blank_text' {long}END"


def intake_guard(docs: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into accepted and rejected texts; a rejected one carries its reason. Texts of any length pass by default.

    The two fence characters of the span scan are turned into blanks, so offsets still fit.
    """
    judged = docs.withColumn("reason", F.expr(reject_reason("text", limit)))
    accepted = judged.filter("reason IS NULL").drop("reason")
    accepted = accepted.withColumn("text", clean_text(F.col("text")))
    return accepted, judged.filter("reason IS NOT NULL")
