"""Queries written in Spark SQL over the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.plans import shapes as S
from cloakframe.plans.catalog import query
from cloakframe.plans.span_queries import shaky_registry
from cloakframe.sql import register_functions


def _ready(spark: SparkSession, d: str, registry=None) -> None:
    register_functions(spark, registry)
    S.documents(spark, d).createOrReplaceTempView("guarded_documents")


@query("sql_scan", f'SELECT doc_id, s AS "start", e AS "end", type, text FROM ({S.DOC_MERGED_SQL}) r')
def sql_scan(spark: SparkSession, d: str) -> DataFrame:
    """The spans of every document through a table function."""
    _ready(spark, d)
    return spark.sql("SELECT d.doc_id, s.start, s.`end`, s.type, s.text FROM guarded_documents d, LATERAL pii_scan(d.text) s")


@query("sql_mask", f"{S.DOC_MASK_CTE} SELECT doc_id, md5(masked) AS masked_md5, CAST(length(masked) AS INT) AS n FROM masked")
def sql_mask(spark: SparkSession, d: str) -> DataFrame:
    """Masked documents through a scalar function."""
    _ready(spark, d)
    return spark.sql("SELECT doc_id, md5(m.masked) AS masked_md5, length(m.masked) AS n FROM (SELECT doc_id, pii_mask(text) AS m FROM guarded_documents)")


@query("sql_restore", "SELECT doc_id, md5(text) AS text_md5, 0 AS missing FROM documents")
def sql_restore(spark: SparkSession, d: str) -> DataFrame:
    """Masked and restored in one statement: every text comes back."""
    _ready(spark, d)
    return spark.sql("""WITH m AS (SELECT doc_id, pii_mask(text) AS m FROM guarded_documents),
        r AS (SELECT doc_id, pii_restore(m.masked, m.vault) AS r FROM m)
        SELECT doc_id, md5(r.restored) AS text_md5, size(r.missing) AS missing FROM r""")


@query(
    "sql_plug_in",
    """SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN 0 END AS "start", CASE WHEN length(text) % 5 <> 0 THEN CAST(length(split_part(text, ' ', 1)) AS INT) END AS "end",
        CASE WHEN length(text) % 5 <> 0 THEN 'PERSON' END AS type, CASE WHEN length(text) % 5 = 0 THEN 'detector_failed:shaky:ValueError' END AS warning FROM documents""",
)
def sql_plug_in(spark: SparkSession, d: str) -> DataFrame:
    """A plug-in detector as a table function with a table argument."""
    _ready(spark, d, shaky_registry())
    return spark.sql("SELECT doc_id, start, `end`, type, warning FROM pii_semantic_privacy(TABLE(SELECT doc_id, text FROM guarded_documents))")
