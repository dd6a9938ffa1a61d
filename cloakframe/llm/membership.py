"""Rows whose id is, or is not, in a table of ids, without shuffling the other rows.

A blocked Bloom filter of the ids, of fixed size, picks the rows that may match; only those are joined. Ids are
longs; a null id matches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.url_filter import bloom_filter, may_hold


def _suspects(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return may_hold(rows, bloom_filter(ids.select(F.col(key).cast("bigint").alias("canon"))), F.col(key).cast("bigint"))


def matching(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``wanted`` on ``key``."""
    return _suspects(rows, wanted, key).filter("hit").select("row.*").join(wanted, key)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``ids``."""
    probed = _suspects(rows, ids, key)
    bad = ids.select(F.col(key).cast("bigint").alias("bad")).distinct()
    doubt = probed.filter("hit").join(bad, F.col("row")[key].cast("bigint") == F.col("bad"), "left_anti")
    return probed.filter("NOT hit").select("row.*").unionByName(doubt.select("row.*"))
