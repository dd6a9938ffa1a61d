"""The query catalogue: name -> Spark plan, and name -> the same result in plain SQL.

Spark plans take (spark, directory). The SQL reads the same tables as views. Texts that the
tables do not hold (labelled identifiers, tokens) are derived from them by one SQL
expression that both engines understand, so every query grows with its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def add(name: str, plan: Plan, sql: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = plan
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def wrap(plan: Plan) -> Plan:
        add(name, plan, sql)
        return plan

    return wrap


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def derived(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Columns derived from one table by SQL expressions."""
    return table(spark, directory, name).selectExpr(*columns)


def duck_spans(source: str, pattern: str, key: str = "doc_id", groups: int = 2) -> str:
    """All matches of an RE2 pattern with offsets, in SQL.

    The pattern is (before)(value) or (before)(value)(after); the value is the span.
    """
    tail = " || '\\3'" if groups == 3 else ""
    pat = pattern.replace("'", "''")
    return f"""
      SELECT {key}, CAST(list_sum(list_transform(seg[1:i - 1], lambda x: length(replace(x, chr(2), '')))) AS INT) AS s,
             split_part(seg[i], chr(2), 1) AS v
      FROM (SELECT {key}, seg, unnest(range(2, len(seg) + 1)) AS i
            FROM (SELECT {key}, string_split(regexp_replace(text, '{pat}', '\\1' || chr(1) || '\\2' || chr(2){tail}, 'g'),
                                             chr(1)) AS seg
                  FROM ({source}) src) a
            WHERE len(seg) > 1) b"""


DUCK_LUHN = """(list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 1
    THEN CASE WHEN 2 * CAST(substr({0}, i, 1) AS INT) > 9 THEN 2 * CAST(substr({0}, i, 1) AS INT) - 9
              ELSE 2 * CAST(substr({0}, i, 1) AS INT) END
    ELSE CAST(substr({0}, i, 1) AS INT) END)) % 10 = 0)"""
