"""Schemas of the span tables and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe import fixed
from cloakframe.functions.checks import strip
from cloakframe.functions.spans import q

SPAN_T = (
    "struct<start:int,end:int,type:string,text:string,confidence:double,sources:array<string>,"
    "validated:boolean,privacy_level:string,semantic_type:string,ord:int>"
)
HITS_T = "array<struct<start:int,end:int,text:string,idx:int>>"
SPAN_COLUMNS = (
    "start", "end", "type", "text", "confidence", "sources", "validated", "privacy_level", "semantic_type", "ord",
)
PREDICTION_DDL = (
    "doc_id BIGINT, model_id STRING, label STRING, `start` INT, `end` INT, text STRING, score DOUBLE"
)


def _map(table: dict) -> str:
    cell = lambda x: q(x) if isinstance(x, str) else str(x)
    return "map(" + ", ".join(f"{q(k)}, {cell(v)}" for k, v in table.items()) + ")"


def label_sql(type_: str = "type") -> str:
    """Display label of a type; an unknown type is its own label."""
    return f"coalesce(element_at({_map(fixed.LABEL)}, {type_}), {type_})"


def priority_sql(type_: str = "type") -> str:
    return f"coalesce(element_at({_map(fixed.PRIORITY)}, {type_}), {fixed.DEFAULT_PRIORITY})"


def level_sql(
    type_: str = "type", semantic_type: str = "semantic_type", model_level: str = "privacy_level"
) -> str:
    """Sensitivity: by type, else the model's own level, else by semantic type, else PL2."""
    semantic = f"regexp_replace(lower({strip(semantic_type)}), '[ -]', '_')"
    own = f"if({model_level} IN ('PL1', 'PL2', 'PL3', 'PL4'), {model_level}, NULL)"
    return (
        f"coalesce(element_at({_map(fixed.LEVEL)}, {type_}), {own}, "
        f"element_at({_map(fixed.SEMANTIC_LEVEL)}, {semantic}), '{fixed.DEFAULT_LEVEL}')"
    )


def rank_sql(level: str) -> str:
    return f"coalesce(element_at({_map({lv: i + 1 for i, lv in enumerate(fixed.LEVELS)})}, {level}), 2)"


def compatible_pairs() -> list[tuple[str, str]]:
    """Ordered pairs of different types that count as the same in scoring."""
    listed = {(a, b) for a, bs in fixed.COMPATIBLE.items() for b in bs if a != b}
    return sorted(listed | {(b, a) for a, b in listed})


def compatible_sql(left: str, right: str) -> str:
    """Two types count as the same in scoring (tested both ways)."""
    pairs = ", ".join(q(f"{a}|{b}") for a, b in compatible_pairs())
    return f"({left} = {right} OR concat({left}, '|', {right}) IN ({pairs}))"


def dim_entity_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, label, p, lv or fixed.DEFAULT_LEVEL) for t, label, p, lv in fixed.ENTITY_TYPES],
        "type string, label string, priority int, privacy_level string",
    )
