"""Manual review of detected spans: add, disable, delete, retarget.

Actions are applied in their ``seq`` order inside the row of a document, as a reviewer
would. They come from people, so the list of one document is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe import fixed
from cloakframe.functions.checks import strip
from cloakframe.functions.spans import once
from cloakframe.operators.mask import mask_spans, token_sql
from cloakframe.schema import _map

REVIEW_T = (
    "array<struct<start:int,end:int,type:string,text:string,label:string,token:string,enabled:boolean,"
    "confidence:double,validated:boolean,source:string>>"
)
_ACTION = ("seq", "action", "type", "start", "end", "new_start", "new_end")


def _review_item(**over: str) -> str:
    names = ("start", "end", "type", "text", "label", "token", "enabled", "confidence", "validated", "source")
    return "named_struct(" + ", ".join(f"'{n}', {over.get(n, f'x.{n}')}" for n in names) + ")"


def apply_reviews(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """Documents with merged ``spans`` plus review actions to reviewed ``review`` items.

    A range is clipped to the text and trimmed of white space; it is refused when nothing is
    left or when it overlaps another enabled span. A known (type, text) keeps its token. Adds
    ``refused``: the number of refused actions.
    """
    masked = mask_spans(docs)
    first = _review_item(
        enabled="true", confidence="1.0D", validated="true", source="'detected'"
    )
    packed = actions.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(*_ACTION))).alias("_acts")
    )
    labels = _map({t: label for t, label, _ in fixed.MANUAL_TYPES})
    same = "x.start = c.start AND x.end = c.end AND x.type = c.type"
    raw_a, raw_b = "if(c.action = 'add', c.start, c.new_start)", "if(c.action = 'add', c.end, c.new_end)"
    a = f"greatest(0, least({raw_a}, {raw_b}))"
    b = f"least(length(text), greatest({raw_a}, {raw_b}))"
    piece = f"substring(text, {a} + 1, {b} - ({a}))"
    left = f"length({piece}) - length(regexp_replace({piece}, '(?U)^\\\\s+', ''))"
    span = f"named_struct('s', {a} + {left}, 'v', {strip(piece)})"
    me = f"(c.action = 'retarget' AND {same})"
    clash = f"exists(z.items, x -> x.enabled AND NOT {me} AND r.s < x.end AND x.start < r.s + length(r.v))"
    known = "filter(z.items, x -> x.type = c.type AND x.text = r.v AND NOT " + me + ")"
    count = f"(size(array_distinct(transform(filter(z.items, x -> x.type = c.type AND NOT {me}), x -> x.text))) + 1)"
    label = f"coalesce(element_at({labels}, c.type), c.type)"
    token = f"coalesce(get({known}, 0).token, {token_sql('c.type', label, 'r.v', count)})"
    added = (
        f"array_append(z.items, named_struct('start', r.s, 'end', r.s + length(r.v), 'type', c.type, 'text', r.v, "
        f"'label', {label}, 'token', {token}, 'enabled', true, 'confidence', 1.0D, 'validated', true, "
        "'source', 'manual_review'))"
    )
    retoken = f"coalesce(get({known}, 0).token, {token_sql('c.type', 'x.label', 'r.v', count)})"
    moved = f"transform(z.items, x -> if({same}, " + _review_item(
        start="r.s", end="r.s + length(r.v)", text="r.v", token=retoken
    ) + ", x))"
    refuse = "named_struct('items', z.items, 'refused', z.refused + 1)"
    keep = lambda items: f"named_struct('items', {items}, 'refused', z.refused)"
    exists = f"exists(z.items, x -> {same})"
    ranged = (
        f"element_at(transform(array({span}), r -> if(length(r.v) = 0 OR {clash} OR (c.action = 'retarget' AND NOT {exists}), "
        f"{refuse}, if(c.action = 'add', {keep(added)}, {keep(moved)}))), 1)"
    )
    step = (
        f"CASE WHEN c.action = 'delete' THEN {keep(f'filter(z.items, x -> NOT ({same}))')} "
        f"WHEN c.action = 'disable' THEN {keep('transform(z.items, x -> if(' + same + ', ' + _review_item(enabled='false') + ', x))')} "
        f"WHEN c.action IN ('add', 'retarget') THEN {ranged} ELSE {refuse} END"
    )
    empty = "cast(array() AS array<struct<seq:int,action:string,type:string,start:int,end:int,new_start:int,new_end:int>>)"
    order = "(l, r) -> CASE WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 WHEN l.end < r.end THEN -1 WHEN l.end > r.end THEN 1 ELSE 0 END"
    fold = f"aggregate(_acts, named_struct('items', _first, 'refused', 0), (z, c) -> {step})"
    return (
        masked.join(packed, "doc_id", "left")
        .transform(
            once, _acts=f"coalesce(_acts, {empty})", _first=f"cast(transform(items, x -> {first}) AS {REVIEW_T})"
        )
        .transform(once, _z=fold)
        .withColumn("review", F.expr(f"array_sort(_z.items, {order})"))
        .withColumn("refused", F.col("_z.refused"))
        .drop("_acts", "_first", "_z", "items", "masked", "vault", "status")
    )
