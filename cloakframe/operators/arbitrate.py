"""Arbitration: one non-overlapping span list per document, then level and policy.

Two layouts give the same result. The array form works inside one row and needs no
shuffle (batch default, the only form in streams). The table form takes exploded
spans, e.g. rule spans united with model predictions: it removes duplicates, cuts
each document into runs of overlapping spans, and resolves every run on its own, so
one very long document spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import fixed
from cloakframe.functions.spans import all_differ, grouped, let, once, running, utf16_length
from cloakframe.operators.sweep import overlap_runs
from cloakframe.schema import SPAN_COLUMNS, SPAN_T, label_sql, level_sql, priority_sql, rank_sql

_SPANS = f"array<{SPAN_T}>"


def _span(**changes: str) -> str:
    """A copy of span ``x`` with some fields replaced."""
    return "named_struct(" + ", ".join(f"'{c}', {changes.get(c, f'x.{c}')}" for c in SPAN_COLUMNS) + ")"


def _order(*keys: str) -> str:
    """A comparator over spans ``l`` and ``r`` from ascending key expressions on ``@``."""
    cases = " ".join(
        f"WHEN {k.replace('@', 'l')} < {k.replace('@', 'r')} THEN -1 "
        f"WHEN {k.replace('@', 'l')} > {k.replace('@', 'r')} THEN 1"
        for k in keys
    )
    return f"(l, r) -> CASE {cases} ELSE 0 END"


# --- array form -------------------------------------------------------------------


def dedupe_array(spans: str) -> str:
    """Join spans of equal (start, end, type): sources united, confidence the maximum,
    everything else from the first in detector order."""
    ordered = f"array_sort({spans}, {_order('@.start', '@.end', '@.type', '@.ord')})"
    same = grouped(ordered, "gl.start <> gr.start OR gl.end <> gr.end OR gl.type <> gr.type", SPAN_T)
    joined = let("g[0]", "x", _span(
        confidence="array_max(transform(g, y -> y.confidence))",
        sources="array_sort(array_distinct(flatten(transform(g, y -> y.sources))))",
    ))
    return f"transform({same}, g -> if(size(g) = 1, g[0], {joined}))"


_QUALITY = ("-@.prio", "-@.confidence", "-(@.end - @.start)", "@.start", "@.ord", "@.type")


def _ranked(spans: str) -> str:
    """Best first: validated, priority, confidence, length, then the earlier start and detector."""
    prio = f"transform({spans}, x -> struct(x AS s, if(x.validated, 1000, 0) + {priority_sql('x.type')} AS prio))"
    keys = tuple(k.replace("@.prio", "#").replace("@.", "@.s.").replace("#", "@.prio") for k in _QUALITY)
    return f"transform(array_sort({prio}, {_order(*keys)}), y -> y.s)"


def _greedy(spans: str) -> str:
    """Keep a span unless a better one already covers part of it."""
    clash = "exists(kept, k -> k.start < x.end AND x.start < k.end)"
    return (
        f"aggregate({_ranked(spans)}, cast(array() AS {_SPANS}), "
        f"(kept, x) -> if({clash}, kept, array_append(kept, x)))"
    )


def _by_position(spans: str) -> str:
    return f"array_sort({spans}, {_order('@.start', '@.end', '@.ord')})"


def runs_array(ordered: str) -> str:
    """Spans in start order cut into runs: one opens where a span starts at or behind all ends before it."""
    reach = running("transform(ms, x -> x.end)", "greatest(ra, rx)", "-1")
    opens = "filter(sequence(1, size(ms)), mi -> if(mi = 1, true, element_at(ms, mi).start >= element_at(mr, greatest(mi - 1, 1))))"
    parts = "transform(mo, (mp, mk) -> slice(ms, mp, if(mk + 1 < size(mo), element_at(mo, mk + 2), size(ms) + 1) - mp))"
    return let(ordered, "ms", f"if(size(ms) = 0, array(ms), {let(reach, 'mr', let(opens, 'mo', parts))})")


def merge_array(spans: str) -> str:
    """Empty spans dropped, duplicates joined, then overlaps resolved run by run (a run: spans chained by overlap)."""
    place = "shiftleft(cast(ax.start AS bigint), 32) + ax.end"  # spans that all have places of their own are no duplicates
    runs = runs_array(_by_position(f"if({all_differ('full', place)}, full, {dedupe_array('full')})"))
    pick = f"transform({runs}, run -> if(size(run) = 1, run, {_by_position(_greedy('run'))}))"
    return let(f"filter({spans}, x -> x.end > x.start)", "full", f"if(size(full) = 0, full, flatten({pick}))")


def level_array(spans: str) -> str:
    """Write the resolved level into every span."""
    level = level_sql("x.type", "x.semantic_type", "x.privacy_level")
    return f"transform({spans}, x -> {_span(privacy_level=level)})"


def policy_array(spans: str, policy: str | None) -> str:
    """Keep levels at or above the policy; an unknown policy filters nothing."""
    if effective_policy(policy) is None:
        return spans
    need = fixed.LEVELS.index(policy.upper()) + 1
    return f"filter({spans}, x -> {rank_sql('x.privacy_level')} >= {need})"


def effective_policy(policy: str | None) -> str | None:
    return policy.upper() if policy and policy.upper() in fixed.LEVELS else None


def arbitrate(docs: DataFrame, policy: str | None = None, spans: str = "spans") -> DataFrame:
    """Array form of the whole step: merge, level, then policy, in this order.

    The policy comes last on purpose: a low-level winner may suppress an overlapping
    high-level loser.
    """
    return once(docs, **{spans: policy_array(level_array(merge_array(spans)), policy)})


def counts_array(spans: str) -> str:
    """Count by type as a map, in order of first appearance."""
    types = f"transform({spans}, x -> x.type)"  # at most as many as there are types
    return (
        f"map_from_entries(transform(array_distinct({types}), t -> struct(t, size(filter({spans}, x -> x.type = t)))))"
    )


def utf16_offset(text: str, at: str) -> str:
    return utf16_length(f"substring({text}, 1, {at})")


def report_array(text: str, spans: str) -> str:
    """Output form of a span: label, UTF-16 offsets, confidence at four digits."""
    wide = f"rlike({text}, '[\\\\x{{10000}}-\\\\x{{10FFFF}}]')"
    at = lambda f: f"if({wide}, {utf16_offset(text, f)}, {f})"
    return (
        f"transform({spans}, x -> named_struct('type', x.type, 'label', {label_sql('x.type')}, "
        f"'start', x.start, 'end', x.end, 'start_utf16', {at('x.start')}, 'end_utf16', {at('x.end')}, "
        "'text', x.text, 'confidence', round(x.confidence, 4), 'sources', x.sources, 'validated', x.validated, "
        "'privacy_level', x.privacy_level, 'semantic_type', x.semantic_type))"
    )


def detection_report(docs: DataFrame, policy: str | None = None) -> DataFrame:
    """Result row per document: entities, counts, engines, warnings, policy and length."""
    out = docs if "engines" in docs.columns else docs.withColumn("engines", F.lit(None).cast("array<string>"))
    out = out if "warnings" in out.columns else out.withColumn("warnings", F.array().cast("array<string>"))
    return arbitrate(out, policy).select(
        "doc_id",
        F.expr(report_array("text", "spans")).alias("entities"),
        F.expr(counts_array("spans")).alias("counts"),
        "engines",
        "warnings",
        F.lit(effective_policy(policy) or fixed.DEFAULT_LEVEL).alias("policy_level"),
        F.length("text").alias("text_length"),
    )


# --- table form ---------------------------------------------------------------------


def dedupe_spans(spans: DataFrame) -> DataFrame:
    """Table form of the duplicate join; partial aggregation absorbs repeated rows map-side.

    ``collect_set`` holds distinct source lists only, of which there are a handful.
    """
    first = F.min_by(F.struct("text", "validated", "privacy_level", "semantic_type"), "ord")
    return (
        spans.groupBy("doc_id", "start", "end", "type")
        .agg(
            first.alias("f"),
            F.max("confidence").alias("confidence"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
            F.min("ord").alias("ord"),
        )
        .select(
            "doc_id", "start", "end", "type", "f.text", "confidence", "sources", "f.validated",
            "f.privacy_level", "f.semantic_type", "ord",
        )
    )


def merge_spans(spans: DataFrame) -> DataFrame:
    """Table form: empty spans dropped, duplicates joined, then the greedy choice inside each overlap run."""
    runs = overlap_runs(dedupe_spans(spans.filter(F.col("end") > F.col("start"))))
    packed = runs.groupBy("doc_id", "run").agg(F.collect_list(F.struct(*SPAN_COLUMNS)).cast(_SPANS).alias("s"))
    kept = packed.withColumn("s", F.expr(f"if(size(s) = 1, s, {_greedy('s')})"))
    return kept.select("doc_id", F.explode_outer("s").alias("s")).select("doc_id", "s.*")


def resolve_level(spans: DataFrame) -> DataFrame:
    return spans.withColumn("privacy_level", F.expr(level_sql()))


def policy_filter(spans: DataFrame, policy: str | None) -> DataFrame:
    """Filter on the resolved level; reads the output of the merge."""
    if effective_policy(policy) is None:
        return spans
    return spans.filter(F.expr(rank_sql("privacy_level")) >= fixed.LEVELS.index(policy.upper()) + 1)


def entity_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def span_row(**cols: Column | str) -> list[Column]:
    """Span columns with defaults for those not given."""
    base = {
        "confidence": F.lit(1.0),
        "sources": F.array().cast("array<string>"),
        "validated": F.lit(False),
        "privacy_level": F.lit(None).cast("string"),
        "semantic_type": F.lit(None).cast("string"),
        "ord": F.lit(0),
    }
    made = {**base, **{k: F.col(v) if isinstance(v, str) else v for k, v in cols.items()}}
    return [made[c].alias(c) for c in SPAN_COLUMNS]
