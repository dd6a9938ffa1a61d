"""Reversible masking: stable tokens, masked text, vault, restore and their gates.

The array form keeps one row per document and never shuffles. Tokens are numbered by
first appearance of a value within (document, type) and carry a short fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloakframe import fixed
from cloakframe.functions.spans import all_differ, cut, grouped, let, once, pieces, q
from cloakframe.operators import detect
from cloakframe.operators.arbitrate import arbitrate, merge_array, runs_array
from cloakframe.operators.sweep import block_numbers, spread
from cloakframe.schema import SPAN_T, label_sql

OK, COLLISION, OVERLAP, BAD_SPAN = "ok", "token_collision", "overlap", "bad_span"
ITEM_T = "array<struct<start:int,end:int,type:string,text:string,label:string,token:string>>"


# --- tokens ---------------------------------------------------------------------------


def _clean_label(label: str) -> str:
    return f"regexp_replace({label}, {q(r'(?U)[\s/]+')}, '_')"


def token_sql(type_: str, label: str, text: str, number: str) -> str:
    """``⟦label_NN_FFFF⟧``: two digits at least, FFFF the first two bytes of a SHA-256."""
    nn = f"if({number} < 10, concat('0', {number}), cast({number} AS string))"
    mark = f"upper(substring(sha2(concat({type_}, '\\0', {text}), 256), 1, 4))"
    return f"concat('⟦', {_clean_label(label)}, '_', {nn}, '_', {mark}, '⟧')"


def items_array(spans: str) -> str:
    """Spans with label and token, in document order."""
    by = lambda *keys: "(l, r) -> CASE " + " ".join(
        f"WHEN {k.replace('@', 'l')} < {k.replace('@', 'r')} THEN -1 WHEN {k.replace('@', 'l')} > {k.replace('@', 'r')} THEN 1" for k in keys
    ) + " ELSE 0 END"
    # One group per value, values by first appearance, one group of values per type: a value's place there is its number.
    values = grouped(f"array_sort({spans}, {by('@.type', '@.text', '@.start')})", "gl.type <> gr.type OR gl.text <> gr.text", SPAN_T)
    types = grouped(f"array_sort({values}, {by('@[0].type', '@[0].start', '@[0].text')})", "gl[0].type <> gr[0].type", f"array<{SPAN_T}>")
    item = lambda number: (
        f"named_struct('start', x.start, 'end', x.end, 'type', x.type, 'text', x.text, "
        f"'label', {label_sql('x.type')}, 'token', {token_sql('x.type', label_sql('x.type'), 'x.text', number)})"
    )
    made = f"flatten(transform({types}, t -> flatten(transform(t, (g, n) -> transform(g, x -> {item('(n + 1)')})))))"
    # Where no type occurs twice, each value is the first of its type.
    made = f"if({all_differ(spans, 'ax.type')}, transform({spans}, x -> {item('1')}), {made})"
    return (
        f"if(size({spans}) = 0, cast(array() AS {ITEM_T}), cast(array_sort({made}, {by('@.start', '@.end', '@.type')}) AS {ITEM_T}))"
    )


def allocate_tokens(spans: DataFrame) -> DataFrame:
    """Table form: number the distinct values of a (document, type) by their first start.

    Values find their first start by themselves, are numbered inside blocks of positions, and blocks carry how many values the
    earlier ones hold; so a document with very many spans spreads over tasks. The plan behind ``spans`` runs once.
    """
    spans = spread(spans, "doc_id", "type", "text")  # read by the numbers and by their sums: what is behind is not run again
    first = F.min("start").over(W.partitionBy("doc_id", "type", "text"))
    label = label_sql() if "label" not in spans.columns else "label"
    return (
        block_numbers(spans.withColumn("_first", first), ("doc_id", "type"), "_first", ("_first", "text"), "_n")
        .withColumn("label", F.expr(label))
        .withColumn("token", F.expr(token_sql("type", "label", "text", "_n")))
        .drop("_n", "_first")
    )


# --- masked text ------------------------------------------------------------------------


def mask_array(text: str, items: str) -> str:
    """Substitute spans left to right."""
    gap = cut("tp", "if(i = 0, 0, element_at(ti, greatest(i, 1)).end)", "x.start")
    rest = cut("tp", "if(size(ti) = 0, 0, element_at(ti, -1).end)", f"length({text})")
    joined = f"concat(array_join(transform(ti, (x, i) -> concat({gap}, x.token)), ''), {rest})"
    return let(items, "ti", f"if(size(ti) = 0, {text}, {let(pieces(text), 'tp', joined)})")


def status_array(text: str, items: str) -> str:
    """Fail closed: one token for two values, or overlapping spans, make the document invalid."""
    by_token = f"array_sort({items}, (l, r) -> CASE WHEN l.token < r.token THEN -1 WHEN l.token > r.token THEN 1 ELSE 0 END)"
    shared = let(by_token, "si", "exists(sequence(1, size(si)), i -> if(i < 2, false, element_at(si, i).token = element_at(si, i - 1).token "
                 "AND element_at(si, i).text <> element_at(si, i - 1).text))")
    walk = let(items, "si", "exists(sequence(1, size(si)), i -> element_at(si, i).start < if(i < 2, 0, element_at(si, i - 1).end))")
    outside = let(f"length({text})", "tn", f"exists({items}, x -> x.start < 0 OR x.end <= x.start OR x.end > tn)")
    return (
        f"CASE WHEN size({items}) = 0 THEN '{OK}' WHEN {shared} THEN '{COLLISION}' WHEN {walk} THEN '{OVERLAP}' "
        f"WHEN {outside} THEN '{BAD_SPAN}' ELSE '{OK}' END"
    )


def vault_array(items: str) -> str:
    """One entry per token, in document order."""
    by = "(l, r) -> CASE WHEN l.token < r.token THEN -1 WHEN l.token > r.token THEN 1 WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 ELSE 0 END"
    item = ITEM_T.removeprefix("array<").removesuffix(">")
    first = f"transform({grouped(f'array_sort({items}, {by})', 'gl.token <> gr.token OR gl.text <> gr.text', item)}, g -> g[0])"
    first = f"if({all_differ(items, 'ax.token')}, {items}, {first})"
    placed = f"array_sort({first}, (l, r) -> CASE WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 ELSE 0 END)"
    return f"transform({placed}, x -> named_struct('token', x.token, 'value', x.text, 'type', x.type, 'label', x.label))"


def mask_items(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Add ``items`` to documents with merged spans."""
    return once(docs, items=items_array(spans))


def mask_spans(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Add ``items``, ``status``, ``masked`` (null unless ok) and ``vault`` to documents with merged spans.

    The vault is a plain column: a reader that leaves it out does not pay for it.
    """
    masked = f"named_struct('status', ms, 'masked', if(ms = '{OK}', {mask_array('text', 'items')}, NULL))"
    made = once(mask_items(docs, spans), _m=let(status_array("text", "items"), "ms", masked))
    done = made.withColumn("status", F.col("_m.status")).withColumn("masked", F.col("_m.masked")).drop("_m")
    return done.withColumn("vault", F.expr(f"filter({vault_array('items')}, v -> status = '{OK}')"))


def protect(docs: DataFrame, policy: str | None = None, **scan_options) -> DataFrame:
    """Detect, arbitrate and mask in one pass over the documents, without a shuffle."""
    return mask_spans(arbitrate(detect.scan(docs, **scan_options), policy))


def build_vault(masked: DataFrame) -> DataFrame:
    """The vault table: one row per distinct (token, value) of a document."""
    return (
        masked.select("doc_id", F.explode_outer("vault").alias("v")).filter("v IS NOT NULL").select("doc_id", "v.*")
    )


def redacted_segments(docs: DataFrame, items: str = "items") -> DataFrame:
    """Text and token pieces in order; spans that are empty, outside or overlapping are skipped."""
    piece = lambda kind, text, a, b, label: (
        f"named_struct('kind', {kind}, 'text', {text}, 'source_start', {a}, 'source_end', {b}, 'label', {label})"
    )
    kind = "array<struct<kind:string,text:string,source_start:int,source_end:int,label:string>>"
    ordered = (
        f"array_sort({let('length(text)', 'tn', f'filter({items}, x -> x.start >= 0 AND x.end > x.start AND x.end <= tn)')}, (l, r) -> CASE "
        "WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 WHEN l.end < r.end THEN -1 WHEN l.end > r.end THEN 1 ELSE 0 END)"
    )
    # Inside a run of overlapping items each counts that starts behind the last counted one.
    pick = (
        f"aggregate(run, named_struct('pos', 0, 'out', cast(array() AS {ITEM_T})), (a, x) -> if(x.start < a.pos, a, "
        "named_struct('pos', x.end, 'out', array_append(a.out, cast(named_struct("
        + ", ".join(f"'{f}', x.{f}" for f in ("start", "end", "type", "text", "label", "token")) + f") AS {ITEM_T[6:-1]})))), a -> a.out)"
    )
    kept = f"flatten(transform({runs_array(ordered)}, run -> {pick}))"
    here = "if(i = 0, 0, element_at(k, greatest(i, 1)).end)"
    gap = piece("'text'", cut("tp", here, "x.start"), here, "x.start", "cast(NULL AS string)")
    token = piece("'token'", "x.token", "x.start", "x.end", "x.label")
    end = "if(size(k) = 0, 0, element_at(k, -1).end)"
    rest = piece("'text'", cut("tp", end, "length(text)"), end, "length(text)", "cast(NULL AS string)")
    parts = f"flatten(transform(k, (x, i) -> concat(if(x.start > {here}, array({gap}), cast(array() AS {kind})), array({token}))))"
    walk = let(kept, "k", let(pieces("text"), "tp", f"concat(cast({parts} AS {kind}), if({end} < length(text), array({rest}), cast(array() AS {kind})))"))
    segments = docs.select("doc_id", F.expr(walk).alias("_p"))
    return segments.select("doc_id", F.posexplode_outer("_p").alias("seq", "p")).filter("p IS NOT NULL").select(
        "doc_id", "seq", "p.*"
    )


def mask_checks(spans: DataFrame) -> DataFrame:
    """Table form of the fail-closed checks over spans with tokens: one status per document."""
    clash = (
        spans.groupBy("doc_id", "token")
        .agg(F.min("text").alias("_a"), F.max("text").alias("_b"))
        .filter("_a <> _b")
        .select("doc_id")
        .distinct()
        .withColumn("_clash", F.lit(True))
    )
    # Neighbours in start order: an overlap exists exactly if some neighbours overlap.
    step = W.partitionBy("doc_id").orderBy("start", "end")
    near = (
        spans.select("doc_id", "start", "end")
        .withColumn("_prev", F.lag("end").over(step))
        .groupBy("doc_id")
        .agg(F.coalesce(F.bool_or(F.col("_prev") > F.col("start")), F.lit(False)).alias("_over"))
    )
    return near.join(clash, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("_clash"), COLLISION).when(F.col("_over"), OVERLAP).otherwise(OK).alias("status"),
    )


def mask_preview(value: str) -> str:
    """Short preview of a value: its first characters, dots, and the last one."""
    n = f"length({value})"
    short = f"concat(substring({value}, 1, 1), repeat('•', greatest(1, {n} - 1)))"
    long = f"concat(substring({value}, 1, 2), repeat('•', least(8, {n} - 3)), right({value}, 1))"
    return f"if({n} <= 3, {short}, {long})"


def handover_text(masked: DataFrame) -> DataFrame:
    """The fixed keep-the-placeholders note in front of the masked text."""
    return masked.select("doc_id", F.concat(F.lit(fixed.HANDOVER_NOTE), F.col("masked")).alias("handover"))


# --- restore ------------------------------------------------------------------------------

UNKNOWN = r"⟦[^⟦⟧\n]{2,80}⟧"


def restore_array(reply: str, vault: str) -> str:
    """Replace tokens by their values; the reply is cut at its placeholders once, and each is looked up.

    Where a value or a token holds a placeholder inside, order matters: longer tokens are then replaced first, one after
    the other. Both ways give the same result otherwise.
    """
    return f"if(exists({vault}, v -> contains(v.value, '⟦') OR NOT rlike(v.token, {q(WHOLE)})), {_one_by_one(reply, vault)}, {_looked_up(reply, vault)})"


_RESTORED = "struct<out:string,replaced:int,missing:array<string>>"
WHOLE = r"^⟦[^⟦⟧]*⟧$"


def _looked_up(reply: str, vault: str) -> str:
    # Marks are cut off the reply; sorted together with the vault's tokens, equal ones stand side by side.
    marks = f"regexp_extract_all({reply}, '⟦[^⟦⟧]*⟧', 0)"
    row = "named_struct('token', {0}, 'at', {1}, 'value', {2})"
    rows = (
        f"concat(transform({vault}, v -> {row.format('v.token', '-1', 'v.value')}), "
        f"transform(lm, (m, i) -> {row.format('m', 'i', 'cast(NULL AS string)')}))"
    )
    by = "(l, r) -> CASE WHEN l.token < r.token THEN -1 WHEN l.token > r.token THEN 1 WHEN l.at < r.at THEN -1 WHEN l.at > r.at THEN 1 WHEN l.value < r.value THEN -1 WHEN l.value > r.value THEN 1 ELSE 0 END"
    same = grouped(f"array_sort({rows}, {by})", "gl.token <> gr.token", "struct<token:string,at:int,value:string>")
    filled = (
        "array_sort(flatten(transform(lg, g -> transform(filter(g, x -> x.at >= 0), x -> named_struct('at', x.at, "
        "'hit', g[0].at < 0, 'value', if(g[0].at < 0, g[0].value, x.token))))), (l, r) -> l.at - r.at)"
    )
    lost = "transform(filter(lg, g -> g[0].at < 0 AND element_at(g, -1).at < 0), g -> g[0].token)"
    ordered = "array_sort({0}, (l, r) -> CASE WHEN length(l) > length(r) THEN -1 WHEN length(l) < length(r) THEN 1 WHEN l < r THEN -1 WHEN l > r THEN 1 ELSE 0 END)"
    text = f"concat(array_join(zip_with(slice(lt, 1, size(lf)), lf, (t, f) -> concat(t, f.value)), ''), element_at(lt, -1))"
    body = (
        f"named_struct('out', {text}, 'replaced', size(filter(lf, f -> f.hit)), 'missing', {ordered.format(lost)})"
    )
    return let(marks, "lm", let(same, "lg", let(filled, "lf", let(f"split({reply}, '⟦[^⟦⟧]*⟧', -1)", "lt", f"cast({body} AS {_RESTORED})"))))


def _one_by_one(reply: str, vault: str) -> str:
    ordered = (
        f"array_sort({vault}, (l, r) -> CASE WHEN length(l.token) > length(r.token) THEN -1 "
        "WHEN length(l.token) < length(r.token) THEN 1 WHEN l.token < r.token THEN -1 "
        "WHEN l.token > r.token THEN 1 ELSE 0 END)"
    )
    hits = "cast((length(a.out) - length(replace(a.out, x.token, ''))) / length(x.token) AS int)"
    return (
        f"aggregate({ordered}, cast(named_struct('out', {reply}, 'replaced', 0, 'missing', cast(array() AS array<string>)) AS {_RESTORED}), "
        "(a, x) -> if(contains(a.out, x.token), "
        f"named_struct('out', replace(a.out, x.token, x.value), 'replaced', a.replaced + {hits}, 'missing', a.missing), "
        "named_struct('out', a.out, 'replaced', a.replaced, 'missing', array_append(a.missing, x.token))))"
    )


def restore_columns(df: DataFrame, reply: str = "reply", vault: str = "vault") -> DataFrame:
    """Restore where reply and vault are in one row: text, counts, unknown and missing tokens."""
    return (
        once(df, _r=restore_array(reply, vault))
        .withColumn("restored", F.col("_r.out"))
        .withColumn("replaced", F.col("_r.replaced"))
        .withColumn("unknown", F.expr(f"regexp_extract_all(_r.out, {q(UNKNOWN)}, 0)"))
        .withColumn("missing", F.col("_r.missing"))
        .withColumn("nested", F.expr(f"exists({vault}, v -> contains(v.value, '⟦'))"))
        .drop("_r")
    )


def restore(replies: DataFrame, vault: DataFrame) -> DataFrame:
    """Join replies to their vault by document and restore them.

    A vault is packed per document: its size is bounded by the distinct values of one
    text, which the intake limit bounds. Replies without a vault pass unchanged.
    """
    packed = vault.groupBy("doc_id").agg(F.collect_list(F.struct("token", "value", "type", "label")).alias("vault"))
    empty = "cast(array() AS array<struct<token:string,value:string,type:string,label:string>>)"
    joined = replies.join(packed, "doc_id", "left").withColumn("vault", F.expr(f"coalesce(vault, {empty})"))
    return restore_columns(joined).drop("vault")


# --- gates --------------------------------------------------------------------------------


def fixed_form_items(spans: str) -> str:
    """Tokens of fixed form ``⟦TYPE_01_xxxxxxxx⟧`` for gates."""
    return (
        f"cast(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'type', x.type, 'text', x.text, "
        "'label', x.type, 'token', concat('⟦', x.type, '_01_', substring(sha1(concat(x.type, x.text)), 1, 8), '⟧'))) "
        f"AS {ITEM_T})"
    )


def fast_mask(docs: DataFrame, rules=None, text: str = "text", out: str = "masked") -> DataFrame:
    """Rule spans only, merged, masked with fixed-form tokens. Adds ``out``."""
    found = detect.scan(docs, rules, extraction=False, text=text, out="_s")
    merged = once(found, _s=merge_array("_s"))
    items = once(merged, _i=fixed_form_items("_s"))
    return once(items, **{out: mask_array(text, "_i")}).drop("_s", "_i")


def idempotence_gate(docs: DataFrame, rules=None) -> DataFrame:
    """Per document: mask(mask(x)) = mask(x), and nothing is detected in the masked text."""
    once = fast_mask(docs, rules, "text", "masked")
    twice = fast_mask(once, rules, "masked", "masked_again")
    again = detect.scan(twice, rules, extraction=False, text="masked", out="_again")
    return again.select(
        "doc_id",
        F.col("masked").eqNullSafe(F.col("masked_again")).alias("idempotent"),
        F.size("_again").alias("redetected"),
        F.expr("exists(_again, x -> contains(x.text, '⟦'))").alias("placeholder_hit"),
    )


def roundtrip_gate(masked: DataFrame) -> DataFrame:
    """restore(mask(x)) = x for every valid document."""
    ok = masked.filter(f"status = '{OK}'")
    back = restore_columns(ok, "masked", "vault")
    return back.select("doc_id", F.col("restored").eqNullSafe(F.col("text")).alias("same"))


def stability_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Documents whose set of normalised surfaces differs between two runs.

    Both inputs hold (doc_id, text) surfaces, which are exchanged once, side by side; no set is ever gathered in one row.
    Null ids and surfaces equal none of the other side.
    """
    norm = "lower(trim(regexp_replace(text, '(?U)\\\\s+', ' ')))"
    side = lambda df, own: df.select("doc_id", F.expr(norm).alias("surface"), F.lit(own).alias("_first"))
    both = spread(side(first, True).unionByName(side(second, False)), "doc_id", "surface")
    met = both.groupBy("doc_id", "surface").agg(F.bool_or("_first").alias("_a"), F.bool_or(~F.col("_first")).alias("_b"))
    lone = "if(doc_id IS NULL OR surface IS NULL, int(_a) + int(_b), int(_a <> _b))"
    return (
        met.groupBy("doc_id")
        .agg(F.sum(F.expr(lone)).cast("long").alias("differences"))
    )


def token_reuse(spans: DataFrame) -> DataFrame:
    """Per repeated value: how many mentions and how many tokens (one token is stable)."""
    return (
        spans.groupBy("doc_id", "type", "text")
        .agg(F.count("*").alias("mentions"), F.count_distinct("token").alias("tokens"))
        .filter("mentions > 1")
    )
