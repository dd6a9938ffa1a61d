"""Model predictions as a table: parsing, checking, labelling, chunking and decoding.

Inference itself is a function the caller brings (``infer``). Everything else is
column work: sequential steps that carry state (cursors, taken spans) are folds over
the few candidates of one document, inside its row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloakframe import fixed
from cloakframe.functions.checks import strip
from cloakframe.functions.spans import literal_spans, once, overlapping_starts, q
from cloakframe.operators.sweep import spread
from cloakframe.schema import PREDICTION_DDL, _map, level_sql

# --- occurrences --------------------------------------------------------------------


def occurrences(docs: DataFrame, fragment: str, overlapping: bool = True) -> DataFrame:
    """Start offsets of a literal (a column of ``docs``) in each text, in order."""
    if overlapping:
        hits = F.expr(overlapping_starts("text", fragment))
    else:
        hits = F.expr(f"transform({literal_spans('text', fragment)}, s -> s.start)")
    return docs.select("doc_id", F.col(fragment), F.explode_outer(hits).alias("start")).filter("start IS NOT NULL")


# --- raw output to spans --------------------------------------------------------------


def _field(v: str, *names: str) -> str:
    """The first non-empty string among some keys of a JSON object."""
    return "coalesce(" + ", ".join(f"nullif(try_variant_get({v}, '$.{n}', 'string'), '')" for n in names) + ")"


def _number(v: str, kind: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"try_variant_get({v}, '$.{n}', '{kind}')" for n in names) + ")"


def normalise_predictions(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans from raw JSON output of four shapes.

    Shapes: ``{"output": [[item]]}``, ``{"output": [item]}``, ``[item]`` and
    ``{label: [item or string]}``. Offsets are trusted only where they spell the span;
    otherwise the n-th such item of one span text takes its n-th occurrence.
    """
    items = "try_variant_get(j, '$', 'array<variant>')"
    output = "try_variant_get(j, '$.output', 'array<variant>')"
    flat = f"flatten(transform({output}, x -> coalesce(try_variant_get(x, '$', 'array<variant>'), array(x))))"
    plain = "transform({}, x -> struct(cast(NULL AS string) AS label, x AS item))"
    by_label = (
        "flatten(transform(map_entries(try_variant_get(j, '$', 'map<string,variant>')), e -> "
        "transform(coalesce(try_variant_get(e.value, '$', 'array<variant>'), array()), "
        "x -> struct(e.key AS label, x AS item))))"
    )
    listed = raw.withColumn("j", F.expr("try_parse_json(raw)")).select(
        "doc_id",
        F.posexplode_outer(
            F.expr(f"coalesce({plain.format(flat)}, {plain.format(items)}, {by_label})")
        ).alias("pos", "it"),
    )
    text_item = "if(schema_of_variant(it.item) = 'STRING', try_variant_get(it.item, '$', 'string'), NULL)"
    fields = listed.filter("it IS NOT NULL").select(
        "doc_id",
        "pos",
        F.expr(f"coalesce({_field('it.item', 'type')}, it.label, {_field('it.item', 'label')}, '实体')").alias("label"),
        F.expr(
            f"coalesce({_field('it.item', 'span', 'text', 'entity')}, if(it.label IS NULL, NULL, {text_item}))"
        ).alias("text_of_span"),
        F.expr(
            f"coalesce(nullif({_number('it.item', 'double', 'probability')}, 0D), "
            f"nullif({_number('it.item', 'double', 'score')}, 0D), 0.92D)"
        ).alias("score"),
        F.expr(
            f"coalesce({_number('it.item', 'int', 'start')}, try_variant_get(it.item, '$.offset[0]', 'int'))"
        ).alias("s"),
        F.expr(
            f"if({_number('it.item', 'int', 'start')} IS NULL, try_variant_get(it.item, '$.offset[1]', 'int'), "
            f"{_number('it.item', 'int', 'end')})"
        ).alias("e"),
    )
    joined = fields.filter("text_of_span IS NOT NULL").join(docs.select("doc_id", "text"), "doc_id")
    trusted = (
        "s >= 0 AND s < e AND e <= length(text) AND substring(text, s + 1, e - s) = text_of_span"
    )
    nth = W.partitionBy("doc_id", "text_of_span", "ok").orderBy("pos")
    placed = (
        joined.withColumn("ok", F.expr(f"coalesce({trusted}, false)"))
        .withColumn("n", F.row_number().over(nth))
        .withColumn(
            "start",
            F.expr(f"if(ok, s, get(transform({literal_spans('text', 'text_of_span')}, x -> x.start), n - 1))"),
        )
    )
    return placed.filter("start IS NOT NULL").select(
        "doc_id",
        "pos",
        "label",
        "start",
        F.expr("start + length(text_of_span)").cast("int").alias("end"),
        F.col("text_of_span").alias("text"),
        "score",
    )


def check_offsets(predictions: DataFrame, docs: DataFrame) -> DataFrame:
    """Keep spans that lie inside their text and spell what they claim (or claim nothing)."""
    texts = docs.select("doc_id", F.col("text").alias("_doc"))
    actual = "substring(_doc, start + 1, end - start)"
    return (
        predictions.join(texts, "doc_id")
        .filter("start >= 0 AND end > start AND end <= length(_doc)")
        .filter(f"coalesce(text, '') = '' OR {actual} = text")
        .withColumn("text", F.expr(actual))
        .drop("_doc")
    )


def strip_tag(label: str) -> str:
    return f"regexp_replace({label}, '^[BIES]-', '')"


def map_labels(predictions: DataFrame, family: str = "span") -> DataFrame:
    """Raw label to (type, semantic type). The label map is a constant of the plan."""
    label = strip("label")
    if family in ("span", "semantic"):
        table = fixed.SPAN_LABELS if family == "span" else fixed.SEMANTIC_LABELS
        key = f"lower({label})"
        known = lambda i: f"element_at({_map({k: v[i] for k, v in table.items()})}, {key})"
        default = f"upper({key})" if family == "span" else f"replace(upper({label}), ' ', '_')"
        raw = key if family == "span" else label
        return predictions.withColumn("type", F.expr(f"coalesce({known(0)}, {default})")).withColumn(
            "semantic_type", F.expr(f"coalesce({known(1)}, {raw})")
        )
    if family == "chinese":
        guess = (
            "CASE WHEN rlike(label, '机构|公司|学校|院') THEN 'ORGANIZATION' "
            "WHEN contains(label, '名') THEN 'CN_NAME' ELSE 'CN_ADDRESS' END"
        )
        type_ = f"coalesce(element_at({_map(fixed.CHINESE_LABELS)}, label), {guess})"
    else:
        table, bare = _map(fixed.CHALLENGER_LABELS[family]), strip_tag(label)
        tries = ", ".join(f"element_at({table}, {k})" for k in (bare, f"upper({bare})", f"lower({bare})"))
        type_ = f"coalesce({tries}, lower({bare}))"
    return predictions.withColumn("type", F.expr(type_)).withColumn("semantic_type", F.lit(None).cast("string"))


def threshold(predictions: DataFrame, at: float = fixed.PREDICTION_THRESHOLD) -> DataFrame:
    """Score filter; reaches the Parquet scan of a stored prediction table."""
    return predictions.filter(F.col("score") >= F.lit(at))


# Vocabulary of the user-name filter.
_ACCOUNT_WORDS = (
    "用户名", "用户名称", "登录账号", "登录帐号", "登录id", "账号", "账户名", "帐号", "username", "user name",
    "login id", "account name",
)
_NARRATIVE = (
    "今天", "明天", "昨天", "去了", "来了", "然后", "打电话", "联系了", "上班", "下班", "吃饭", "回家", "发生",
    "看到", "听到", "觉得", "因为", "所以", "如果", "但是", "而且", "不过", "由于", "不仅", "公司", "会议",
    "工作", "报告", "讨论", "协商", "安排",
)
_CJK_ALL = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2CEAF}]"


def plausible_username_sql(value: str, doc: str = "_doc") -> str:
    """A user name: an ASCII token, or a short CJK handle next to an account word."""
    v = strip(value)
    around = (
        f"lower(concat(substring({doc}, greatest(start - 30, 0) + 1, least(start, 30)), '\\n', "
        f"substring({doc}, end + 1, 20)))"
    )
    near = " OR ".join(f"contains({around}, {q(w)})" for w in _ACCOUNT_WORDS)
    token = f"rlike({v}, '[a-zA-Z0-9]') AND rlike({v}, '^[a-zA-Z0-9_@.-]+$') AND length(rtrim('.', {v})) >= 2"
    handle = (
        f"({near}) AND length({v}) <= 20 AND size(split({v}, '(?U)\\\\s+')) <= 2 "
        f"AND NOT rlike({v}, '{'|'.join(_NARRATIVE)}')"
    )
    return (
        f"length({v}) BETWEEN 2 AND 40 AND NOT rlike({v}, '[，。！？；…\\n\\r,;!?]') "
        f"AND if(rlike({v}, {q(_CJK_ALL)}), {handle}, {token})"
    )


def plausible_username(predictions: DataFrame, docs: DataFrame) -> DataFrame:
    """Drop USERNAME predictions that do not read like one; other types pass."""
    texts = docs.select("doc_id", F.col("text").alias("_doc"))
    keep = f"type <> 'USERNAME' OR ({plausible_username_sql('text')})"
    return predictions.join(texts, "doc_id").filter(keep).drop("_doc")


def card_gate(predictions: DataFrame) -> DataFrame:
    """CREDIT_CARD spans hold one line and 12 to 19 digits; other types pass."""
    ok = "NOT rlike(text, '[\\n\\r]') AND length(regexp_replace(text, '(?U)\\\\D', '')) BETWEEN 12 AND 19"
    return predictions.filter(f"type <> 'CREDIT_CARD' OR ({ok})")


def prediction_spans(predictions: DataFrame, source: str, first_order: int = 2000) -> DataFrame:
    """Predictions in the span schema. Ties are ordered after all built-in detectors, among themselves by ``seq``, the place in
    the detector's own list, where given, else by a hash of place and type.
    """
    hashed = F.pmod(F.xxhash64("start", "end", "type"), F.lit(1_000_000)).cast("int")
    text_order = F.col("seq").cast("int") if "seq" in predictions.columns else hashed
    level = (
        F.col("privacy_level") if "privacy_level" in predictions.columns else F.lit(None).cast("string")
    )
    return predictions.select(
        "doc_id", F.col("start").cast("int"), F.col("end").cast("int"), "type", "text",
        F.round("score", 4).alias("confidence"), F.array(F.lit(source)).alias("sources"), F.lit(False).alias("validated"),
        level.alias("privacy_level"), "semantic_type", (F.lit(first_order) + text_order).alias("ord"),
    )


# --- generated text -------------------------------------------------------------------


def parse_generated(raw: DataFrame) -> DataFrame:
    """Items of a JSON array inside generated text; ``raw`` holds (doc_id, raw, text).

    Reasoning blocks and code fences are removed, trailing commas dropped, and single
    objects salvaged when the array does not parse. Snippets must occur in the text.
    """
    think = f"regexp_replace(raw, {q('(?s)<think>.*?</think>')}, '')"
    fence = q(r"(?s)```(?:json)?\s*(\[.*?\])\s*```")
    array = q(r"(?s)\[\s*\{.*?\}\s*\]")
    comma = q(r",\s*([\]\}])")
    cleaned = (
        raw.withColumn("c", F.expr(strip(think)))
        .withColumn(
            "c", F.expr("if(contains(c, '<think>') AND NOT contains(c, '</think>'), substring_index(c, '<think>', 1), c)")
        )
        .withColumn(
            "c",
            F.expr(
                f"coalesce(nullif(regexp_extract(c, {fence}, 1), ''), nullif(regexp_extract(c, {array}, 0), ''), c)"
            ),
        )
        .withColumn("c", F.expr(f"regexp_replace(c, {comma}, '$1')"))
        # In brackets, so that text after a first value makes the parse fail.
        .withColumn("j", F.expr("try_variant_get(try_parse_json(concat('[', c, ']')), '$', 'array<variant>')"))
    )
    salvage = f"transform(regexp_extract_all(c, {q('[{][^{}]*[}]')}, 0), x -> try_parse_json(x))"
    items = f"if(j IS NULL OR size(j) <> 1, {salvage}, try_variant_get(j[0], '$', 'array<variant>'))"
    one = cleaned.select("doc_id", "text", F.posexplode_outer(F.expr(items)).alias("seq", "v"))
    level = f"upper({strip(_field('v', 'privacy_level', 'level', 'pl', 'risk_level'))})"
    key = "lower(raw_type)"
    table = {k: v[0] for k, v in fixed.SEMANTIC_LABELS.items()}
    semantic = {k: v[1] for k, v in fixed.SEMANTIC_LABELS.items()}
    parsed = (
        one.filter("v IS NOT NULL AND startswith(schema_of_variant(v), 'OBJECT')")
        .withColumn("snippet", F.expr(strip(_field("v", "original_text", "text", "entity"))))
        .filter("length(snippet) > 0 AND contains(text, snippet)")
        .withColumn("raw_type", F.expr(strip(f"coalesce({_field('v', 'privacy_type', 'type', 'label')}, 'PII')")))
        .withColumn("type", F.expr(f"coalesce(element_at({_map(table)}, {key}), replace(upper(raw_type), ' ', '_'))"))
        .withColumn("semantic_type", F.expr(f"coalesce(element_at({_map(semantic)}, {key}), raw_type)"))
        .withColumn("own_level", F.expr(f"if({level} IN ('PL1', 'PL2', 'PL3', 'PL4'), {level}, NULL)"))
    )
    return parsed.select(
        "doc_id", "seq", "type", F.col("snippet").alias("text"), F.lit(0.95).alias("confidence"), "semantic_type",
        F.expr(f"coalesce(own_level, {level_sql(model_level='cast(NULL AS string)')})").alias("privacy_level"),
        F.expr(_field("v", "context", "context_hint")).alias("context_hint"),
    )


# --- snippets to offsets -----------------------------------------------------------------

_CAND = "struct<seq:int,type:string,text:string,confidence:double,semantic_type:string,privacy_level:string,context_hint:string>"


def _packed(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document with its candidates in order; only documents that have any."""
    have = set(candidates.columns)
    default = {"confidence": "0.8D", "semantic_type": "cast(NULL AS string)", "privacy_level": "cast(NULL AS string)",
               "context_hint": "cast(NULL AS string)"}
    fields = ", ".join(
        f"'{c}', {c if c in have else default[c]}"
        for c in ("seq", "type", "text", "confidence", "semantic_type", "privacy_level", "context_hint")
    )
    lists = candidates.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.expr(f"cast(named_struct({fields}) AS {_CAND})"))).alias("cands")
    )
    return lists.join(docs.select("doc_id", "text"), "doc_id")


def resolve_spans(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Place text snippets: (doc_id, seq, type, text, …) to spans or a reason for skipping.

    One occurrence: taken if free. Several: by the context hint (its exact place, else the
    best window sharing two characters or more), else the first free one after the cursor.
    The state (taken spans, cursor) is a fold over the candidates inside the row.
    """
    n = "length(c.text)"
    free = "filter(c.occ, o -> NOT exists(a.taken, t -> t.s < o + length(c.text) AND o < t.e))"
    direct_at = "(instr(text, c.context_hint) + instr(c.context_hint, c.text) - 2)"
    direct = (
        f"if(instr(text, c.context_hint) > 0 AND instr(c.context_hint, c.text) > 0 "
        f"AND array_contains(f.free, {direct_at}), {direct_at}, NULL)"
    )
    window = f"substring(text, greatest(o - 12, 0) + 1, least(o, 12) + {n} + 12)"
    shared = f"size(filter(split(c.context_hint, ''), ch -> length(ch) > 0 AND contains({window}, ch)))"
    best = (
        "aggregate(if(size(f.after) > 0, f.after, f.free), named_struct('at', -1, 'score', -1), "
        f"(b, o) -> if({shared} > b.score, named_struct('at', o, 'score', {shared}), b), "
        "b -> if(b.score >= 2, b.at, NULL))"
    )
    choice = (
        f"CASE WHEN size(c.occ) = 1 THEN get(f.free, 0) "
        f"WHEN length(c.context_hint) > 0 THEN coalesce({direct}, {best}) ELSE get(f.after, 0) END"
    )
    reason = (
        "CASE WHEN size(c.occ) = 0 THEN 'not_found' WHEN p.at IS NOT NULL THEN 'ok' "
        "WHEN size(c.occ) = 1 THEN 'occupied' WHEN length(c.context_hint) > 0 THEN 'no_context_match' "
        "ELSE 'ambiguous' END"
    )
    # ``element_at(transform(array(v), x -> …), 1)`` binds v once to a name.
    step = (
        f"element_at(transform(array(named_struct('free', {free}, 'after', filter({free}, o -> o >= a.cursor))), f -> "
        f"element_at(transform(array(named_struct('at', {choice})), p -> named_struct("
        f"'cursor', if(p.at IS NULL, a.cursor, p.at + {n}), "
        f"'taken', if(p.at IS NULL, a.taken, array_append(a.taken, named_struct('s', p.at, 'e', p.at + {n}))), "
        f"'out', array_append(a.out, named_struct('seq', c.seq, 'start', p.at, 'reason', {reason})))), 1)), 1)"
    )
    begin = (
        "named_struct('cursor', 0, 'taken', cast(array() AS array<struct<s:int,e:int>>), "
        "'out', cast(array() AS array<struct<seq:int,start:int,reason:string>>))"
    )
    usable = (
        "filter(transform(cands, c -> named_struct('seq', c.seq, 'type', c.type, "
        f"'text', {strip('c.text')}, 'confidence', c.confidence, 'semantic_type', c.semantic_type, "
        f"'privacy_level', c.privacy_level, 'context_hint', c.context_hint, "
        f"'occ', {overlapping_starts('text', strip('c.text'))})), c -> length(c.text) > 0)"
    )
    placed = (
        _packed(candidates, docs)
        .transform(once, cands=usable)
        .transform(once, placed=f"aggregate(cands, {begin}, (a, c) -> {step}, a -> a.out)")
        .select("doc_id", F.explode(F.arrays_zip("cands", "placed")).alias("z"))
        .select("doc_id", "z.cands.*", F.col("z.placed.start").alias("start"), F.col("z.placed.reason").alias("reason"))
    )
    return placed.select(
        "doc_id", "seq", "start", F.expr("start + length(text)").cast("int").alias("end"), "type", "text", "confidence",
        "semantic_type", F.expr(level_sql()).alias("privacy_level"), "reason",
    )


def align_sequential(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Place snippets strictly left to right from a cursor that never moves back."""
    at = "(locate(c.text, text, a.cursor + 1) - 1)"
    step = (
        f"if({at} >= 0, named_struct('cursor', {at} + length(c.text), 'out', array_append(a.out, "
        f"named_struct('seq', c.seq, 'start', {at}, 'reason', 'ok'))), named_struct('cursor', a.cursor, 'out', "
        "array_append(a.out, named_struct('seq', c.seq, 'start', cast(NULL AS int), 'reason', "
        "if(contains(text, c.text), 'out_of_order', 'not_found')))))"
    )
    begin = "named_struct('cursor', 0, 'out', cast(array() AS array<struct<seq:int,start:int,reason:string>>))"
    return (
        _packed(candidates, docs)
        .transform(once, cands="filter(cands, c -> length(c.text) > 0)")
        .transform(once, placed=f"aggregate(cands, {begin}, (a, c) -> {step}, a -> a.out)")
        .select("doc_id", F.explode(F.arrays_zip("cands", "placed")).alias("z"))
        .select(
            "doc_id", "z.cands.seq", F.col("z.placed.start").alias("start"),
            F.expr("z.placed.start + length(z.cands.text)").cast("int").alias("end"), "z.cands.type", "z.cands.text",
            "z.cands.confidence", F.col("z.placed.reason").alias("reason"),
        )
    )


# --- chunks -------------------------------------------------------------------------------

# Cut marks, best first, and the generation budgets by length.
DELIMITERS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";")
SINGLE_CHUNK = 3500
BUDGETS = ((1000, 256), (4000, 384), (None, 512))


def chunk_texts(docs: DataFrame, size: int = 3000, overlap: int = 200, whole: int = SINGLE_CHUNK) -> DataFrame:
    """Overlapping chunks for long texts: (doc_id, chunk, start, end, text).

    Texts of up to ``whole`` characters stay in one chunk; for a model that takes less, pass a smaller one with ``size``. A chunk ends after the best delimiter in its last ``overlap`` characters. The fold
    carries only the start offset, over as many steps as the text can need.
    """
    cuts = ", ".join(
        f"if(instr(w, {d}) > 0, length(w) - instr(reverse(w), reverse({d})) + 1, NULL)" for d in map(q, DELIMITERS)
    )
    first = f"greatest(a.start + 100, a.start + {size} - {overlap})"
    cut = (
        f"coalesce(element_at(transform(array(substring(text, {first} + 1, a.start + {size} - ({first}))), "
        f"w -> {first} + coalesce({cuts})), 1), a.start + {size})"
    )
    piece = "named_struct('start', a.start, 'end', {0}, 'text', substring(text, a.start + 1, {0} - a.start))"
    step = (
        f"CASE WHEN a.done THEN a WHEN a.start + {size} >= length(text) THEN named_struct('start', a.start, "
        f"'done', true, 'out', array_append(a.out, {piece.format('length(text)')})) "
        f"ELSE element_at(transform(array({cut}), c -> named_struct("
        f"'start', greatest(a.start + 1, c - {overlap}), "
        f"'done', greatest(a.start + 1, c - {overlap}) >= length(text), "
        f"'out', array_append(a.out, {piece.format('c')}))), 1) END"
    )
    kind = "array<struct<start:int,end:int,text:string>>"
    steps = f"sequence(1, cast(ceil(length(text) / greatest({size} - 2 * {overlap}, 1)) AS int) + 1)"
    walk = (
        f"aggregate({steps}, named_struct('start', 0, 'done', false, 'out', cast(array() AS {kind})), "
        f"(a, i) -> {step}, a -> a.out)"
    )
    one = "array(named_struct('start', 0, 'end', length(text), 'text', text))"
    chunks = f"if(length(text) <= {whole}, cast({one} AS {kind}), {walk})"
    return (
        docs.filter("length(text) > 0")
        .select("doc_id", F.posexplode(F.expr(chunks)).alias("chunk", "c"))
        .select("doc_id", "chunk", "c.*")
    )


def unchunk(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunk-local spans to document offsets, checked, the first chunk's copy kept."""
    moved = (
        spans.withColumn("start", (F.col("chunk_start") + F.col("start")).cast("int"))
        .withColumn("end", (F.col("chunk_start") + F.col("end")).cast("int"))
        .join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
        .filter("start >= 0 AND end <= length(_doc) AND substring(_doc, start + 1, end - start) = text")
        .drop("_doc")
    )
    rest = [c for c in moved.columns if c not in ("doc_id", "type", "start", "end", "text", "chunk_start")]
    agg = moved.groupBy("doc_id", "type", "start", "end", "text").agg(
        F.min_by(F.struct("chunk_start", *rest), "chunk_start").alias("f")
    )
    return agg.select("doc_id", "start", "end", "type", "text", *[f"f.{c}" for c in rest])


def generation_budget(text: str = "text") -> str:
    cases = " ".join(f"WHEN length({text}) <= {n} THEN {b}" for n, b in BUDGETS if n)
    return f"CASE {cases} ELSE {BUDGETS[-1][1]} END"


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Completeness per document from (doc_id, chunk, done, truncated)."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("done")).alias("completed"),
        F.count_if(F.col("truncated")).alias("truncated"),
    ).withColumn("incomplete", F.expr("completed > 0 AND completed < chunks"))


# --- token labels ----------------------------------------------------------------------------


def decode_bioes(tokens: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Token labels (doc_id, tok, start, end, label) to spans (doc_id, start, end, label).

    An island starts at each B or S and lasts to the next one. Its span grows over I of the
    same body and closes at the first E of it; any other E is a span by itself. O does not
    close a span.
    """
    doc = W.partitionBy("doc_id").orderBy("tok")
    tagged = spread(tokens.filter("start < end AND label <> 'O'"), "doc_id").select(
        "doc_id", "tok", "start", "end",
        F.expr("if(rlike(label, '^[BIES]-'), substring(label, 1, 1), 'S')").alias("tag"),
        F.expr("if(rlike(label, '^[BIES]-'), substring(label, 3), label)").alias("body"),
    )
    island = tagged.withColumn("isl", F.sum(F.expr("if(tag IN ('B', 'S'), 1, 0)")).over(doc))
    w = W.partitionBy("doc_id", "isl").orderBy("tok")
    prior = w.rowsBetween(W.unboundedPreceding, -1)
    marked = (
        island.withColumn("head", F.first(F.struct("tag", "body")).over(w))
        .withColumn("mine", F.expr("head.tag = 'B' AND body = head.body"))
        .withColumn("closed", F.coalesce(F.sum(F.expr("if(mine AND tag = 'E', 1, 0)")).over(prior), F.lit(0)) > 0)
        .withColumn("grows", F.expr("mine AND NOT closed"))
    )
    grown = (
        marked.filter("grows")
        .groupBy("doc_id", "isl")
        .agg(F.min("start").alias("start"), F.max_by("end", "tok").alias("end"), F.first("body").alias("label"))
        .select("doc_id", "start", "end", "label")
    )
    single = marked.filter("tag = 'S' OR (tag = 'E' AND NOT grows)").select(
        "doc_id", "start", "end", F.col("body").alias("label")
    )
    spans = grown.unionByName(single)
    if docs is None:
        return spans
    joined = spans.join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
    return joined.withColumn("text", F.expr(strip("substring(_doc, start + 1, end - start)"))).drop("_doc").filter(
        "length(text) > 0"
    )


# --- inference ---------------------------------------------------------------------------------


def infer(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], model_id: str) -> DataFrame:
    """Run a caller-given model over documents; ``load`` is called once per Python worker task.

    The loaded function maps a batch of texts to lists of dicts with label, start, end,
    text and score. Documents without a text are not handed to it.
    """

    def run(batches: Iterator):
        import pandas as pd

        predict = load()
        for pdf in batches:
            rows = [
                (doc, model_id, p["label"], p["start"], p["end"], p.get("text"), float(p.get("score", 1.0)))
                for doc, found in zip(pdf["doc_id"], predict(pdf["text"].tolist()), strict=True)
                for p in found
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "model_id", "label", "start", "end", "text", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, PREDICTION_DDL.replace("doc_id BIGINT", f"doc_id {kind}"))
