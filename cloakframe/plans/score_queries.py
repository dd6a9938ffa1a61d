"""Queries over prediction ingestion, scoring and corpus building."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe import fixed
from cloakframe.functions.spans import q
from cloakframe.operators import arbitrate, corpus, detect, mask, predictions, registry, score

from cloakframe.operators.sweep import spread
from cloakframe.plans import shapes as S
from cloakframe.plans.catalog import add, derived, query, table
from cloakframe.schema import compatible_pairs
from cloakframe.sources import prediction_store as store
from cloakframe.sources.texts import scan_texts

# --- predictions ---------------------------------------------------------------------------

_LABELS = ("Person", "phone number", "E-MAIL", "credit card", "username ", "people", "ssn", "odd label")
_LINE = "(l_partkey * 13 + l_linenumber * 7) % 60"
_HEX = S.HEX.format("l_orderkey")
_PREDICTED = (
    ("doc_id", "l_orderkey"),
    ("label", S._pick("l_partkey % 8", _LABELS)),
    ("s", f"CAST({_LINE} AS int)"),
    ("e", f"CAST({_LINE} + 4 + l_suppkey % 50 AS int)"),
    ("text", f"CASE WHEN l_suppkey % 9 = 0 THEN 'wrong' WHEN l_suppkey % 9 = 1 THEN '' ELSE substr({_HEX}, CAST({_LINE} + 1 AS int), CAST(4 + l_suppkey % 50 AS int)) END"),
    ("score", "CAST(30 + (l_partkey * 31 + l_suppkey * 17) % 60 AS double) / 100"),
)
_PREDICTED_SQL = f"SELECT {S._select(_PREDICTED)} FROM lineitem"


def predicted(spark, d):
    return S._named(derived(spark, d, "lineitem", *S._expr(_PREDICTED)))


@query(
    "check_offsets",
    f"""SELECT p.doc_id, p.s AS "start", p.e AS "end", substr(d.text, s + 1, e - s) AS text FROM ({_PREDICTED_SQL}) p
        JOIN ({S.DOCS_SQL}) d USING (doc_id) WHERE e <= length(d.text) AND (p.text = '' OR p.text = substr(d.text, s + 1, e - s))""",
)
def check_offsets_query(spark, d):
    return predictions.check_offsets(predicted(spark, d), S.order_docs(spark, d)).select("doc_id", "start", "end", "text")


_SPAN_MAP = "(VALUES " + ", ".join(f"('{k}', '{t}', '{s}')" for k, (t, s) in fixed.SPAN_LABELS.items()) + ") mp(k, t, sem)"


@query(
    "map_labels",
    f"""SELECT label, coalesce(t, upper(lower(trim(label)))) AS type, coalesce(sem, lower(trim(label))) AS semantic_type, count(*) AS n
        FROM ({_PREDICTED_SQL}) p LEFT JOIN {_SPAN_MAP} ON k = lower(trim(label)) GROUP BY ALL""",
)
def map_labels_query(spark, d):
    out = predictions.map_labels(predicted(spark, d), "span")
    return out.groupBy("label", "type", "semantic_type").agg(F.count("*").alias("n"))


_TAGS = ("B-PER", "I-loc", "S-GPE", "E-ORG", "人名", "misc", "B-机构名", "NAME")
_NER = "(VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in fixed.CHALLENGER_LABELS["ner_tags_zh"].items()) + ") mp(k, t)"


@query(
    "map_labels_challenger",
    f"""SELECT label, coalesce((SELECT t FROM {_NER} WHERE k = bare), (SELECT t FROM {_NER} WHERE k = upper(bare)), lower(bare)) AS type, n
        FROM (SELECT label, regexp_replace(label, '^[BIES]-', '') AS bare, count(*) AS n
              FROM (SELECT {S._pick('l_partkey % 8', _TAGS)} AS label FROM lineitem) x GROUP BY ALL) y""",
)
def map_challenger_query(spark, d):
    rows = derived(spark, d, "lineitem", f"{S._pick('l_partkey % 8', _TAGS)} AS label")
    return predictions.map_labels(rows, "ner_tags_zh").groupBy("label", "type").agg(F.count("*").alias("n"))


@query("threshold", f"SELECT label, count(*) AS n FROM ({_PREDICTED_SQL}) p WHERE score >= 0.5 GROUP BY label")
def threshold_query(spark, d):
    return predictions.threshold(predicted(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


_USER_TEXT = S._pick("c_custkey % 8", ("用户名：小明同学，", "今天小明来了", "username 小明打电话", "at bob_7 now", "a b!c", "登录ID是张三李四", "x", "账号 abc.def."))
_USER_SPAN = ((4, 8), (2, 4), (9, 14), (3, 8), (0, 3), (5, 9), (0, 1), (3, 11))
_USER_KEEP = "doc_id % 8 IN (0, 3, 5, 7)"


def _at(i: int) -> str:
    return "CASE c_custkey % 8 " + " ".join(f"WHEN {n} THEN {x[i]}" for n, x in enumerate(_USER_SPAN)) + " END"


@query("plausible_username", f"SELECT doc_id, {_USER_KEEP} AS kept FROM (SELECT c_custkey AS doc_id FROM customer) x WHERE {_USER_KEEP}")
def username_query(spark, d):
    docs = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_USER_TEXT} AS text")
    spans = derived(
        spark, d, "customer", "c_custkey AS doc_id", f"{_at(0)} AS start", f"{_at(1)} AS `end`", "'USERNAME' AS type",
        f"substr({_USER_TEXT}, {_at(0)} + 1, {_at(1)} - {_at(0)}) AS text",
    )
    return predictions.plausible_username(spans, docs).select("doc_id", F.lit(True).alias("kept"))


_CARD = "CASE c_custkey % 4 WHEN 0 THEN '4111 1111 1111' WHEN 1 THEN '4111 1111' || chr(10) || '1111 1111' WHEN 2 THEN '12345' ELSE repeat('1', 20) END"


@query("card_gate", "SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0")
def card_gate_query(spark, d):
    rows = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_CARD} AS text", "CASE WHEN c_custkey % 3 = 0 THEN 'PHONE' ELSE 'CREDIT_CARD' END AS type")
    return predictions.card_gate(rows).select("doc_id")


@query(
    "occurrences",
    f"""SELECT doc_id, CAST(i - 1 AS INT) AS "start" FROM (SELECT doc_id, unnest(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = f)) AS i
        FROM (SELECT doc_id, text, repeat(substr(text, 1, 1), 2) AS f FROM ({S.DOCS_SQL}) d) x) y""",
)
def occurrences_query(spark, d):
    docs = S.order_docs(spark, d).withColumn("f", F.expr("repeat(substr(text, 1, 1), 2)"))
    return predictions.occurrences(docs, "f").select("doc_id", "start")


def _raw_output(spark, d):
    """Raw model output in the four shapes, with right, wrong and no offsets."""
    t = "text"
    item = lambda v, rest: f"concat('{{\"type\":\"人物\",\"span\":\"', {v}, '\"{rest}}}')"
    a, b = f"substr({t}, 11, 5)", f"substr({t}, 31, 6)"
    good = ',"offset":[10,15]'
    bad = ',"start":1,"end":3'
    one = item(a, good)
    two = item(b, bad)
    shape = (
        f"CASE doc_id % 4 WHEN 0 THEN concat('{{\"output\":[[', {one}, '],[', {two}, ']]}}') "
        f"WHEN 1 THEN concat('[', {two}, ',', {one}, ']') "
        f"WHEN 2 THEN concat('{{\"人物\":[', {one}, ',\"', {b}, '\"]}}') ELSE concat('{{\"output\":[', {two}, ',{{\"span\":\"zzz\"}}]}}') END"
    )
    return S.order_docs(spark, d).select("doc_id", F.expr(shape).alias("raw"))


_B_FIRST = "instr(text, substr(text, 31, 6)) - 1"


@query(
    "normalise_predictions",
    f"""WITH d AS ({S.DOCS_SQL}) SELECT doc_id, '人物' AS label, 10 AS "start", 15 AS "end", substr(text, 11, 5) AS text FROM d WHERE doc_id % 4 <> 3
        UNION ALL SELECT doc_id, '人物', CAST({_B_FIRST} AS INT), CAST({_B_FIRST} + 6 AS INT), substr(text, 31, 6) FROM d""",
)
def normalise_query(spark, d):
    out = predictions.normalise_predictions(_raw_output(spark, d), S.order_docs(spark, d))
    return out.select("doc_id", "label", "start", "end", "text")


_GEN = (
    "CASE doc_id % 3 WHEN 0 THEN concat('<think>x</think>```json\n[{\"original_text\":\"', substr(text, 11, 5), '\",\"privacy_type\":\"Real Name\",\"privacy_level\":\"pl3\"},]\n```') "
    "WHEN 1 THEN concat('found {\"text\":\"', substr(text, 21, 5), '\",\"type\":\"odd thing\",} and {broken} <think> y') "
    "ELSE 'nothing' END"
)


@query(
    "parse_generated",
    f"""WITH d AS ({S.DOCS_SQL}) SELECT doc_id, 'PERSON' AS type, substr(text, 11, 5) AS text, 'Real Name' AS semantic_type, 'PL3' AS privacy_level FROM d WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 'ODD_THING', substr(text, 21, 5), 'odd thing', 'PL2' FROM d WHERE doc_id % 3 = 1""",
)
def parse_query(spark, d):
    raw = S.order_docs(spark, d).select("doc_id", F.expr(_GEN).alias("raw"), "text")
    return predictions.parse_generated(raw).select("doc_id", "type", "text", "semantic_type", "privacy_level")


def _candidates(spark, d):
    """Three snippets per text: two in reading order, one from the front again."""
    cut = "CASE i WHEN 0 THEN substr(text, 5, 4) WHEN 1 THEN substr(text, 41, 4) ELSE substr(text, 1, 4) END"
    return S.order_docs(spark, d).select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).select(
        "doc_id", F.col("i").alias("seq"), F.lit("PERSON").alias("type"), F.expr(cut).alias("text")
    )


@query(
    "align_sequential",
    f"""WITH d AS ({S.DOCS_SQL}), a AS (SELECT *, instr(text, substr(text, 5, 4)) - 1 AS p0 FROM d),
          b AS (SELECT *, p0 + 4 + instr(substr(text, p0 + 5), substr(text, 41, 4)) - 1 AS p1 FROM a),
          c AS (SELECT *, instr(substr(text, p1 + 5), substr(text, 1, 4)) AS i2 FROM b)
        SELECT doc_id, 0 AS seq, CAST(p0 AS INT) AS "start", 'ok' AS reason FROM c UNION ALL SELECT doc_id, 1, CAST(p1 AS INT), 'ok' FROM c
        UNION ALL SELECT doc_id, 2, CAST(CASE WHEN i2 > 0 THEN p1 + 4 + i2 - 1 END AS INT), CASE WHEN i2 > 0 THEN 'ok' ELSE 'out_of_order' END FROM c""",
)
def align_query(spark, d):
    return predictions.align_sequential(_candidates(spark, d), S.order_docs(spark, d)).select("doc_id", "seq", "start", "reason")


# Six snippets per text, most of them repeated in it: without a hint, with one that spells the place, with one that only shares characters,
# a snippet taken before, one next to it, and one that is not there.
_SNIPPETS = (
    ("substr(text, 5, 2)", "CAST(NULL AS string)"), ("substr(text, 41, 2)", "substr(text, 39, 6)"), ("substr(text, 21, 1)", "concat(substr(text, 30, 3), 'z')"),
    ("substr(text, 5, 2)", "'zy'"), ("substr(text, 6, 1)", "CAST(NULL AS string)"), ("'xyz'", "'x'"),
)


def _placed_sql() -> str:
    """The walk over the snippets of a text: each step carries the cursor and the places taken."""
    rows = " UNION ALL ".join(f"SELECT doc_id, text, {k} AS seq, {t} AS t, {h} AS hint FROM d" for k, (t, h) in enumerate(_SNIPPETS))
    window = "substr(text, CAST(greatest(p - 12, 0) + 1 AS INT), CAST(least(p, 12) + n + 12 AS INT))"
    score = f"len(list_filter(string_split(hint, ''), lambda ch: length(ch) > 0 AND contains({window}, ch)))"
    return f"""WITH RECURSIVE d AS ({S.DOCS_SQL}), k AS ({rows}),
      o AS (SELECT *, length(t) AS n, list_filter(range(0, length(text) - length(t) + 1), lambda p: substr(text, p + 1, length(t)) = t) AS occ,
              instr(text, hint) + instr(hint, t) - 2 AS direct, instr(text, hint) > 0 AND instr(hint, t) > 0 AS spelt FROM k),
      w AS (SELECT doc_id, -1 AS seq, CAST(0 AS BIGINT) AS cur, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS taken, CAST(NULL AS BIGINT) AS spot, 0 AS n, '' AS reason FROM d
        UNION ALL SELECT doc_id, seq, CASE WHEN spot IS NULL THEN cur ELSE spot + n END,
            CASE WHEN spot IS NULL THEN taken ELSE list_append(taken, {{'s': spot, 'e': spot + n}}) END, spot, n,
            CASE WHEN len(occ) = 0 THEN 'not_found' WHEN spot IS NOT NULL THEN 'ok' WHEN len(occ) = 1 THEN 'occupied'
                 WHEN length(hint) > 0 THEN 'no_context_match' ELSE 'ambiguous' END
          FROM (SELECT *, CASE WHEN len(occ) = 1 THEN free[1]
                    WHEN length(hint) > 0 THEN coalesce(CASE WHEN spelt AND list_contains(free, direct) THEN direct END,
                      CASE WHEN list_max(scores) >= 2 THEN tries[list_position(scores, list_max(scores))] END)
                    ELSE aft[1] END AS spot
            FROM (SELECT *, list_transform(tries, lambda p: {score}) AS scores
              FROM (SELECT *, CASE WHEN len(aft) > 0 THEN aft ELSE free END AS tries
                FROM (SELECT *, list_filter(free, lambda p: p >= cur) AS aft
                  FROM (SELECT o.*, w.cur, w.taken, list_filter(occ, lambda p: len(list_filter(w.taken, lambda q: q.s < p + o.n AND p < q.e)) = 0) AS free
                    FROM w JOIN o ON o.doc_id = w.doc_id AND o.seq = w.seq + 1) x1) x2) x3) x4) x5)
      SELECT doc_id, CAST(seq AS INT) AS seq, CAST(spot AS INT) AS "start", CAST(spot + n AS INT) AS "end", reason FROM w WHERE seq >= 0"""


@query("resolve_spans", _placed_sql())
def resolve_query(spark, d):
    each = ", ".join(f"named_struct('seq', {k}, 'text', {t}, 'context_hint', {h})" for k, (t, h) in enumerate(_SNIPPETS))
    docs = S.order_docs(spark, d)
    snippets = docs.select("doc_id", F.explode(F.expr(f"array({each})")).alias("x")).select("doc_id", F.lit("PERSON").alias("type"), "x.*")
    return predictions.resolve_spans(snippets, docs).select("doc_id", "seq", "start", "end", "reason")


def _cut_sql(st: str) -> str:
    w = f"substr(text, {st} + 2801, 200)"
    tries = ", ".join(
        f"CASE WHEN instr({w}, {c}) > 0 THEN {st} + 2800 + length({w}) - instr(reverse({w}), reverse({c})) + 1 END"
        for c in ("chr(10) || chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'.'", "'!'", "'?'", "'；'", "';'")
    )
    return f"CASE WHEN {st} + 3000 >= n THEN n ELSE coalesce({tries}, {st} + 3000) END"


_CHUNKS_CTE = f"""WITH RECURSIVE base AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
  ch AS (SELECT doc_id, text, n, 0 AS k, CAST(0 AS BIGINT) AS st, CASE WHEN n <= 3500 THEN n ELSE {_cut_sql('0')} END AS en FROM base
         UNION ALL SELECT doc_id, text, n, k + 1, st2, {_cut_sql('st2')} FROM (SELECT *, en - 200 AS st2 FROM ch WHERE en < n) z)"""


@query("chunk_texts", f'{_CHUNKS_CTE} SELECT doc_id, k AS chunk, CAST(st AS INT) AS "start", CAST(en AS INT) AS "end" FROM ch')
def chunk_query(spark, d):
    return predictions.chunk_texts(S.documents(spark, d)).select("doc_id", "chunk", "start", "end")


@query(
    "unchunk",
    f"""{_CHUNKS_CTE} SELECT doc_id, CAST(st AS INT) AS "start", CAST(least(st + 5, n) AS INT) AS "end", substr(text, st + 1, 5) AS text, 'W' AS type FROM ch""",
)
def unchunk_query(spark, d):
    """The first characters of every chunk, reported by the chunk and, shifted, by the first one."""
    docs = S.documents(spark, d)
    chunks = predictions.chunk_texts(docs)
    head = chunks.select("doc_id", F.col("start").alias("chunk_start"), F.expr("substr(text, 1, 5)").alias("text"), F.lit("W").alias("type"))
    own = head.withColumn("start", F.lit(0)).withColumn("end", F.length("text"))
    shifted = head.withColumn("start", F.col("chunk_start")).withColumn("end", F.expr("chunk_start + length(text)")).withColumn("chunk_start", F.lit(0))
    return predictions.unchunk(own.unionByName(shifted), docs).select("doc_id", "start", "end", "text", "type")


@query(
    "chunk_report",
    """SELECT l_orderkey AS doc_id, count(*) AS chunks, count(*) FILTER (WHERE l_partkey % 5 <> 0) AS completed,
         count(*) FILTER (WHERE l_suppkey % 4 = 0) AS truncated,
         count(*) FILTER (WHERE l_partkey % 5 <> 0) BETWEEN 1 AND count(*) - 1 AS incomplete FROM lineitem GROUP BY l_orderkey""",
)
def chunk_report_query(spark, d):
    rows = derived(spark, d, "lineitem", "l_orderkey AS doc_id", "l_linenumber AS chunk", "l_partkey % 5 <> 0 AS done", "l_suppkey % 4 = 0 AS truncated")
    return predictions.chunk_report(rows)


@query("generation_budget", "SELECT CASE WHEN length(text) <= 1000 THEN 256 WHEN length(text) <= 4000 THEN 384 ELSE 512 END AS budget, count(*) AS n FROM documents GROUP BY 1")
def budget_query(spark, d):
    return S.documents(spark, d).select(F.expr(predictions.generation_budget()).alias("budget")).groupBy("budget").agg(F.count("*").alias("n"))


_TOK = S._pick("(l_partkey + l_linenumber) % 9", ("O", "B-A", "I-A", "E-A", "S-B", "I-B", "E-B", "B-B", "I-A"))
_TOKENS = f"l_orderkey AS doc_id, CAST(r AS int) AS tok, CAST(r * 4 AS int) AS s, CAST(r * 4 + 3 AS int) AS e, {_TOK} AS label"
_TOK_FROM = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) li"


@query(
    "decode_bioes",
    f"""WITH RECURSIVE t AS (SELECT {_TOKENS} FROM {_TOK_FROM}),
      w AS (SELECT doc_id, 0 AS tok, -1 AS os, -1 AS oe, '' AS ob, CAST([] AS STRUCT(s INT, e INT, b VARCHAR)[]) AS done FROM (SELECT DISTINCT doc_id FROM t) x
        UNION ALL SELECT w.doc_id, t.tok,
          CASE WHEN g = 'B' THEN t.s WHEN g = 'S' OR (g = 'E' AND os >= 0 AND ob = b) THEN -1 ELSE os END,
          CASE WHEN g = 'B' THEN t.e WHEN g = 'I' AND os >= 0 AND ob = b THEN t.e ELSE oe END,
          CASE WHEN g = 'B' THEN b ELSE ob END,
          CASE WHEN g = 'B' AND os >= 0 THEN list_append(done, {{'s': os, 'e': oe, 'b': ob}})
               WHEN g = 'S' AND os >= 0 THEN list_append(list_append(done, {{'s': os, 'e': oe, 'b': ob}}), {{'s': t.s, 'e': t.e, 'b': b}})
               WHEN g = 'S' THEN list_append(done, {{'s': t.s, 'e': t.e, 'b': b}})
               WHEN g = 'E' AND os >= 0 AND ob = b THEN list_append(done, {{'s': os, 'e': t.e, 'b': b}})
               WHEN g = 'E' THEN list_append(done, {{'s': t.s, 'e': t.e, 'b': b}}) ELSE done END
        FROM w JOIN (SELECT *, substr(label, 1, 1) AS g, substr(label, 3) AS b FROM t) t ON t.doc_id = w.doc_id AND t.tok = w.tok + 1),
      f AS (SELECT doc_id, arg_max(CASE WHEN os >= 0 THEN list_append(done, {{'s': os, 'e': oe, 'b': ob}}) ELSE done END, tok) AS done FROM w GROUP BY doc_id)
      SELECT doc_id, x.s AS "start", x.e AS "end", x.b AS label FROM (SELECT doc_id, unnest(done) AS x FROM f) y""",
)
def bioes_query(spark, d):
    from pyspark.sql.window import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = spread(table(spark, d, "lineitem"), "l_orderkey").withColumn("r", F.row_number().over(order))
    tokens = S._named(li.selectExpr("l_orderkey AS doc_id", "r AS tok", "r * 4 AS s", "r * 4 + 3 AS e", f"{_TOK} AS label"))
    return predictions.decode_bioes(tokens).select("doc_id", "start", "end", "label")


def _load_stub():
    def predict(texts):
        return [[{"label": "person", "start": 0, "end": min(3, len(t)), "text": t[:3], "score": 0.9}] for t in texts]

    return predict


@query("infer", "SELECT doc_id, 'person' AS label, 0 AS \"start\", least(3, CAST(length(text) AS INT)) AS \"end\", substr(text, 1, 3) AS text FROM documents")
def infer_query(spark, d):
    return predictions.infer(S.documents(spark, d), _load_stub, "stub").select("doc_id", "label", "start", "end", "text")


# --- scoring ------------------------------------------------------------------------------------

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in compatible_pairs())
_OK = f"(g.type = p.type OR (g.type, p.type) IN (VALUES {_PAIRS}))"
_SAME = "g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e"


def match_cte(gold: str = S.GOLD_SQL, pred: str = S.PRED_SQL, key: str = "") -> str:
    """Matching in SQL; spans are unique by construction, so 1:1 needs no bookkeeping."""
    k = f"AND g.{key} = p.{key}" if key else ""
    kg, kp = (f"g.{key}, ", f"p.{key}, ") if key else ("", "")
    return f"""WITH g AS ({gold}), p AS ({pred}),
      m AS (SELECT {kg}g.doc_id, g.s, g.e, 'TP' AS outcome, g.type AS gold_type, p.type AS pred_type, should_redact FROM g JOIN p ON {_SAME} AND {_OK} {k}
        UNION ALL SELECT {kg}g.doc_id, g.s, g.e, 'FN', g.type, NULL, should_redact FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE {_SAME} AND {_OK} {k})
        UNION ALL SELECT {kp}p.doc_id, p.s, p.e, 'FP', NULL, p.type, NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE {_SAME} AND {_OK} {k}))"""


_N = "count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn"
_PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1 ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1 ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1"""


def _matches(spark, d):
    return score.match_spans(S.gold_spans(spark, d), S.pred_spans(spark, d))


@query("match_spans", f'{match_cte()} SELECT doc_id, s AS "start", e AS "end", outcome, gold_type, pred_type, should_redact FROM m')
def match_query(spark, d):
    return _matches(spark, d).select("doc_id", "start", "end", "outcome", "gold_type", "pred_type", "should_redact")


_SAME_TYPE = "CASE WHEN l_partkey % 2 = 0 THEN 'PHONE' ELSE 'MEDICAL' END"
_REPEATED_G = f"SELECT l_orderkey AS doc_id, CAST(l_linenumber * 9 AS INT) AS s, CAST(l_linenumber * 9 + 5 AS INT) AS e, {_SAME_TYPE} AS type FROM lineitem WHERE l_suppkey % 5 <> 0"
_REPEATED_P = _REPEATED_G.replace("l_suppkey % 5 <> 0", "l_suppkey % 3 <> 0")


@query(
    "match_spans_repeated",
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, type) AS k FROM ({_REPEATED_G}) x),
      p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, type) AS k FROM ({_REPEATED_P}) x)
      SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.s, p.s) AS "start", coalesce(g.type, p.type) AS type,
        CASE WHEN p.k IS NULL THEN 'FN' WHEN g.k IS NULL THEN 'FP' ELSE 'TP' END AS outcome, count(*) AS n
      FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type AND g.k = p.k GROUP BY ALL""",
)
def match_repeated_query(spark, d):
    """Line items that share a line number give the same span several times: each gold span takes one prediction."""
    spans = lambda keep: S._named(derived(spark, d, "lineitem", *S._expr((
        ("doc_id", "l_orderkey"), ("s", "CAST(l_linenumber * 9 AS INT)"), ("e", "CAST(l_linenumber * 9 + 5 AS INT)"), ("type", _SAME_TYPE), ("keep", keep)))).filter("keep").drop("keep"))
    out = score.match_spans(spans("l_suppkey % 5 <> 0"), spans("l_suppkey % 3 <> 0"))
    return out.groupBy("doc_id", "start", score.outcome_type().alias("type"), "outcome").agg(F.count("*").alias("n"))


@query("prf", f"{match_cte()} SELECT doc_id, tp, fp, fn, {_PRF} FROM (SELECT doc_id, {_N} FROM m GROUP BY doc_id) x")
def prf_query(spark, d):
    return score.prf(_matches(spark, d).groupBy("doc_id").agg(*score.counts()))


def _slice(name: str, expr: str) -> str:
    return f"SELECT '{name}' AS slice, CAST({expr} AS VARCHAR) AS value, {_N} FROM mm GROUP BY 2"


@query(
    "metrics_by",
    f"""{match_cte()}, mm AS (SELECT m.*, coalesce(gold_type, pred_type) AS type, lvl AS level, o_orderstatus AS lang FROM m
          JOIN orders ON o_orderkey = doc_id LEFT JOIN {S.LEVEL_SQL} ON lv.type = coalesce(gold_type, pred_type))
        SELECT slice, value, tp, fp, fn, {_PRF} FROM ({_slice('overall', "'all'")} UNION ALL {_slice('type', 'type')}
          UNION ALL {_slice('level', 'level')} UNION ALL {_slice('lang', 'lang')}) x""",
)
def metrics_query(spark, d):
    langs = S.order_docs(spark, d).select("doc_id", "lang")
    rows = _matches(spark, d).join(langs, "doc_id").withColumn("type", score.outcome_type()).withColumn("level", score.outcome_level())
    return score.metrics_by(rows, ["type", "level", "lang"])


_CHARS = """, gc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM g), pc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM p),
  rc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS c FROM g WHERE should_redact),
  fnc AS (SELECT doc_id, should_redact, unnest(range(s, e)) AS c FROM m WHERE outcome = 'FN'),
  fpc AS (SELECT doc_id, unnest(range(s, e)) AS c FROM m WHERE outcome = 'FP')"""


@query(
    "char_leakage",
    f"""{match_cte()}{_CHARS}, l AS (SELECT doc_id, count(*) FILTER (WHERE pc.c IS NULL) AS n FROM fnc LEFT JOIN pc USING (doc_id, c) GROUP BY doc_id),
          o AS (SELECT doc_id, count(*) FILTER (WHERE gc.c IS NULL) AS n FROM fpc LEFT JOIN gc USING (doc_id, c) GROUP BY doc_id)
        SELECT coalesce(l.doc_id, o.doc_id) AS doc_id, coalesce(l.n, 0) AS leaked_chars, coalesce(o.n, 0) AS overredacted_chars FROM l FULL OUTER JOIN o USING (doc_id)""",
)
def leakage_query(spark, d):
    g, p = S.gold_spans(spark, d), S.pred_spans(spark, d)
    return score.char_leakage(score.match_spans(g, p))


@query(
    "score_layered",
    f"""{match_cte()}{_CHARS}, b AS (SELECT {_N}, count(*) FILTER (WHERE outcome = 'TP' AND gold_type = pred_type) AS tc,
          count(*) FILTER (WHERE outcome <> 'FP' AND should_redact) AS rg, count(*) FILTER (WHERE outcome = 'TP' AND should_redact) AS rcov FROM m),
        rx AS (SELECT count(*) AS n FROM m WHERE outcome = 'FN' AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND p.s < m.e AND m.s < p.e
          AND (p.type = m.gold_type OR (m.gold_type, p.type) IN (VALUES {_PAIRS})))),
        l AS (SELECT count(*) AS n FROM fnc LEFT JOIN pc USING (doc_id, c) WHERE should_redact AND pc.c IS NULL),
        o AS (SELECT count(*) AS n FROM fpc LEFT JOIN rc USING (doc_id, c) WHERE rc.c IS NULL)
        SELECT tp, fp, fn, {_PRF}, round(tc / tp, 6) AS type_accuracy, round(rx.n / (tp + fn), 6) AS relaxed_recall,
          round(rcov / rg, 6) AS redaction_coverage, round(fp / (tp + fp), 6) AS over_redaction_rate, l.n AS leaked_chars, o.n AS overredacted_chars
        FROM b, rx, l, o""",
)
def layered_query(spark, d):
    return score.score_layered(S.gold_spans(spark, d), S.pred_spans(spark, d))


@query(
    "score_semantic",
    f"""WITH g AS ({S.GOLD_SQL}), p AS (SELECT DISTINCT doc_id, s, e, type FROM ({S.PRED_SQL}) x),
          f AS (SELECT p.doc_id, p.s, p.e, p.type, coalesce(bool_or(sensitive), false) AS pos, coalesce(bool_or(NOT sensitive), false) AS neg
                FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND p.s < g.e AND g.s < p.e GROUP BY ALL)
        SELECT count(*) FILTER (WHERE pos) AS tp, count(*) FILTER (WHERE NOT pos) AS fp,
          (SELECT count(*) FROM g WHERE sensitive AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.s < g.e AND g.s < p.e)) AS fn,
          count(*) FILTER (WHERE neg) AS overreach FROM f""",
)
def semantic_query(spark, d):
    return score.score_semantic(S.gold_spans(spark, d), S.pred_spans(spark, d))


_TH = "(VALUES " + ", ".join(f"(CAST({t} AS DOUBLE))" for t in fixed.SWEEP_THRESHOLDS) + ") th(threshold)"
_CRIT = ", ".join(q(t) for t in fixed.CRITICAL_TYPES)
_SWEEP_G, _SWEEP_P = f"SELECT x.*, threshold FROM ({S.GOLD_SQL}) x, {_TH}", f"SELECT x.*, threshold FROM ({S.PRED_SQL}) x, {_TH} WHERE score >= threshold"


@query(
    "threshold_sweep",
    f"""{match_cte(_SWEEP_G, _SWEEP_P, 'threshold')},
        b AS (SELECT threshold, {_N}, count(*) FILTER (WHERE outcome = 'TP' AND gold_type = pred_type) AS tc,
          count(*) FILTER (WHERE outcome = 'FN' AND should_redact) AS redactable_fn,
          count(*) FILTER (WHERE outcome = 'FN' AND should_redact AND gold_type IN ({_CRIT})) AS critical_fn FROM m GROUP BY threshold),
        free AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM g)),
        fl AS (SELECT threshold, count(DISTINCT doc_id) AS n FROM p WHERE doc_id IN (SELECT doc_id FROM free) GROUP BY threshold),
        cf AS (SELECT g.threshold, count(*) FILTER (WHERE g.type IN ('CN_NAME', 'PERSON') AND p.type = 'USERNAME') AS pu,
          count(*) FILTER (WHERE g.type = 'USERNAME' AND p.type IN ('CN_NAME', 'PERSON')) AS up
          FROM g JOIN p ON g.threshold = p.threshold AND g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e GROUP BY g.threshold)
        SELECT b.threshold, tp, fp, fn, {_PRF}, round(tc / tp, 6) AS type_accuracy, round(coalesce(fl.n, 0) / (SELECT count(*) FROM free), 6) AS pii_free_fpr,
          coalesce(fl.n, 0) AS pii_free_flagged, (SELECT count(*) FROM free) AS pii_free_total, coalesce(pu, 0) AS person_to_username,
          coalesce(up, 0) AS username_to_person, redactable_fn, critical_fn
        FROM b LEFT JOIN fl USING (threshold) LEFT JOIN cf USING (threshold)""",
)
def sweep_query(spark, d):
    return score.threshold_sweep(S.order_docs(spark, d), S.gold_spans(spark, d), S.pred_spans(spark, d))


@query(
    "pii_free_fpr",
    f"""{match_cte()}, free AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM g))
        SELECT count(*) AS pii_free, count(*) FILTER (WHERE hit) AS flagged, round(count(*) FILTER (WHERE hit) / count(*), 6) AS fpr
        FROM (SELECT doc_id IN (SELECT doc_id FROM m WHERE outcome = 'FP') AS hit FROM free) x""",
)
def fpr_query(spark, d):
    g = S.gold_spans(spark, d)
    return score.pii_free_fpr(S.order_docs(spark, d), g, score.match_spans(g, S.pred_spans(spark, d)))


_NEG = S._pick("c_custkey % 5", ("format_perfect_fake", "reserved_documentation", "code_identifiers", "uuid_hash", "version_timestamp"))
_NEG_TEXT = (
    "CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'no' ELSE 'key AKIA' || upper(substr(md5(cast(c_custkey AS string)), 1, 16)) END "
    "WHEN 1 THEN 'mail a' || c_custkey || '@example.com' WHEN 2 THEN 'token_count >= ' || c_custkey WHEN 3 THEN 'id=' || md5(cast(c_custkey AS string)) "
    "ELSE 'version 10.2.3.' || c_custkey END"
)


@query(
    "negative_gate",
    """SELECT CASE c_custkey % 5 WHEN 0 THEN 'fake' WHEN 1 THEN 'reserved' ELSE 'strict' END AS grp, count(*) AS docs,
         count(*) FILTER (WHERE c_custkey % 5 = 1 OR (c_custkey % 5 = 0 AND c_custkey % 3 <> 0)) AS detected FROM customer GROUP BY 1""",
)
def negative_query(spark, d):
    docs = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_NEG} AS category", f"{_NEG_TEXT} AS text")
    return score.negative_gate(docs, detect.detect_rules(docs))


@query(
    "nearest_rank",
    """SELECT lang, fraction, n_chars AS percentile FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r,
         count(*) OVER (PARTITION BY lang) AS n FROM documents) x, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) f(fraction)
       WHERE r = CAST(round_even(fraction * (n - 1), 0) AS BIGINT) + 1""",
)
def rank_query(spark, d):
    return score.nearest_rank(table(spark, d, "documents"), "n_chars", [0.5, 0.95], ["lang"])


@query("fp_profile", f"{match_cte()} SELECT pred_type AS type, count(*) AS n FROM m WHERE outcome = 'FP' GROUP BY 1 ORDER BY n DESC, type LIMIT 8")
def fp_query(spark, d):
    return score.fp_profile(_matches(spark, d))


@query(
    "confusion",
    f"""SELECT g.type AS gold_type, p.type AS pred_type, count(*) AS n FROM ({S.GOLD_SQL}) g JOIN ({S.PRED_SQL}) p
        ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e GROUP BY ALL""",
)
def confusion_query(spark, d):
    return score.confusion(S.gold_spans(spark, d), S.pred_spans(spark, d))


_MG = f"SELECT x.*, model_id FROM ({S.GOLD_SQL}) x, (VALUES ('m0'), ('m1')) mo(model_id)"


@query(
    "compare_models",
    f"""{match_cte(_MG, S.PRED_SQL, 'model_id')}, gc AS (SELECT DISTINCT model_id, doc_id, unnest(range(s, e)) AS c FROM g),
          pc AS (SELECT DISTINCT model_id, doc_id, unnest(range(s, e)) AS c FROM p),
          ov AS (SELECT model_id, count(*) AS n FROM (SELECT model_id, doc_id, unnest(range(s, e)) AS c FROM m WHERE outcome = 'FP') f ANTI JOIN gc USING (model_id, doc_id, c) GROUP BY model_id),
          lk2 AS (SELECT model_id, count(*) AS n FROM (SELECT model_id, doc_id, unnest(range(s, e)) AS c FROM m WHERE outcome = 'FN') f ANTI JOIN pc USING (model_id, doc_id, c) GROUP BY model_id),
          b AS (SELECT model_id, {_N} FROM m GROUP BY model_id), free AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM g)),
          fl AS (SELECT model_id, count(DISTINCT doc_id) AS n FROM m WHERE outcome = 'FP' AND doc_id IN (SELECT doc_id FROM free) GROUP BY model_id)
        SELECT model_id, tp, fp, fn, {_PRF}, round(coalesce(fl.n, 0) / (SELECT count(*) FROM free), 6) AS pii_free_fpr, lk2.n AS leaked_chars, ov.n AS overredacted_chars
        FROM b LEFT JOIN fl USING (model_id) LEFT JOIN lk2 USING (model_id) LEFT JOIN ov USING (model_id)""",
)
def compare_query(spark, d):
    return score.compare_models(S.order_docs(spark, d), S.gold_spans(spark, d), S.pred_spans(spark, d), ["m0", "m1"])


@query(
    "engine_usage",
    "SELECT 'multilingual_rules' AS engine, count(*) AS docs FROM documents UNION ALL SELECT 'chinese_ie', count(*) FROM documents "
    "UNION ALL SELECT 'shaky', count(*) FROM documents WHERE length(text) % 5 <> 0",
)
def engines_query(spark, d):
    """The engines that detection reports for each document; one plug-in fails on some of them."""
    from cloakframe.plans.span_queries import shaky_registry

    return score.engine_usage(registry.detected(S.documents(spark, d), shaky_registry()))


@query(
    "hard_cases",
    f"""WITH p AS ({S.PRED_SQL}), o AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT doc_id, threshold, coalesce(string_agg(s || ':' || e || ':' || type || ':' || score, '|' ORDER BY s, e, type, score) FILTER (WHERE score >= threshold), '') AS preds
        FROM o CROSS JOIN (VALUES (CAST(0.4 AS DOUBLE)), (CAST(0.6 AS DOUBLE))) t(threshold) LEFT JOIN p USING (doc_id) GROUP BY doc_id, threshold""",
)
def hard_query(spark, d):
    return score.hard_cases(S.pred_spans(spark, d), S.order_docs(spark, d), "source = '1-URGENT'", [0.4, 0.6])


# Surfaces: fragments of gold texts, widened, narrowed or unrelated.
_FRAG = "'Frag  ' || (l_partkey % 50) || ' x'"
_SURF = "CASE l_suppkey % 4 WHEN 0 THEN 'frag ' || (l_partkey % 50) || ' X' WHEN 1 THEN 'the Frag ' || (l_partkey % 50) || ' x too' WHEN 2 THEN 'ag ' || (l_partkey % 50) ELSE 'other ' || l_partkey END"
_SURF_CTE = f"""WITH g AS (SELECT l_orderkey AS doc_id, {S._pick('l_partkey % 8', S.TYPES)} AS type, {_FRAG} AS text, l_partkey % 4 <> 0 AS red,
      l_partkey % 17 = 0 AS quasi, lower(trim(regexp_replace({_FRAG}, '\\s+', ' ', 'g'))) AS f FROM {S._ONE} WHERE l_orderkey % 5 <> 0),
    s AS (SELECT l_orderkey AS doc_id, l_linenumber AS sid, lower({_SURF}) AS s FROM {S._ONE} WHERE l_suppkey % 3 <> 0),
    h AS (SELECT g.doc_id, g.f, g.red, s.sid FROM g JOIN s ON g.doc_id = s.doc_id AND (contains(s.s, g.f) OR contains(g.f, s.s))),
    used AS (SELECT DISTINCT doc_id, sid FROM (SELECT doc_id, f, min(sid) AS sid FROM h WHERE red GROUP BY doc_id, f) z),
    cov AS (SELECT DISTINCT doc_id, f FROM h WHERE red),
    pg AS (SELECT g.doc_id, count(*) FILTER (WHERE red) AS gold, count(*) FILTER (WHERE red AND cov.f IS NOT NULL) AS covered,
        CAST(coalesce(sum(CASE WHEN red AND cov.f IS NULL THEN length(text) ELSE 0 END), 0) AS BIGINT) AS residual_chars, count(*) FILTER (WHERE quasi) AS q
        FROM g LEFT JOIN cov ON cov.doc_id = g.doc_id AND cov.f = g.f GROUP BY g.doc_id),
    j AS (SELECT s.doc_id, (SELECT count(*) FROM used u WHERE u.doc_id = s.doc_id AND u.sid = s.sid) > 0 AS used,
        (SELECT count(*) FROM h WHERE h.doc_id = s.doc_id AND h.sid = s.sid AND red) > 0 AS r, (SELECT count(*) FROM h WHERE h.doc_id = s.doc_id AND h.sid = s.sid AND NOT red) > 0 AS p FROM s),
    ps AS (SELECT doc_id, count(*) AS surfaces, count(*) FILTER (WHERE NOT used AND p) AS over_public, count(*) FILTER (WHERE NOT used AND NOT p AND NOT r) AS over_no_gold FROM j GROUP BY doc_id),
    sc AS (SELECT coalesce(pg.doc_id, ps.doc_id) AS doc_id, coalesce(gold, 0) AS gold, coalesce(covered, 0) AS covered, coalesce(surfaces, 0) AS surfaces,
        coalesce(over_public, 0) AS over_public, coalesce(over_no_gold, 0) AS over_no_gold, coalesce(residual_chars, 0) AS residual_chars, coalesce(q, 0) AS q
        FROM pg FULL OUTER JOIN ps ON pg.doc_id = ps.doc_id),
    fin AS (SELECT doc_id, gold, covered, surfaces, over_public, over_no_gold, residual_chars,
        round(CASE WHEN gold > 0 THEN covered / gold ELSE 1 END, 6) AS identity_recall,
        round(CASE WHEN surfaces > 0 THEN (surfaces - over_public - over_no_gold) / surfaces ELSE 1 END, 6) AS identity_precision,
        round(CASE WHEN q > 0 THEN covered / q END, 6) AS quasi_recall FROM sc)"""


def _surface_inputs(spark, d):
    lines = S._lines(spark, d)
    gold = lines.filter("l_orderkey % 5 <> 0").selectExpr(
        "l_orderkey AS doc_id", f"{S._pick('l_partkey % 8', S.TYPES)} AS type", f"{_FRAG} AS text", "l_partkey % 4 <> 0 AS should_redact",
        "CASE WHEN l_partkey % 17 = 0 THEN 'quasi_identifier' ELSE 'explicit' END AS context_class",
    )
    return gold, lines.filter("l_suppkey % 3 <> 0").selectExpr("l_orderkey AS doc_id", "l_linenumber AS sid", f"{_SURF} AS surface")


@query("score_surfaces", f"{_SURF_CTE} SELECT * FROM fin")
def surfaces_query(spark, d):
    return score.score_surfaces(*_surface_inputs(spark, d))


_CAT = "(VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in fixed.SURFACE_CATEGORY.items()) + ") ca(type, category)"


@query(
    "category_recall",
    f"""{_SURF_CTE} SELECT coalesce(category, 'other') AS category, count(*) FILTER (WHERE cov.f IS NOT NULL) AS covered, count(*) AS gold
        FROM g LEFT JOIN cov ON cov.doc_id = g.doc_id AND cov.f = g.f LEFT JOIN {_CAT} ON ca.type = g.type WHERE red GROUP BY 1""",
)
def category_query(spark, d):
    return score.category_recall(*_surface_inputs(spark, d))


@query(
    "surface_summary",
    f"""{_SURF_CTE} SELECT round(avg(identity_recall), 6) AS identity_recall, round(avg(identity_precision), 6) AS identity_precision,
        CAST(sum(residual_chars) AS BIGINT) AS residual_chars, count(*) AS docs, CAST(0 AS BIGINT) AS roundtrip_failures FROM fin""",
)
def summary_query(spark, d):
    from cloakframe.plans.span_queries import masked_docs

    return score.surface_summary(score.score_surfaces(*_surface_inputs(spark, d)), mask.roundtrip_gate(masked_docs(spark, d)))


# --- corpora ------------------------------------------------------------------------------------------


def _passages(spark, d):
    docs = S.documents(spark, d)
    items = scan_texts(spark, d, "benchmark").select(F.col("doc_id").alias("pid"), F.col("text").alias("fragment"))
    return docs, corpus.find_passages(docs, items)


@query(
    "find_passages",
    """SELECT d.doc_id, b.item_id AS pid, CAST(instr(d.text, b.text) - 1 AS INT) AS "start",
         CAST(instr(d.text, b.text) - 1 + length(b.text) AS INT) AS "end" FROM documents d JOIN benchmark b ON contains(d.text, b.text)
       WHERE (length(d.text) - length(replace(d.text, b.text, ''))) = length(b.text)
       UNION ALL SELECT doc_id, pid, CAST(s AS INT), CAST(s + n AS INT) FROM (
         SELECT d.doc_id, b.item_id AS pid, length(b.text) AS n, unnest(list_filter(range(0, length(d.text)), lambda i: substr(d.text, i + 1, length(b.text)) = b.text)) AS s
         FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE (length(d.text) - length(replace(d.text, b.text, ''))) > length(b.text)) x""",
)
def passages_query(spark, d):
    return _passages(spark, d)[1].select("doc_id", "pid", "start", "end")


_FRAGS = "CASE l_linenumber % 3 WHEN 0 THEN substr({t}, 1, 2) WHEN 1 THEN substr({t}, 9, 1) ELSE 'zz' END"


@query(
    "annotate_fragments",
    f"""SELECT doc_id, type, f AS text, CAST(i AS INT) AS "start", CAST(i + length(f) AS INT) AS "end" FROM (
          SELECT doc_id, type, f, unnest(CASE WHEN contains(t, f) THEN list_transform(range(1, len(string_split(t, f))),
            lambda i: list_sum(list_transform(string_split(t, f)[1:i], lambda x: length(x))) + (i - 1) * length(f)) ELSE [NULL] END) AS i
          FROM (SELECT l_orderkey AS doc_id, 'T' || (l_linenumber % 3) AS type, {_HEX} AS t, {_FRAGS.format(t=_HEX)} AS f FROM {S._ONE}) x) y""",
)
def annotate_query(spark, d):
    frags = S._lines(spark, d).selectExpr(
        "l_orderkey AS doc_id", "'T' || (l_linenumber % 3) AS type", f"{_FRAGS.format(t=_HEX)} AS fragment"
    )
    return corpus.annotate_fragments(S.order_docs(spark, d), frags).select("doc_id", "type", "text", "start", "end")


@query(
    "extend_documents",
    f"""WITH b AS (SELECT o_orderkey AS doc_id, {S.HEX.format('o_orderkey')} AS t, o_orderkey % 2 = 0 AS more FROM orders)
        SELECT doc_id, 2 AS "start", 8 AS "end", substr(t, 3, 6) AS text, true AS good FROM b
        UNION ALL SELECT doc_id, 2, 8, substr(t, 3, 6), true FROM b WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 96 + 5, 96 + 11, substr(t, 3, 6), true FROM b WHERE more""",
)
def extend_query(spark, d):
    """Every third document holds its span twice; the appendix is still searched once."""
    docs = S.order_docs(spark, d)
    one = docs.select("doc_id", F.lit(2).alias("start"), F.lit(8).alias("end"), F.lit("T").alias("type"), F.expr("substr(text, 3, 6)").alias("text"))
    twice = one.unionByName(one.filter("doc_id % 3 = 0"))
    extra = docs.filter("doc_id % 2 = 0").select("doc_id", F.expr("concat(' see ', substr(text, 3, 6), '.')").alias("appendix"))
    grown, spans = corpus.extend_documents(docs, twice, extra)
    texts = grown.select("doc_id", F.col("text").alias("_t"))
    return spans.join(texts, "doc_id").select(
        "doc_id", "start", "end", "text", F.expr("substr(_t, start + 1, end - start) = text").alias("good")
    )


_NOTE = "note {n} is neutral and says nothing"


@query(
    "pad_documents",
    """WITH RECURSIVE p AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text || 'note ' || length(text) || ' is neutral and says nothing' FROM p WHERE length(text) < 3050)
       SELECT doc_id, max(length(text)) AS n, md5(arg_max(text, length(text))) AS h FROM p GROUP BY doc_id""",
)
def pad_query(spark, d):
    return corpus.pad_documents(S.documents(spark, d), _NOTE).select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("h"))


_BAND = "CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 500 THEN 'medium' WHEN length(text) < 3000 THEN 'long' ELSE 'very_long' END"


@query("length_band", f"SELECT lang, {_BAND} AS band, count(*) AS n FROM documents GROUP BY ALL")
def band_query(spark, d):
    return S.documents(spark, d).groupBy("lang", F.expr(corpus.length_band()).alias("band")).agg(F.count("*").alias("n"))


@query(
    "risk_group",
    f"""WITH g AS ({S.GOLD_SQL}) SELECT CASE WHEN q THEN 'quasi_identifier' WHEN has OR sem THEN 'direct' ELSE 'none' END AS risk_group, NOT has AS pii_free, count(*) AS n
        FROM (SELECT o_orderkey IN (SELECT doc_id FROM g WHERE context_class = 'quasi_identifier') AS q, o_orderkey IN (SELECT doc_id FROM g) AS has, o_orderkey % 10 = 0 AS sem FROM orders) x GROUP BY ALL""",
)
def risk_query(spark, d):
    docs = S.order_docs(spark, d)
    out = corpus.risk_group(docs, S.gold_spans(spark, d), docs.filter("doc_id % 10 = 0").select("doc_id"))
    return out.groupBy("risk_group", "pii_free").agg(F.count("*").alias("n"))


@query(
    "corpus_summary",
    f"""WITH g AS ({S.GOLD_SQL}), pd AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE should_redact) AS r FROM g GROUP BY doc_id)
        SELECT lang, {_BAND} AS band, count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS gold, CAST(coalesce(sum(r), 0) AS BIGINT) AS redactable,
          count(*) FILTER (WHERE n IS NULL) AS pii_free FROM ({S.DOCS_SQL}) d LEFT JOIN pd USING (doc_id) GROUP BY ALL""",
)
def corpus_query(spark, d):
    return corpus.corpus_summary(S.order_docs(spark, d), S.gold_spans(spark, d))


@query(
    "gold_integrity",
    f"""SELECT p.doc_id, p.s AS "start", p.e AS "end", CASE WHEN e > length(d.text) THEN 'out_of_bounds' ELSE 'text_mismatch' END AS violation
        FROM ({_PREDICTED_SQL}) p JOIN ({S.DOCS_SQL}) d USING (doc_id) WHERE e > length(d.text) OR substr(d.text, s + 1, e - s) <> p.text""",
)
def integrity_query(spark, d):
    return corpus.gold_integrity(S.order_docs(spark, d), predicted(spark, d))


@query(
    "gold_overlaps",
    f"""WITH x AS (SELECT DISTINCT doc_id, s, e, type FROM ({S.RAW_SQL}) r)
        SELECT doc_id, s AS "start", e AS "end", type FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.doc_id = x.doc_id AND y.s < x.e AND x.s < y.e AND (y.s, y.e, y.type) <> (x.s, x.e, x.type))""",
)
def overlaps_query(spark, d):
    return corpus.gold_overlaps(arbitrate.dedupe_spans(S.raw_spans(spark, d)))


_WIDE = "'a😀b' || {0} || '𝒳é'"


@query(
    "utf16_offsets",
    f"""SELECT c_custkey AS doc_id, 2 AS "start", CAST(3 + length(cast(c_custkey AS string)) + 1 AS INT) AS "end", 3 AS start_utf16,
          CAST(3 + length(cast(c_custkey AS string)) + 3 AS INT) AS end_utf16, true AS round_trip FROM customer""",
)
def utf16_query(spark, d):
    docs = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_WIDE.format('c_custkey')} AS text")
    spans = docs.select("doc_id", F.lit(2).alias("start"), (F.length("text") - 1).alias("end"), F.expr("substr(text, 3, length(text) - 3)").alias("text"))
    return corpus.utf16_offsets(docs, spans)




@query(
    "unicode_flags",
    """SELECT c_custkey AS doc_id, c_custkey % 5 = 1 AS astral, c_custkey % 5 IN (1, 2) AS emoji, c_custkey % 5 = 3 AS arabic, c_custkey % 5 = 4 AS combining,
         c_custkey % 5 <> 0 AS unicode_stress FROM customer""",
)
def unicode_query(spark, d):
    text = S._pick("c_custkey % 5", ("plain", "a😀", "☀ sun", "سلام", "é"))
    return corpus.unicode_flags(derived(spark, d, "customer", "c_custkey AS doc_id", f"{text} AS text"))


@query(
    "composition_gates",
    f"""WITH g AS ({S.GOLD_SQL}), c AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM documents WHERE length(text) > 3000) AS long,
          (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM g WHERE context_class = 'quasi_identifier')) AS quasi,
          (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM g WHERE type = 'SECRET')) AS secret, (SELECT count(*) FROM documents WHERE lang = 'en') AS en)
        SELECT gate, n, fl AS floor, n >= fl AS ok FROM (SELECT unnest(['docs', 'long', 'quasi', 'secret', 'lang:en']) AS gate, unnest([docs, long, quasi, secret, en]) AS n,
          unnest(CAST([100, 10, 10, 100000, 20] AS BIGINT[])) AS fl FROM c) x""",
)
def gates_query(spark, d):
    spans = S.gold_spans(spark, d).withColumn("layer", F.lit("entities"))
    return corpus.composition_gates(S.documents(spark, d), spans, {"docs": 100, "long": 10, "quasi": 10, "secret": 100000, "lang:en": 20})


@query(
    "stratified_subset",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) x WHERE r % 6 = 0 OR source = 'src3'""",
)
def subset_query(spark, d):
    return corpus.stratified_subset(table(spark, d, "documents"), 6, "source = 'src3'").select("doc_id", "lang")


@query(
    "secret_scan",
    f"""SELECT d.source, r.type, count(*) AS findings, count(DISTINCT r.doc_id) AS docs FROM ({S.DOC_RAW_SQL}) r JOIN documents d USING (doc_id)
        WHERE r.type = 'SECRET' GROUP BY ALL""",
)
def secret_query(spark, d):
    return corpus.secret_scan(S.documents(spark, d))


# --- stored predictions ----------------------------------------------------------------------------------


def _plain_sql(*columns: str) -> str:
    """``prediction_store.plain_row`` in the other engine's SQL."""
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-') || ';'" for c in columns)


def _digest_sql(source: str, *columns: str) -> str:
    words = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0) AS VARCHAR)" for i in range(8))
    return f"SELECT sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {words})) AS digest, count(*) AS n FROM (SELECT sha256({_plain_sql(*columns)}) AS h FROM ({source}) s) hs"


_RUNTIME = ["s_name" if k == "platform" else "NULL" for k in sorted(store.RUNTIME_KEYS)]


@query(
    "cache_signature",
    f"""SELECT s_suppkey AS doc_id, substr(sha256({_plain_sql("concat('{\"threshold\": 0.', s_suppkey % 9, '}')", 'md5(CAST(s_suppkey AS VARCHAR))', *_RUNTIME)}), 1, 16) AS signature FROM supplier""",
)
def signature_query(spark, d):
    """Signatures of one configuration per supplier."""
    keys = derived(
        spark, d, "supplier", "s_suppkey AS doc_id", "md5(cast(s_suppkey AS string)) AS model_files_hash",
        "concat('{\"threshold\": 0.', s_suppkey % 9, '}') AS inference_config", "map('platform', s_name) AS runtime",
    )
    return store.cache_signature(keys).select("doc_id", "signature")


@query(
    "content_hash",
    "SELECT n AS prediction_count, digest AS predictions_sha256 FROM ("
    + _digest_sql(f"SELECT *, NULL AS txt FROM ({S.PRED_SQL}) p", "doc_id", "model_id", "type", "s", "e", "txt", "score") + ") x",
)
def hash_query(spark, d):
    rows = S.pred_spans(spark, d).withColumnRenamed("type", "label").withColumn("text", F.lit(None).cast("string"))
    return store.content_hash(rows).select("prediction_count", "predictions_sha256")


@query("corpus_fingerprint", "SELECT digest AS fingerprint, n FROM (" + _digest_sql("SELECT * FROM documents", "doc_id", "lang", "n_chars", "source", "text") + ") x")
def corpus_fingerprint_query(spark, d):
    return store.corpus_fingerprint(table(spark, d, "documents"))


def _rule_counts(spark, d):
    """How often each single rule fires on the documents; rules without a hit do not show."""
    rows = detect.detect_rules(S.documents(spark, d))
    keys = {r.order: r.key for r in S.doc_rules()}
    pairs = ", ".join(f"{o}, '{k}'" for o, k in keys.items())
    return rows.groupBy(F.expr(f"element_at(map({pairs}), ord)").alias("rule")).agg(F.count("*").alias("n"))


add(
    "rule_counts",
    _rule_counts,
    f"""SELECT CASE type WHEN 'EMAIL' THEN 'B28' WHEN 'PHONE' THEN 'B31' WHEN 'CN_BANK_CARD' THEN 'B35' ELSE 'B42' END AS rule, count(*) AS n
        FROM ({S.DOC_RAW_SQL}) r GROUP BY 1""",
)
