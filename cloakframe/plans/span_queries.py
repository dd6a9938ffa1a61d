"""Queries over detection, arbitration, masking, restoring and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe import fixed
from cloakframe.functions.checks import CHECKS, check
from cloakframe.operators import arbitrate, detect, mask, registry
from cloakframe.operators.review import apply_reviews
from cloakframe.operators.rules import Rule
from cloakframe.plans import shapes as S
from cloakframe.plans.catalog import DUCK_LUHN, add, derived, query, table
from cloakframe.schema import compatible_pairs, compatible_sql, dim_entity_type
from cloakframe.sources.scratch import scratch_dir
from cloakframe.sources.texts import intake_guard, scan_texts

SPAN_OUT = ("doc_id", "start", "end", "type", "text", "confidence", "validated")
_OUT_SQL = 'doc_id, s AS "start", e AS "end", type, text, confidence, validated'


# --- sources -------------------------------------------------------------------------------


@query(
    "scan_texts",
    """SELECT 'documents' AS name, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
       WHERE trim(text) <> '' GROUP BY lang
       UNION ALL SELECT 'conversations', NULL, count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations WHERE trim(text) <> ''
       UNION ALL SELECT 'pages', NULL, count(*), CAST(sum(length(html)) AS BIGINT) FROM pages WHERE trim(html) <> ''""",
)
def scan_texts_query(spark, d):
    parts = [
        scan_texts(spark, d, name).select(F.lit(name).alias("name"), "lang", F.length("text").alias("n"))
        for name in ("documents", "conversations", "pages")
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("name", "lang").agg(F.count("*").alias("n_"), F.sum("n").alias("chars")).select(
        "name", "lang", F.col("n_").alias("n"), "chars"
    )


@query(
    "intake_guard",
    """SELECT CASE WHEN text IS NULL THEN 'null_text' WHEN trim(text) = '' THEN 'blank_text'
         WHEN length(text) > 1500 THEN 'too_long' ELSE 'accepted' END AS reason, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids
       FROM (SELECT doc_id, CASE doc_id % 7 WHEN 3 THEN NULL WHEN 5 THEN '   ' ELSE text END AS text FROM documents) x GROUP BY 1""",
)
def intake_guard_query(spark, d):
    docs = derived(spark, d, "documents", "doc_id", "CASE doc_id % 7 WHEN 3 THEN NULL WHEN 5 THEN '   ' ELSE text END AS text")
    ok, bad = intake_guard(docs, limit=1500)
    rows = ok.select("doc_id", F.lit("accepted").alias("reason")).unionByName(bad.select("doc_id", "reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


# --- detection -------------------------------------------------------------------------------


@query("detect_rules", f"SELECT {_OUT_SQL} FROM ({S.DOC_RAW_SQL}) r")
def detect_rules_query(spark, d):
    return detect.detect_rules(S.documents(spark, d)).select(*SPAN_OUT)


@query("detect_rules_conversations", "SELECT 0 AS n, 'none' AS type WHERE false")
def detect_conversations_query(spark, d):
    rows = detect.detect_rules(scan_texts(spark, d, "conversations"))
    return rows.groupBy("type").agg(F.count("*").cast("int").alias("n"))


# The page texts hold markup around the same four rule families.
_PAGE_RAW_SQL = S.DOC_RAW_SQL.replace(S._DOC_TEXT, "SELECT page_id AS doc_id, html AS text FROM pages")


@query("detect_rules_pages", f"SELECT {_OUT_SQL} FROM ({_PAGE_RAW_SQL}) r")
def detect_pages_query(spark, d):
    return detect.detect_rules(scan_texts(spark, d, "pages")).select(*SPAN_OUT)


@query("detect", f"SELECT {_OUT_SQL} FROM ({S.DOC_MERGED_SQL}) r")
def detect_query(spark, d):
    return registry.detect_documents(S.documents(spark, d), registry.Registry()).select(*SPAN_OUT)


def _stub(d):
    """A plug-in detector: the first word of every text is a person."""
    word = F.substring_index("text", " ", 1)
    return d.select("doc_id", *arbitrate.span_row(
        start=F.lit(0), end=F.length(word), type=F.lit("PERSON"), text=word, confidence=F.lit(0.7),
        sources=F.array(F.lit("stub")), ord=F.lit(5000)))


_STUB_SQL = """SELECT doc_id, 0 AS s, CAST(length(split_part(text, ' ', 1)) AS INT) AS e, split_part(text, ' ', 1) AS text,
    'PERSON' AS type, CAST(0.7 AS DOUBLE) AS confidence, false AS validated FROM documents"""


@query(
    "combine_detectors",
    f"""SELECT type, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, 'multilingual_rules|chinese_ie|stub' AS engines
        FROM (SELECT doc_id, s, e, text, type, confidence, validated FROM ({S.DOC_RAW_SQL}) a UNION ALL {_STUB_SQL}) u
        GROUP BY type""",
)
def combine_detectors_query(spark, d):
    reg = registry.Registry()
    reg.register(registry.Detector(registry.SEMANTIC, "stub", _stub))
    spans = registry.combine_detectors(S.documents(spark, d), reg, slots=[registry.SEMANTIC])
    return spans.groupBy("type").agg(
        F.count("*").alias("n"), F.sum("start").alias("starts"), F.max(F.array_join("engines", "|")).alias("engines")
    )


@query(
    "detector_plugin",
    f"""SELECT doc_id, s AS "start", e AS "end", type, text FROM ({S.DOC_MERGED_SQL}) r
        UNION ALL SELECT a.doc_id, a.s, a.e, a.type, a.text FROM ({_STUB_SQL}) a WHERE a.e > 0 AND NOT EXISTS (
          SELECT 1 FROM ({S.DOC_MERGED_SQL}) b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)""",
)
def detector_plugin_query(spark, d):
    """A registered plug-in beside the built-in detectors, merged in table form."""
    reg = registry.Registry()
    reg.register(registry.Detector(registry.SEMANTIC, "stub", _stub))
    return registry.detect_documents(S.documents(spark, d), reg, slots=[registry.SEMANTIC]).select(
        "doc_id", "start", "end", "type", "text"
    )


def _shaky(texts):
    """A plug-in that fails on texts whose length is divisible by five."""
    if any(len(t) % 5 == 0 for t in texts):
        raise ValueError("length")
    return [[{"start": 0, "end": len(t.split(" ")[0]), "type": "PERSON", "text": t.split(" ")[0], "confidence": 0.7}] for t in texts]


def shaky_registry() -> registry.Registry:
    reg = registry.Registry()
    reg.register(registry.Detector(registry.SEMANTIC, "shaky", batch=_shaky), enabled=True)
    return reg


@query(
    "detector_failing",
    f"""SELECT doc_id, CAST(CASE WHEN length(text) % 5 = 0 THEN 0 ELSE 1 END AS INT) AS spans,
        CASE WHEN length(text) % 5 = 0 THEN 'detector_failed:shaky:ValueError' END AS warning FROM documents""",
)
def detector_failing_query(spark, d):
    """A plug-in that fails on some documents: those get a warning, the others their spans."""
    reg = shaky_registry()
    done = registry.detected(S.documents(spark, d), reg)  # by its switch: no slot is named
    own = F.expr("size(filter(spans, x -> array_contains(x.sources, 'shaky')))")
    return done.select("doc_id", own.alias("spans"), F.get("warnings", F.lit(0)).alias("warning"))


@query("detector_switches", """SELECT * FROM (VALUES ('on', 'multilingual_rules|chinese_ie|stub'), ('off', 'multilingual_rules|chinese_ie'),
    ('no extraction', 'multilingual_rules'), ('named', 'multilingual_rules|chinese_ie|stub')) v(switch, engines) CROSS JOIN (SELECT count(*) AS docs FROM documents) n""")
def detector_switches_query(spark, d):
    """The engines that run for each state of the switches, over the same documents."""
    states = {}
    for name, on, extraction, slots in (("on", True, True, None), ("off", False, True, None), ("no extraction", False, False, None), ("named", False, True, [registry.SEMANTIC])):
        reg = registry.Registry()
        reg.register(registry.Detector(registry.SEMANTIC, "stub", _stub), enabled=on)
        reg.set_enabled(registry.CHINESE_IE, extraction)
        states[name] = (reg, slots)
    rows = registry.detected_each(S.documents(spark, d), states)
    return rows.groupBy(F.col("state").alias("switch"), F.array_join("engines", "|").alias("engines")).agg(F.count("*").alias("docs"))


@query(
    "rule_plugin",
    """SELECT doc_id, type, n FROM (SELECT doc_id, 'TICKET' AS type, len(regexp_extract_all(text, '[a-z]{3}tion')) AS n FROM documents) x WHERE n > 0""",
)
def rule_plugin_query(spark, d):
    """A registered extra rule, run alone."""
    reg = registry.Registry()
    rule = reg.register_rule(spark, Rule("X1", "TICKET", 0.9, "[a-z]{3}tion", gate=("tion",)))
    return detect.rule_spans(S.documents(spark, d), rule).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


# Chinese extraction on labelled lines derived from customers; the name of every fourth is
# not a name, and addresses come with and without a province.
_FAMILY = ("王", "李", "张", "刘", "陈", "杨", "黄", "赵", "吴", "周")
_NAME = f"({S._pick('c_custkey % 10', _FAMILY)} || {S._pick('c_custkey % 3', ('伟', '小明', '秀英'))})"
_ZH = (
    f"CASE c_custkey % 6 WHEN 0 THEN '联系人：' || {_NAME} || '，' || c_custkey WHEN 1 THEN '负责人是' || {_NAME} || '先生。' "
    f"WHEN 2 THEN '我叫' || {_NAME} || ' ' WHEN 3 THEN '由' || {_NAME} || '经理负责' WHEN 4 THEN '姓名：管理员 ' || c_custkey "
    f"ELSE '请联系' || {_NAME} || '！' END"
)
_ZH_CONF = "CASE c_custkey % 6 WHEN 3 THEN 0.88 WHEN 5 THEN 0.85 ELSE 0.92 END"


@query(
    "detect_cn_names_ie",
    f"""SELECT doc_id, CAST(instr(text, name) - 1 AS INT) AS "start", CAST(instr(text, name) - 1 + length(name) AS INT) AS "end",
          'CN_NAME' AS type, name AS text, CAST(conf AS DOUBLE) AS confidence
        FROM (SELECT c_custkey AS doc_id, {_ZH} AS text, {_NAME} AS name, {_ZH_CONF} AS conf FROM customer WHERE c_custkey % 6 <> 4) x""",
)
def cn_names_ie_query(spark, d):
    docs = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_ZH} AS text")
    return detect.detect_extraction(docs).filter("type = 'CN_NAME'").select("doc_id", "start", "end", "type", "text", "confidence")


_ADDR = "('上海市浦东新区世纪大道' || (c_custkey % 90 + 1) || '号环球大厦')"
_ADDR_TEXT = f"CASE c_custkey % 3 WHEN 0 THEN '寄往' || {_ADDR} || '，谢谢' || c_custkey WHEN 1 THEN '地址：' || {_ADDR} ELSE '送到世纪大道' || c_custkey || '号' END"


@query(
    "detect_cn_address_ie",
    f"""SELECT doc_id, CAST(instr(text, a) - 1 AS INT) AS "start", CAST(instr(text, a) - 1 + length(a) AS INT) AS "end",
          'CN_ADDRESS' AS type, a AS text FROM (SELECT c_custkey AS doc_id, {_ADDR_TEXT} AS text, {_ADDR} AS a FROM customer) x
        WHERE instr(text, a) > 0""",
)
def cn_address_ie_query(spark, d):
    docs = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_ADDR_TEXT} AS text")
    return detect.detect_extraction(docs).filter("type = 'CN_ADDRESS'").select("doc_id", "start", "end", "type", "text")


# --- post filters, on values derived from customers -------------------------------------------

_SPACED = "CASE c_custkey % 3 WHEN 0 THEN '  ab' || c_custkey || ' ' WHEN 1 THEN 'ab' || c_custkey ELSE chr(9) || c_custkey END"


@query(
    "trim_spans",
    f"""SELECT doc_id, CAST(7 + length(v) - length(ltrim(v, ' ' || chr(9))) AS INT) AS "start",
          CAST(7 + length(v) - length(ltrim(v, ' ' || chr(9))) + length(trim(v, ' ' || chr(9))) AS INT) AS "end",
          trim(v, ' ' || chr(9)) AS text FROM (SELECT c_custkey AS doc_id, {_SPACED} AS v FROM customer) x""",
)
def trim_spans_query(spark, d):
    rows = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_SPACED} AS v")
    spans = rows.withColumn("s", F.expr("named_struct('start', 7, 'end', 7 + length(v), 'text', v, 'idx', 0)"))
    return spans.select("doc_id", F.expr(detect.trim_span()).alias("s")).select("doc_id", "s.start", "s.end", "s.text")


def _filter_query(name: str, value: str, keep_sql: str, keep: str) -> None:
    """A post filter as a boolean over spans of a text ``t`` starting at 20."""

    def plan(spark, d):
        rows = derived(spark, d, "customer", "c_custkey AS doc_id", f"{value} AS v")
        rows = rows.withColumn("s", F.expr("named_struct('start', instr(v, '@') - 1, 'text', substring_index(v, '@', -1))"))
        return rows.select("doc_id", F.expr(keep).alias("keep"))

    add(name, plan, f"SELECT doc_id, {keep_sql} AS keep FROM (SELECT c_custkey AS doc_id, {value} AS v FROM customer) x")


_filter_query(
    "drop_doc_examples", S._pick("c_custkey % 3", ("k@abcEXAMPLE", "k@example1", "k@x-example")) + " || ''",
    "NOT (lower(v) LIKE '%example')", detect.not_doc_example(),
)
_filter_query(
    "drop_prose_username", S._pick("c_custkey % 4", ("@小王的号", "@小王", "@abc的", "@user")),
    "v NOT LIKE '%的%'", detect.not_prose(),
)
_filter_query(
    "drop_foreign_prefix",
    "CASE c_custkey % 4 WHEN 0 THEN 'tel +44 (@13800138000' WHEN 1 THEN 'call 0049-@13800138000' WHEN 2 THEN '+49 @+8613800138000' ELSE 'no 12 @13800138000' END",
    "doc_id % 4 >= 2", detect.not_foreign("v"),
)
_filter_query(
    "drop_uri_email", "CASE c_custkey % 2 WHEN 0 THEN 'http://u:p' || c_custkey || '@h.org' ELSE 'mail@h.org' END",
    "true", detect.not_uri_email("v"),
)
_PW = S._pick(
    "c_custkey % 12",
    ("Abc123!!", "short", "${HOME_X}", "<secret1>", "********a", "REDACTED1", "password", "密码策略要求1", "！！！！！！", "p@ss word", "env[KEY_1", "x⟦y⟧zzzz"),
)


@query("password_ok", f"SELECT c_custkey AS doc_id, c_custkey % 12 IN (0, 9) AS ok FROM customer")
def password_ok_query(spark, d):
    rows = derived(spark, d, "customer", "c_custkey AS doc_id", f"{_PW} AS v")
    return rows.select("doc_id", check("password_ok", "v").alias("ok"))


@query(
    "trim_password",
    """SELECT c_custkey AS doc_id, rtrim(CASE c_custkey % 3 WHEN 0 THEN 'abc;,' WHEN 1 THEN 'abc。' ELSE ';a;b' END, '。，,;；') AS text
       FROM customer""",
)
def trim_password_query(spark, d):
    value = "CASE c_custkey % 3 WHEN 0 THEN 'abc;,' WHEN 1 THEN 'abc。' ELSE ';a;b' END"
    rows = derived(spark, d, "customer", "c_custkey AS doc_id", f"{value} AS v")
    spans = rows.withColumn("s", F.expr("named_struct('start', 0, 'end', length(v), 'text', v, 'idx', 0)"))
    return spans.select("doc_id", F.expr(f"({detect.rtrim_span(detect.PASSWORD_TAIL, keep_whole=True)}).text").alias("text"))


# --- validators: value from the order key, expected result in SQL --------------------------------

_K = "o_orderkey"
_D16 = f"('4' || lpad(cast(({_K} * 7919) % 1000000000 AS string), 9, '3') || lpad(cast(({_K} * 104729) % 1000000 AS string), 6, '7'))"
_VALIDATORS = {
    "luhn": (f"CASE WHEN {_K} % 50 = 0 THEN '0000000000000000' ELSE {_D16} END",
             f"v <> '0000000000000000' AND {DUCK_LUHN.format('v')}"),
    "bank_card": (f"CASE WHEN {_K} % 3 = 0 THEN '9' || substr({_D16}, 2) WHEN {_K} % 3 = 1 THEN substr({_D16}, 1, 4) || ' ' || substr({_D16}, 5) ELSE {_D16} END",
                  f"v NOT LIKE '9%' AND {DUCK_LUHN.format(chr(114) + 'eplace(v, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + chr(39) + ')')}"),
    "ipv4": (f"({_K} % 300) || '.' || ({_K} % 7) || '.01.' || ({_K} % 260)", f"doc_id % 300 < 256 AND doc_id % 260 < 256"),
    "private_ipv4": (f"CASE {_K} % 3 WHEN 0 THEN '192.168.' WHEN 1 THEN '100.' || ({_K} % 140) || '.' ELSE '10.0.' END || ({_K} % 260) || CASE WHEN {_K} % 3 = 1 THEN '.1' ELSE '.9' END",
                     "CASE doc_id % 3 WHEN 0 THEN doc_id % 260 < 256 WHEN 1 THEN doc_id % 140 BETWEEN 64 AND 127 AND doc_id % 260 < 256 ELSE false END"),
    "ipv6": (S._pick(f"{_K} % 6", ("1:2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:7::", "1:2:3", "1:2:3:4:5:6:7:8::", "::")), "doc_id % 6 IN (0, 1, 2, 5)"),
    "mac": (f"CASE {_K} % 3 WHEN 0 THEN 'ff-ff-ff-ff-ff-FF' WHEN 1 THEN '00:1a:2b:3c:4d:' || substr(md5(cast({_K} AS string)), 1, 2) ELSE '00:1a:2b:3c:4d' END", "doc_id % 3 = 1"),
    "intl_phone": (f"CASE {_K} % 3 WHEN 0 THEN '+1 111 1111' WHEN 1 THEN '+49 (30) ' || (1000 + {_K}) ELSE '12-34' END", "doc_id % 3 = 1"),
    "card_expiry": (f"({_K} % 15) || ' / ' || CASE WHEN {_K} % 2 = 0 THEN '27' ELSE '202' END", "doc_id % 15 BETWEEN 1 AND 12 AND doc_id % 2 = 0"),
    "cn_mobile": (f"CASE {_K} % 3 WHEN 0 THEN '+86 138-0013-' || (1000 + {_K} % 9000) WHEN 1 THEN '0086138001380' || (10 + {_K} % 90) ELSE '138' || (1000 + {_K} % 9000) END",
                  "length(regexp_replace(regexp_replace(regexp_replace(v, '[^0-9]', '', 'g'), '^0086', ''), '^86', '')) = 11"),
    "jwt_header": (
        S._pick(f"{_K} % 5", ("eyJhbGciOiJIUzI1NiJ9", "eyJhbGciOiIifQ", "eyJ0eXAiOiJKV1QifQ", "eyJhbGciOiJSUzUxMiIsInR5cCI6IkpXVCJ9", "WyJhbGciXQ"))
        + f" || '.' || md5(cast({_K} AS string)) || '.' || CASE WHEN {_K} % 7 = 0 THEN '' ELSE 'abcdefgh' END",
        "doc_id % 5 IN (0, 3) AND doc_id % 7 <> 0"),
    "cn_id_card": (f"'11010519' || lpad(cast({_K} % 100 AS string), 2, '0') || lpad(cast({_K} % 14 AS string), 2, '0') || lpad(cast({_K} % 33 AS string), 2, '0') || lpad(cast(({_K} * 31) % 1000 AS string), 3, '0') || substr('10X98765432', cast({_K} % 11 + 1 AS int), 1)",
                   "try_strptime(substr(v, 7, 8), '%Y%m%d') IS NOT NULL AND substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), "
                   "lambda i: CAST(substr(v, i, 1) AS INT) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i])) AS INT) % 11 + 1, 1) = substr(v, 18, 1)"),
    "cn_uscc": (f"'91' || lpad(cast({_K} % 1000000 AS string), 6, '3') || 'MA' || lpad(cast(({_K} * 7919) % 10000000 AS string), 7, '1') || substr('0123456789ABCDEFGHJKLMNPQRTUWXYIO', cast({_K} % 33 + 1 AS int), 1)",
                "substr(v, 18, 1) NOT IN ('I', 'O') AND substr('0123456789ABCDEFGHJKLMNPQRTUWXY', CAST((31 - list_sum(list_transform(range(1, 18), "
                "lambda i: (instr('0123456789ABCDEFGHJKLMNPQRTUWXY', substr(v, i, 1)) - 1) * [1,3,9,27,19,26,16,17,20,29,25,13,8,24,10,30,28][i])) % 31) % 31 AS INT) + 1, 1) = substr(v, 18, 1)"),
    "iban": (f"'DE' || lpad(cast({_K} % 100 AS string), 2, '0') || '37040044' || lpad(cast(({_K} * 7919) % 10000000000 AS string), 10, '0')",
             "(CAST(substr(v, 5) || '1314' || substr(v, 3, 2) AS HUGEINT)) % 97 = 1"),
}


def _validator(name: str, value: str, expected: str) -> None:
    def plan(spark, d):
        rows = derived(spark, d, "orders", "o_orderkey AS doc_id", f"{value} AS v")
        return rows.select("doc_id", check(name, "v").alias("ok"))

    add(f"valid_{name}", plan, f"SELECT doc_id, ({expected}) AS ok FROM (SELECT o_orderkey AS doc_id, {value} AS v FROM orders) x")


for _name, (_value, _expected) in _VALIDATORS.items():
    _validator(_name, _value, _expected)
assert set(_VALIDATORS) | {"password_ok"} == set(CHECKS)


# --- arbitration ------------------------------------------------------------------------------------


@query(
    "dedupe_spans",
    f"""SELECT doc_id, s AS "start", e AS "end", type, text, confidence, array_to_string(sources, ',') AS sources, validated, ord
        FROM ({S.DEDUPED_SQL}) r""",
)
def dedupe_query(spark, d):
    out = arbitrate.dedupe_spans(S.raw_spans(spark, d)).withColumn("sources", F.array_join("sources", ","))
    return out.select("doc_id", "start", "end", "type", "text", "confidence", "sources", "validated", "ord")


_MERGED_OUT = f'{S.MERGED_CTE} SELECT doc_id, s AS "start", e AS "end", type, text, confidence, validated FROM merged'


@query("merge_spans", _MERGED_OUT)
def merge_query(spark, d):
    return arbitrate.merge_spans(S.raw_spans(spark, d)).select(*SPAN_OUT)


def packed_docs(spark, d):
    """Order texts with their raw spans packed into the row, as a scan would leave them."""
    spans = S.raw_spans(spark, d).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", *arbitrate.SPAN_COLUMNS[:-1]))).alias("p"))
    cols = ", ".join(f"'{c}', x.{c}" for c in arbitrate.SPAN_COLUMNS)
    packed = spans.select("doc_id", F.expr(f"transform(p, x -> named_struct({cols}))").cast(arbitrate._SPANS).alias("spans"))
    docs = S.order_docs(spark, d).join(packed, "doc_id", "left")
    return docs.withColumn("spans", F.expr(f"coalesce(spans, cast(array() AS {arbitrate._SPANS}))"))


@query("merge_spans_in_row", _MERGED_OUT)
def merge_array_query(spark, d):
    return detect.explode_spans(arbitrate.arbitrate(packed_docs(spark, d))).select(*SPAN_OUT)


@query(
    "resolve_level",
    f"""SELECT k AS doc_id, coalesce(lvl, CASE WHEN own IN ('PL1','PL2','PL3','PL4') THEN own END,
          CASE sem WHEN 'Health Info' THEN 'PL3' WHEN 'preference' THEN 'PL1' END, 'PL2') AS privacy_level
        FROM (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'SECRET' WHEN 1 THEN 'BIC' ELSE 'NEW_TYPE' END AS type,
                CASE o_orderkey % 5 WHEN 0 THEN 'PL4' WHEN 1 THEN 'PL9' END AS own,
                CASE o_orderkey % 3 WHEN 0 THEN 'Health Info' WHEN 1 THEN 'preference' END AS sem FROM orders) x
        LEFT JOIN {S.LEVEL_SQL} USING (type)""",
)
def level_query(spark, d):
    rows = derived(
        spark, d, "orders", "o_orderkey AS doc_id",
        "CASE o_orderkey % 4 WHEN 0 THEN 'SECRET' WHEN 1 THEN 'BIC' ELSE 'NEW_TYPE' END AS type",
        "CASE o_orderkey % 5 WHEN 0 THEN 'PL4' WHEN 1 THEN 'PL9' END AS privacy_level",
        "CASE o_orderkey % 3 WHEN 0 THEN 'Health Info' WHEN 1 THEN 'preference' END AS semantic_type",
    )
    return arbitrate.resolve_level(rows).select("doc_id", "privacy_level")


@query(
    "policy_filter",
    f"""{S.MERGED_CTE} SELECT doc_id, s AS "start", type, lvl AS privacy_level FROM merged JOIN {S.LEVEL_SQL} USING (type)
        WHERE lvl >= 'PL3'""",
)
def policy_query(spark, d):
    merged = arbitrate.resolve_level(arbitrate.merge_spans(S.raw_spans(spark, d)))
    return arbitrate.policy_filter(merged, "pl3").select("doc_id", "start", "type", "privacy_level")


@query("entity_counts", f"{S.MERGED_CTE} SELECT doc_id, type, count(*) AS n FROM merged GROUP BY doc_id, type")
def counts_query(spark, d):
    return arbitrate.entity_counts(arbitrate.merge_spans(S.raw_spans(spark, d)))


@query(
    "detection_report",
    f"""{S.MERGED_CTE}, agg AS (SELECT doc_id, string_agg(type || ':' || label || ':' || s || '-' || e, ',' ORDER BY s) AS entities,
          count(*) AS n FROM merged JOIN {S.LABELS_SQL} USING (type) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(entities, '') AS entities, coalesce(n, 0) AS n, CAST(length(d.text) AS INT) AS text_length, 'PL2' AS policy_level
        FROM ({S.DOCS_SQL}) d LEFT JOIN agg USING (doc_id)""",
)
def report_query(spark, d):
    out = arbitrate.detection_report(packed_docs(spark, d))
    cell = "concat(x.type, ':', x.label, ':', x.start_utf16, '-', x.end_utf16)"
    return out.select(
        "doc_id", F.expr(f"array_join(transform(entities, x -> {cell}), ',')").alias("entities"),
        F.expr("cast(aggregate(map_values(counts), 0, (a, x) -> a + x) AS bigint)").alias("n"), "text_length", "policy_level",
    )


@query(
    "report_engines",
    """SELECT doc_id, 'multilingual_rules|chinese_ie' || CASE WHEN length(text) % 5 = 0 THEN '' ELSE '|shaky' END AS engines,
        CASE WHEN length(text) % 5 = 0 THEN 'detector_failed:shaky:ValueError' ELSE '' END AS warnings, 'PL3' AS policy_level,
        CAST(length(text) AS INT) AS text_length FROM documents""",
)
def report_engines_query(spark, d):
    """The report of each document over all detectors, a failing plug-in among them."""
    out = arbitrate.detection_report(registry.detected(S.documents(spark, d), shaky_registry()), "PL3")
    return out.select("doc_id", F.array_join("engines", "|").alias("engines"), F.array_join("warnings", "|").alias("warnings"), "policy_level", "text_length")


# --- masking ------------------------------------------------------------------------------------------


def masked_docs(spark, d):
    return mask.mask_spans(arbitrate.arbitrate(packed_docs(spark, d)))


@query("allocate_tokens", f"{S.MERGED_CTE} SELECT doc_id, s AS \"start\", type, text, label, token FROM tokens")
def tokens_query(spark, d):
    return mask.allocate_tokens(arbitrate.merge_spans(S.raw_spans(spark, d))).select(
        "doc_id", "start", "type", "text", "label", "token"
    )


@query(
    "redacted_segments",
    f"""{S.MERGED_CTE}, t AS (SELECT t.*, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM tokens t)
        SELECT doc_id, 'token' AS kind, token AS text, s AS source_start, e AS source_end FROM t
        UNION ALL SELECT t.doc_id, 'text', substr(d.text, prev + 1, s - prev), prev, s FROM t JOIN ({S.DOCS_SQL}) d USING (doc_id) WHERE s > prev
        UNION ALL SELECT d.doc_id, 'text', substr(d.text, coalesce(m, 0) + 1), coalesce(m, 0), CAST(length(d.text) AS INT)
          FROM ({S.DOCS_SQL}) d LEFT JOIN (SELECT doc_id, max(e) AS m FROM t GROUP BY doc_id) l USING (doc_id) WHERE coalesce(m, 0) < length(d.text)""",
)
def segments_query(spark, d):
    return mask.redacted_segments(mask.mask_items(arbitrate.arbitrate(packed_docs(spark, d)))).select("doc_id", "kind", "text", "source_start", "source_end")


@query("mask", f"{S.MERGED_CTE} SELECT doc_id, 'ok' AS status, masked FROM masked")
def mask_query(spark, d):
    return masked_docs(spark, d).select("doc_id", "status", "masked")


_CHECK_SPANS = (
    "l_orderkey AS doc_id, l_linenumber * 10 + l_partkey % 4 AS start, l_linenumber * 10 + l_partkey % 4 + 8 AS {e}, "
    "'t' || (l_partkey % 6) AS token, 'v' || (l_partkey % 6) || CASE WHEN l_suppkey % 9 = 0 THEN 'x' ELSE '' END AS text"
)


@query(
    "mask_checks",
    f"""WITH x AS (SELECT {_CHECK_SPANS.format(e='"end"')} FROM lineitem),
          o AS (SELECT doc_id, bool_or(p > "start") AS over FROM (SELECT doc_id, "start", lag("end") OVER (PARTITION BY doc_id ORDER BY "start", "end") AS p FROM x) y GROUP BY doc_id),
          c AS (SELECT DISTINCT doc_id FROM x GROUP BY doc_id, token HAVING count(DISTINCT text) > 1)
        SELECT o.doc_id, CASE WHEN c.doc_id IS NOT NULL THEN 'token_collision' WHEN over THEN 'overlap' ELSE 'ok' END AS status
        FROM o LEFT JOIN c ON c.doc_id = o.doc_id""",
)
def mask_checks_query(spark, d):
    spans = table(spark, d, "lineitem").selectExpr(*_split(_CHECK_SPANS.format(e="`end`")))
    return mask.mask_checks(spans)


def _split(columns: str) -> list[str]:
    """Split a select list at commas outside brackets."""
    out, depth, cur = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


@query("build_vault", f"{S.MERGED_CTE} SELECT DISTINCT doc_id, token, text AS value, type, label FROM tokens")
def vault_query(spark, d):
    return mask.build_vault(masked_docs(spark, d))


# A reply quotes the masked text, repeats it for every third document, and adds a foreign placeholder.
_REPLY_SQL = "CASE WHEN doc_id % 3 = 0 THEN masked || masked ELSE substr(masked, 1, 60) END || ' ⟦姓名_99_0000⟧'"


@query(
    "restore",
    f"""{S.MERGED_CTE}, reply AS (SELECT doc_id, text, {_REPLY_SQL} AS reply FROM masked),
          v AS (SELECT DISTINCT doc_id, token, text AS value FROM tokens),
          hit AS (SELECT doc_id, token, value, (length(reply) - length(replace(reply, token, ''))) // length(token) AS n FROM v JOIN reply USING (doc_id))
        SELECT r.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS replaced, count(token) FILTER (WHERE n = 0) AS missing,
          CAST(CASE WHEN r.doc_id % 3 = 0 THEN 1 ELSE 1 END AS BIGINT) AS unknown,
          bool_and(CASE WHEN r.doc_id % 3 = 0 THEN true ELSE NULL END) AS whole
        FROM reply r LEFT JOIN hit USING (doc_id) GROUP BY r.doc_id""",
)
def restore_query(spark, d):
    """Replies restored from a stored vault: masking ran before, once."""
    docs = masked_docs(spark, d).select("doc_id", "text", "masked", "vault")
    place = scratch_dir(spark)
    docs.write.parquet(place)
    docs = spark.read.schema(docs.schema).parquet(place)
    replies = docs.select("doc_id", "text", F.expr(_REPLY_SQL).alias("reply"))
    out = mask.restore(replies, mask.build_vault(docs))
    whole = F.expr("if(doc_id % 3 = 0, restored = concat(text, text, ' ⟦姓名_99_0000⟧'), NULL)")
    return out.select(
        "doc_id", F.col("replaced").cast("long").alias("replaced"), F.size("missing").cast("long").alias("missing"),
        F.size("unknown").cast("long").alias("unknown"), whole.alias("whole"),
    )


@query(
    "mask_preview",
    """SELECT p_partkey AS doc_id, CASE WHEN length(v) <= 3 THEN substr(v, 1, 1) || repeat('•', greatest(1, length(v) - 1))
         ELSE substr(v, 1, 2) || repeat('•', least(8, length(v) - 3)) || right(v, 1) END AS preview
       FROM (SELECT p_partkey, substr(md5(cast(p_partkey AS string)), 1, CAST(p_partkey % 17 AS INT)) AS v FROM part) x""",
)
def preview_query(spark, d):
    rows = derived(spark, d, "part", "p_partkey AS doc_id", "substr(md5(cast(p_partkey AS string)), 1, CAST(p_partkey % 17 AS INT)) AS v")
    return rows.select("doc_id", F.expr(mask.mask_preview("v")).alias("preview"))


_FAST_CTE = S.DOC_MASK_CTE.replace("JOIN nums USING (doc_id, type, text) JOIN", "JOIN").replace(
    S.DOC_MASK_CTE[S.DOC_MASK_CTE.index("'⟦' || regexp_replace") : S.DOC_MASK_CTE.index(" AS token")],
    "'⟦' || m.type || '_01_' || substr(sha1(m.type || m.text), 1, 8) || '⟧'",
)


@query("fast_mask", f"{_FAST_CTE} SELECT doc_id, md5(masked) AS masked_md5, CAST(length(masked) AS INT) AS n FROM masked")
def fast_mask_query(spark, d):
    out = mask.fast_mask(S.documents(spark, d))
    return out.select("doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").alias("n"))


@query(
    "mask_documents",
    f"{S.DOC_MASK_CTE} SELECT doc_id, 'ok' AS status, md5(masked) AS masked_md5, CAST(length(masked) AS INT) AS n FROM masked",
)
def mask_documents_query(spark, d):
    out = mask.protect(S.documents(spark, d))
    return out.select("doc_id", "status", F.md5("masked").alias("masked_md5"), F.length("masked").alias("n"))


@query(
    "mask_summary",
    f"""{S.DOC_MASK_CTE} SELECT d.lang, t.type, count(*) AS spans, count(DISTINCT t.doc_id) AS docs,
          CAST(sum(length(t.text)) AS BIGINT) AS chars FROM tokens t JOIN documents d USING (doc_id) GROUP BY d.lang, t.type""",
)
def mask_summary_query(spark, d):
    """The flagship: guard, detect, arbitrate and mask; then placeholders by language and type."""
    done = mask.protect(S.documents(spark, d))
    items = done.select("doc_id", "lang", "status", F.explode_outer("items").alias("i")).filter("status = 'ok' AND i IS NOT NULL")
    return items.groupBy("lang", F.col("i.type").alias("type")).agg(
        F.count("*").alias("spans"), F.count_distinct("doc_id").alias("docs"), F.sum(F.length("i.text")).alias("chars")
    )


@query("idempotence_gate", "SELECT count(*) AS docs, count(*) AS idempotent, CAST(0 AS BIGINT) AS redetected FROM documents")
def idempotence_query(spark, d):
    out = mask.idempotence_gate(S.documents(spark, d))
    return out.agg(
        F.count("*").alias("docs"), F.count_if("idempotent").alias("idempotent"), F.sum("redetected").alias("redetected")
    )


@query("roundtrip_gate", "SELECT count(*) AS docs, count(*) AS same FROM documents")
def roundtrip_query(spark, d):
    out = mask.roundtrip_gate(mask.protect(S.documents(spark, d)))
    return out.agg(F.count("*").alias("docs"), F.count_if("same").alias("same"))


@query(
    "stability_check",
    """WITH a AS (SELECT DISTINCT l_orderkey AS doc_id, 'x ' || (l_partkey % 9) AS surface FROM lineitem),
         b AS (SELECT DISTINCT l_orderkey AS doc_id, 'x ' || (CASE WHEN l_suppkey % 10 = 0 THEN l_partkey % 8 ELSE l_partkey % 9 END) AS surface FROM lineitem)
       SELECT doc_id, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS differences
       FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.surface AS x, b.surface AS y FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.surface = b.surface) z
       GROUP BY doc_id""",
)
def stability_query(spark, d):
    a = derived(spark, d, "lineitem", "l_orderkey AS doc_id", "'X  ' || (l_partkey % 9) AS text")
    b = derived(spark, d, "lineitem", "l_orderkey AS doc_id",
                "' x ' || (CASE WHEN l_suppkey % 10 = 0 THEN l_partkey % 8 ELSE l_partkey % 9 END) AS text")
    return mask.stability_check(a, b)


@query(
    "token_reuse",
    """SELECT l_orderkey AS doc_id, 'PERSON' AS type, 'v' || (l_partkey % 3) AS text, count(*) AS mentions, CAST(1 AS BIGINT) AS tokens
       FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def token_reuse_query(spark, d):
    """Each repeated value of a document has one token."""
    spans = derived(spark, d, "lineitem", "l_orderkey AS doc_id", "l_linenumber AS start", "'PERSON' AS type", "'v' || (l_partkey % 3) AS text")
    return mask.token_reuse(mask.allocate_tokens(spans))


@query(
    "handover_text",
    f"{S.MERGED_CTE} SELECT doc_id, md5('{fixed.HANDOVER_NOTE.strip()}' || chr(10) || chr(10) || masked) AS handover FROM masked",
)
def handover_query(spark, d):
    return mask.handover_text(masked_docs(spark, d)).withColumn("handover", F.md5("handover"))


# --- review ---------------------------------------------------------------------------------------------

# One e-mail-like span [2, 8) per order; every order gets one action by its key.
_REVIEW_SQL = """SELECT doc_id, "start", "end", type, text, enabled, refused FROM (
  SELECT k AS doc_id, CASE k % 5 WHEN 3 THEN 10 ELSE 2 END AS "start", CASE k % 5 WHEN 3 THEN 16 ELSE 8 END AS "end", 'EMAIL' AS type,
     substr(t, CASE k % 5 WHEN 3 THEN 11 ELSE 3 END, 6) AS text, k % 5 <> 1 AS enabled, CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END AS refused
  FROM b WHERE k % 5 <> 0
  UNION ALL SELECT k, 20, 25, 'PHONE', substr(t, 21, 5), true, 0 FROM b WHERE k % 5 = 2) z"""


@query("apply_reviews", f"WITH b AS (SELECT o_orderkey AS k, {S.HEX.format('o_orderkey')} AS t FROM orders) {_REVIEW_SQL}")
def reviews_query(spark, d):
    docs = S.order_docs(spark, d)
    one = F.array(F.struct(*arbitrate.span_row(start=F.lit(2), end=F.lit(8), type=F.lit("EMAIL"), text=F.substring("text", 3, 6)))).cast(arbitrate._SPANS)
    kind = "CASE o_orderkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'disable' WHEN 2 THEN 'add' WHEN 3 THEN 'retarget' ELSE 'add' END"
    actions = derived(
        spark, d, "orders", "o_orderkey AS doc_id", "1 AS seq", f"{kind} AS action",
        "CASE WHEN o_orderkey % 5 IN (2, 4) THEN 'PHONE' ELSE 'EMAIL' END AS type",
        "CASE o_orderkey % 5 WHEN 2 THEN 25 WHEN 4 THEN 6 ELSE 2 END AS start",
        "CASE o_orderkey % 5 WHEN 2 THEN 20 WHEN 4 THEN 12 ELSE 8 END AS `end`", "10 AS new_start", "16 AS new_end",
    )
    out = apply_reviews(docs.withColumn("spans", one), actions)
    return out.select("doc_id", "refused", F.explode_outer("review").alias("r")).filter("r IS NOT NULL").select(
        "doc_id", "r.start", "r.end", "r.type", "r.text", "r.enabled", "refused"
    )


# --- dimensions ------------------------------------------------------------------------------------------


@query(
    "entity_dimension",
    f"""SELECT type, label, prio AS priority, coalesce(lvl, 'PL2') AS privacy_level, count(*) AS spans
        FROM ({S.RAW_SQL}) r JOIN {S.LABELS_SQL} USING (type) JOIN {S.PRIORITY_SQL} USING (type) LEFT JOIN {S.LEVEL_SQL} USING (type)
        GROUP BY ALL""",
)
def dimension_query(spark, d):
    dim = F.broadcast(dim_entity_type(spark))  # 58 fixed rows
    return S.raw_spans(spark, d).drop("privacy_level").join(dim, "type").groupBy("type", "label", "priority", "privacy_level").agg(
        F.count("*").alias("spans")
    )


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in compatible_pairs())


@query(
    "types_compatible",
    f"""SELECT g.type AS gold_type, p.type AS pred_type, g.type = p.type OR (g.type, p.type) IN (VALUES {_PAIRS}) AS compatible, count(*) AS n
        FROM ({S.GOLD_SQL}) g JOIN ({S.PRED_SQL}) p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e GROUP BY ALL""",
)
def compatible_query(spark, d):
    g = S.gold_spans(spark, d).select("doc_id", "start", "end", F.col("type").alias("gold_type"))
    p = S.pred_spans(spark, d).select("doc_id", "start", "end", F.col("type").alias("pred_type"))
    both = g.join(p, ["doc_id", "start", "end"])
    return both.withColumn("compatible", F.expr(compatible_sql("gold_type", "pred_type"))).groupBy(
        "gold_type", "pred_type", "compatible"
    ).agg(F.count("*").alias("n"))


