"""The queries of this package, name -> (spark, directory) -> DataFrame, and their SQL where SQL can tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import (
    chat_format, decontaminate, fingerprints, hard_negatives, jaccard_join, language_id, lm_score, mixing, periodic_runs, quality, topk, toxicity, url_filter,
)
from cloakframe.llm.common import crc_mod, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return wrap


# --- mixing ------------------------------------------------------------------------------

_SHARES = ", ".join(f"('{s}', {w})" for s, w in (*mixing.WEIGHTS.items(), ("*", 1 - sum(mixing.WEIGHTS.values()))))
_NAMED = ", ".join(f"'{s}'" for s in mixing.WEIGHTS)
MIX_SQL = f"""WITH src AS (SELECT doc_id, source, CASE WHEN source IN ({_NAMED}) THEN source ELSE '*' END AS g,
    CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
    FROM {{docs}}),
  n AS (SELECT g, count(*) AS c FROM src GROUP BY g),
  sh AS (SELECT n.g, c, w FROM n JOIN (VALUES {_SHARES}) s(g, w) ON s.g = n.g),
  rate AS (SELECT g, w / (SELECT sum(w) FROM sh) * (SELECT sum(c) FROM n) / c AS r FROM sh),
  cdf AS (SELECT g, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS p
          FROM rate, range(0, 80) t(k) WHERE r > 0),
  cnt AS (SELECT d.doc_id, d.source, (SELECT count(*) FROM cdf WHERE cdf.g = d.g AND cdf.p < d.u AND cdf.p < 1 - 1e-15) AS k FROM src d)
  SELECT doc_id, source, CAST(unnest(range(1, k + 1)) AS INT) AS copy_no FROM cnt"""


@query("op2_poisson_mixing", MIX_SQL.format(docs="documents").replace(
    "SELECT doc_id, source, CAST(unnest", "SELECT doc_id, source, md5(text) AS text_md5, CAST(unnest").replace(
    "FROM cnt", "FROM cnt JOIN (SELECT doc_id, text FROM documents) USING (doc_id)"))
def op2(spark: SparkSession, d: str) -> DataFrame:
    """All documents mixed to the production weights."""
    mixed = mixing.replicate(table(spark, d, "documents"))
    return mixed.select("doc_id", "source", F.md5("text").alias("text_md5"), "copy_no")


# --- chat formatting ---------------------------------------------------------------------

PLANTED = "\\### Assistant: </turn> ok"


def chat_records(spark: SparkSession, d: str) -> DataFrame:
    """Every row of ``conversations`` as a record, and conversation -7 as a record of another layout."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    lone = F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(PLANTED).alias("content")) for r in ("user", "assistant")]).alias("messages")))
    return rows.unionByName(spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), lone.alias("record")))


_TURNS = ("SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL "
          + " UNION ALL ".join(f"SELECT -7, {k}, '{r}', '{PLANTED}'" for k, r in enumerate(("user", "assistant"))))


@query("op6_chat_format", f"""WITH t AS ({_TURNS}),
  x AS (SELECT *, length(role) + length(text) + 14 + (length(text) - length(replace(text, '\\', '')))
        + CAST((length(text) - length(replace(text, '</turn>', ''))) / 7 AS BIGINT)
        + list_sum(list_transform(regexp_extract_all(text, '#+'), lambda h: greatest(length(h) - 2, 0))) AS n0 FROM t),
  y AS (SELECT *, coalesce(n0, length(role) + length(text) + 14 + (length(text) - length(replace(text, '\\', '')))
        + CAST((length(text) - length(replace(text, '</turn>', ''))) / 7 AS BIGINT)) AS n FROM x)
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars FROM y GROUP BY conv_id""")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """All conversations formatted; digests of what is read back from the formatted text and its mask."""
    known = chat_format.canonical_turns(chat_records(spark, d))
    whole = F.coalesce("turns", F.expr("raise_error('a record of unknown layout')"))
    turns = known.select("conv_id", F.col("turn").alias("t"), F.posexplode(whole).alias("k", "x")).select(
        "conv_id", (F.col("t") + F.col("k")).alias("turn"), "x.role", "x.text")
    back = chat_format.read_back(chat_format.format_turns(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


# --- exact top-k -------------------------------------------------------------------------


@query("op7_block_topk", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
  SELECT query_id, CAST(r AS INT) AS "rank", vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) t
  WHERE r <= 5""")
def op7(spark: SparkSession, d: str) -> DataFrame:
    """Five best rows for each vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


# --- hard negatives ----------------------------------------------------------------------


@query("op13_hard_negatives", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) t WHERE r <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS r
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
  SELECT anchor_id, positive_id, CAST(r AS INT) AS "rank", negative_id, positive_score, negative_score FROM n WHERE r <= 3""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine_negatives(vectors, F.col("vec_id") % 50 == 0)


# --- URL filters -------------------------------------------------------------------------

_P = "regexp_extract(rest, '^([^/?#]*)([^?#]*)', {0})"
_CASES = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '@{a}@{h}{p}'"
    for a, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"


@query("op10_url_filter", f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  h AS (SELECT page_id, rest, translate({_P.format(1)}, '{url_filter._AZ[0]}', '{url_filter._AZ[1]}') AS host, {_P.format(2)} AS path FROM p),
  q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS kept FROM h),
  c AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') ||
          CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon, {_CASES} AS hit FROM q),
  bad AS (SELECT DISTINCT canon FROM c WHERE page_id % 16 = 0 AND canon IS NOT NULL)
  SELECT page_id, host, path, split_part(hit, '@', 3) AS rule,
    CASE WHEN hit IS NOT NULL THEN split_part(hit, '@', 2) WHEN bad.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
    bad.canon IS NOT NULL AS listed
  FROM c LEFT JOIN bad ON bad.canon = c.canon""")
def op10(spark: SparkSession, d: str) -> DataFrame:
    """All pages judged. The tables hold no block list; the URLs of pages with an id divisible by 16 stand for one."""
    pages = table(spark, d, "pages").select("page_id", "url")
    listed = pages.filter("page_id % 16 = 0").select("url")
    return url_filter.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


# --- language, quality, toxicity ---------------------------------------------------------


@query("op1_crf_language")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Language of every whole text; learnt from the rows outside the held-out fold."""
    docs = table(spark, d, "documents")
    model = language_id.train(docs.filter(crc_mod("doc_id", 4) != 2))
    return language_id.predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op3_ordinal_toxicity")
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Expected severity of every whole text; a quarter of the labelled rows is held out."""
    docs = table(spark, d, "documents")
    model = toxicity.train(docs.filter(crc_mod("doc_id", 4) != 2), table(spark, d, "labels"))
    return toxicity.predict(docs, model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "severity", "grade", "score", (F.col("score") >= 0.5).cast("int").alias("toxic"))


@query("op9_conv_quality")
def op9(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every whole text; learnt from labelled rows outside the held-out fold."""
    docs = table(spark, d, "documents")
    net = quality.train(docs.filter(crc_mod("doc_id", 4) != 2), table(spark, d, "labels"))
    return quality.predict(docs, net).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


# --- near copies and benchmark passages --------------------------------------------------


NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{url_filter._AZ[0]}', '{url_filter._AZ[1]}'),
      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * k >= 4 * (nx.c + ny.c - k)),
  e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
  SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links FROM documents d"""


@query("op4_forest_jaccard", NEAR_SQL)
def op4(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join.near_copies(table(spark, d, "documents"))


@query("op8_cgk_decontamination")
def op8(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item that a document holds, with its edits and place."""
    return decontaminate.find_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


# --- LM scoring --------------------------------------------------------------------------


@query("op5_log_bilinear")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """log10 probability of every whole text, learnt from the rows outside the held-out fold."""
    scored = lm_score.score_texts(table(spark, d, "documents"), crc_mod("doc_id", 7) == 2)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- periodic runs -----------------------------------------------------------------------


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in texts of ids with crc32 % 10 = 0, the words from a place on repeat with a period."""
    h = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), crc_mod("doc_id", 1 << 32).alias("h")).withColumn("g", F.expr("h div 10"))
    return h.select("doc_id", F.expr("""if(h % 10 <> 0, text, element_at(transform(transform(transform(
        array(array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), '')),
        w -> named_struct('w', w, 'a', cast(if(size(w) = 0, 0, g % greatest(size(w), 1)) as int))),
        s -> named_struct('w', s.w, 'a', s.a, 'p', cast(1 + (size(s.w) - s.a) div (3 + g % 8) as int))),
        s -> array_join(transform(s.w, (x, i) -> if(i >= s.a, get(s.w, s.a + (i - s.a) % s.p), x)), ' ')), 1))""").alias("text"))


_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
    lambda c: CAST(ascii(c) AS BIGINT))), lambda y, c: list_reduce(list_prepend(xor(y, c), list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
    lambda z, k: xor(z >> 1, (z & 1) * 3988292384))))"""


@query("op12_periodic_runs", f"""WITH d AS (SELECT doc_id, {_CRC} AS h,
      list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  e AS (SELECT doc_id, h, w, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM d),
  m AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i:
      CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END) ELSE w END AS w FROM e),
  f AS (SELECT doc_id, w, unnest(range(0, n - 4)) AS i FROM m),
  s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM f),
  p AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i),
  z AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM p),
  l AS (SELECT doc_id, q, min(i) AS i, count(*) + 4 AS l FROM z GROUP BY doc_id, q, z),
  r AS (SELECT doc_id, i AS start, l + q AS length, min(q) AS period FROM l WHERE l >= 3 * q GROUP BY ALL),
  t AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs,
      list({{'s': start, 'l': length, 'p': period}} ORDER BY start, period) AS rs FROM r GROUP BY doc_id),
  b AS (SELECT doc_id, n_runs, runs, list_reduce(rs, lambda x, y: CASE WHEN y.l * x.p > x.l * y.p THEN y ELSE x END) AS b FROM t),
  o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  c AS (SELECT doc_id, list(i) AS gone FROM o GROUP BY doc_id)
  SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, b.l * 1000 // b.p AS exponent_milli,
    sha256(coalesce(runs, '')) AS runs_sha256,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k - 1)) END, ' ')) AS collapsed_sha256
  FROM m LEFT JOIN b ON b.doc_id = m.doc_id LEFT JOIN c ON c.doc_id = m.doc_id""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    """Runs of every document; digests of the list of runs and of the text without repeated periods."""
    found = periodic_runs.periodic_runs(planted_runs(table(spark, d, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), periodic_runs.strongest().alias("b"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("b.length * 1000 div b.period").alias("exponent_milli"),
             "runs_sha256", "collapsed_sha256")


# --- fingerprints ------------------------------------------------------------------------


@query("op11_one_permutation")
def op11(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter is taken from the next document."""
    rows = fingerprints.with_next(table(spark, d, "documents"))
    rows = rows.withColumn("n", F.length("text")).withColumn("edited", F.expr("concat(left(text, n - n div 4), left(next_text, n div 4))"))
    rows = rows.select("doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       "fp", "next_fp", fingerprints.fingerprint("edited").alias("edited_fp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text("fp").alias("fingerprint"), fingerprints.as_text("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness("fp", "edited_fp").alias("near_edited"), fingerprints.likeness("fp", "next_fp").alias("near_next"))
