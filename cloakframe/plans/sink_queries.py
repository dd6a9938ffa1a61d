"""Queries that write and read back: streams, vault containers, stored predictions, gold files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import mask
from cloakframe.plans import shapes as S
from cloakframe.plans.catalog import query
from cloakframe.plans.span_queries import masked_docs
from cloakframe.sources import gold, prediction_store as store, vault
from cloakframe.sources.scratch import scratch_dir
from cloakframe.streaming.mask_stream import manifest_of, mask_stream, published


_QUARANTINED = "doc_id % 11 = 3"


@query(
    "mask_stream",
    f"""{S.DOC_MASK_CTE} SELECT doc_id, 'masked' AS sink, md5(masked) AS content, CAST(length(masked) AS INT) AS n FROM masked WHERE NOT ({_QUARANTINED})
      UNION ALL SELECT DISTINCT doc_id, 'vault', md5(token || text), CAST(length(text) AS INT) FROM tokens WHERE NOT ({_QUARANTINED})
      UNION ALL SELECT doc_id, 'quarantine', 'blank_text' || ' ', 1 FROM documents WHERE {_QUARANTINED}""",
)
def mask_stream_query(spark, d):
    """The three sinks of the masking stream over the documents; every eleventh text is blank and goes to quarantine with its text."""
    root = scratch_dir(spark)
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    # A pattern: a stream takes no plain path of a single file, and the table may be a file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{d}/{{documents.parquet}}")
    rows = stream.select("doc_id", F.expr(f"if({_QUARANTINED}, ' ', text)").alias("text"))
    paths = [f"{root}/{name}" for name in ("masked", "vault", "quarantine")]
    mask_stream(rows, *paths, f"{root}/checkpoint").awaitTermination()
    masked, kept, held = (published(spark, p, manifest_of(paths[0])) for p in paths)
    return (
        masked.select("doc_id", F.lit("masked").alias("sink"), F.md5("masked").alias("content"), F.length("masked").alias("n"))
        .unionByName(kept.select("doc_id", F.lit("vault").alias("sink"), F.md5(F.concat("token", "value")).alias("content"), F.length("value").alias("n")))
        .unionByName(held.select("doc_id", F.lit("quarantine").alias("sink"), F.concat("status", "text").alias("content"), F.length("text").alias("n")))
    )


@query("vault_round_trip", f"{S.MERGED_CTE} SELECT DISTINCT doc_id, token, text AS value, type, label FROM tokens")
def vault_query(spark, d):
    """Encrypted containers written to a table, read back and opened."""
    root = scratch_dir(spark)
    vault.encrypt_vault(mask.build_vault(masked_docs(spark, d)), "a long pass phrase").write.parquet(f"{root}/vault")
    return vault.decrypt_vault(spark.read.parquet(f"{root}/vault"), "a long pass phrase")


@query(
    "stored_predictions",
    f"SELECT doc_id, s AS \"start\", e AS \"end\", type AS label, score FROM ({S.PRED_SQL}) p WHERE model_id = 'm0' AND score >= 0.5",
)
def store_query(spark, d):
    """Predictions stored with their manifest and loaded again after verification."""
    root = scratch_dir(spark)
    preds = S.pred_spans(spark, d).filter("model_id = 'm0'").withColumnRenamed("type", "label").withColumn(
        "text", F.lit(None).cast("string"))
    key = store.StoreKey("0" * 64, "lineitem", "m0", "r1", inference_config={"threshold": 0.3})
    store.save_predictions(preds, key, root, {"lineitem"})
    loaded = store.load_predictions(spark, root, key)
    return loaded.filter("score >= 0.5").select("doc_id", "start", "end", "label", "score")


@query(
    "read_gold",
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, s AS "start", e AS "end", type, should_redact FROM ({S.GOLD_SQL}) g""",
)
def gold_query(spark, d):
    """A layered gold corpus as JSON lines, read with its schema and taken apart."""
    root = scratch_dir(spark)
    spans = S.gold_spans(spark, d).groupBy("doc_id").agg(
        F.collect_list(F.struct(F.lit("x").alias("text"), "start", "end", "type", "should_redact", "context_class")).alias("entities")
    )
    docs = S.order_docs(spark, d).join(spans, "doc_id", "left")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("en").alias("language"), "text", "entities")
    rows.write.json(f"{root}/gold")
    return gold.gold_spans(gold.read_gold(spark, f"{root}/gold", "layered")).select("doc_id", "start", "end", "type", "should_redact")


_PART = "concat(coalesce(lang, 'none'), '-', doc_id div 1000)"


@query(
    "dataset_fingerprint",
    """WITH t AS (SELECT doc_id, coalesce(lang, 'none') || '-' || (doc_id // 1000) AS name, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
      l AS (SELECT name, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM t),
      o AS (SELECT name, sha256(line) AS h, strlen(line) + 1 AS n, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY name ORDER BY doc_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
      d AS (SELECT name, n, CAST(pos AS BIGINT) // 65536 AS c, sha256(CAST(CAST(pos AS BIGINT) AS VARCHAR) || ':' || h) AS h FROM o),
      c AS (SELECT name, c, """ + "sha256(concat_ws(':', CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + """)) AS d FROM d GROUP BY name, c),
      f AS (SELECT name, """ + "sha256(concat_ws(':', CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + """)) AS d
            FROM (SELECT name, sha256(c || ':' || d) AS h FROM c) x GROUP BY name),
      z AS (SELECT sha256(concat_ws(':', name, CAST(size AS VARCHAR), d)) AS h FROM f JOIN (SELECT name, CAST(sum(n) AS BIGINT) AS size FROM d GROUP BY name) s USING (name))
      SELECT """ + "sha256(concat_ws(':', CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + """)) AS fingerprint FROM z""",
)
def dataset_fingerprint_query(spark, d):
    """The documents written as files of lines, one file for each language and thousand of ids, and fingerprinted from the files."""
    root = scratch_dir(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_PART).alias("part"), F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").option("lineSep", "\n").text(root)
    return store.dataset_fingerprint(store.file_fingerprints(spark, root, "*.txt", "regexp_extract(path, 'part=([^/]*)', 1)", 1 << 16))
