import json

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import arbitrate, mask, registry
from cloakframe.operators.rules import Rule, built_in_rules
from cloakframe.sources import gold, prediction_store as store, vault
from cloakframe.sources.texts import intake_guard
from cloakframe.streaming.mask_stream import mask_stream, masked_rows

PRED = "doc_id bigint, model_id string, label string, start int, `end` int, text string, score double"


def test_intake(spark):
    rows = [(1, "ok\u0001x"), (2, " \n　"), (3, None), (4, "y" * 11)]
    ok, bad = intake_guard(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=10)
    assert [(r.doc_id, r.text) for r in ok.collect()] == [(1, "ok x")]
    assert {r.doc_id: r.reason for r in bad.collect()} == {2: "blank_text", 3: "null_text", 4: "too_long"}


def test_gold(spark, tmp_path):
    row = {"id": "a", "language": "zh", "text": "张三x", "entities": [{"text": "张三", "start": 0, "end": 2, "type": "CN_NAME"}]}
    (tmp_path / "g.jsonl").write_text(json.dumps(row, ensure_ascii=False) + "\n\n", encoding="utf-8")
    corpus = gold.read_gold(spark, str(tmp_path / "g.jsonl"), "multilingual")
    assert [(r.doc_id, r.type, r.should_redact) for r in gold.gold_spans(corpus).collect()] == [("a", "CN_NAME", True)]


def key(**kw):
    base = dict(corpus_sha256="a" * 64, corpus_file="c.jsonl", model_id="org/m", revision="main", model_files_hash="h",
                inference_config={"threshold": 0.3}, runtime={"platform": "x"})
    return store.StoreKey(**{**base, **kw})


def test_store(spark, tmp_path):
    root = str(tmp_path)
    rows = [(1, "m", "person", 0, 3, "abc", 0.9), (2, "m", "phone", 0, 3, "abc", 0.4)]
    preds = spark.createDataFrame(rows, PRED)
    with pytest.raises(store.CorpusNotAllowed):
        store.save_predictions(preds, key(corpus_file="private.jsonl"), root, {"c.jsonl"})
    sig = store.save_predictions(preds, key(), root, {"c.jsonl"})
    assert len(sig) == 16 and store.load_predictions(spark, root, key()).count() == 2
    assert store.load_predictions(spark, root, key(), signature="any").count() == 2
    with pytest.raises(FileNotFoundError):
        store.load_predictions(spark, root, key(model_files_hash="other"))
    # Tampered content, then a lost manifest, then two signatures.
    path = f"{root}/predictions/corpus_id={'a' * 16}/model_key=org_m/revision_key=main/signature={sig}"
    spark.createDataFrame([(1, "m", "person", 0, 3, "abc", 0.9), (2, "m", "phone", 0, 3, "abc", 0.5)], PRED).write.mode("overwrite").parquet(path)
    with pytest.raises(store.ContentMismatch):
        store.load_predictions(spark, root, key())
    import shutil

    shutil.move(f"{root}/manifest", f"{root}/gone")
    with pytest.raises(store.MissingManifest):
        store.load_predictions(spark, root, key())
    assert store.load_predictions(spark, root, key(), allow_unverified=True).count() == 2
    store.save_predictions(preds, key(model_files_hash="h2"), root, {"c.jsonl"})
    with pytest.raises(store.AmbiguousSignature):
        store.load_predictions(spark, root, key(), signature="any")


def test_content_hash_ignores_order(spark):
    rows = [(i, "m", "x", i, i + 1, "t", 0.5) for i in range(50)]
    df = spark.createDataFrame(rows, PRED)
    a, b = store.content_hash(df).first(), store.content_hash(df.orderBy(F.desc("doc_id")).repartition(5)).first()
    assert a == b != store.content_hash(df.filter("doc_id > 0")).first()


def test_vault(spark):
    rows = spark.createDataFrame([(1, "⟦a⟧", "v1", "T", "L"), (1, "⟦b⟧", "v2", "T", "L"), (2, "⟦a⟧", "v", "T", "L")],
                                 "doc_id bigint, token string, value string, type string, label string")
    with pytest.raises(vault.VaultError):
        vault.encrypt_vault(rows, "short")
    sealed = vault.encrypt_vault(rows, "long enough pass").cache()
    assert "long enough" not in sealed._jdf.queryExecution().toString()
    assert sorted(map(tuple, vault.decrypt_vault(sealed, "long enough pass").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="cannot be opened"):
        vault.decrypt_vault(sealed, "another password").collect()
    with pytest.raises(vault.VaultError):
        vault.decrypt_vault(sealed.withColumn("format", F.lit("x")), "long enough pass")


def test_registry(spark):
    reg = registry.Registry()
    rule = reg.register_rule(spark, Rule("X1", "TICKET", 0.9, "T-[0-9]+", gate=("T-",)))
    with pytest.raises(ValueError):
        reg.register_rule(spark, Rule("X2", "BAD", 0.9, "(["))
    reg.set_enabled(registry.BUILT_IN, False)
    assert reg.is_enabled(registry.BUILT_IN) and rule.order == max(r.order for r in reg.rules)
    assert reg.plan(use_model=True)[1] == [registry.NOT_READY]

    def people(d):
        return d.select("doc_id", *arbitrate.span_row(start=F.lit(0), end=F.lit(2), type=F.lit("PERSON"), text=F.substring("text", 1, 2), ord=F.lit(5000)))

    def broken(d):
        return d.select("no_such_column")

    docs = spark.createDataFrame([(1, "ab T-12 x"), (2, "cd")], "doc_id bigint, text string")
    reg.register(registry.Detector(registry.SEMANTIC, "people", people))
    reg.register(registry.Detector(registry.GENERAL_PII, "broken", broken))
    found = registry.detect_documents(docs, reg, slots=[registry.SEMANTIC, registry.GENERAL_PII])
    assert sorted((r.doc_id, r.type) for r in found.collect()) == [(1, "PERSON"), (1, "TICKET"), (2, "PERSON")]
    row = registry.detected(docs, reg, slots=[registry.SEMANTIC, registry.GENERAL_PII]).first()
    engines, warnings = row["engines"], row["warnings"]
    assert engines[-1] == "people" and warnings[0].startswith("detector_failed:broken")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"mail u{i}@x.org and u{i % 3}@y.org") for i in range(30)] + [(99, "  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    rules = built_in_rules()[:30]
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("masked", "vault", "quarantine", "checkpoint")]
    mask_stream(stream, *paths, rules=rules, extraction=False).awaitTermination()
    batch = masked_rows(docs, rules=rules, extraction=False)
    got = {r.doc_id: r.masked for r in spark.read.parquet(paths[0]).collect()}
    assert got == {r.doc_id: r.masked for r in batch.filter("status = 'ok'").collect()} and len(got) == 30
    assert spark.read.parquet(paths[1]).count() == mask.build_vault(batch).count() == 60
    assert [r.status for r in spark.read.parquet(paths[2]).collect()] == ["blank_text"]


def test_stream_reads_a_folder_of_files(spark, data, tmp_path):
    from cloakframe.plans import load

    spark.read.parquet(f"{data}/documents.parquet").limit(40).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = load.QUERIES["mask_stream"](spark, str(tmp_path)).filter("sink <> 'vault'")
    assert held.select("doc_id").distinct().count() == 40
