"""Documents without a word are documents: counts and reports of the queries have them, as the SQL has."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import arbitrate, predictions
from cloakframe.plans import load

BLANK = [(900_001, "", "en", "src1", 0), (900_002, "  ", "fr", "src2", 2), (900_003, " \n\u3000 ", "de", "src3", 4), (900_004, " begins later", "en", "src1", 13)]
TABLES = ("orders", "lineitem", "customer")


@pytest.fixture(scope="module")
def blank(spark, data, tmp_path_factory):
    """The smallest tables, and four documents more, three of them blank."""
    place = str(tmp_path_factory.mktemp("blank"))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.createDataFrame(BLANK, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(more).coalesce(1).write.parquet(f"{place}/documents.parquet")
    for name in TABLES:
        os.symlink(f"{data}/{name}.parquet", f"{place}/{name}.parquet")
    return place


def both(spark, place, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}/documents.parquet/*.parquet'")
    for other in TABLES:
        con.execute(f"CREATE VIEW {other} AS SELECT * FROM '{place}/{other}.parquet'")
    out = load.QUERIES[name](spark, place)
    found = con.execute(load.ORACLES[name])
    columns = [c[0] for c in found.description]
    return sorted(map(str, (tuple(r[c] for c in columns) for r in out.collect()))), sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", (
    "composition_gates", "detector_failing", "detector_switches", "engine_usage", "generation_budget", "infer", "length_band",
    "report_engines", "roundtrip_gate", "idempotence_gate", "combine_detectors", "detector_plugin", "mask_documents", "pad_documents"))
def test_blank_documents_are_in_the_result(spark, blank, name):
    got, wanted = both(spark, blank, name)
    assert got == wanted


def test_both_forms_of_the_merge_drop_empty_spans(spark):
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id bigint, text string")
    made = lambda a, b: docs.select("doc_id", *arbitrate.span_row(
        start=F.lit(a), end=F.lit(b), type=F.lit("PERSON"), text=F.lit("x"), sources=F.array(F.lit("stub"))))
    spans = made(0, 0).unionByName(made(3, 5)).unionByName(made(4, 4))
    packed = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in spans.columns if c != "doc_id"])).cast(arbitrate._SPANS).alias("spans"))
    assert [(s.start, s.end) for s in arbitrate.arbitrate(packed).first().spans] == [(3, 5)]
    assert [(s.start, s.end) for s in arbitrate.merge_spans(spans).collect()] == [(3, 5)]


def test_a_model_is_not_handed_a_missing_text(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, None), (3, "")], "doc_id bigint, text string")
    load_model = lambda: lambda texts: [[{"label": "x", "start": 0, "end": len(t), "text": t}] for t in texts]
    assert {(r.doc_id, r.end) for r in predictions.infer(docs, load_model, "m").collect()} == {(1, 4), (3, 0)}
