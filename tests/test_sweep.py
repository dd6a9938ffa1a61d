"""Blocked sweeps against brute force, and one very long document that spreads over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import mask, score, sweep
from cloakframe.schema import compatible_pairs

DDL = "doc_id bigint, start int, `end` int, type string"
PAIRS = set(compatible_pairs())


def spans(rnd, n, width, longest, types=("PERSON",)):
    return sorted({(rnd.randrange(3) or None, s := rnd.randrange(width), s + rnd.choice([0, 1, 2, 5, longest]), rnd.choice(types)) for _ in range(n)},
                  key=lambda x: (x[0] or 0, *x[1:]))


def brute_runs(rows):
    out, reach, run = {}, {}, {}
    for d, s, e, t in sorted(rows, key=lambda x: (x[0] or 0, x[1], x[2])):
        if d not in reach or s >= reach[d]:
            run[d] = s
        reach[d] = max(reach.get(d, e), e)
        out[d, s, e, t] = run[d]
    return out


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_runs_equal_brute_force(spark, block):
    rnd = random.Random(block)
    for longest in (9, 300):
        rows = spans(rnd, 160, 900, longest)
        got = sweep.overlap_runs(spark.createDataFrame(rows, DDL), block=block).collect()
        assert {(r.doc_id, r.start, r.end, r.type): r.run for r in got} == brute_runs(rows) and len(got) == len(rows)


def test_block_numbers_equal_dense_rank(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), rnd.randrange(5000), rnd.choice("abc")) for _ in range(400)]
    got = sweep.block_numbers(spark.createDataFrame(rows, "doc_id int, at int, text string"), ("doc_id",), "at", ("at", "text"), "n", 64).collect()
    want = {(d, *v): k + 1 for d in range(3) for k, v in enumerate(sorted({x[1:] for x in rows if x[0] == d}))}
    assert all(r.n == want[r.doc_id, r["at"], r.text] for r in got) and len(got) == len(rows)


def test_tokens_are_numbered_by_first_appearance(spark):
    rnd = random.Random(4)
    rows = [(1, s := rnd.randrange(40000), s + 2, rnd.choice(["EMAIL", "PHONE"]), f"v{rnd.randrange(120)}") for _ in range(500)]
    got = mask.allocate_tokens(spark.createDataFrame(rows, DDL + ", text string")).collect()
    first = {}
    for _, s, _, t, v in rows:
        first[t, v] = min(s, first.get((t, v), s))
    for r in got:
        place = sum((first[r.type, r.text], r.text) >= (s, v) for (t, v), s in first.items() if t == r.type)
        assert int(r.token.split("_")[-2]) == place


@pytest.mark.parametrize("block", [8, 4096])
def test_measures_equal_brute_force(spark, block):
    rnd = random.Random(7 + block)
    types = ("PERSON", "CN_NAME", "PHONE", "CN_LANDLINE", "CN_PHONE_NUMBER", "SECRET", "PASSWORD", "EMAIL")
    rows = [(d, s, e, rnd.choice(["FN", "FP", "TP"]), t) for d, s, e, t in spans(rnd, 150, 200, 60, types)]
    df = spark.createDataFrame(rows, "doc_id int, start int, `end` int, outcome string, type string").withColumn("n", F.monotonically_increasing_id())
    df = df.withColumn("gold_type", F.when(F.col("outcome") != "FP", F.col("type"))).withColumn("pred_type", F.when(F.col("outcome") != "FN", F.col("type")))
    events = sweep.measured(sweep.boundary_events(df, block), ("doc_id",), {"gold": "outcome <> 'FP'", "pred": "outcome <> 'FN'"})
    events = sweep.met_compatible(events, ("doc_id",), "outcome = 'FN' AND `end` > start", "gold_type", "outcome <> 'FN' AND `end` > start", "pred_type")
    got = events.groupBy("n", "doc_id", "start", "end", "outcome", "type").agg(
        F.sum("_in_gold").alias("gold"), F.sum("_in_pred").alias("pred"), (F.sum("_met") > 0).alias("met")).collect()
    assert len(got) == len(rows)
    chars = lambda d, skip: {c for x in rows if x[0] == d and x[3] != skip for c in range(x[1], x[2])}
    for r in got:
        own = set(range(r.start, r.end))
        assert (r.gold, r.pred) == (len(own & chars(r.doc_id, "FP")), len(own & chars(r.doc_id, "FN")))
        near = [x for x in rows if x[0] == r.doc_id and x[3] != "FN" and x[1] < r.end and r.start < x[2] and x[2] > x[1] and (x[4] == r.type or (x[4], r.type) in PAIRS)]
        assert r.met == (r.outcome == "FN" and r.end > r.start and bool(near))


def test_scores_of_each_model_share_one_gold(spark):
    gold = spark.createDataFrame([(1, 0, 5, "PERSON"), (1, 9, 12, "EMAIL"), (2, 3, 4, "PHONE")], DDL).withColumn("should_redact", F.lit(True))
    pred = spark.createDataFrame([(1, 0, 5, "CN_NAME", "a"), (1, 8, 10, "EMAIL", "a"), (2, 3, 4, "PHONE", "b"), (3, 0, 2, "PHONE", "b"), (3, 0, 2, "PHONE", "x")],
                                 DDL + ", model_id string")
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id bigint")
    got = {r.model_id: (r.tp, r.fp, r.fn, r.pii_free_fpr, r.leaked_chars, r.overredacted_chars)
           for r in score.compare_models(docs, gold, pred, ["a", "b", "c"]).collect()}
    assert got == {"a": (1, 1, 2, 0.0, 3, 1), "b": (1, 1, 2, 0.5, 8, 2), "c": (0, 0, 3, 0.0, 9, 0)}


def test_one_long_document_spreads_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = spark.range(400_000).selectExpr("1L AS doc_id", "int(id * 11) AS start", "int(id * 11 + 13 - id % 5 * 3) AS `end`", "'EMAIL' AS type", "concat('v', id) AS text")
        for out, made in ((sweep.overlap_runs(many), "run"), (mask.allocate_tokens(many), "token")):
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(made).alias("n")).collect()]
            assert len(sizes) == 4 and max(sizes) < 200_000 and sum(sizes) == 400_000
        hit = many.withColumn("outcome", F.expr("if(start % 2 = 0, 'FN', 'FP')")).withColumn("gold_type", F.col("type")).withColumn("pred_type", F.col("type"))
        swept = sweep.measured(sweep.boundary_events(hit), ("doc_id",), {"pred": "outcome = 'FP'"})
        assert max(r["n"] for r in swept.groupBy(F.spark_partition_id()).agg(F.count("_in_pred").alias("n")).collect()) < 450_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
