"""The pipeline's stages: decisions take effect, clean documents stay, odd input passes."""

import os
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, jaccard_join, quality, stages
from cloakframe.llm.common import table
from cloakframe.sources.scratch import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(data):
    return data.replace("sf0.001", "sf0.01")


def test_stages_do_what_they_decide(spark, small):
    docs = table(spark, small, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stages.stored(stage(spark, docs, small))
        left[name] = docs.count()
        ids = docs.select("doc_id").distinct()
        assert ids.join(before, "doc_id", "left_anti").count() == 0
        assert (docs.columns == COLUMNS) == (name != "mixing")
        if name == "quality":
            gone = before.join(docs, "doc_id", "left_anti").join(table(spark, small, "labels"), "doc_id")
            assert gone.filter("quality = 0").count() > 5 * gone.filter("quality = 1").count()
        if name == "near_duplicates":
            links = jaccard_join.near_copies(docs)
            assert links.filter("n_links > 0").count() == 0
            groups = jaccard_join.near_copies(before).select("class_id").distinct().count()
            assert left[name] == groups
        if name == "decontamination":
            assert decontaminate.find_items(docs, table(spark, small, "benchmark")).count() == 0
            assert before.count() - left[name] == decontaminate.find_items(before, table(spark, small, "benchmark")).select("doc_id").distinct().count()
    assert left["language_id"] > 0.99 * 1000 > left["quality"] > left["near_duplicates"] > left["decontamination"]
    assert docs.columns == [*COLUMNS, "copy_no"]


def test_stages_take_odd_tables(spark, small):
    docs = table(spark, small, "documents")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = odd.unionByName(docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10**9).withColumn("text", F.lit(None).cast("string")))
    odd = stages.stored(odd.withColumn("row", F.lit("clash")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns and out.count() <= odd.count()
        assert stage(spark, odd.limit(0), small).count() == 0
    assert stages.keep_one_of_each(spark, odd, small).filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert stages.keep_languages(spark, odd, small).filter("text IS NULL").count() == 0
    assert quality.THRESHOLD == 0.7


def test_rows_without_an_id_or_with_one_id_meet_the_same_fate(spark, small):
    docs = table(spark, small, "documents")
    kept = Counter()
    for name, odd in (("none", docs.withColumn("doc_id", F.lit(None).cast("bigint"))), ("one", docs.withColumn("doc_id", F.lit(5).cast("bigint")))):
        for stage in (stages.keep_languages, stages.drop_contaminated):
            out = Counter(r["text"] for r in stage(spark, odd, small).select("text").collect())
            kept[name, stage.__name__] = sum(out.values())
            assert not out - Counter(r["text"] for r in odd.select("text").collect())
    assert set(kept.values()) <= set(range(900, 1001))
    want = Counter(r["text"] for r in stages.drop_contaminated(spark, docs, small).select("text").collect())
    assert kept["none", "drop_contaminated"] == sum(want.values()) == kept["one", "drop_contaminated"]
    named = stages.keep_one_of_each(spark, docs, small)
    bare = stages.keep_one_of_each(spark, docs.withColumn("doc_id", F.lit(None).cast("bigint")), small)
    assert named.count() == bare.count()
    mixed = stages.mix_sources(spark, docs.withColumn("doc_id", F.lit(None).cast("bigint")), small)
    assert 900 < mixed.count() < 1100 and max(r["count"] for r in mixed.groupBy("copy_no").count().collect()) < 800


def test_a_hot_id_spreads_over_partitions(spark, small):
    docs = table(spark, small, "documents").withColumn("doc_id", F.lit(5).cast("bigint"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = stages.mix_sources(spark, docs, small).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 600


def test_texts_of_no_learned_language_go_and_mixed_ones_stay(spark, small):
    docs = table(spark, small, "documents")
    by = {r["lang"]: r["text"] for r in docs.filter("length(text) between 300 and 900 and lang is not null").collect()}
    some = list(by.values())
    odd = [(1, "A kutya a kertben fut és ugat egész nap mert nincs aki figyeljen rá ma este"), (2, "xqz wvk jjj kkq zzx"), (3, "これは 日本語 の 文 です"),
           (4, " ".join(t[:250] for t in some)), (5, some[0]), (6, None), (7, "12 34")]
    more = docs.unionByName(spark.createDataFrame([(-i, t, None, None, 0) for i, t in odd], docs.schema))
    kept = {r["doc_id"] for r in stages.keep_languages(spark, more, small).filter("doc_id < 0").collect()}
    assert kept == {-4, -5}


def test_stages_leave_little_behind(spark, small):
    place = os.path.dirname(scratch_dir(spark))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(place) for f in names if f.startswith("part-"))
    docs = stages.stored(table(spark, small, "documents"))
    whole = sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in docs.inputFiles())
    before = size()
    for _, stage in corpus_pipeline.STAGES:
        docs = stages.stored(stage(spark, docs, small))
    written = sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in docs.inputFiles())
    assert written > 0 and size() - before < 8 * whole  # five outputs, two inputs with numbers, and small tables
