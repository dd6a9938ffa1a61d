"""Continuous masking of arriving documents.

Every step works inside the row, so the stream holds no state and needs no watermark.
Each micro-batch goes to three sinks: masked documents, vault rows, and a quarantine of
documents that were rejected or failed a check, with their texts. The three are published together: when all are written, one
row for the batch is added to a manifest, in one file, and ``published`` reads only batches that the manifest names. A
batch that breaks between the sinks is therefore never seen; its replay overwrites what was left. A batch that
is in the manifest already is not written again, so what readers see never changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators import mask
from cloakframe.sources.texts import reject_reason


def masked_rows(docs: DataFrame, policy: str | None = None, **scan_options) -> DataFrame:
    """The stateless plan, for batch and stream alike: guard, detect, merge, mask."""
    judged = docs.withColumn("reason", F.expr(reject_reason()))
    safe = judged.withColumn("source_text", F.col("text")).withColumn("text", F.expr("if(reason IS NULL, translate(text, '\u0001\u0002', '  '), '')"))
    done = mask.protect(safe, policy, **scan_options)
    return done.withColumn("status", F.expr("coalesce(reason, status)")).drop("reason", "spans")


MANIFEST_DDL = "batch bigint, masked bigint, vault bigint, quarantine bigint, published_at timestamp"


def manifest_of(masked_path: str) -> str:
    """Where a stream's manifest is kept unless another place is named."""
    return masked_path.rstrip("/") + ".published"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per published batch; empty before the first."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    rows = spark.read.schema(MANIFEST_DDL).parquet(path) if there else spark.createDataFrame([], MANIFEST_DDL)
    return rows.dropDuplicates(["batch"])


def published(spark: SparkSession, sink_path: str, manifest_path: str) -> DataFrame:
    """The rows of one sink, of published batches only, with their ``batch``."""
    return spark.read.parquet(sink_path).join(manifest(spark, manifest_path).select("batch"), "batch", "left_semi")


def mask_stream(
    stream: DataFrame, masked_path: str, vault_path: str, quarantine_path: str, checkpoint: str,
    policy: str | None = None, trigger: dict | None = None, manifest_path: str | None = None, **scan_options,
) -> StreamingQuery:
    """Start the query; ``trigger`` is passed on, by default everything available, once."""
    log = manifest_path or manifest_of(masked_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if manifest(spark, log).filter(F.col("batch") == batch_id).limit(1).count():
            return  # published before the stream noted it
        # The scan is the expensive part: keep the batch for its three sinks.
        rows = batch.persist()
        try:
            parts = (
                (masked_path, rows.filter("status = 'ok'").select("doc_id", "masked")),
                (vault_path, mask.build_vault(rows.filter("status = 'ok'"))),
                (quarantine_path, rows.filter("status <> 'ok'").select("doc_id", "status", F.col("source_text").alias("text"))),
            )
            counts = []
            for path, part in parts:
                target = f"{path}/batch={batch_id}"
                part.write.mode("overwrite").parquet(target)
                counts.append(spark.read.schema(part.schema).parquet(target).count())  # of the file footers
            row = spark.createDataFrame([(batch_id, *counts)], "batch bigint, masked bigint, vault bigint, quarantine bigint")
            row.coalesce(1).withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(log)
        finally:
            rows.unpersist()

    plan = masked_rows(stream, policy, **scan_options)
    return (
        plan.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
