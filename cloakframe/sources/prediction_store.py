"""Stored predictions that are reused only when their origin and content are proven.

Layout: ``root/predictions`` partitioned by corpus, model, revision and signature, and
``root/manifest`` with one row per stored set. The content hash is order-free: a sum and
an xor of row hashes plus the count, folded into one SHA-256, so it is an ordinary
distributed aggregation and does not depend on partitioning.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloakframe.operators.sweep import carried

# The runtime facts that a signature covers.
RUNTIME_KEYS = (
    "python_version", "platform", "machine", "torch_version", "transformers_version", "modelscope_version",
    "gliner_version",
)
PARTITIONS = ("corpus_id", "model_key", "revision_key", "signature")
MANIFEST_DDL = (
    "corpus_sha256 STRING, corpus_file STRING, model_id STRING, revision STRING, model_files_hash STRING, "
    "inference_config STRING, runtime MAP<STRING, STRING>, signature STRING, predictions_sha256 STRING, "
    "prediction_count BIGINT, saved_at TIMESTAMP"
)


class StoreError(Exception):
    """Base of all refusals."""


class CorpusNotAllowed(StoreError):
    pass


class AmbiguousSignature(StoreError):
    pass


class ContentMismatch(StoreError):
    pass


class MissingManifest(StoreError):
    pass


@dataclass(frozen=True)
class StoreKey:
    corpus_sha256: str
    corpus_file: str
    model_id: str
    revision: str
    model_files_hash: str = "no_model_dir"
    inference_config: dict = field(default_factory=dict)
    runtime: dict = field(default_factory=dict)

    @property
    def config_json(self) -> str:
        return json.dumps(self.inference_config, sort_keys=True, ensure_ascii=False)


def _safe(name: str) -> str:
    return name.replace("/", "_").replace("\\", "_")


def plain_row(columns: list[str]) -> str:
    """SQL for one text per row: each field with its length in front, a null as ``-``; any SQL engine can write the same."""
    return "concat(" + ", ".join(f"coalesce(concat(length(cast({c} AS string)), ':', cast({c} AS string)), '-'), ';'" for c in columns) + ")"


def order_free_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(digest, n): SHA-256 over the number of rows and the sums of the eight words of their hashes; independent of order."""
    part = lambda i: f"cast(conv(substring(_h, {i}, 8), 16, 10) AS decimal(38, 0))"
    hashed = rows.select(F.expr(f"sha2({plain_row(columns)}, 256)").alias("_h"))
    sums = hashed.agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.sum(F.expr(part(1 + 8 * i))), F.lit(0).cast("decimal(38,0)")).alias(f"_{i}") for i in range(8)],
    )
    digest = "sha2(concat_ws(':', n, " + ", ".join(f"cast(_{i} AS string)" for i in range(8)) + "), 256)"
    return sums.select(F.expr(digest).alias("digest"), "n")


def cache_signature(keys: DataFrame) -> DataFrame:
    """Add ``signature``: the first 16 hex digits of a SHA-256 over config, model hash and runtime.

    ``keys`` holds model_files_hash, inference_config (JSON with sorted keys) and runtime
    (a map), read in a fixed order of fields and of runtime keys.
    """
    body = plain_row(["inference_config", "model_files_hash", *(f"runtime['{k}']" for k in sorted(RUNTIME_KEYS))])
    return keys.withColumn("signature", F.expr(f"substring(sha2({body}, 256), 1, 16)"))


def _key_frame(spark: SparkSession, key: StoreKey) -> DataFrame:
    row = [(key.corpus_sha256, key.corpus_file, key.model_id, key.revision, key.model_files_hash, key.config_json,
            {k: str(v) for k, v in key.runtime.items()})]
    ddl = ("corpus_sha256 STRING, corpus_file STRING, model_id STRING, revision STRING, model_files_hash STRING, "
           "inference_config STRING, runtime MAP<STRING, STRING>")
    return cache_signature(spark.createDataFrame(row, ddl))


def content_hash(predictions: DataFrame) -> DataFrame:
    """One row (predictions_sha256, prediction_count), independent of row order."""
    fields = ["doc_id", "model_id", "label", "`start`", "`end`", "text", "score"]
    return order_free_digest(predictions, fields).select(F.col("digest").alias("predictions_sha256"), F.col("n").alias("prediction_count"))


def save_predictions(predictions: DataFrame, key: StoreKey, root: str, allowed: set[str]) -> str:
    """Store raw predictions and their manifest row; only allow-listed corpora may be stored."""
    if key.corpus_file not in allowed:
        raise CorpusNotAllowed(f"{key.corpus_file!r} is not an allowed corpus")
    spark = predictions.sparkSession
    manifest = _key_frame(spark, key)
    signature = manifest.first()["signature"]
    path = dict(zip(PARTITIONS, (key.corpus_sha256[:16], _safe(key.model_id), _safe(key.revision), signature), strict=True))
    out = predictions.select("doc_id", "model_id", "label", "start", "end", "text", "score")
    target = f"{root}/predictions/" + "/".join(f"{k}={v}" for k, v in path.items())
    out.write.mode("overwrite").parquet(target)
    # The hash is taken from what was written, not from a second run of the input plan.
    stored = spark.read.schema(out.schema).parquet(target)
    row = manifest.join(F.broadcast(content_hash(stored).withColumn("_k", F.lit(0))), F.expr("_k = 0")).drop("_k")
    row = row.withColumn("saved_at", F.current_timestamp())
    row.select(*[c.strip().split(" ")[0] for c in MANIFEST_DDL.replace("MAP<STRING, STRING>", "MAP").split(",")]).write.mode(
        "overwrite"
    ).parquet(f"{root}/manifest/" + "/".join(f"{k}={v}" for k, v in path.items()))
    return signature


def _read_or_none(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    return (spark.read.schema(ddl) if ddl else spark.read).parquet(path)


def load_predictions(
    spark: SparkSession, root: str, key: StoreKey, *, signature: str | None = None, allow_unverified: bool = False
) -> DataFrame:
    """Verified load: every key part, the count and the hash must agree.

    ``signature=None`` derives it from the key. Pass ``"any"`` to accept the only stored set
    of this corpus, model and revision whatever its configuration.
    """
    base = f"corpus_id={key.corpus_sha256[:16]}/model_key={_safe(key.model_id)}/revision_key={_safe(key.revision)}"
    wanted = signature or _key_frame(spark, key).first()["signature"]
    if wanted == "any":
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/predictions/{base}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found = sorted(n.split("=", 1)[1] for n in names if n.startswith("signature="))
        if len(found) > 1:
            raise AmbiguousSignature(f"several signatures stored: {found}")
        if not found:
            raise FileNotFoundError(f"{root}/predictions/{base}")
        wanted = found[0]
    predictions = _read_or_none(spark, f"{root}/predictions/{base}/signature={wanted}")  # document keys keep the type they were stored with
    if predictions is None:
        raise FileNotFoundError(f"{root}/predictions/{base}/signature={wanted}")
    manifest = _read_or_none(spark, f"{root}/manifest/{base}/signature={wanted}", MANIFEST_DDL)
    row = manifest.first() if manifest is not None else None
    if row is None:
        if allow_unverified:
            return predictions
        raise MissingManifest(f"no manifest for signature {wanted}")
    checks = {"corpus_sha256": key.corpus_sha256, "model_id": key.model_id, "revision": key.revision}
    if signature is None:
        checks |= {"model_files_hash": key.model_files_hash, "inference_config": key.config_json}
        runtime = {k: (row["runtime"] or {}).get(k) for k in RUNTIME_KEYS}
        if runtime != {k: (None if key.runtime.get(k) is None else str(key.runtime[k])) for k in RUNTIME_KEYS}:
            raise ContentMismatch("runtime differs from the stored one")
    for name, value in checks.items():
        if row[name] != value:
            raise ContentMismatch(f"{name} differs from the stored one")
    actual = content_hash(predictions).first()
    if actual["prediction_count"] != row["prediction_count"]:
        raise ContentMismatch("prediction count differs from the manifest")
    if actual["predictions_sha256"] != row["predictions_sha256"]:
        raise ContentMismatch("prediction content differs from the manifest")
    return predictions


#: Bytes of a file that make one chunk of its fingerprint.
CHUNK = 1 << 26


def _summed(rows: DataFrame, by: list[str], digest: str, out: str, more: list | None = None) -> DataFrame:
    """For each ``by``: a hash over the number of rows and the sums of the words of their hashes; map-side sums, no list of rows."""
    word = lambda i: F.expr(f"cast(conv(substring({digest}, {1 + 8 * i}, 8), 16, 10) AS decimal(38, 0))")
    sums = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(word(i)), F.lit(0).cast("decimal(38,0)")).alias(f"_{i}") for i in range(8)], *(more or []))
    body = F.concat_ws(":", "_n", *[F.col(f"_{i}").cast("string") for i in range(8)])
    return sums.withColumn(out, F.sha2(body, 256)).drop("_n", *[f"_{i}" for i in range(8)])


def file_fingerprints(spark: SparkSession, path: str, glob: str = "*", name: str = "regexp_extract(path, '[^/]+$', 0)", chunk: int = CHUNK) -> DataFrame:
    """(name, size, digest) of every file below ``path``, whatever its size.

    Files are read by byte ranges, as lines of bytes that are hashed where they are read; only hashes and lengths go on. A line's offset comes from
    the lengths before it in its range and the bytes of the ranges before. Hashes of (offset, line) are summed up to a digest of each
    chunk, those of (chunk, digest) to one of each file: a tree whose nodes are sums, so no level is ever a list. The file's size
    tells a last line with a line feed from one without.
    """
    read = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    lines = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_at"),
        F.sha2(F.col("value").cast("binary"), 256).alias("_h"), (F.octet_length("value") + 1).cast("bigint").alias("_len"))
    before = F.sum("_len").over(W.partitionBy("path", "_b").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    placed = carried(lines.withColumn("_in", F.coalesce(before, F.lit(0))), ("path",), F.sum("_len"), F.sum("_part"))
    placed = placed.withColumn("_off", F.col("_in") + F.coalesce("_carry", F.lit(0)))
    placed = placed.select("path", F.expr(f"_off div {chunk}L").alias("_c"), F.sha2(F.concat_ws(":", "_off", "_h"), 256).alias("_h"))
    chunks = _summed(placed, ["path", "_c"], "_h", "_d").select("path", F.sha2(F.concat_ws(":", "_c", "_d"), 256).alias("_h"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    every = listed.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size")).join(_summed(chunks, ["path"], "_h", "digest"), "path", "left")
    return every.select(F.expr(name).alias("name"), "size", F.coalesce("digest", F.lit("")).alias("digest"))


def dataset_fingerprint(files: DataFrame) -> DataFrame:
    """One fingerprint of all files: the root of the tree over the (name, size, digest) of ``file_fingerprints``."""
    return _summed(files.select(F.sha2(F.concat_ws(":", "name", "size", "digest"), 256).alias("_h")), [], "_h", "fingerprint")


def corpus_fingerprint(rows: DataFrame) -> DataFrame:
    """Order-free SHA-256 of table content, for corpora that are tables instead of files."""
    return order_free_digest(rows, [f"`{c}`" for c in sorted(rows.columns)]).select(F.col("digest").alias("fingerprint"), "n")
