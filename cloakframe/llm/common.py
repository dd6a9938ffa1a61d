"""Helpers shared by the operators: stored intermediate tables, stratified samples, batches, words.

Words are bytes between ASCII white space, A-Z lower-cased, unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.scratch import scratch_dir

#: Text bytes handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: The tables of the open ``passing`` blocks, outermost first.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows of ``df``, written once below the shared folder and read back; cuts lineage and survives lost executors.

    Inside ``passing`` the table is deleted at the end of the block; one to be kept, at the end of the block around it, if any.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    blocks = _PASSING.get()
    if len(blocks) > keep:
        blocks[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Tables stored in this block go at its end. What outlives it must be written by then, with ``keep``, and read nothing of them."""
    paths: list[str] = []
    before = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(before)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


#: Rows of a batch on its way from the JVM to Python and back; a batch is a whole in the memory of both.
BATCH_ROWS = 1000


def in_batches(df: DataFrame, task, schema) -> DataFrame:
    """``df.mapInArrow`` with batches small enough for long texts: the session's limit is lowered to ``BATCH_ROWS``."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


def keep_rows(df: DataFrame, text: str, decide: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``df`` that ``decide`` (texts -> true or false) keeps, in one pass; null texts are decided as empty ones."""
    at = df.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["n", "text"])
            kept = [s.column("n").filter(pa.array(decide(s.column("text")))) for s in slices([own])]
            if kept:
                yield batch.take(pa.concat_arrays(kept))

    return in_batches(df, judge, df.schema)


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of an id as text, modulo ``mod``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


def unit_hash(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values of ``columns`` alone."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def stratified(df: DataFrame, by: str, per_class: int, *key: str, seed: int = 1) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, chosen by a hash of the columns ``key``; all rows of a class that has fewer.

    Only the number of rows of each value reaches the driver. Null classes are left out. Rows that agree in ``key`` are chosen together.
    """
    sizes = [(r[0], r[1]) for r in df.filter(F.col(by).isNotNull()).groupBy(by).count().collect()]
    if not sizes:
        return df.limit(0)
    share = F.lit(0.0)
    for value, n in sizes:
        share = F.when(F.col(by) == F.lit(value), F.lit(per_class / max(n, 1))).otherwise(share)
    return df.filter(F.col(by).isNotNull() & (unit_hash(*key, seed=seed) < share))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts hold about ``most`` bytes; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(text)
        batch = batch.set_column(k, text, pc.fill_null(batch.column(k).cast(pa.string()), ""))
        ends = np.cumsum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a run of texts: ``codes`` into distinct words, ``doc`` (row of each word), ``counts`` per row."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = lists.flatten()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.greater(pc.binary_length(flat), 0)
        doc = np.repeat(np.arange(len(texts)), counts)
        if not pc.all(full).as_py() if len(flat) else False:
            doc, flat = doc[full.to_numpy(zero_copy_only=False)], flat.filter(full)
        words = flat.dictionary_encode()
        self.doc, self.counts = doc, np.bincount(doc, minlength=len(texts))
        self.codes = words.indices.to_numpy(zero_copy_only=False)
        self.distinct = words.dictionary

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words as one byte array and their offsets."""
        return string_bytes(self.distinct)

    def hashes(self) -> np.ndarray:
        return word_hashes(*self.bytes())


def string_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = values.cast(pa.string())
    _, off, data = values.buffers()
    if off is None or not len(values):
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    offsets = np.frombuffer(off, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _PRIME) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string."""
    n = len(offsets) - 1
    if not len(data):
        return mix(np.zeros(n, np.uint64))
    lens = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lens)
    terms = mix(data.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[place]
    sums = np.zeros(n, np.uint64)
    full = lens > 0
    sums[full] = np.add.reduceat(terms, offsets[:-1][full])
    return mix(sums + lens.astype(np.uint64))


def marked_ngrams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams of words fenced by marks, as (word, feature) pairs; those with a mark are prefixes and suffixes."""
    n, lens = len(offsets) - 1, np.diff(offsets)
    marked = np.ones(len(data) + 2 * n, np.uint64)
    word = np.repeat(np.arange(n), lens + 2)
    ends = np.cumsum(lens + 2)
    inner = np.ones(len(marked), bool)
    inner[ends - 1] = inner[ends - lens - 2] = False
    marked[inner] = data
    marked[ends - 1] = 2
    spread = mix(marked)
    counts = [int(np.maximum(lens + 3 - size, 0).sum()) for size in sizes]
    words, features = np.empty(sum(counts), np.int64), np.empty(sum(counts), np.int64)
    at = 0
    for size, count in zip(sizes, counts, strict=True):
        if not count:
            continue
        h = np.zeros(len(marked) - size + 1, np.uint64)
        for k in range(size):
            h = h * _PRIME + spread[k : k + len(h)]
        ok = word[: len(h)] == word[size - 1 :]
        words[at : at + count] = word[: len(h)][ok]
        features[at : at + count] = mix(h[ok] + np.uint64(size)) >> np.uint64(64 - bits)
        at += count
    return words, features
