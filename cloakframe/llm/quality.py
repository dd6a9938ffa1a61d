"""Quality of whole texts by a byte-level convolutional network, trained and run in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP``; every chunk of the whole text is read. Bytes have
learned vectors; learned filters of ``WIDTH`` bytes slide over a chunk, their rectified responses are max-pooled, and
the mean of the pooled responses of all chunks goes through a logistic unit: one probability per text.

Fit on a bounded sample (``PER_CLASS`` labelled texts of each class), classes weighted alike.

Defined results: null and empty texts are one chunk of padding and get a score too; without training rows of both classes every
score is that of the only class (or 0.5 with none); null labels are not learnt from; of several labels of one document the smallest counts;
repeated rows get equal scores; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import in_batches, slices, stratified, string_bytes

PER_CLASS = 1500
CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE = 8, 2
DIM, FILTERS = 8, 16
STEPS, BATCH, CHUNKS_PER_TEXT = 500, 48, 3
#: Share of the good chunks that a training step shortens, so that few bytes alone do not count as junk.
SHORTENED = 0.5
THRESHOLD = 0.7
_AT_ONCE = 64


@dataclass
class ConvNet:
    vectors: np.ndarray  # byte × DIM
    filters: np.ndarray  # WIDTH * DIM × FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk bytes, text of each chunk) of all texts; zero pads the last chunk of a text."""
    lens = np.diff(offsets)
    step = CHUNK - OVERLAP
    each = np.maximum(1, -(-(lens - OVERLAP) // step))
    text = np.repeat(np.arange(len(lens)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    begin = offsets[:-1][text] + number * step
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][text][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), text


def windows(chunks: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """chunk × position × (WIDTH * DIM)."""
    flat = vectors[chunks].reshape(len(chunks), -1)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DIM, axis=1)
    return view[:, :: STRIDE * DIM]


def pooled(net: ConvNet, chunks: np.ndarray) -> np.ndarray:
    out = np.empty((len(chunks), FILTERS), np.float32)
    for k in range(0, len(chunks), _AT_ONCE):
        w = windows(chunks[k : k + _AT_ONCE], net.vectors)
        r = w.reshape(-1, WIDTH * DIM) @ net.filters
        out[k : k + _AT_ONCE] = r.reshape(len(w), -1, FILTERS).max(1)
    return np.maximum(out + net.bias, 0)


def scores(net: ConvNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    chunks, text = chunks_of(data, offsets)
    z = pooled(net, chunks) @ net.out
    n = len(offsets) - 1
    mean = np.bincount(text, weights=z, minlength=n) / np.bincount(text, minlength=n)
    return 1.0 / (1.0 + np.exp(-np.clip(mean + net.base, -30, 30)))


def fit(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 11) -> ConvNet:
    rng = np.random.default_rng(seed)
    net = ConvNet(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    net.vectors[0] = 0
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.base = 0.0 if not len(y) else 8.0 * (2 * y[0] - 1)
        return net
    chunks, text = chunks_of(*string_bytes(pa.array(texts, pa.string())))
    first = np.searchsorted(text, np.arange(len(texts)))
    each = np.bincount(text, minlength=len(texts))
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    params = [net.vectors, net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        pick = first[docs][:, None] + (rng.random((BATCH, CHUNKS_PER_TEXT)) * each[docs][:, None]).astype(int)
        x = chunks[pick.ravel()]
        good = np.repeat(y[docs] == 1, CHUNKS_PER_TEXT)
        size = np.where(good & (rng.random(len(x)) < SHORTENED), CHUNK ** rng.uniform(0.4, 0.8, len(x)), CHUNK)
        x = np.where(np.arange(CHUNK) < size[:, None], x, 0).astype(np.uint8)
        w = windows(x, params[0])
        r = (w.reshape(-1, WIDTH * DIM) @ params[1]).reshape(len(x), -1, FILTERS)
        best = r.argmax(1)
        top = np.take_along_axis(r, best[:, None], 1)[:, 0] + params[2]
        act = np.maximum(top, 0)
        z = (act @ params[3]).reshape(BATCH, -1).mean(1) + params[4]
        dz = (1 / (1 + np.exp(-z)) - y[docs]) / BATCH
        dchunk = np.repeat(dz / CHUNKS_PER_TEXT, CHUNKS_PER_TEXT).astype(np.float32)
        dact = dchunk[:, None] * params[3] * (top > 0)
        won = w[np.arange(len(x))[:, None], best]  # chunk × filter × (WIDTH * DIM)
        dfilters = np.einsum("cfw,cf->wf", won, dact)
        dwon = (dact[:, :, None] * params[1].T).reshape(len(x), FILTERS, WIDTH, DIM)
        spot = np.take_along_axis(x, (best[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(len(x), -1), 1).ravel()
        slot = spot.astype(np.int64)[:, None] * DIM + np.arange(DIM)
        dvec = np.bincount(slot.ravel(), weights=dwon.reshape(-1, DIM).ravel(), minlength=256 * DIM).reshape(256, DIM)
        dvec[0] = 0
        grads = [dvec, dfilters + 1e-4 * params[1], dact.sum(0), act.T @ dchunk + 1e-4 * params[3], np.array([dz.sum()])]
        for p, g, m, s in zip(params, grads, means, squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g**2 - s)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    net.vectors, net.filters, net.bias, net.out = (p.astype(np.float32) for p in params[:4])
    net.base = float(params[4][0])
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality", key: str = "doc_id", text: str = "text") -> ConvNet:
    """Fit on about ``per_class`` labelled documents of each class; only their ids are broadcast, only their texts collected."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).cast("int").alias("__y"))
    chosen = stratified(known, "__y", per_class, key)
    texts = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    got = texts.join(F.broadcast(chosen), key).groupBy(key, "__y").agg(F.min("t").alias("t")).collect()
    got.sort(key=lambda r: str(r[key]))
    return fit([r["t"] for r in got], [r["__y"] for r in got])


def predict(docs: DataFrame, net: ConvNet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "score": pa.array(scores(held.value, *string_bytes(batch.column(1))))})

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs.select(F.col(key), F.col(text).cast("string").alias("text")), score, f"`{key}` {kind}, score double")
