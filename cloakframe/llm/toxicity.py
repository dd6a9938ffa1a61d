"""Severity of toxic language by cumulative-link ordinal regression over sparse word features.

P(grade <= k) = logistic(threshold_k - w·x): one weight vector, ordered thresholds. x marks which hashed words a text
holds. Weights are not negative and an L1 penalty leaves few, so clean words of long texts add up to nothing. The labels tell only toxic
or not, so grades are made from them: 0 for clean texts; toxic ones get 1, 2 or 3 by how many of their words are cues,
words far more frequent in toxic than in clean training texts.

Fit on a bounded sample (``PER_CLASS`` labelled texts of each class); applied to every whole text.

Defined results: null and empty texts get the severity of a text without features; with one class only, that class's grade; null labels
are not learnt from, of several labels of one document the largest counts; repeated rows get equal results; an empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import Words, in_batches, slices, stratified, string_bytes, word_hashes

PER_CLASS = 2000
BITS = 20
GRADES = 4
STEM = 4
MIN_TEXTS = 3
#: L1 penalty for one toxic training text; it shrinks with the root of their number, as chance frequencies do.
L1 = 0.15
ROUNDS = 400
_MARKS = ".,;:!?\"'()[]{}<>*#%&$-_/\\|"


@dataclass
class Ordinal:
    features: np.ndarray  # sorted feature numbers with a weight
    weights: np.ndarray
    thresholds: np.ndarray  # GRADES - 1, ascending


def word_features(words: Words) -> np.ndarray:
    """Two features of each distinct word, punctuation at its ends left out: the word and its first ``STEM`` bytes; -1 if there is none."""
    data, offsets = string_bytes(pc.ascii_trim(words.distinct, characters=_MARKS))
    lens = np.diff(offsets)
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], lens) < STEM
    stems = np.concatenate([[0], np.cumsum(np.minimum(lens, STEM))])
    whole, stem = (word_hashes(*x) >> np.uint64(64 - BITS) for x in ((data, offsets), (data[inside], stems)))
    return np.stack([np.where(lens > 0, whole.astype(np.int64), -1), np.where(lens > STEM, (stem ^ np.uint64(1)).astype(np.int64), -1)], 1)


def pairs(words: Words, f: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text and feature as one number, times) for the wanted features of all words."""
    spot = np.flatnonzero(wanted.any(1)[words.codes])
    code = words.codes[spot]
    both = words.doc[spot].astype(np.int64)[:, None] << BITS | f[code]
    return np.unique(both[wanted[code]], return_counts=True)


def present(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of each feature that a text holds."""
    f = word_features(words)
    pair, times = pairs(words, f, f >= 0)
    return pair >> BITS, pair & ((1 << BITS) - 1), times


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _leans(in1: np.ndarray, in0: np.ndarray, toxic: np.ndarray, times: float) -> np.ndarray:
    """Features that toxic texts hold so many times more often than clean ones."""
    return (in1 + 0.5) / max(1, toxic.sum()) > times * (in0 + 0.5) / max(1, (1 - toxic).sum())


def grade(toxic: np.ndarray, doc: np.ndarray, feature: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 of training texts: terciles of the number of cue words among the toxic ones."""
    hits = toxic[doc]
    in1 = np.bincount(feature, weights=hits, minlength=1 << BITS)
    in0 = np.bincount(feature, weights=1 - hits, minlength=1 << BITS)
    cue = _leans(in1, in0, toxic, 8) & (in1 >= MIN_TEXTS)
    count = np.bincount(doc, weights=times * cue[feature], minlength=len(toxic))
    bounds = np.quantile(count[toxic == 1], [1 / 3, 2 / 3]) if toxic.any() else np.zeros(2)
    return np.where(toxic == 1, 1 + (count > bounds[0]) + (count > bounds[1]), 0).astype(int)


def fit(texts: list[str], toxic: list[int], rounds: int = ROUNDS) -> Ordinal:
    t = np.array(toxic, int)
    if len(set(toxic)) < 2:
        at = 0.0 if not len(t) else (12.0 if t[0] == 0 else -12.0)
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), at + np.arange(GRADES - 1.0))
    doc, feature, times = present(Words(pa.array(texts, pa.string())))
    y = grade(t, doc, feature, times)
    in1, in0 = (np.bincount(feature[t[doc] == k], minlength=1 << BITS) for k in (1, 0))
    ok = (_leans(in1, in0, t, 4) & (in1 >= MIN_TEXTS))[feature]
    doc, feature = doc[ok], feature[ok]
    known, col = np.unique(feature, return_inverse=True)
    n, m = len(t), len(known)
    share = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    w, raw = np.zeros(m), np.array([1.0, 0.0, 0.0])  # first threshold, then logarithms of the gaps
    gw, gr = np.full(m, 1e-4), np.full(GRADES - 1, 1e-4)
    penalty, chosen = L1 / t.sum() ** 0.5, np.ones(m)
    for step in range(rounds):
        if step == rounds // 2:  # the penalty has chosen the features; their weights are then fitted without it
            chosen, penalty = w > 0, 1e-5
        s = np.bincount(doc, weights=w[col], minlength=n)
        edge = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]), [np.inf]])
        up, down = _sigmoid(edge[y + 1] - s), _sigmoid(edge[y] - s)
        up, down = np.where(y == GRADES - 1, 1.0, up), np.where(y == 0, 0.0, down)
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        ds = share * (du - dd)  # the loss by s
        de = np.bincount(y, weights=-share * du, minlength=GRADES)[:-1] + np.bincount(y, weights=share * dd, minlength=GRADES)[1:]
        later = np.cumsum(de[::-1])[::-1]
        draw = np.concatenate([later[:1], later[1:] * np.exp(raw[1:])])
        grad = np.bincount(col, weights=ds[doc], minlength=m)
        gw, gr = gw + grad**2, gr + draw**2
        rate = 0.3 / np.sqrt(gw)
        w = np.clip(w - rate * (grad + penalty), 0, 8.0) * chosen  # words only ever add to the severity
        raw = raw - 0.3 * draw / np.sqrt(gr)
    theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
    keep = w != 0
    return Ordinal(known[keep], w[keep], theta)


def grades_of(model: Ordinal, texts: pa.Array) -> np.ndarray:
    """P(grade >= k) for k = 1 … of each text."""
    words = Words(texts)
    f = word_features(words)
    at = np.minimum(np.searchsorted(model.features, f), max(0, len(model.features) - 1))
    known = (model.features[at] == f) if len(model.features) else np.zeros(f.shape, bool)
    pair, _ = pairs(words, f, known)
    weight = model.weights[np.searchsorted(model.features, pair & ((1 << BITS) - 1))] if len(pair) else np.zeros(0)
    s = np.bincount(pair >> BITS, weights=weight, minlength=len(texts))
    return _sigmoid(s[:, None] - model.thresholds)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Ordinal:
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    chosen = stratified(known, "__y", per_class, key)
    texts = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    got = texts.join(F.broadcast(chosen), key).groupBy(key, "__y").agg(F.min("t").alias("t")).collect()
    got.sort(key=lambda r: str(r[key]))
    return fit([r["t"] for r in got], [r["__y"] for r in got])


def predict(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, severity, grade, score) of every row: expected grade, likeliest grade, P(grade >= 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            above = grades_of(held.value, batch.column(1))
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "severity": pa.array(above.sum(1)),
                                              "grade": pa.array(each.argmax(1).astype(np.int32)), "score": pa.array(above[:, 0])})

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs.select(F.col(key), F.col(text).cast("string").alias("text")), rate, f"`{key}` {kind}, severity double, grade int, score double")
