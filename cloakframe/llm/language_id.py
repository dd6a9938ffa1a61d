"""Language of every word, and of whole texts, by a linear-chain conditional random field.

Emissions sum hashed weights of byte n-grams (those that touch a word's ends are its affixes) and of the word itself
(the lexicon); transitions are learned on spans of known language strung together, so that switches inside a text
are seen. Forward-backward runs over all texts of a slice at once: segments of ``SEGMENT`` words get a transfer matrix, the
segments of a text are chained, then all segments are swept together; it is exact for any length.

Fit on a bounded sample (``PER_LANGUAGE`` texts of each language, chosen by a hash of id and text); applied to every whole text. The
share of a text's words that the training texts hold (``known``) tells texts of a learned language from others, however many languages there are.

Defined results: null text or text without a letter is ``und`` with score 0; without any training row all is ``und``;
rows with null language are not learnt from; repeated rows get equal results; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import Words, in_batches, marked_ngrams, mix, slices, stratified

#: Training texts of each language, and bytes of each that are not exceeded by cutting between words into several sequences.
PER_LANGUAGE = 250
BITS = 17
NGRAMS = (2, 3, 4)
SEGMENT = 64
SEQUENCE = 32
ROUNDS = 30
#: Sequences that are passed over at once in training; memory of the driver grows with it.
AT_ONCE = 1024


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # features × labels
    transitions: np.ndarray  # from × to
    lexicon: np.ndarray  # hashes of the training texts' words, ascending


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.bytes()
    word, feature = marked_ngrams(data, offsets, NGRAMS, BITS)
    whole = (mix(words.hashes() ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([word, np.arange(len(whole))]), np.concatenate([feature, whole])


def emissions(word: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(word, weights=weights[feature, k], minlength=n) for k in range(weights.shape[1])], 1)


def _spans(counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An order of all positions in which spans of 4 to 24 words of different texts follow each other."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    cuts = [np.zeros(0, np.int64)]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        at = a + np.concatenate([[0], np.cumsum(rng.integers(4, 25, max(1, (b - a) // 4 + 1)))])
        cuts.append(at[at < b])
    first = np.concatenate(cuts)
    last = np.append(first[1:], starts[-1])
    order = rng.permutation(len(first))
    return np.concatenate([np.arange(first[i], last[i]) for i in order]) if len(first) else np.zeros(0, np.int64)


def _passes(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each word of sequences, and the expected transitions, by one pass forwards and one back."""
    n, length, size = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    x = np.full((n, size), 1.0 / size)
    for t in range(length):
        x = (x @ a) * e[:, t]
        x /= x.sum(1, keepdims=True)
        alpha[:, t] = x
    b, pairs = np.ones((n, size)), np.zeros((size, size))
    for t in range(length - 1, -1, -1):
        beta[:, t] = b
        right = e[:, t] * b
        if t:
            both = alpha[:, t - 1, :, None] * a * right[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        b = right @ a.T
        b /= b.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    return gamma, pairs


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 7) -> Crf:
    labels = sorted(set(langs))
    size = len(labels)
    rng = np.random.default_rng(seed)
    words = Words(pa.array(texts, pa.string()))
    gold = np.array([labels.index(x) for x in langs])[words.doc]
    order = _spans(words.counts, rng)
    n = len(order) // SEQUENCE
    weights, trans = np.zeros((1 << BITS, size), np.float32), np.zeros((size, size))
    if size < 2 or not n:
        return Crf(labels, weights, trans, np.unique(words.hashes()))
    order = order[: n * SEQUENCE]
    code, y = words.codes[order].reshape(n, SEQUENCE), gold[order].reshape(n, SEQUENCE)
    m = len(words.distinct)
    word, feature = word_features(words)
    seen = np.stack([np.bincount(code.ravel()[y.ravel() == k], minlength=m) for k in range(size)], 1).astype(float)
    seen_t = np.bincount((y[:, :-1] * size + y[:, 1:]).ravel(), minlength=size * size).reshape(size, size)
    sums, sums_t = np.full(weights.shape, 1e-3), np.full(trans.shape, 1e-3)
    for _ in range(rounds):
        em = emissions(word, feature, m, weights)
        em, a = np.exp(em - em.max(1, keepdims=True)), np.exp(trans)
        expected, pairs = np.zeros((m, size)), np.zeros((size, size))
        for first in range(0, n, AT_ONCE):
            held = code[first : first + AT_ONCE]
            gamma, both = _passes(em[held], a)
            pairs += both
            for k in range(size):
                expected[:, k] += np.bincount(held.ravel(), weights=gamma[:, :, k].ravel(), minlength=m)
        gap = (expected - seen) / (n * SEQUENCE)
        grad = np.stack([np.bincount(feature, weights=gap[word, k], minlength=1 << BITS) for k in range(size)], 1) + 1e-8 * weights
        grad_t = (pairs - seen_t) / (n * SEQUENCE)
        sums, sums_t = sums * 0.9 + grad**2 * 1e6, sums_t * 0.9 + grad_t**2 * 1e2
        weights = (weights - 100.0 * grad / np.sqrt(sums)).astype(np.float32)
        trans = trans - 1.0 * grad_t / np.sqrt(sums_t)
    return Crf(labels, weights, trans, np.unique(words.hashes()))


def posteriors(em: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(label | whole text) of each word; ``counts``: words of each text, in order."""
    n, size = em.shape
    if not n:
        return em
    a = np.exp(trans)
    e = np.exp(em - em.max(1, keepdims=True))
    segs = -(-counts // SEGMENT)
    total = int(segs.sum())
    doc_first = np.cumsum(segs) - segs  # first segment of each text
    number = np.arange(total) - np.repeat(doc_first, segs)
    begin = np.repeat(np.cumsum(counts) - counts, segs) + number * SEGMENT
    length = np.minimum(np.repeat(counts, segs) - number * SEGMENT, SEGMENT)
    at = np.minimum(begin[:, None] + np.arange(SEGMENT), n - 1)
    real = np.arange(SEGMENT) < length[:, None]
    e = np.where(real[:, :, None], e[at], 1.0)
    whole = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for t in range(SEGMENT):
        step = (whole @ a) * e[:, t, None, :]
        step /= step.max((1, 2), keepdims=True)
        whole = np.where(real[:, t, None, None], step, whole)
    enter, leave = np.full((total, size), 1.0 / size), np.ones((total, size))
    most = int(segs.max())
    by_number = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[by_number], np.arange(most + 1))
    for k in range(1, most):
        s = by_number[bounds[k] : bounds[k + 1]]
        v = np.einsum("ni,nij->nj", enter[s - 1], whole[s - 1])
        enter[s] = v / v.sum(1, keepdims=True)
    for k in range(most - 1, 0, -1):
        s = by_number[bounds[k] : bounds[k + 1]]
        v = np.einsum("nij,nj->ni", whole[s], leave[s])
        leave[s - 1] = v / v.sum(1, keepdims=True)
    gamma = np.empty((total, SEGMENT, size))
    x = enter
    for t in range(SEGMENT):
        step = (x @ a) * e[:, t]
        step /= step.sum(1, keepdims=True)
        x = np.where(real[:, t, None], step, x)
        gamma[:, t] = x
    b = leave
    for t in range(SEGMENT - 1, -1, -1):
        gamma[:, t] *= b
        step = (e[:, t] * b) @ a.T
        step /= step.sum(1, keepdims=True)
        b = np.where(real[:, t, None], step, b)
    gamma /= gamma.sum(2, keepdims=True)
    return gamma[real]


def predict_slice(texts: pa.Array, model: Crf, with_runs: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, list[list[dict]]]:
    """(language, score, share of known words, runs of words of one language) of each text; only words with a letter count."""
    n = len(texts)
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    words = Words(texts)
    lang, score, share, runs = np.full(n, "und", object), np.zeros(n), np.zeros(n), [[] for _ in range(n)]
    if not len(words.codes) or not model.labels:
        return list(lang), score, share, runs
    em = emissions(*word_features(words), len(words.distinct), model.weights)[words.codes]
    p = posteriors(em, words.counts, model.transitions)
    counted = pc.match_substring_regex(words.distinct, r"\p{L}").to_numpy(zero_copy_only=False)[words.codes]
    mass = np.stack([np.bincount(words.doc, weights=p[:, k] * counted, minlength=n) for k in range(p.shape[1])], 1)
    total = mass.sum(1)
    best = mass.argmax(1)
    ok = letters & (total > 0)
    lang[ok] = np.array(model.labels, object)[best[ok]]
    score[ok] = np.minimum(1.0, mass[ok, best[ok]] / total[ok])
    h = words.hashes()
    known = model.lexicon[np.minimum(np.searchsorted(model.lexicon, h), len(model.lexicon) - 1)] == h
    share[ok] = (np.bincount(words.doc, weights=known[words.codes] & counted, minlength=n) / np.maximum(1, np.bincount(words.doc, weights=counted, minlength=n)))[ok]
    if not with_runs:
        return list(lang), score, share, runs
    label = p.argmax(1)
    start = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])])
    first = np.cumsum(words.counts) - words.counts
    for s, e in zip(start, np.append(start[1:], len(label)), strict=True):
        d = words.doc[s]
        if ok[d]:
            runs[d].append({"first": int(s - first[d]), "words": int(e - s), "lang": model.labels[label[s]]})
    return list(lang), score, share, runs


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf:
    """Fit on about ``per_language`` rows of each language, chosen by a hash of id and text; rows that repeat both are learnt once."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    got = sorted((r for r in stratified(rows, "l", per_language, "k", "t").distinct().collect()), key=lambda r: (str(r["k"]), r["t"], r["l"]))
    return fit([r["t"] for r in got], [r["l"] for r in got])


def predict(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text", runs: bool = False) -> DataFrame:
    """(key, lang_pred, score, known) of every row, and ``runs`` (first word, words, lang) where asked for."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, known, found = predict_slice(batch.column(1), held.value, runs)
            cols = {key: batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "known": pa.array(known)}
            if runs:
                cols["runs"] = pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, lang_pred string, score double, known double" + ", runs array<struct<first:int,words:int,lang:string>>" * runs
    return in_batches(docs.select(F.col(key), F.col(text).cast("string").alias("text")), label, schema)
