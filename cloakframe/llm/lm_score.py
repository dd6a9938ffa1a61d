"""Log-probabilities of whole texts by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Tokens are the words of a text (ASCII white space parts them, A-Z lower-cased) and one end. Every token has a class: the
``HEAD`` most frequent words have one each, all others share ``TAIL`` classes by their last two characters. The log-bilinear model
gives P(class | last ``CONTEXT`` classes): a linear prediction from the context's vectors meets the vectors of all classes in
one matrix product, and a softmax over all of them normalises it. P(word | class) is (c + 1) / (tokens + words + 1 of the class), which
leaves one share for words never seen, so the probabilities of all words and the unseen ones sum to one.

Counts cover all training tokens. The model sees every training document once, in ``ROUNDS`` rounds: each partition trains on
its part of the round from the common parameters, and Spark averages them weighted by tokens. Only parameters, class totals
and words with at least ``1 / FREQUENT`` of all tokens (so at most ``FREQUENT``) reach the driver. The counts of rarer words
come by a join on the word; the words that could be hot keys are the frequent ones, which never enter it.

Defined results: a null text is an empty one and holds just its end; without training rows all words are unseen, N is 0 and the classes are
uniform; repeated rows and null ids are scored row by row; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import Words, in_batches, slices, stored

HEAD, TAIL = 384, 128
CLASSES = HEAD + TAIL
DIM, CONTEXT = 16, 3
ROUNDS, BATCH, NOISE, RATIO, RATE = 4, 1024, 64, 24.0, 0.1
FREQUENT = 1 << 17
#: Contexts whose products with all classes are made at once; they fit a core's cache.
AT_ONCE = 512
#: Bytes of text scored together; contexts repeat more in longer runs of texts.
SCORED = 4 << 20
#: Tasks that sum up the partitions' parameters.
GROUPS = 16
#: The end of a text; no word holds a line feed.
END = "\n"


@dataclass
class Counts:
    """What tasks need of the training counts."""

    tokens: int
    words: int
    frequent: pa.Array  # the end first, then by falling count
    count: np.ndarray  # of each frequent word
    class_tokens: np.ndarray
    class_words: np.ndarray


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c) over all tokens of ``train`` (one column, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            words = Words(batch.column(0))
            n = np.bincount(words.codes, minlength=len(words.distinct))
            yield pa.RecordBatch.from_pydict({"word": pa.concat_arrays([words.distinct.cast(pa.string()), pa.array([END])]),
                                              "c": pa.array(np.append(n, batch.num_rows).astype(np.int64))})

    return in_batches(train, count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def gather(vocab: DataFrame) -> Counts:
    tokens, words = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = vocab.filter(F.col("c") * FREQUENT >= tokens).collect()
    known = sorted(((r["word"], r["c"]) for r in often if r["word"] != END), key=lambda x: (-x[1], x[0]))
    known.insert(0, (END, sum(r["c"] for r in often if r["word"] == END) or sum(r[0] for r in vocab.filter(F.col("word") == END).select("c").collect())))
    heads = [w for w, _ in known[:HEAD]]
    tail = vocab.filter(~F.col("word").isin(heads)).groupBy((HEAD + F.crc32(F.right("word", F.lit(2))) % TAIL).cast("int").alias("k"))
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (_, c) in enumerate(known[:HEAD]):
        class_tokens[k], class_words[k] = c, 1
    for r in tail.agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_tokens[r["k"]], class_words[r["k"]] = r["c"], r["n"]
    return Counts(tokens, words, pa.array([w for w, _ in known], pa.string()), np.array([c for _, c in known], np.int64), class_tokens, class_words)


def classify(words: Words, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """(class, place among the frequent words or -1) of each distinct word."""
    place = pc.fill_null(pc.index_in(words.distinct, value_set=counts.frequent), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = pc.utf8_slice_codeunits(words.distinct, -2).dictionary_encode()
    by_end = np.array([HEAD + crc32(x.encode()) % TAIL for x in ends.dictionary.to_pylist()], np.int64)
    tail = by_end[ends.indices.to_numpy(zero_copy_only=False)] if len(by_end) else np.zeros(0, np.int64)
    return np.where((place >= 0) & (place < HEAD), place, tail), place


def sequence(words: Words, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, contexts, text) of every token, ends included; before a text stand ends."""
    n = words.counts
    stop = np.cumsum(n + 1) - 1
    y = np.zeros(int(stop[-1]) + 1 if len(stop) else 0, np.int64)
    inner = np.ones(len(y), bool)
    inner[stop] = False
    y[inner] = kinds[words.codes]
    text = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(y)) - np.repeat(stop - n, n + 1)
    before = np.stack([np.where(place >= k, y[np.maximum(np.arange(len(y)) - k, 0)], 0) for k in range(1, CONTEXT + 1)], 1)
    return y, before, text


SHAPES = ((CLASSES, DIM), (CONTEXT * DIM, DIM), (CLASSES, DIM), (CLASSES,))


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    """Context vectors, context matrices, class vectors, class biases; then the squares that Adagrad keeps of each."""
    out, at = [], 0
    for shape in SHAPES * 2:
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def start(counts: Counts) -> np.ndarray:
    """Parameters that predict class frequencies whatever the context is."""
    rng = np.random.default_rng(3)
    mats = np.concatenate([np.eye(DIM) / CONTEXT for _ in range(CONTEXT)])
    bias = np.log((counts.class_tokens + 1) / (counts.class_tokens + 1).sum())
    flat = [rng.normal(0, 0.5, SHAPES[0]), mats, np.zeros(SHAPES[2]), bias]
    return np.concatenate([*(x.ravel() for x in flat), *(np.full(s, 1e-4).ravel() for s in SHAPES)])


def nce_step(params: list[np.ndarray], ctx: np.ndarray, y: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
    """One Adagrad step on a batch; the noise classes are shared by its tokens."""
    r, mats, q, b = params[:4]
    n = len(y)
    x = r[ctx].reshape(n, -1)
    v = x @ mats
    good = (v * q[y]).sum(1) + b[y] - np.log(RATIO) - log_noise[y]
    few = q[noise]
    h = v @ few.T
    h += b[noise] - np.log(RATIO) - log_noise[noise]
    g = (1 / (1 + np.exp(-np.clip(good, -30, 30))) - 1) / n
    np.clip(h, -30, 30, out=h)
    np.exp(np.negative(h, out=h), out=h)  # the largest array of a step: filled in place
    h += 1
    np.divide(RATIO / len(noise) / n, h, out=h)
    dv = g[:, None] * q[y] + h @ few
    dim = np.arange(DIM)
    add = lambda rows, values: np.bincount((rows[:, None] * DIM + dim).ravel(), weights=values.ravel(), minlength=CLASSES * DIM).reshape(CLASSES, DIM)
    dq = add(y, g[:, None] * v) + add(noise, h.T @ v)
    db = np.bincount(y, weights=g, minlength=CLASSES) + np.bincount(noise, weights=h.sum(0), minlength=CLASSES)
    dr = add(ctx.ravel(), (dv @ mats.T).reshape(-1, DIM))
    for p, s, d in zip(params[:4], params[4:], (dr, x.T @ dv, dq, db), strict=True):
        s += d * d
        p -= RATE * d / np.sqrt(s)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (sum of weights, weighted sum of parameters) of a task's rows."""
    total, weight = None, 0.0
    for batch in batches:
        for w, p in zip(batch.column("w").to_pylist(), batch.column("p"), strict=True):
            x = w * np.asarray(p.values)
            total, weight = x if total is None else total + x, weight + w
    if total is not None:
        yield pa.RecordBatch.from_pydict({"w": pa.array([weight]), "p": pa.array([total.tolist()], pa.list_(pa.float64()))})


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after all rounds; ``docs``: (doc_id, text)."""
    flat = start(counts)
    log_noise = np.log((counts.class_tokens + 1) / (counts.class_tokens + 1).sum())
    context = docs.sparkSession.sparkContext
    for k in range(rounds):
        held = context.broadcast((flat, counts, log_noise))

        def fit(batches: Iterator[pa.RecordBatch], held=held, k=k) -> Iterator[pa.RecordBatch]:
            own, known, noise_log = held.value
            own = own.copy()
            params = unpack(own)
            part = TaskContext.get()
            rng = np.random.default_rng([k, part.partitionId() if part else 0])
            share = np.cumsum(np.exp(noise_log))
            seen = 0
            for batch in slices(batches, "text"):
                words = Words(batch.column("text"))
                y, ctx, _ = sequence(words, classify(words, known)[0])
                for a in range(0, len(y), BATCH):
                    noise = np.minimum(np.searchsorted(share, rng.random(NOISE)), CLASSES - 1)
                    nce_step(params, ctx[a : a + BATCH], y[a : a + BATCH], noise, noise_log)
                seen += len(y)
            if seen:
                yield pa.RecordBatch.from_pydict({"w": pa.array([float(seen)]), "p": pa.array([own.tolist()], pa.list_(pa.float64()))})

        turn = docs.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == k)
        # Sums of whole parameter arrays, in two levels: in ``GROUPS`` tasks, then of their few results.
        parts = in_batches(turn, fit, "w double, p array<double>").repartition(GROUPS).mapInArrow(_summed, "w double, p array<double>").collect()
        if parts:
            flat = sum(np.array(r["p"]) for r in parts) / sum(r["w"] for r in parts)
    return flat


def class_log10(flat: np.ndarray, y: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """log10 P(class | context) of every token, normalised over all classes."""
    r, mats, q, b = (x.astype(np.float32) for x in unpack(flat)[:4])
    # A column of ones carries the biases through the product.
    moved = [np.ascontiguousarray(np.pad(r @ mats[k * DIM : (k + 1) * DIM], ((0, 0), (0, 1)), constant_values=1 / CONTEXT)) for k in range(CONTEXT)]
    classes = np.ascontiguousarray(np.concatenate([q, b[:, None]], 1).T)
    ones = np.ones(CLASSES, np.float32)
    # The sum over all classes is the same for all tokens behind the same classes, so it is made once for each context.
    key = np.zeros(len(y), np.int64)
    for k in range(CONTEXT):
        key = key * CLASSES + ctx[:, k]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(y)])
    contexts, stops = ctx[order[first]], np.append(first, len(y))
    out = np.empty(len(y))
    for a in range(0, len(contexts), AT_ONCE):
        c = contexts[a : a + AT_ONCE]
        times = np.diff(stops[a : a + len(c) + 1])
        tokens, at = order[stops[a] : stops[a + len(c)]], np.repeat(np.arange(len(c)), times)
        own = y[tokens]
        v = sum(moved[k][c[:, k]] for k in range(CONTEXT))
        s = v @ classes
        mine = s[at, own]
        with np.errstate(over="ignore"):
            total = np.exp(s, out=s) @ ones
        if not (total.min() > 1e-30 and total.max() < 1e37):  # beyond what single precision sums up as it is
            s = v @ classes
            top = s.max(1)
            mine, total = mine - top[at], np.exp(s - top[:, None]) @ ones
        out[tokens] = mine - np.log(total)[at]
    return out / np.log(10)


def score(docs: DataFrame, vocab: DataFrame, counts: Counts, flat: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((counts, flat))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, params = held.value
        spare = np.where(np.arange(CLASSES) < HEAD, 0.0, np.log10(known.class_tokens + known.class_words + 1))
        part = TaskContext.get()
        row = (part.partitionId() if part else 0) << 40
        for batch in slices(batches, "text", SCORED):
            n = batch.num_rows
            words = Words(batch.column("text"))
            kinds, place = classify(words, known)
            y, ctx, text = sequence(words, kinds)
            own = np.bincount(text, weights=class_log10(params, y, ctx) - spare[y], minlength=n)
            at = place[words.codes]
            often = at >= 0
            count = known.count[np.maximum(at, 0)]
            times = lambda x: np.bincount(words.doc, weights=np.where(often, x, 0), minlength=n)
            base = times(np.log10(count + 1.0)) + np.log10(known.count[0] + 1.0)
            tail = times(np.where(at < HEAD, 0.0, np.log10(count + 1.0)))
            pair, m = np.unique(words.doc[~often].astype(np.int64) * max(1, len(words.distinct)) + words.codes[~often], return_counts=True)
            doc, code = pair // max(1, len(words.distinct)), pair % max(1, len(words.distinct))
            offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            rare = words.distinct.take(pa.array(code)) if len(code) else pa.array([], pa.string())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "row": pa.array(row + np.arange(n)), "n": pa.array(words.counts + 1),
                "k": pa.array(np.bincount(words.doc, weights=often, minlength=n).astype(np.int64) + int(known.count[0] > 0)),
                "base": pa.array(base), "own": pa.array(own + tail),
                "rare": pa.ListArray.from_arrays(offsets, rare.cast(pa.string())), "times": pa.ListArray.from_arrays(offsets, pa.array(m.astype(np.int32)))})
            row += n

    rows = in_batches(docs, measure, f"doc_id {kind}, row bigint, n bigint, k bigint, base double, own double, rare array<string>, times array<int>")
    # One more row for each text carries its sums; its key holds a line feed and so meets no word.
    lone = F.array(F.struct(F.concat(F.lit(END), F.col("row").cast("string")).alias("word"), F.lit(0).alias("m"),
                            F.struct("doc_id", "n", "k", "base", "own").alias("sums")))
    none = F.lit(None).cast(f"struct<doc_id:{kind},n:bigint,k:bigint,base:double,own:double>")
    each = F.zip_with("rare", "times", lambda w, t: F.struct(w.alias("word"), t.alias("m"), none.alias("sums")))
    flat_rows = rows.select("row", F.explode(F.concat(lone, each)).alias("x")).select("row", "x.*")
    met = flat_rows.join(vocab.filter(F.col("c") * FREQUENT < counts.tokens), "word", "left")
    some = F.col("c").isNotNull()  # a word without a count was never seen
    sums = met.groupBy("row").agg(
        F.max("sums.doc_id").alias("doc_id"), *[F.sum(f"sums.{x}").alias(x) for x in ("n", "own", "base")], F.sum("sums.k").alias("often"), F.sum(F.when(some, F.col("m")).otherwise(0)).alias("k"),
        F.sum(F.when(some, F.col("m") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("l"))
    scale = float(np.log10(counts.tokens + counts.words + 1))
    return sums.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("often") + F.col("k")).alias("n_known"), F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("l") - F.col("n") * scale).alias("base_score"), (F.col("own") + F.col("l")).alias("score"))


def score_texts(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows outside ``held_out`` (a boolean column) and scores all."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    learnt = rows.filter(~held_out)
    vocab = stored(vocabulary(learnt.select("text")))
    counts = gather(vocab)
    return score(rows, vocab, counts, train(learnt, counts))
