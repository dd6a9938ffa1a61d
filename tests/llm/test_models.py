"""The trained models: held-out accuracy, exact sums against brute force, defined results of odd input."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloakframe.llm import language_id, lm_score, quality, queries, toxicity
from cloakframe.llm.common import Words, crc_mod, slices, string_bytes, table

DOCS = "doc_id bigint, text string, lang string, score string"
ODD = [None, "", " \n\t ", "123 %% 45", "a", "é", "\x00", "日本語 の 文", "x" * 300_000, "ab " * 60_000]


def odd(spark):
    return spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(ODD)] * 2 + [(None, "text", None, "clash")], DOCS)


def test_slices_keep_every_row():
    texts = ["a" * n for n in (0, 5, 3_000_000, 1, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": pa.array(texts, pa.string())})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), most=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
    assert [x for p in parts for x in p.column(1).to_pylist()] == [t or "" for t in texts]


def test_words_are_bytes_between_white_space():
    texts = [" A  b\tÉ\x0b", "", "c d\n"]
    words = Words(pa.array(texts))
    flat = words.distinct.to_pylist()
    assert [flat[c] for c in words.codes] == ["a", "b", "É", "c d"]
    assert words.counts.tolist() == [3, 0, 1] and words.doc.tolist() == [0, 0, 0, 2]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    trans = rng.normal(0, 1, (2, 2))
    for n in (1, 2, 7):
        em = rng.normal(0, 2, (n, 2))
        total, mass = 0.0, np.zeros((n, 2))
        for path in product(range(2), repeat=n):
            s = sum(em[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))
            first = np.exp(trans[:, path[0]]).sum()
            p = math.exp(s) * first
            total += p
            for t, y in enumerate(path):
                mass[t, y] += p
        assert np.allclose(language_id.posteriors(em, np.array([n]), trans), mass / total)
    em = rng.normal(0, 1, (500, 2))  # several segments equal one after another
    whole = language_id.posteriors(em, np.array([300, 0, 200]), trans)
    kept, language_id.SEGMENT = language_id.SEGMENT, 1000
    try:
        assert np.allclose(whole, language_id.posteriors(em, np.array([300, 0, 200]), trans))
    finally:
        language_id.SEGMENT = kept


def test_language_of_held_out_and_switched_texts(spark, data):
    docs = table(spark, data, "documents")
    train = docs.filter(crc_mod("doc_id", 4) != 2)
    model = language_id.train(train)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(crc_mod("doc_id", 4) == 2).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    rows = {r["lang"]: r["text"] for r in docs.filter("length(text) > 500").collect()}
    mixed = " ".join(rows["en"].split()[:30] + rows["de"].split()[:30] + rows["en"].split()[30:60])
    runs = language_id.predict_slice(pa.array([mixed]), model, True)[3][0]
    label = [r["lang"] for r in runs for _ in range(r["words"])]
    want = ["en"] * 30 + ["de"] * 30 + ["en"] * 30
    assert sum(a == b for a, b in zip(label, want, strict=True)) >= 80


def test_language_of_odd_texts(spark, data):
    model = language_id.train(table(spark, data, "documents"))
    got = {r["doc_id"]: r for r in language_id.predict(odd(spark), model).collect()}
    assert {i for i in range(len(ODD)) if got[i]["lang_pred"] == "und"} == {0, 1, 2, 3, 6}
    assert all(got[i]["score"] == 0 for i in (0, 1, 2, 3, 6))
    assert language_id.predict(odd(spark), model).count() == 2 * len(ODD) + 1
    assert language_id.predict(odd(spark).limit(0), model).count() == 0
    nothing = language_id.train(odd(spark))
    assert {r["lang_pred"] for r in language_id.predict(odd(spark), nothing).collect()} == {"und"}


def test_quality_held_out(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op9_conv_quality"](spark, d).join(table(spark, d, "labels"), "doc_id").filter("held_out").collect()
    good, bad = ([r for r in got if r["quality"] == k] for k in (1, 0))
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.8 * len(bad)


def test_quality_reads_whole_texts_and_odd_ones(spark):
    net = quality.fit(["good words here and there. " * 9] * 20 + ["%%% $$$ ### " * 20] * 20, [1] * 20 + [0] * 20, steps=60)
    text = "good words here and there. " * 400
    a, b = quality.scores(net, *string_bytes(pa.array([text, text[:5000] + "%%% $$$ ### " * 4000 + text[5000:]])))
    assert a > 0.7 > b
    alone = quality.scores(net, *string_bytes(pa.array(["x", "%%%"])))
    assert np.allclose(alone, [quality.scores(net, *string_bytes(pa.array([t])))[0] for t in ("x", "%%%")], atol=1e-5)
    got = quality.predict(odd(spark), net).collect()
    assert len(got) == 2 * len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.predict(odd(spark).limit(0), net).count() == 0
    none = quality.train(odd(spark), spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int"))
    assert {r["score"] for r in quality.predict(odd(spark), none).collect()} == {0.5}
    data, offsets = string_bytes(pa.array(["a" * n for n in (0, 1, 512, 513, 960, 961)]))
    chunks, text = quality.chunks_of(data, offsets)
    assert np.bincount(text).tolist() == [1, 1, 1, 2, 2, 3]
    assert (chunks > 0).sum() == sum((0, 1, 512, 513 + 64, 960 + 64, 961 + 128))


def toxic_rows(rng, n):
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(1500)]
    rows = []
    for i in range(n):
        words = [rng.choice(voc) for _ in range(rng.randrange(20, 300))]
        bad = rng.choice([0, 0, 1, 4, 12])
        for _ in range(bad):
            words.insert(rng.randrange(len(words)), rng.choice(["Zorgon!", "zrrp", "zlab,"]))
        rows.append((i, " ".join(words), bad))
    return rows


def test_toxicity_orders_severity_and_leaves_clean_texts(spark):
    rng = random.Random(3)
    rows = toxic_rows(rng, 900)
    model = toxicity.fit([t for _, t, _ in rows[:600]], [int(b > 0) for *_, b in rows[:600]])
    above = toxicity.grades_of(model, pa.array([t for _, t, _ in rows[600:]]))
    severity, bad = above.sum(1), np.array([b for *_, b in rows[600:]])
    assert (above[bad > 0, 0] >= 0.5).mean() > 0.95 and (above[bad == 0, 0] >= 0.5).mean() < 0.02
    means = [severity[bad == b].mean() for b in (0, 1, 4, 12)]
    assert means == sorted(means) and means[3] > 2
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(above, axis=1) <= 0).all()
    got = toxicity.predict(odd(spark), model).collect()
    assert len(got) == 2 * len(ODD) + 1 and all(0 <= r["severity"] <= 3 for r in got)
    assert toxicity.predict(odd(spark).limit(0), model).count() == 0
    none = toxicity.train(odd(spark), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r["grade"] for r in toxicity.predict(odd(spark), none).collect()} == {1} or none.thresholds[0] == 0
    clean = toxicity.train(odd(spark), spark.createDataFrame([(1, 0), (4, 0), (4, None)], "doc_id bigint, toxic int"))
    assert {r["grade"] for r in toxicity.predict(odd(spark), clean).collect()} == {0}


def test_language_model_counts_are_exact_and_it_beats_them(spark, data):
    got = queries.QUERIES["op5_log_bilinear"](spark, data).collect()
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(az)), None] for r in table(spark, data, "documents").collect()}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(tokens)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_normalised(spark):
    rng = random.Random(5)
    voc = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choice(voc) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocab = lm_score.vocabulary(docs.select("text")).cache()
    known = lm_score.gather(vocab)
    flat = lm_score.train(docs, known, rounds=1)
    ctx = np.tile(np.array([[5, 200, 0]]), (lm_score.CLASSES, 1))
    p = 10 ** lm_score.class_log10(flat, np.arange(lm_score.CLASSES), ctx)
    assert math.isclose(p.sum(), 1, rel_tol=1e-5)
    words = Words(known.frequent.slice(1))
    kinds, _ = lm_score.classify(words, known)
    inside = Counter()
    for k, w in zip(kinds, words.distinct.to_pylist(), strict=True):
        c = {r["word"]: r["c"] for r in vocab.collect()}[w] if not inside else None
        inside[int(k)] += 1
        assert c is None or c > 0
    for k in range(lm_score.HEAD, lm_score.CLASSES):
        assert inside[k] == known.class_words[k]
    assert known.class_tokens.sum() == known.tokens


def test_language_model_of_odd_texts(spark):
    got = lm_score.score_texts(odd(spark), F.lit(True)).collect()  # nothing to learn from
    assert len(got) == 2 * len(ODD) + 1
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
    got = lm_score.score_texts(odd(spark), F.coalesce(F.col("doc_id") > 4, F.lit(True))).collect()
    assert len(got) == 2 * len(ODD) + 1 and all(math.isfinite(r["score"]) for r in got)
    assert lm_score.score_texts(odd(spark).limit(0), F.lit(False)).count() == 0


def test_quality_equals_a_plain_convolution():
    rng = np.random.default_rng(5)
    net = quality.ConvNet(rng.normal(0, 0.5, (256, quality.DIM)), rng.normal(0, 0.3, (quality.WIDTH * quality.DIM, quality.FILTERS)),
                          rng.normal(0, 0.2, quality.FILTERS), rng.normal(0, 0.4, quality.FILTERS), 0.3)
    texts = ["", "short", "é" * 300, " ".join(f"word{k}" for k in range(400))]
    got = quality.scores(net, *string_bytes(pa.array(texts)))
    for text, score in zip(texts, got, strict=True):
        data, means, at = text.encode(), [], 0
        while True:  # chunks of 512 bytes that overlap by 64, up to the end of the text
            chunk = data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            best = [-math.inf] * quality.FILTERS
            for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                x = np.concatenate([net.vectors[b] for b in chunk[p : p + quality.WIDTH]])
                best = [max(b, float(x @ net.filters[:, f])) for f, b in enumerate(best)]
            means.append(sum(max(0.0, b + c) * w for b, c, w in zip(best, net.bias, net.out, strict=True)))
            if at + quality.CHUNK >= len(data):
                break
            at += quality.CHUNK - quality.OVERLAP
        assert math.isclose(score, 1 / (1 + math.exp(-(sum(means) / len(means) + net.base))), rel_tol=1e-4)


def test_grades_equal_plain_sums():
    rng = np.random.default_rng(6)
    texts = ["you absolute fool, fool!", "", "a fine day", "fools foolish (fool)", "nothing here at all"]
    every = Words(pa.array(texts))
    features = np.unique(toxicity.word_features(every))
    features = features[features >= 0]
    model = toxicity.Ordinal(features, rng.normal(0, 1, len(features)), np.array([-0.5, 0.4, 2.0]))
    got = toxicity.grades_of(model, pa.array(texts))
    weight = dict(zip(features.tolist(), model.weights.tolist(), strict=True))
    for text, row in zip(texts, got, strict=True):
        held = set()
        for w in text.lower().split():
            one = Words(pa.array([w]))
            held |= {int(f) for f in toxicity.word_features(one).ravel() if f >= 0}
        s = sum(weight[f] for f in held)
        assert np.allclose(row, [1 / (1 + math.exp(-(s - t))) for t in model.thresholds])


def test_language_model_score_equals_plain_sums(spark):
    texts = ["the cat sat on the mat", "the dog", "", "a cat and a dog and the mat the cat", "unseen zebra the"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    learnt = docs.filter("doc_id < 4")
    vocab = lm_score.vocabulary(learnt.select("text")).cache()
    known = lm_score.gather(vocab)
    flat = lm_score.train(learnt, known, rounds=1)
    got = {r["doc_id"]: r for r in lm_score.score(docs, vocab, known, flat).collect()}
    count = {r["word"]: r["c"] for r in vocab.collect()}
    r, mats, q, b = lm_score.unpack(flat)[:4]
    place = {w: k for k, w in enumerate(known.frequent.to_pylist())}
    for i, t in enumerate(texts):
        total, before = 0.0, [0] * lm_score.CONTEXT
        for w in [*t.split(), lm_score.END]:
            k = place.get(w, lm_score.HEAD)
            k = k if k < lm_score.HEAD else lm_score.HEAD + zlib.crc32(w[-2:].encode()) % lm_score.TAIL
            v = np.concatenate([r[c] for c in before]) @ mats
            s = q @ v + b
            total += (s[k] - np.log(np.exp(s).sum())) / math.log(10)
            if k >= lm_score.HEAD:
                total += math.log10((count.get(w, 0) + 1) / (known.class_tokens[k] + known.class_words[k] + 1))
            before = [k, *before[:-1]]
        assert math.isclose(got[i]["score"], total, rel_tol=1e-4), (t, got[i]["score"], total)


def test_equal_contexts_share_their_sum(monkeypatch):
    """The sum over all classes is made once for each context, and every token has the value that it has alone."""
    rng = np.random.default_rng(5)
    sizes = [int(np.prod(s)) for s in lm_score.SHAPES]
    ctx = rng.integers(0, lm_score.CLASSES, (700, lm_score.CONTEXT))[rng.integers(0, 700, 5000)]
    y = rng.integers(0, lm_score.CLASSES, 5000)
    for scale in (0.5, 200.0):  # the second goes beyond single precision
        flat = np.concatenate([rng.normal(0, scale, sum(sizes)), np.ones(sum(sizes))])
        alone = np.concatenate([lm_score.class_log10(flat, y[k : k + 1], ctx[k : k + 1]) for k in range(0, 5000, 10)])
        rows = []
        monkeypatch.setattr(np, "exp", lambda x, *a, _exp=np.exp, **kw: rows.append(len(x)) or _exp(x, *a, **kw))
        together = lm_score.class_log10(flat, y, ctx)
        monkeypatch.undo()
        assert np.allclose(together[::10], alone, rtol=1e-4, atol=1e-4) and len(together) == 5000
        assert sum(rows) <= 2 * len({tuple(c) for c in ctx}) < 5000
    assert len(lm_score.class_log10(flat, y[:0], ctx[:0])) == 0
