"""Periodic runs, hard negatives and fingerprints against brute force; odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import fingerprints, hard_negatives, periodic_runs, queries
from cloakframe.llm.periodic_runs import runs_of

# --- periodic runs ---------------------------------------------------------------------------


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)  # ascending: the smallest period
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def periodic(rng):
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 50])) for _ in range(rng.randrange(60))]
    if w and rng.random() < 0.5:
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // (3 + rng.randrange(8))
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        docs = [periodic(rng) for _ in range(rng.randrange(1, 5))]
        words = np.array([x for d in docs for x in d], np.int64)
        if len(words):
            got = runs_of(words, np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
            base = np.cumsum([0, *map(len, docs)])
            assert [tuple(r) for r in got.tolist()] == sorted((s + base[k], n, q) for k, d in enumerate(docs) for s, n, q in brute_runs(d))


def test_runs_of_very_long_texts():
    n = 300_000
    doc = np.zeros(n, np.int64)
    assert runs_of(np.zeros(n, np.int64), doc).tolist() == [[0, n, 1]]
    assert runs_of(np.arange(n) % 7001, doc).tolist() == [[0, n, 7001]]
    assert len(runs_of(np.arange(n), doc)) == 0


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a " * 9), (None, "a " * 9), (7, "x b c b c b c b c b c b c y"),
            (7, "p q p q p q p q z"), (8, "a A a A a A a A a A"), (9, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("clash")).withColumn("key", F.lit(0))
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs.periodic_runs(df).collect())
    assert got == Counter([(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), *2 * [(None, 9, ((0, 9, 1),), "a")], (7, 8, ((1, 6, 1),), "x b c y"),
                           (7, 9, ((0, 8, 2),), "p q z"), (8, 10, ((0, 10, 2),), "a A"), (9, 5, (), "a b c d e")])
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, power=2)


def test_run_query_equals_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, data, "documents").collect()}
    seen = 0
    for r in queries.op12(spark, data).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        runs = brute_runs(w) if n < 600 else None
        if runs is None:
            continue
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 10


# --- hard negatives --------------------------------------------------------------------------


def brute_negatives(rows, k=5, n=3):
    out = Counter()
    rows = [(i, lab, np.floor(256 * np.array(v, float)).astype(int)) for i, lab, v in rows
            if lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    place = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for a, (i, lab, v) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = [(int(v @ w), j, m) for b, (j, m, w) in enumerate(rows) if b != a and len(w) == len(v)]
        for ps, pid, _ in sorted((s for s in scored if s[2] == lab), key=place)[:k]:
            fit = sorted((s for s in scored if s[2] != lab and 50 * ps <= 100 * s[0] <= 95 * ps), key=place)[:n]
            out.update((i, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(fit))
    return out


def test_negatives_equal_brute_force(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 150), ("TILE_ANCHORS", 4), ("BLOCK", 64)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(4)) if i % 3 else 0, [float(x) for x in rng.normal(0.05, 0.3, 19)]) for i in range(700)]  # a hot label
    rows += [(i, i % 2, [0.5] * 19) for i in range(700, 900)]  # one vector, many times
    rows += [(50, 1, [0.3] * 19), (None, 1, [0.4] * 19), (None, 2, [0.4] * 19), (950, None, [0.1] * 19), (1000, 1, None), (1050, 1, [1.0, None]), (1100, 1, []),
             (1150, 1, [float("nan")] * 19), (1200, 3, [1.0, 2.0]), (1201, 3, [1.0, 2.0]), (1202, 1, [1.0, 1.0]), (1250, 9, [0.1] * 19), (1300, 1, [-9.0] * 19)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], "vec_id bigint, embedding array<double>, label int")
    df = df.withColumn("score", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = Counter(tuple(r) for r in hard_negatives.mine_negatives(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_negatives(rows) and len(got) > 100
    assert hard_negatives.mine_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_segment_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 300, (8, 64))
    m = (centre[rng.integers(8, size=400)] + rng.normal(0, 20, (400, 64))).astype(np.int64)
    s, true = hard_negatives.summaries(m), m @ m.T
    widths = []

    def keep(a, low, high, alive):
        assert (low <= true[a]).all() and (true[a] <= high).all()
        widths.append(float((high - low).mean()))
        return alive

    hard_negatives.refine(s, s, np.ones((400, 400), bool), keep)
    assert widths[0] > widths[1] > widths[2]
    best = np.sort(true, 1)[:, -5]
    left = hard_negatives.refine(s, s, np.ones((400, 400), bool), lambda a, low, high, alive: high >= best[a, None])
    assert left.mean() < 0.5 and (left | (true < best[:, None])).all()


# --- fingerprints ----------------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(2)
    voc, pairs = [f"w{k}" for k in range(300)], []
    for _ in range(300):
        a = [rng.choice(voc) for _ in range(rng.choice([3, 20, 60, 200, 900]))]
        b = [rng.choice(voc) if rng.random() < rng.choice([0, 0.01, 0.05, 0.5]) else x for x in a]
        pairs.append((" ".join(a), " ".join(b)))
    pairs += [("", ""), ("", "a"), (None, None), ("Same Words", "same  words"), ("one", "two")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("x", fingerprints.fingerprint("a")).withColumn("y", fingerprints.fingerprint("b"))
    off = []
    for r in df.select("*", fingerprints.likeness("x", "y").alias("l"), fingerprints.as_text("x").alias("t")).collect():
        p, q = shingles(r["a"]), shingles(r["b"])
        off.append(r["l"] - (len(p & q) / len(p | q) if p | q else 1.0))
        assert len(r["t"]) == (fingerprints.BINS if p else 0) and (p != q or r["l"] == 1.0)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.035 and np.abs(off).max() < 0.15


def test_every_row_meets_the_next_one(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randrange(-500, 500) * 10**12, f"text {k}") for k in range(400)]
    rows += [(7, "copy")] * 300 + [(None, f"no id {k}") for k in range(50)] + [(None, None), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("range", F.lit("clash")).withColumn("fp", F.lit(1))
    for step in (8 << 20, 1400):
        monkeypatch.setattr(fingerprints, "RANGE_BYTES", step)
        got = fingerprints.with_next(df).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t or "") for i, t in rows)
        after = {}
        for r in got:
            after.setdefault((r["doc_id"], r["text"]), Counter())[r["next_text"]] += 1
        assert sum(after[(7, "copy")].values()) == 300 and after[(7, "copy")]["copy"] >= 300 - 16
        ids = sorted({i for i, _ in rows if i is not None})
        for i, j in zip(ids, ids[1:], strict=False):  # the last text of an id is followed by a text of the next id
            here, there = [{t or "" for k, t in rows if k == x} for x in (i, j)]
            assert any(n in there for t in here for n in after[(i, t)])
        assert all(r["next_fp"] is not None for r in got)
    one = fingerprints.with_next(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")).collect()
    assert [(r["text"], r["next_text"]) for r in one] == [("a b", "a b")]
    assert fingerprints.with_next(df.limit(0)).count() == 0


def test_fingerprint_query(spark, data, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 20_000)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in queries.table(spark, data, "documents").collect()))
    got = {r["doc_id"]: r for r in queries.op11(spark, data).collect()}
    off = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(t) // 4
        edited = t[: len(t) - m] + n[:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", n)):
            p, q = shingles(t), shingles(other)
            off.append(got[i][name] - len(p & q) / max(1, len(p | q)))
    assert np.std(off) < 0.03 and np.abs(off).max() < 0.12
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    plan = queries.op11(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
