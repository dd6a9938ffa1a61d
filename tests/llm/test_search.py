"""Exact top-k, components, near copies and benchmark passages against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, jaccard_join, topk
from cloakframe.llm.components import connected_components
from cloakframe.llm.membership import matching, without

DOCS = "doc_id bigint, text string, id string, root string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], DOCS)


def brute_top(vectors, queries, k):
    out = set()
    for q, v in queries:
        s = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for i, w in vectors if i != q and len(w) == len(v)))[:k]
        out |= {(q, r + 1, None if none else i, -n) for r, (n, none, i) in enumerate(s)}
    return out


def test_top_k_with_ties_nulls_and_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 5)]) for i in range(900)]
    rows += [(i, [0.5, -0.25, 0.125, 0.0, 0.3]) for i in range(900, 1400)]  # one vector, many times
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 5), (2150, [float("inf")] * 5), (2200, [1.0, 2.0]), (2250, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()}
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    assert got == brute_top(ints, [(i, v) for i, v in ints if i is not None and i % 50 == 0], 5)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert topk.top_k(df, df.limit(0), 5).count() == 0


def test_blocks_are_pruned_but_nothing_is_lost():
    rng = np.random.default_rng(2)
    blocks, flat = [], []
    for b in range(30):
        m = rng.integers(-40, 40, (16, 6)) // (1 + b)
        ids = np.arange(16) + 16 * b
        blocks.append((ids, m, m.max(0), m.min(0)))
        flat += list(zip(ids.tolist(), m.tolist(), strict=True))
    q = rng.integers(-40, 40, (20, 6))
    own = np.arange(20) * 7
    row, ids, score = topk.search_tile(blocks, q, own, 4)
    for k in range(20):
        s = sorted((-int(np.dot(q[k], v)), i) for i, v in flat if i != own[k])[:4]
        assert sorted(zip((-score[row == k]).tolist(), ids[row == k].tolist(), strict=True)) == s
    big = [(np.array([1, 2]), np.array([[1 << 27, 1], [1 << 27, 2]]), np.array([1 << 27, 2]), np.array([1 << 27, 1]))]
    _, ids, score = topk.search_tile(big, np.array([[1 << 27, 1]]), np.array([9]), 1)  # beyond exact doubles
    assert (ids.tolist(), score.tolist()) == ([2], [(1 << 54) + 2])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 1000)] + [(1, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in ends}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_membership(spark):
    rows, ids = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    assert without(rows, ids, "k").count() == 1001 - 143
    assert matching(rows, ids, "k").count() == 143
    assert without(rows, ids.limit(0), "k").count() == 1001


def brute_links(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in sets}


def near_texts(rng, n_groups=12, size=6, words=90):
    voc = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(n_groups):
        base = [rng.choice(voc) for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(voc)
            texts.append(" ".join(own))
    return texts


def test_near_copies_match_brute_force(spark):
    rng = random.Random(6)
    texts = near_texts(rng)
    texts += [texts[0]] * 40 + [texts[0].upper() + "\n"] + [None, "", " \t", "one", "One", "one two", "a b c d e", "a b c d e f"] + ["x " * 30000, "x " * 29999]
    rows = list(enumerate(texts, start=10))
    want_links, want_root = brute_links(rows)
    got = {r["doc_id"]: r for r in jaccard_join.near_copies(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    missed = sum(want_links[i] - got[i]["n_links"] for i, _ in rows)
    assert all(got[i]["n_links"] <= want_links[i] for i, _ in rows)
    assert missed <= 0.02 * sum(want_links.values())
    assert sum(got[i]["class_id"] == want_root[i] for i, _ in rows) >= 0.98 * len(rows)


def test_a_large_group_of_near_copies_is_tiled(spark):
    rng = random.Random(7)
    rows = list(enumerate(near_texts(rng, 1, 400, 200)))
    want, _ = brute_links(rows)
    got = {r["doc_id"]: r for r in jaccard_join.near_copies(docs_of(spark, rows)).collect()}
    assert {r["class_id"] for r in got.values()} == {0}
    assert {i: r["n_links"] for i, r in got.items()} == want


def test_near_copies_of_odd_tables(spark):
    assert jaccard_join.near_copies(docs_of(spark, [])).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (5, None), (6, "")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_links"]) for r in jaccard_join.near_copies(docs_of(spark, rows)).collect())
    assert got == [(False, 1, 2), (False, 1, 2), (False, 5, 0), (False, 6, 0), (True, 0, 0), (True, 0, 2)]
    assert jaccard_join.depth_for(0.98) == 7 and jaccard_join.depth_for(0.0) == jaccard_join.DEPTH


def brute_edits(item, region):
    prev = [0] * (len(region) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(region, 1):
            cur.append(min(prev[j - 1] + (a != b), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_walks_of_many_windows_are_those_of_each():
    """Keys made in blocks from one mixed word a step are those of plain walks, whatever block a window falls into."""
    words = decontaminate.mix(np.arange(40_000, dtype=np.uint64) % np.uint64(700))
    for size in (3, 8, 32):
        w, step = decontaminate.width(size), decontaminate.stride(size)
        starts = np.arange(0, len(words) - w + 1, step)
        keys = decontaminate.window_keys(words, starts, size)
        salts = decontaminate.mix(np.arange(len(keys), dtype=np.uint64) + np.uint64(size << 20)).tolist()
        for i in (0, 1, decontaminate.AT_ONCE - 1, decontaminate.AT_ONCE, len(starts) - 1):
            if i >= len(starts):
                continue
            plain = []
            for seed, samples in decontaminate._plan(w):
                own = decontaminate.mix(words[starts[i] : starts[i] + w] ^ np.uint64(seed)).tolist()
                factors = (decontaminate.mix(np.arange(3 * w, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)).tolist()
                at, copied = 0, []
                for j in range(2 * w):
                    symbol = own[at] if at < w else 0
                    copied.append(symbol * factors[j])
                    at += symbol // (decontaminate.AT_ONCE << j) % 2
                whole = sum(x * f for x, f in zip(own, factors[2 * w :], strict=True)) if w <= 4 else 0
                plain += [whole + sum(copied[j] for j in places) for places in samples]
            assert keys[:, i].tolist() == [(a + b) % (1 << 64) for a, b in zip(plain, salts, strict=True)]
        assert keys[:, :0].shape == decontaminate.window_keys(words, starts[:0], size).shape
    windows = decontaminate.mix(np.arange(12_000, dtype=np.uint64))
    windows[::4] = windows[0]  # windows of one first word: no key of a whole window is shared by others
    assert len(np.unique(decontaminate.window_keys(windows, np.arange(0, 12_000, 4), 4))) == 3000


def test_edit_distance_is_exact():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        edits, first, end = decontaminate.best_match(np.array([a + [9]]), np.array([len(a)]), np.array([b + [8, 8]]), np.array([len(b)]))
        assert edits[0] == brute_edits(a, b)
        assert brute_edits(a, b[first[0] : end[0]]) == edits[0]


def edited(rng, words, share, voc):
    words = list(words)
    for _ in range(int(len(words) * share)):
        p = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[p] = rng.choice(voc)
        elif kind == 1:
            words.insert(p, rng.choice(voc))
        elif len(words) > 2:
            del words[p]
    return words


def test_passages_are_found_with_edits(spark):
    rng = random.Random(9)
    voc = [f"v{k}" for k in range(800)]
    items = [(k, [rng.choice(voc) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 5, 6, 9, 13, 14, 20, 27, 28, 40, 59, 70, 150] * 4)]
    rows, share = [], {}
    for k, (item, words) in enumerate(items * 2):
        share[(k, item)] = rng.choice([0, 0.05, 0.1, 0.2])
        noise = [[rng.choice(voc) for _ in range(rng.randrange(90))] for _ in range(2)]
        rows.append((k, " ".join(noise[0] + edited(rng, words, share[(k, item)], voc) + noise[1]).upper()))
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (5002, rows[40][1]), (5002, rows[40][1])]
    table = spark.createDataFrame([(i, " ".join(w) + ".", "clash") for i, w in items] + [(900, None, ""), (901, " ", "")], "item_id bigint, text string, key string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_items(docs_of(spark, rows), table).collect()}
    words = {i: t.lower().split() for i, t in rows if t}
    truth = {(d, i): brute_edits(w, t) for d, t in words.items() for i, w in items}
    truth = {k: n for k, n in truth.items() if n <= 0.2 * len(items[k[1]][1]) + 1e-9}
    assert all(k in truth and got[k]["edits"] >= truth[k] for k in got)
    exact = {k for k, n in truth.items() if n == 0}
    assert exact <= set(got)
    assert len(set(got) & set(truth)) >= 0.9 * len(truth)
    assert decontaminate.find_items(docs_of(spark, []), table).count() == 0
    assert decontaminate.find_items(docs_of(spark, rows), table.limit(0)).count() == 0


def test_top_k_of_like_vectors_in_many_runs(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("TILE_BLOCKS", 4), ("TILE_QUERIES", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(7)
    middle = rng.normal(0, 1, (9, 12))
    rows = [(i, [float(x) for x in middle[i % 9] + rng.normal(0, 0.05, 12)]) for i in range(900)] + [(None, [0.4] * 12), (50, [0.2] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()]
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert len(got) == 5 * 19 and set(got) == brute_top(ints, [(i, v) for i, v in ints if i is not None and i % 50 == 0], 5)  # id 50 is two queries


def test_share_of_scored_pairs_on_like_vectors(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(0, 1, (40, 32))
    m = np.floor(256 * (middle[rng.integers(40, size=4000)] + rng.normal(0, 0.1, (4000, 32)))).astype(np.int64)
    near = topk.nearest_centre(m.astype(float), 256 * middle)
    order = np.argsort(near, kind="stable")
    blocks = [m[order[k : k + 32]] for k in range(0, 4000, 32)]
    top, low = np.array([b.max(0) for b in blocks]), np.array([b.min(0) for b in blocks])
    q = m[::50]
    kth = np.sort(q @ m.T, 1)[:, -6]
    assert (topk.bounds(q, top.astype(float), low.astype(float)) >= kth[:, None]).mean() < 0.5
