"""Cases that an operator once left out: edits at their full share, rows without an id, ids that repeat."""

import random

import numpy as np

from cloakframe.llm import decontaminate, jaccard_join, stages
from cloakframe.llm.common import table

DOCS = "doc_id bigint, text string"
KINDS = ("replace", "insert", "delete", "mixed")


def edited(rng, words, kind, voc):
    """``words`` with a fifth of them edited, each at a place of its own."""
    words = list(words)
    for p in sorted(rng.sample(range(len(words)), len(words) // 5), reverse=True):
        this = rng.choice(KINDS[:3]) if kind == "mixed" else kind
        if this == "insert":
            words.insert(p, rng.choice(voc))
        else:
            words[p : p + 1] = [rng.choice(voc)] if this == "replace" else []
    return words


def test_passages_with_a_fifth_of_their_words_edited_are_found(spark):
    rng = random.Random(11)
    voc = [f"v{k}" for k in range(800)]
    items, docs, of = [], [], {}
    for n in (5, 6, 7, 10, 14, 15, 20, 27, 28, 40, 55, 56, 70, 111, 112, 224):
        for kind in KINDS:
            for _ in range(20):
                k, words = len(items), [rng.choice(voc) for _ in range(n)]
                noise = [[rng.choice(voc) for _ in range(rng.randrange(60))] for _ in range(2)]
                items.append((k, " ".join(words)))
                docs.append((k, " ".join(noise[0] + edited(rng, words, kind, voc) + noise[1])))
                of[k] = (n, kind)
    got = decontaminate.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {r["doc_id"] for r in got.filter("doc_id = item_id").collect()}
    recall = {x: sum(of[k] == x for k in found) / 20 for x in set(of.values())}
    assert min(recall.values()) >= 0.9, sorted(x for x in recall.items() if x[1] < 0.9)


def test_near_copies_with_null_and_repeated_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    near = lambda t: t + " end"
    rows = [(7, a), (8, a), (None, a), (9, near(a)), (4, b), (None, b), (5, near(b)), (6, "one text"), (6, "other words"), (None, "lone"), (None, "lone")]
    got = jaccard_join.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    want = [(7, 7, 3), (8, 7, 3), (None, 7, 3), (9, 7, 3), (4, 4, 2), (None, 4, 2), (5, 4, 2), (6, 6, 0), (6, 6, 0), (None, None, 1), (None, None, 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_stages_decide_about_rows_without_an_id_or_with_a_repeated_one(spark, data):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = table(spark, data, "documents").select(columns)
    item = table(spark, data, "benchmark").first()["text"]
    rows = lambda *x: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in x], docs.schema)
    mine = [f"{x} " + " ".join(f"{x}{k}" for k in range(40)) for x in "pqrs"]
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.select("doc_id", "text").collect())
    odd = rows((None, "12 34 !"), (None, "56 78 !"), (3, "90 !"), (3, docs.first()["text"]))
    kept = stages.keep_languages(spark, stages.stored(docs.filter("doc_id <> 3").unionByName(odd)), data)
    assert kept.filter("text LIKE '%!' AND length(text) < 8").count() == 0 and kept.filter("doc_id = 3").count() == 1
    copies = rows((None, mine[0]), (7, mine[0]), (8, mine[0]), (None, mine[1]), (None, mine[1]), (5, mine[2]), (5, mine[3]))
    assert texts(stages.keep_one_of_each(spark, copies, data)) == sorted([(7, mine[0]), (0, mine[1]), (5, mine[2]), (5, mine[3])])
    leaks = rows((None, f"{mine[0]} {item}"), (5, f"{mine[1]} {item}"), (5, mine[2]), (None, mine[2]))
    assert texts(stages.drop_contaminated(spark, leaks, data)) == [(0, mine[2]), (5, mine[2])]


def test_passages_of_rows_without_an_id(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog tonight"), (2, " ".join(f"w{k}" for k in range(60)))]
    docs = [(None, f"before {items[0][1]} after"), (None, f"before {items[0][1]} after"), (None, f"{items[1][1]} more"), (None, "nothing"), (None, None), (7, items[0][1])]
    got = decontaminate.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(((r["doc_id"] or -1, r["item_id"], r["edits"], r["first_word"]) for r in got.collect())) == [(-1, 1, 0, 1), (-1, 2, 0, 0), (7, 1, 0, 0)]


def test_the_bitmap_grows_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 8)
    for n in (3, 5000):
        keys = spark.range(n).selectExpr("xxhash64(id) AS key")
        bits = decontaminate.key_bitmap(keys)
        held = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
        assert len(decontaminate.known_keys(bits, held)) == n and 16 * n <= 64 * len(bits) <= max(256, 32 * n)
        other = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2)
        assert len(decontaminate.known_keys(bits, other)) < 2000
