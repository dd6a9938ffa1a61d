import random

import pytest

from cloakframe import fixed
from cloakframe.operators import corpus, intervals, predictions, score
from cloakframe.schema import compatible_pairs


def brute_resolve(text, items):
    """items: (snippet, hint); returns start or None, by the written rule."""
    out, taken, cursor = [], [], 0
    for snippet, hint in items:
        occ = [i for i in range(len(text)) if text.startswith(snippet, i)]
        free = [o for o in occ if all(o + len(snippet) <= a or b <= o for a, b in taken)]
        after = [o for o in free if o >= cursor]
        at = None
        if len(occ) == 1:
            at = free[0] if free else None
        elif occ and hint:
            place = text.find(hint) + hint.find(snippet) if hint in text and snippet in hint else None
            if place in free:
                at = place
            else:
                pool = after or free
                scores = [sum(c in text[max(0, o - 12) : o + len(snippet) + 12] for c in hint) for o in pool]
                if pool and max(scores) >= 2:
                    at = pool[scores.index(max(scores))]
        elif after:
            at = after[0]
        if at is not None:
            taken.append((at, at + len(snippet)))
            cursor = at + len(snippet)
        out.append(at)
    return out


def test_resolve_spans_equals_brute_force(spark):
    rnd, docs, cands, want = random.Random(3), [], [], {}
    for doc in range(60):
        text = "".join(rnd.choice("abc ") for _ in range(40)) + "😀ab"
        items = []
        for seq in range(rnd.randint(1, 6)):
            i = rnd.randint(0, 36)
            snippet = text[i : i + rnd.randint(1, 3)].strip()
            hint = rnd.choice([None, None, text[max(0, i - 2) : i + 5], "zz", "abz"])
            if snippet:
                items.append((snippet, hint))
                cands.append((doc, len(items) - 1, "PERSON", snippet, hint))
        docs.append((doc, text))
        want |= {(doc, n): at for n, at in enumerate(brute_resolve(text, items))}
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    c = spark.createDataFrame(cands, "doc_id bigint, seq int, type string, text string, context_hint string")
    got = {(r.doc_id, r.seq): r.start for r in predictions.resolve_spans(c, d).collect()}
    assert got == want


def brute_chunks(text, size=3000, overlap=200):
    if len(text) <= 3500:
        return [(0, len(text))]
    out, start = [], 0
    while True:
        end = start + size
        if end >= len(text):
            return [*out, (start, len(text))]
        low = max(start + 100, end - overlap)
        cut = next((text.rfind(m, low, end) + len(m) for m in predictions.DELIMITERS if text.rfind(m, low, end) >= 0), end)
        out.append((start, cut))
        start = max(start + 1, cut - overlap)


def test_chunks_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = ["x" * 9000, "ab. " * 2000, "short", "".join(rnd.choice("abcde。\n.!;") for _ in range(12000)), "😀" * 3600]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in predictions.chunk_texts(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
        assert texts[r.doc_id][r.start : r.end] == r.text
    assert {k: sorted(v) for k, v in got.items()} == {i: brute_chunks(t) for i, t in enumerate(texts)}


def compat(a, b):
    return a == b or (a, b) in set(compatible_pairs())


def test_match_and_chars_equal_brute_force(spark):
    rnd, gold, pred = random.Random(11), [], []
    types = ["PERSON", "CN_NAME", "SECRET", "PASSWORD", "EMAIL"]
    for doc in range(40):
        for side in (gold, pred):
            spans = {(s := rnd.randint(0, 6), s + rnd.randint(1, 2), rnd.choice(types)) for _ in range(rnd.randint(0, 12))}
            side += [(doc, a, b, t, o) for o, (a, b, t) in enumerate(sorted(spans))]
    want, leak, over = {"TP": 0, "FP": 0, "FN": 0}, 0, 0
    for doc in range(40):
        g, p = [x for x in gold if x[0] == doc], [x for x in pred if x[0] == doc]
        used = set()
        pc, gc = {i for x in p for i in range(x[1], x[2])}, {i for x in g for i in range(x[1], x[2])}
        for x in g:
            hit = next((i for i, y in enumerate(p) if i not in used and y[1:3] == x[1:3] and compat(y[3], x[3])), None)
            if hit is None:
                want["FN"] += 1
                leak += sum(i not in pc for i in range(x[1], x[2]))
            else:
                used.add(hit)
                want["TP"] += 1
        for i, y in enumerate(p):
            if i not in used:
                want["FP"] += 1
                over += sum(c not in gc for c in range(y[1], y[2]))
    ddl = "doc_id bigint, start int, `end` int, type string, ord int"
    g, p = spark.createDataFrame(gold, ddl), spark.createDataFrame(pred, ddl)
    m = score.match_spans(g, p).cache()
    assert {r.outcome: r["count"] for r in m.groupBy("outcome").count().collect()} == want
    sums = score.char_leakage(m).groupBy().sum("leaked_chars", "overredacted_chars").first()
    assert tuple(sums) == (leak, over)


def test_overlap_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    make = lambda: [(rnd.randint(0, 2), s := rnd.randint(0, 3000), s + rnd.randint(1, 900)) for _ in range(60)]
    a, b = make(), make()
    ddl = "doc_id bigint, start int, `end` int"
    got = intervals.overlap_pairs(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl))
    rows = sorted((r.doc_id, r.start, r.end, r.r_start, r.r_end) for r in got.collect())
    assert rows == sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_prf_empty_cases(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (0, 2, 0), (2, 2, 0)], "tp int, fp int, fn int")
    got = [(r.precision, r.recall, r.f1) for r in score.prf(rows).collect()]
    assert got == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.5, 1.0, 0.666667)]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_nearest_rank(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([-3.5, 0.0, 1e-9, 2.25, rnd.random() * 1000, -rnd.random()]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.fraction: r.percentile for r in score.nearest_rank(df, "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got == {f: sorted(values)[round(f * (n - 1))] for f in (0.0, 0.5, 0.95, 1.0)}


def test_passages_equal_contains(spark):
    docs = [(1, "one two three four five"), (2, "xx two three four"), (3, "short ab"), (4, "two  three")]
    items = [(1, "two three four"), (2, "e two three four f"), (3, "ab"), (4, "wo  th"), (5, "two")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    p = spark.createDataFrame(items, "pid int, fragment string")
    got = {(r.doc_id, r.pid, r.start) for r in corpus.find_passages(d, p).collect()}
    assert got == {(i, k, t.index(f)) for i, t in docs for k, f in items if f in t}


def test_generated_and_labels(spark):
    raw = [(1, "<think>[]</think>```json\n[{\"original_text\": \"bob\", \"privacy_type\": \"Name\"},]```", "hi bob"),
           (2, "{\"text\":\"al\",\"type\":\"email\",} {bad}", "al"), (3, "[{\"text\":\"nope\"}]", "zz"), (4, "", "zz")]
    rows = predictions.parse_generated(spark.createDataFrame(raw, "doc_id bigint, raw string, text string")).collect()
    assert [(r.doc_id, r.type, r.text) for r in rows] == [(1, "PERSON", "bob"), (2, "EMAIL", "al")]
    assert len(fixed.SPAN_LABELS) == 33 and len(fixed.SEMANTIC_LABELS) == 49


def test_bioes(spark):
    labels = "O B-A I-A O I-A E-A E-A S-B B-C E-D I-C B-C".split()
    tokens = spark.createDataFrame([(1, i, i * 2, i * 2 + 2, x) for i, x in enumerate(labels)], "doc_id bigint, tok int, start int, `end` int, label string")
    got = sorted((r.start, r.end, r.label) for r in predictions.decode_bioes(tokens).collect())
    assert got == [(2, 12, "A"), (12, 14, "A"), (14, 16, "B"), (16, 22, "C"), (18, 20, "D"), (22, 24, "C")]


def test_surfaces_in_a_row_and_by_keys_agree(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda: " ".join(rnd.choice(["a", "ab", "Abc", "bc d", "x", ""]) for _ in range(rnd.randint(1, 3)))
    gold = [(d, "PERSON", word(), rnd.random() < 0.6, rnd.choice(["quasi_identifier", "explicit"])) for d in range(30) for _ in range(rnd.randint(0, 6))]
    surf = [(d, i, word()) for d in range(30) for i in range(rnd.randint(0, 6))]
    args = (spark.createDataFrame(gold, "doc_id bigint, type string, text string, should_redact boolean, context_class string"),
            spark.createDataFrame(surf, "doc_id bigint, sid bigint, surface string"))
    both = lambda: (sorted(map(str, score.score_surfaces(*args).collect())), sorted(map(str, score.category_recall(*args).collect())))
    in_row = both()
    for forms in (0, 3):  # all by keys; some by keys
        monkeypatch.setattr(score, "ROW_FORMS", forms)
        assert both() == in_row


def test_many_small_rows_are_dealt_to_many_parts(spark):
    from cloakframe.operators import corpus, mask, predictions
    from cloakframe.operators.sweep import PARTS

    tokens = spark.range(10).selectExpr("id AS doc_id", "1 AS tok", "0 AS start", "3 AS `end`", "'S-A' AS label")
    docs = spark.range(10).selectExpr("id AS doc_id", "'abc' AS text")
    spans = docs.selectExpr("doc_id", "0 AS start", "9 AS `end`", "text")
    for df in (predictions.decode_bioes(tokens), mask.stability_check(docs, docs), corpus.gold_integrity(docs, spans)):
        assert f", {PARTS}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_stability_counts_nulls_of_each_side(spark):
    from cloakframe.operators import mask

    a = spark.createDataFrame([(1, "X  y"), (1, None), (2, "q"), (None, "z")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "x y"), (1, None), (2, "r"), (None, "z")], "doc_id bigint, text string")
    assert {r.doc_id: r.differences for r in mask.stability_check(a, b).collect()} == {1: 2, 2: 2, None: 2}
