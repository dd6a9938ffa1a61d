"""Shapes of plans that decide what a query costs on large tables, and the results beside them."""

from __future__ import annotations

from cloakframe.operators import arbitrate, mask, registry, score, sweep
from cloakframe.schema import SPAN_T

GOLD = "doc_id bigint, start int, `end` int, type string, should_redact boolean"
PRED = "doc_id bigint, start int, `end` int, type string, score double"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sweep_matches_kinds_of_places(spark):
    """Places that hold the same are counted, and matched once for all: the folds stand above a grouping by what is held."""
    gold = spark.createDataFrame([(d, 0, 5, "PERSON", True) for d in range(50)] + [(7, 9, 12, "EMAIL", False)], GOLD)
    pred = spark.createDataFrame(
        [(d, 0, 5, "PERSON", 0.41 + d / 100) for d in range(40)] + [(7, 9, 12, "EMAIL", None), (60, 1, 2, "PHONE", float("nan"))], PRED)
    docs = spark.createDataFrame([(d,) for d in range(61)], "doc_id bigint")
    out = score.threshold_sweep(docs, gold, pred, (0.6, 0.4, 0.5))
    assert "Aggregate [gold#" in plan(out)
    rows = {r["threshold"]: r for r in out.collect()}
    for t, hits in ((0.4, 40), (0.5, 31), (0.6, 21)):
        r = rows[t]
        assert (r["tp"], r["fp"], r["fn"], r["redactable_fn"], r["pii_free_flagged"]) == (hits, 1, 51 - hits, 50 - hits, 1)


def test_runs_of_short_texts_stay_where_they_lie(spark):
    """Rows dealt by document are not exchanged for their runs: block 0 meets nothing that is carried."""
    spans = spark.createDataFrame([(d, s, s + 7, "PERSON") for d in range(40) for s in range(0, 50, 5)] + [(3, 90, 9000, "EMAIL"), (3, 8000, 8005, "EMAIL")],
                                  "doc_id bigint, start int, `end` int, type string")
    runs = sweep.overlap_runs(sweep.spread(spans, "doc_id"))
    first = runs._jdf.queryExecution().sparkPlan().children().apply(0).toString()
    assert "Join" not in first
    assert {(r.doc_id, r.start): r.run for r in runs.filter("doc_id = 3 AND start >= 90").collect()} == {(3, 90): 90, (3, 8000): 90}
    assert runs.filter("start < 90").count() == 400 and runs.filter("start < 90 AND run = 0").count() == 400


def test_tokens_read_their_spans_once(spark):
    """The numbers and their sums over earlier blocks read one exchange of the spans."""
    spans = spark.createDataFrame([(d, s, s + 3, "EMAIL", f"v{s % 4}") for d in range(5) for s in range(0, 40, 4)],
                                  "doc_id bigint, start int, `end` int, type string, text string")
    out = mask.allocate_tokens(spans)
    assert plan(out).count("RepartitionByExpression [doc_id") == 2 and out.count() == 50
    assert plan(out).count("Window") >= 2


def test_states_of_the_switches_share_their_scans(spark):
    """Each detector runs once for all states, and each state has the spans, engines and warnings that it has alone."""
    texts = ["mail a@x.org, card 4111 1111 1111 1111", "nothing", "联系人：王小明，电话 13812345678", "gone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def word(texts):
        if "gone" in texts:
            raise ValueError("gone")
        return [[{"start": 0, "end": 2, "type": "PERSON", "text": t[:2]}] for t in texts]

    def lost(_):
        raise KeyError("plan")

    shaky, broken = registry.Detector(registry.SEMANTIC, "word", batch=word), registry.Detector(registry.GENERAL_PII, "lost", run=lost)
    states = {}
    for name, plugins, extraction in (("all", [shaky, broken], True), ("rules", [], False), ("one", [shaky], False)):
        reg = registry.Registry()
        for p in plugins:
            reg.register(p, enabled=True)
        reg.set_enabled(registry.CHINESE_IE, extraction)
        states[name] = (reg, None)
    together = registry.detected_each(docs, states)
    assert plan(together).count("pythonUDF0#") and plan(together).count("ArrowEvalPython") == 1 and "Union" not in plan(together)
    columns = ("doc_id", "text", "spans", "engines", "warnings")
    for name, (reg, slots) in states.items():
        alone = registry.detected(docs, reg, slots).select(*columns).orderBy("doc_id").collect()
        assert together.filter(f"state = '{name}'").select(*columns).orderBy("doc_id").collect() == alone
    assert sum(len(r.spans) for r in together.collect()) > 6


def test_compatible_overlaps_are_found_among_pieces(spark):
    """One row of each span, not its two boundary events, is sorted by family, and one running value of each slot is kept."""
    gold = [(1, 0, 5, "PERSON", True), (1, 10, 15, "EMAIL", True), (1, 20, 25, "CN_NAME", True), (2, 4090, 4100, "PERSON", False), (3, 3, 3, "PERSON", True)]
    pred = [(1, 4, 8, "CN_NAME", 0.5), (1, 15, 18, "EMAIL", 0.5), (1, 8, 10, "EMAIL", 0.5), (1, 19, 30, "PHONE", 0.5), (2, 4096, 4098, "PERSON", 0.5), (3, 0, 9, "PERSON", 0.5)]
    out = score.score_layered(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED))
    lines = plan(out).splitlines()
    family = [k for k, line in enumerate(lines) if "Window" in line and "_family" in line]
    events = [k for k, line in enumerate(lines) if "Generate" in line and "_d" not in line and "named_struct(at" in line]
    assert family and events and max(events) < min(family)
    r = out.collect()[0]
    assert (r.tp, r.fp, r.fn, r.relaxed_recall) == (0, 6, 5, 0.4)


def test_masking_does_what_is_read(spark):
    """One pass merges and levels, one makes tokens, one judges and masks; the vault is made for those who read it. All sizes number alike."""
    span = lambda s, e, t, text, ord_: (s, e, t, text, 0.5, ["rules"], False, None, None, ord_)
    body = "".join(chr(97 + k % 7) for k in range(2400))
    make = lambda places, types: [span(s, s + w, types[k % len(types)], body[s : s + w], k) for k, (s, w) in enumerate(places)]
    rows = [
        (0, body, []),
        (1, body, make([(30, 3), (0, 4), (10, 5)], ["EMAIL", "PERSON", "PHONE"])),
        (2, body, make([(0, 3), (7, 3), (20, 2), (14, 3)], ["EMAIL"])),
        (3, body, make([(0, 3), (0, 3), (5, 6), (8, 6), (21, 2)], ["EMAIL"])),
        (4, body, make([(k * 8, 1 + k % 5) for k in range(299, -1, -1)], ["EMAIL", "PERSON"])),
    ]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, spans array<{SPAN_T}>").repartition(2)
    out = mask.mask_spans(arbitrate.arbitrate(docs))
    assert plan(out.select("doc_id", "masked")).count("Generate explode") == 3
    assert "named_struct(token" not in plan(out.select("doc_id", "masked")) and "named_struct(token" in plan(out.select("vault"))
    for r in out.collect():
        known, wanted = {}, []
        for x in r["spans"]:
            values = known.setdefault(x.type, {})
            wanted.append((x.start, x.end, values.setdefault(x.text, len(values) + 1)))
        assert r.status == "ok" and [(x.start, x.end, int(x.token.split("_")[-2])) for x in r["items"]] == wanted
        assert [v.token for v in r.vault] == list(dict.fromkeys(x.token for x in r["items"]))
        masked, at = "", 0
        for x in r["items"]:
            masked, at = masked + body[at : x.start] + x.token, x.end
        assert r.masked == masked + body[at:]
        assert len(wanted) == [0, 3, 4, 3, 300][r.doc_id]
