"""URL filter, chat formatting and mixing: brute force, round trips, defined results of odd input."""

import hashlib
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.llm import chat_format, mixing, queries, url_filter

PAGES = "page_id bigint, url string, host string, __w0 string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def test_url_parts_rules_and_list(spark):
    urls = [None, "", "no scheme", "http://", "http://A.ORG", "HTTP://x.example.org/es/1", "https://example.org/en/12?u=1#f",
            "http://notexample.org/es/", "https://fr.com/fr/", "http://com/de/x", "https://é.Com/de/", "a://b://c/d", "http://net/a\nb/c?q",
            "https://www.net/a/b/?utm_source=1&b=2&a=1", "http://NET/a/b?a=1&b=2&ref=z#x", "http://net/a/b?a=1", "http://net/A/b?a=1&b=2"]
    rows = [(k, u, "clash", "clash") for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, PAGES)
    listed = spark.createDataFrame([("http://net/a/b?b=2&a=1",), (None,), ("nothing",), ("http://x.example.org/es/1",)], "u string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed).collect()}
    assert url_filter.judge_urls(pages, listed).count() == len(rows)
    for k, u in enumerate(urls):
        assert (got[k]["host"], got[k]["path"]) == brute_parts(u), u
    verdicts = {u: (got[k]["rule"], got[k]["verdict"]) for k, u in enumerate(urls)}
    assert verdicts[None] == (None, "allow")
    assert verdicts["http://A.ORG"] == (None, "allow")  # its path does not start with /
    assert verdicts["HTTP://x.example.org/es/1"] == ("example.org/es/", "block")
    assert verdicts["https://example.org/en/12?u=1#f"] == ("example.org/en/1", "block")
    assert verdicts["http://notexample.org/es/"] == ("org/", "allow")
    assert verdicts["https://fr.com/fr/"] == ("com/fr/", "allow")
    assert verdicts["https://é.Com/de/"] == ("com/de/", "block")
    assert verdicts["https://www.net/a/b/?utm_source=1&b=2&a=1"] == (None, "block")
    assert verdicts["http://NET/a/b?a=1&b=2&ref=z#x"] == (None, "block")
    assert verdicts["http://net/a/b?a=1"] == verdicts["http://net/A/b?a=1&b=2"] == (None, "allow")


def test_url_filter_empty_sides_and_false_hits(spark):
    none, pages = spark.createDataFrame([], "u string"), spark.createDataFrame([(1, "http://a.net/x")], "page_id bigint, url string")
    assert url_filter.judge_urls(pages, none).first()["verdict"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0
    # a full filter passes everything; the exact join still decides
    urls = spark.range(400_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), F.col("id")).alias("url"))
    got = url_filter.judge_urls(urls, urls.filter("page_id % 2 = 0").select("url"))
    assert got.filter("(page_id % 2 = 0) <> (verdict = 'block')").count() == 0
    assert got.filter("maybe_listed AND NOT listed").count() < 20_000
    assert got.filter("listed AND NOT maybe_listed").count() == 0


RECORDS = {
    '{"prompt":"p","completion":"c"}': [("user", "p"), ("assistant", "c")],
    '{"completion":null,"prompt":"p"}': [("user", "p"), ("assistant", "")],
    '{"response":"c","system":"s","prompt":"p"}': [("system", "s"), ("user", "p"), ("assistant", "c")],
    '{"instruction":"i","input":"x","output":"o"}': [("user", "i"), ("user", "x"), ("assistant", "o")],
    '{"instruction":"i","output":"o"}': [("user", "i"), ("assistant", "o")],
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}': [("user", "a"), ("assistant", "b")],
    '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': [("user", "a"), ("assistant", "b")],
    '{"data":{"question":"q","answer":"a"}}': [("user", "q"), ("assistant", "a")],
    '{"role":"user","text":"t"}': [("user", "t")],
    '{"role":null,"text":"t"}': [("", "t")],
    '{"prompt":{"deep":"p"},"completion":"c"}': None,
    '{"unknown":1}': None,
    "not json": None,
    None: None,
}


def test_layouts_are_chosen_by_fingerprint(spark):
    df = spark.createDataFrame([(k, r, "clash") for k, r in enumerate(RECORDS)], "id int, record string, turns string")
    got = {r["id"]: r for r in chat_format.canonical_turns(df).collect()}
    for k, want in enumerate(RECORDS.values()):
        have = got[k]["turns"]
        assert (None if have is None else [(t["role"], t["text"]) for t in have]) == want, list(RECORDS)[k]
        assert (got[k]["layout"] is None) == (want is None)


TEXTS = st.lists(st.sampled_from([*"\\#<>/shlc: \nturné", "</turn>", "###", "### assistant: "]), max_size=30).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", "sys:tem", "", None]), st.one_of(st.none(), TEXTS)), min_size=1, max_size=60))
def test_formatting_reads_back(spark, turns):
    df = spark.createDataFrame([(c, k, r, t) for k, (c, r, t) in enumerate(turns)], "conv_id int, turn bigint, role string, text string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    for c in {t[0] for t in turns}:
        want = [(r or "", t or "") for cc, r, t in turns if cc == c]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert back[c]["learnt"] == "".join(t for r, t in want if r == "assistant")
        assert back[c]["formatted"].count("</turn>") == len(want)


def test_long_conversation_ties_and_empty_table(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), (F.col("id") % 1500).alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat_format.read_back(chat_format.format_turns(rows)).first()
    want = [str(x) for t in range(1500) for x in sorted((str(t), str(t + 1500)))]
    assert [t["text"] for t in got["turns"]] == want and got["learnt"] == "".join(want)
    assert chat_format.format_turns(rows.limit(0)).count() == 0


def test_planted_conversation(spark, data):
    row = queries.QUERIES["op6_chat_format"](spark, data).filter("conv_id = -7").first()
    text = queries.PLANTED
    assert (row["n_turns"], row["loss_chars"]) == (2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def brute_copies(rate, u):
    k, total, term = 0, 0.0, math.exp(-rate)
    while True:
        total += term
        if total >= u or k > 200:
            return k
        k += 1
        term *= rate / k


def test_replication_inverts_poisson(spark):
    rng = random.Random(4)
    rows = [(i, f"t{i}", rng.choice(["hot", "hot", "b", "c", None]), "clash", 7) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __k0 string, copy_no int")
    weights = {"hot": 0.2, "b": 0.3}
    out = mixing.replicate(docs, weights, seed=9).collect()
    assert set(out[0].asDict()) == set(docs.columns)
    sizes = Counter(r[2] if r[2] in weights else "*" for r in rows)
    rates = mixing.rates(dict(sizes), weights)
    got = Counter(r["doc_id"] for r in out)
    for i, _, s, *_ in rows:
        u = int(hashlib.md5(f"9:{i}:{hashlib.md5(f't{i}'.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert got[i] == brute_copies(rates[s if s in weights else "*"], u)
    assert {(r["doc_id"], r["copy_no"]) for r in out} == {(i, c + 1) for i, n in got.items() for c in range(n)}
    share = Counter(r["source"] if r["source"] in weights else "*" for r in out)
    for g, w in {**weights, "*": 0.5}.items():
        assert abs(share[g] / len(out) - w) < 0.03
    ids = [r["doc_id"] for r in out]
    assert abs(sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids) - 0.5) < 0.05  # no order is left


def test_replication_of_odd_input(spark):
    docs = spark.createDataFrame([(None, None, None), (None, None, None), (1, "", "a"), (1, "", "a")], "doc_id bigint, text string, source string")
    out = mixing.replicate(docs, {"a": 0.5}, growth=4.0)
    assert out.filter("doc_id = 1").count() % 2 == 0
    assert mixing.replicate(docs.limit(0), {"a": 0.5}).count() == 0
    assert mixing.replicate(docs, {"a": 0.0}).filter("source = 'a'").count() == 0
    assert mixing.thresholds(0.0) == [1.0] and mixing.rates({}, {"a": 1.0}) == {}
    with pytest.raises(ValueError):
        mixing.rates({"a": 1}, {"a": 1.5})
