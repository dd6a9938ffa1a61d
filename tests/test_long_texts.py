"""No length limit, and time that grows with the length of a text, not with its square."""

import time

from cloakframe.operators import mask
from cloakframe.sources.texts import intake_guard

LINE = "Ticket {0:06d}: write to user{0}@example.org or call +49 170 {0:07d} about the order of today, thanks a lot. "


def long_text(chars: int) -> str:
    return "".join(LINE.format(k) for k in range(chars // len(LINE.format(0)) + 1))[:chars]


def test_two_million_characters_are_masked_and_restored(spark):
    text = long_text(2_000_000)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    accepted, rejected = intake_guard(docs)
    assert rejected.count() == 0
    done = mask.protect(accepted).select("doc_id", "status", "masked", "vault", "text").cache()
    row = done.first()
    assert row["status"] == "ok" and len(row["vault"]) > 30_000
    assert "@example.org" not in row["masked"]
    back = mask.restore_columns(done, "masked", "vault").select("restored", "replaced", "unknown", "missing").first()
    assert back["restored"] == text and back["replaced"] >= len(row["vault"])
    assert back["unknown"] == [] and back["missing"] == []


def test_time_grows_with_the_length(spark):
    def seconds(chars: int) -> float:
        docs = spark.createDataFrame([(1, long_text(chars))], "doc_id bigint, text string")
        plan = mask.protect(docs).select("masked")
        best = 1e9
        for _ in range(3):
            begin = time.perf_counter()
            plan.collect()
            best = min(best, time.perf_counter() - begin)
        return best

    seconds(131_072)  # compiles the plan
    short, long = seconds(131_072), seconds(524_288)
    assert long <= 5 * short + 1.0, (short, long)


def test_limit_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, None), (4, " ")], "doc_id bigint, text string")
    ok, bad = intake_guard(docs, limit=4)
    assert [r["doc_id"] for r in ok.collect()] == [1]
    assert {r["doc_id"]: r["reason"] for r in bad.collect()} == {2: "too_long", 3: "null_text", 4: "blank_text"}
