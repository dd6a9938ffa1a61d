"""URL verdicts: host rules first, then a list of URLs behind a blocked Bloom filter. Built-in functions only.

The filter has a fixed number of 512-bit blocks, so what is broadcast has a bound that does not depend on
the list: ``BLOCKS`` rows of nine longs, about 5 MB. A longer list only raises the share of false hits, all of
which the exact join removes.

Defined results: null URL or one without ``://`` has an empty host and path, meets no rule and is never listed
(verdict allow); repeated rows are judged one by one; an empty list lets all pass; extra columns stay, and input
columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path prefix); fixed values of the production rule set.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BLOCKS = 1 << 16
WORDS = 8
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty if the URL is null or has no ``://``."""
    rest = F.col("__rest")
    tail = F.expr("CASE WHEN instr(__url, '://') > 0 THEN substr(__url, instr(__url, '://') + 3) ELSE '' END")
    df = df.withColumn("__url", F.col(url).cast("string")).withColumn("__rest", tail)
    return df.withColumn("host", F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), *_AZ)).withColumn(
        "path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def canonical() -> Column:
    """One form for URLs of the same page, from the columns of ``with_parts``; null without a host.

    Scheme, ``www.``, fragment, final slashes, ``ref`` and ``utm_`` parameters go; the other parameters are sorted.
    """
    query = F.regexp_extract("__rest", r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(
        F.col("host") != "",
        F.concat(F.regexp_replace("host", r"^www\.", ""), F.regexp_replace("path", "/+$", ""), tail),
    )


def rule_column(rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits host and path; null where none fits."""
    rule = action = F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, action = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _block(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BLOCKS)).cast("int")


def _mask(url: str, word: int) -> Column:
    return F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64({url}, 1), {6 * word}) & 63 AS INT))")


def bloom_filter(listed: DataFrame, url: str = "canon") -> DataFrame:
    """Rows (block, w0 … w7): at most ``BLOCKS``, each with one bit per URL and word."""
    words = [F.bit_or(_mask(url, k)).alias(f"__w{k}") for k in range(WORDS)]
    return listed.groupBy(_block(url).alias("__block")).agg(*words)


def may_hold(rows: DataFrame, filter_: DataFrame, value: Column) -> DataFrame:
    """(row, hit): each row as a struct, and false where the filter rules its value out. The filter's fixed size lets it be broadcast."""
    own = rows.select(F.struct("*").alias("row"), value.alias("value")).withColumn("__block", F.coalesce(_block("value"), F.lit(-1)))
    probed = own.join(F.broadcast(filter_), "__block", "left")
    hit = F.col("value").isNotNull()
    for k in range(WORDS):
        hit = hit & (F.col(f"__w{k}").bitwiseAND(_mask("value", k)) == _mask("value", k))
    return probed.select("row", F.coalesce(hit, F.lit(False)).alias("hit"))


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, maybe_listed (the filter's word) and listed (the exact one).

    ``listed``: one column of URLs, in any form. Rules come first; a listed URL that no rule allows is blocked.
    """
    first = listed.columns[0]
    bad = with_parts(listed.select(F.col(first).alias("u")), "u").select(canonical().alias("canon")).filter("canon IS NOT NULL").distinct()
    rule, action = rule_column(rules)
    own = with_parts(pages.select(F.struct("*").alias("page"), F.col(url).alias("u")), "u")
    own = own.select("page", "host", "path", rule.alias("rule"), action.alias("action"), canonical().alias("canon"))
    probed = may_hold(own, bloom_filter(bad), F.col("canon")).select("row.*", F.col("hit").alias("maybe_listed"))
    clear = probed.filter("NOT maybe_listed").withColumn("listed", F.lit(False))
    doubt = probed.filter("maybe_listed").join(bad.withColumn("listed", F.lit(True)), "canon", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    new = {"host": "host", "path": "path", "rule": "rule", "maybe_listed": "maybe_listed", "listed": "listed"}
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    kept = [F.col("page")[c].alias(c) for c in pages.columns if c not in new and c != "verdict"]
    return clear.unionByName(doubt).select(*kept, *new, verdict)
