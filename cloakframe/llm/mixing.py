"""Mixing sources to target weights by Poisson replication. Built-in functions only.

Each document is written k times, k ~ Poisson(rate of its group), where rate = weight × rows out / rows of the
group. k inverts the distribution at a number hashed from seed, id and text, so a rerun, another partitioning or a lost
executor gives the same copies. Groups are the named sources and one group for all others (null too), so the rates
are as many as the weights plus one.

Defined results: a null id or text hashes as an empty one, so texts that share an id, or have none, are drawn one by one; rows that
repeat both id and text share k;
an empty table stays empty; a group without rows gives its weight to the others; weight 0 drops a group;
extra columns stay; an input column ``copy_no`` is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the output for each named source; the rest goes to all other sources together.
WEIGHTS = {"src0": 0.20, "src1": 0.08, "src2": 0.02}
SEED = 20240
#: Rows out for one row in.
GROWTH = 1.0


def _group(weights: dict[str, float], source: str) -> Column:
    names = list(weights)
    return F.when(F.col(source).isin(names), F.col(source)).otherwise(F.lit("*")) if names else F.lit("*")


def rates(sizes: dict[str, int], weights: dict[str, float], growth: float = GROWTH) -> dict[str, float]:
    """Mean copies per document of each group."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are shares of one")
    share = dict(weights) | {"*": max(0.0, 1.0 - sum(weights.values()))}
    there = {g: share[g] for g in share if sizes.get(g)}
    total, whole = sum(sizes.values()), sum(there.values())
    return {g: (w / whole * total * growth / sizes[g] if whole else 0.0) for g, w in there.items()}


def thresholds(rate: float) -> list[float]:
    """P(k <= 0), P(k <= 1), … up to where a double no longer tells them from one."""
    out, k, total = [], 0, 0.0
    while total < 1 - 1e-15 and k < 10 * rate + 60:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        out.append(min(total, 1.0))
        k += 1
    return out


def unit(seed: int, key: str, text: str) -> Column:
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), whole(key), F.lit(":"), F.md5(whole(text))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, growth: float = GROWTH,
              source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Copies of ``docs`` with ``copy_no`` (from 1), dealt to random places of random partitions."""
    weights = WEIGHTS if weights is None else weights
    group = _group(weights, source)
    sizes = {r[0]: r[1] for r in docs.groupBy(group.alias("g")).count().collect()}
    copies = F.lit(0)
    for name, rate in rates(sizes, weights, growth).items():
        steps = F.array(*[F.lit(t) for t in thresholds(rate)])
        copies = F.when(F.col("g") == name, F.size(F.filter(steps, lambda t: t < F.col("u")))).otherwise(copies)
    row = F.struct(*[F.col(c) for c in docs.columns if c != "copy_no"]).alias("row")
    out = docs.select(row, F.xxhash64(F.lit(seed), key, text).alias("own"), unit(seed, key, text).alias("u"), group.alias("g"))
    out = out.select("row", "own", copies.alias("k")).filter("k > 0")
    out = out.select("row", "own", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy_no"))
    out = out.withColumn("place", F.xxhash64("own", "copy_no"))
    return out.repartition("place").sortWithinPartitions("place").select("row.*", "copy_no")
