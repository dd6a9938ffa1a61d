"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import passing, stored


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours. Written out, so that the join with it can be split at hot nodes."""
    return stored(links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))


def _round(now: DataFrame) -> DataFrame:
    """The links after a large and a small star."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = stored(both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
    small = large.join(_least(large), "u").select(F.explode(F.array(
        F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
    return small.filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every end of a link: the smallest id it is connected with. Ids are longs.

    The rounds grow with the logarithm of the longest path; each writes its links, drops its lineage and deletes what it wrote on the way. Minima are
    aggregated before the shuffle, so a node with very many links is no hot group, and no component is ever collected.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    with passing(edges.sparkSession):
        now = stored(ends.filter("u <> v").distinct())
        mark = _mark(now)
        while True:
            with passing(edges.sparkSession):
                now = stored(_round(now), keep=True)
            seen, mark = mark, _mark(now)
            if mark == seen:
                break
        now = stored(now, keep=True)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
