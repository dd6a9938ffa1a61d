"""Interval joins over spans, keyed by document and position block.

A span is listed under every block of positions it touches, so an overlap join is an
equi-join on (document, block) plus a condition. A pair is emitted only in the block
that holds the later of the two starts, hence once. Nothing is a cross product, and a
hot document spreads over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def _blocks(spans: DataFrame) -> DataFrame:
    first, last = f"floor(start / {BLOCK})", f"floor(greatest(end - 1, start) / {BLOCK})"
    return spans.filter("end > start").withColumn("_b", F.explode(F.expr(f"sequence({first}, {last})")))


def overlap_pairs(
    left: DataFrame, right: DataFrame, by: Sequence[str] = ("doc_id",), prefix: str = "r_"
) -> DataFrame:
    """All pairs of overlapping spans of the same document; right columns get a prefix."""
    renamed = right.select(*by, *[F.col(c).alias(prefix + c) for c in right.columns if c not in by])
    r = (
        renamed.filter(f"{prefix}end > {prefix}start")
        .withColumn(
            "_b",
            F.explode(
                F.expr(f"sequence(floor({prefix}start / {BLOCK}), floor(({prefix}end - 1) / {BLOCK}))")
            ),
        )
    )
    hit = F.expr(f"start < {prefix}end AND {prefix}start < end")
    home = F.expr(f"_b = floor(greatest(start, {prefix}start) / {BLOCK})")
    pairs = _blocks(left).join(r, [*by, "_b"]).filter(hit & home)
    return pairs.drop("_b")


def flag_overlaps(
    left: DataFrame, right: DataFrame, name: str, by: Sequence[str] = ("doc_id",), condition: str | None = None
) -> DataFrame:
    """Add a boolean column: does any right span (meeting ``condition``) overlap the left row?

    Left rows must be distinct and free of nulls. Pairs are reduced to distinct left rows before joining back.
    """
    keys = list(left.columns)
    pairs = overlap_pairs(left, right, by)
    if condition:
        pairs = pairs.filter(condition)
    hits = pairs.select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(hits, keys, "left").fillna(False, [name])
