"""Sweeps over the boundaries of spans, cut into blocks of positions.

A span becomes two events, +1 where it starts and -1 where it ends. Spans are cut at the borders of blocks of ``BLOCK``
positions first, so a sweep is a running sum inside one (text, block): no text is ever one group, however
many spans it has, and nothing is joined. What a sweep measures is additive over the pieces of a span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cloakframe.functions.spans import q
from cloakframe.schema import _map, compatible_pairs

BLOCK = 4096
#: Parts that many small rows are dealt to, at least. Exchanged rows are packed tightly, and parts joined by their packed size would hold more
#: unpacked rows than a task has memory for.
PARTS = 192


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by ``by`` to at least ``PARTS`` parts; windows and groups by these columns (and more) need no further exchange."""
    return rows.repartition(max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def _families() -> tuple[dict[str, str], dict[str, int], dict[str, tuple[int, ...]]]:
    """Types tied by compatibility: the family of each, its slot inside the family, and the slots it is compatible with."""
    near: dict[str, set[str]] = {}
    for a, b in compatible_pairs():
        near.setdefault(a, {a}).add(b)
    family: dict[str, str] = {}
    for first in sorted(near):
        todo = [] if first in family else [first]
        while todo:
            t = todo.pop()
            if t not in family:
                family[t] = first
                todo += sorted(near[t])
    slot = {t: sorted(x for x in family if family[x] == family[t]).index(t) for t in family}
    return family, slot, {t: tuple(sorted(slot[x] for x in near[t])) for t in family}


FAMILY, SLOT, MATES = _families()
SLOTS = max(SLOT.values()) + 1


def blocks_of(start: str = "start", end: str = "end", block: int = BLOCK) -> Column:
    """The blocks that a span touches; an empty span touches that of its start."""
    return F.expr(f"sequence(floor({start} / {block}), floor(greatest({end} - 1, {start}) / {block}))")


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each piece of a span: ``_b`` (block)."""
    return rows.withColumn("_b", F.explode(blocks_of(block=block)))


def boundary_events(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Two rows for each piece of a span: ``_b`` (block), ``_at`` (position) and ``_d`` (+1 at its start, -1 at its end)."""
    cut = rows if "_b" in rows.columns else in_blocks(rows, block)
    ends = (f"array(named_struct('at', greatest(start, _b * {block}), 'd', 1), "
            f"named_struct('at', least(greatest(`end`, start), (_b + 1) * {block}), 'd', -1))")
    return cut.withColumn("_e", F.explode(F.expr(ends))).withColumn("_at", F.col("_e.at")).withColumn("_d", F.col("_e.d")).drop("_e")


def measured(events: DataFrame, by: Sequence[str], sides: dict[str, str]) -> DataFrame:
    """``events`` plus, for each named side (a condition on the rows), ``_in_<side>``.

    Summed over the events of a span, it gives the number of its characters that the spans of the side cover.
    """
    order = W.partitionBy(*by, "_b").orderBy("_at")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = events.withColumn("_gap", F.col("_at") - F.lag("_at").over(order))
    for name, condition in sides.items():
        out = out.withColumn(f"_open_{name}", F.sum(F.when(F.expr(condition), F.col("_d")).otherwise(0)).over(so_far))
    for name in sides:
        covered = F.when(F.lag(f"_open_{name}").over(order) > 0, F.col("_gap")).otherwise(0)
        out = out.withColumn(f"_len_{name}", covered)
    for name in sides:
        out = out.withColumn(f"_in_{name}", -F.col("_d") * F.sum(f"_len_{name}").over(so_far))
    return out.drop("_gap", *[f"_{p}_{name}" for p in ("open", "len") for name in sides])


def met_compatible(rows: DataFrame, by: Sequence[str], asks: str, asks_type: str, holds: str, holds_type: str) -> DataFrame:
    """``rows`` (pieces of spans, or their events) plus ``_met``: 1 on a row that meets ``asks`` if a span that meets ``holds`` and is of
    a compatible type overlaps its span in the row's block, else 0.

    Of the spans that start before the asking one ends, the greatest end of each slot is kept, inside each family of types: one of them
    overlaps if that end lies behind the asking span's start.
    """
    kind = f"if({asks}, {asks_type}, {holds_type})"
    family = F.expr(f"coalesce(element_at({_map(FAMILY)}, {kind}), {kind})")
    place = F.expr(f"if({asks}, `end`, start)")
    rank = F.expr(f"if({holds}, 1, 0)")  # a span that starts where another ends does not meet it
    order = W.partitionBy(*by, "_b", "_family").orderBy("_place", "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("_family", family).withColumn("_place", place).withColumn("_rank", rank)
    out = out.withColumn("_slot", F.expr(f"if({holds}, coalesce(element_at({_map(SLOT)}, {holds_type}), 0), -1)"))
    for k in range(SLOTS):
        out = out.withColumn(f"_reach{k}", F.max(F.when(F.col("_slot") == k, F.col("end"))).over(order))
    masks = {t: sum(1 << k for k in mates) for t, mates in MATES.items()}
    out = out.withColumn("_mask", F.expr(f"coalesce(element_at({_map(masks)}, {asks_type}), 1)"))
    behind = " OR ".join(f"((_mask & {1 << k}) <> 0 AND coalesce(_reach{k} > start, false))" for k in range(SLOTS))
    out = out.withColumn("_met", F.expr(f"if({asks} AND ({behind}), 1L, 0L)"))
    return out.drop("_family", "_place", "_rank", "_slot", "_mask", *[f"_reach{k}" for k in range(SLOTS)])


def carried(rows: DataFrame, by: Sequence[str], summary: Column, total: Column, every: DataFrame | None = None) -> DataFrame:
    """``rows`` plus ``_carry``: ``total`` of the blocks' ``summary`` over all earlier blocks (``_b``) of the same ``by``; null in the first.

    ``every``: the rows of all blocks, where ``rows`` are those of some.

    Only one small row for each block is ordered inside ``by``; the rows themselves stay where their block is.
    """
    parts = (rows if every is None else every).groupBy(*by, "_b").agg(summary.alias("_part"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    own = [f"_k{i}" for i in range(len(by))]
    parts = parts.select(*by, "_b", total.over(before).alias("_carry")).toDF(*own, "_kb", "_carry")
    on = F.col("_b") == F.col("_kb")
    for b, k in zip(by, own, strict=True):
        on = on & F.col(b).eqNullSafe(F.col(k))
    return rows.join(parts, on, "left").drop(*own, "_kb")


def overlap_runs(spans: DataFrame, by: Sequence[str] = ("doc_id",), out: str = "run", block: int = BLOCK) -> DataFrame:
    """Name each run of chained overlapping spans by the start of its first span.

    A segmented running maximum of ``end``. Spans go to the block of their start, and one that reaches into later blocks leaves its
    end there too, so a block knows from itself which of its spans open a run. The last opening of each block, one small row, is
    carried over the blocks of a text; a block's spans before its first opening belong to the run carried in. Nothing is carried into
    the first block, so its spans, all of a short text, stay where they lie; only spans that reach beyond it meet what is carried.
    """
    home = f"greatest(floor(start / {block}), 0L)"
    local = W.partitionBy(*by, "_b").orderBy(F.col("_own"), "start", "end")

    def placed(some: DataFrame) -> DataFrame:
        rows = some.withColumn("_x", F.explode(F.expr(
            f"transform(sequence({home}, greatest(floor(greatest(`end` - 1, start) / {block}), 0L)), b -> named_struct('b', b, 'own', b = {home}))")))
        rows = rows.withColumn("_b", F.col("_x.b")).withColumn("_own", F.col("_x.own")).drop("_x")
        reach = F.max("end").over(local.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("_open", F.when(F.col("_own") & (reach.isNull() | (F.col("start") >= reach)), F.col("start")))
        return rows.withColumn("_run", F.max("_open").over(local.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("_own")

    helpers = ("_b", "_own", "_open", "_run", "_carry")
    known = placed(spans)
    first = known.filter("_b = 0").withColumn(out, F.col("_run"))
    later = placed(spans.filter(f"start >= {block} OR `end` > {block}")).filter("_b > 0")
    later = carried(later, by, F.max("_open"), F.max("_part"), known).withColumn(out, F.coalesce("_run", "_carry"))
    return first.drop(*helpers).unionByName(later.drop(*helpers))


def block_numbers(rows: DataFrame, by: Sequence[str], at: str, order: Sequence[str], out: str, block: int = BLOCK) -> DataFrame:
    """Dense rank of ``order``, whose first column ``at`` is a position, inside each ``by``: ranks inside blocks plus the ranks of the blocks before."""
    cut = rows.withColumn("_b", F.floor(F.col(at) / block))
    local = W.partitionBy(*by, "_b").orderBy(*order)
    cut = cut.withColumn("_r", F.dense_rank().over(local))
    return carried(cut, by, F.max("_r"), F.sum("_part")).withColumn(out, F.col("_r") + F.coalesce("_carry", F.lit(0))).drop("_b", "_r", "_carry")
