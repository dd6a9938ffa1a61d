"""Hard negatives by segment summaries: for each anchor and each of its nearest rows of the same label, the best rows of other labels
whose score lies in a window below the positive's.

A vector is cut into segments, and the mean m and deviation d of each are stored. Two vectors' inner product over segments of w
components lies within sum(w · m · m') ± sum(w · d · d'). Segments are refined hierarchically (``LEVELS``: one, four, sixteen a vector): a level
bounds only pairs that the coarser one left, and what is left after the last is scored exactly.

1. Positives: a tile is a share of the rows of one label by a share of its anchors. A pair goes when its upper bound is below the k-th best
   score so far, or below the k-th best lower bound of its block.
2. Negatives: a tile is a share of all rows by a share of all anchors, each anchor with the windows of its positives. A pair goes
   when its bounds miss every window, or what a window still lacks.

Shares have a fixed number of rows and are dealt by row number, so a hot label or vector fills no tile, and memory in a task does not
grow with the tables. A tile keeps k rows for each anchor (and window); a window function keeps the best over all tiles.

Defined results: rows without a label, and vectors that are null, empty or hold a null or non-finite component, take no part; only vectors of one
length are compared; every row counts by itself, so an id that occurs twice is two candidates and two anchors; ties go to smaller ids,
null ids last; a positive score below zero has no negatives (its window is empty); an anchor without a positive gives no rows, nor does an
empty table. Extra columns are not read. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import in_batches, stored

#: Segments of a vector, from coarse to fine; each divides the next.
LEVELS = (1, 4, 16)
#: Rows and anchors of a tile, and rows of a tile that are bounded at once.
TILE_ROWS, TILE_ANCHORS, BLOCK = 8192, 1024, 1024
_NONE = np.iinfo(np.int64).min
Summary = list[tuple[np.ndarray, np.ndarray]]


def summaries(m: np.ndarray) -> Summary:
    """(means, deviations) of the segments of each row, for each level, both times the root of the segment's width."""
    n, dim = m.shape
    width = -(-dim // LEVELS[-1])
    x = np.zeros((n, width * LEVELS[-1]))
    x[:, :dim] = m
    out = []
    for parts in LEVELS:
        cut = x.reshape(n, parts, -1)
        root = np.sqrt(cut.shape[2])
        out.append((cut.mean(2) * root, cut.std(2) * root))
    return out


def refine(anchors: Summary, rows: Summary, alive: np.ndarray, keep: Callable) -> np.ndarray:
    """``alive`` (anchors × rows) without the pairs that ``keep(anchor numbers, low, high, alive)`` refuses at some level."""
    for (am, ad), (rm, rd) in zip(anchors, rows, strict=True):
        a, r = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(a):
            break
        mid, off = am[a] @ rm[r].T, ad[a] @ rd[r].T
        off += 1e-9 * (np.abs(mid) + off) + 1e-6  # what rounding may lose
        at = np.ix_(a, r)
        alive[at] &= keep(a, mid - off, mid + off, alive[at])
    return alive


def exact(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs left."""
    a, r = np.nonzero(alive)
    big = max(1.0, float(np.abs(anchors).max())) * max(1.0, float(np.abs(rows).max())) * anchors.shape[1]
    kind = np.float64 if big < 2.0**52 else np.int64  # products in doubles are exact up to here
    x, y = anchors.astype(kind), rows.astype(kind)
    score = np.einsum("ij,ij->i", x[a], y[r]) if 8 * len(a) < alive.size else (x @ y.T)[a, r]
    return a, r, score.astype(np.int64)


def best(found: pd.DataFrame, by: list[str], k: int) -> pd.DataFrame:
    """The ``k`` best rows of each group; ties to smaller ids, null ids last."""
    found = found.assign(down=~found["score"]).sort_values([*by, "down", "none", "id", "row"], kind="stable")
    return found[found.groupby(by, sort=False).cumcount() < k].drop(columns="down")


def least_kept(found: pd.DataFrame, key: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The k-th score of each group, -inf where it has fewer."""
    out = np.full(groups, np.inf)
    np.minimum.at(out, key, found["score"].to_numpy(float))
    return np.where(np.bincount(key, minlength=groups) >= k, out, -np.inf)


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, Summary]:
    m = np.frombuffer(b"".join(rows["v"]), np.int64).reshape(len(rows), -1)
    flat = np.frombuffer(b"".join(rows["summary"]), np.float64).reshape(len(rows), 2, -1)
    cuts = np.cumsum(LEVELS)[:-1]
    return m, list(zip(np.split(flat[:, 0], cuts, 1), np.split(flat[:, 1], cuts, 1), strict=True))


def _part(s: Summary, a: int, b: int) -> Summary:
    return [(m[a:b], d[a:b]) for m, d in s]


def nearest(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """(a, row, none, id, score): the best ``k`` of ``rows`` for each of ``anchors`` (numbered a), itself left out."""
    (x, xs), (y, ys) = _unpacked(anchors), _unpacked(rows)
    own, other = anchors["row"].to_numpy(), rows["row"].to_numpy()
    found, floor = None, np.full(len(x), -np.inf)

    def keep(a: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        least = floor[a]
        if low.shape[1] >= k:
            least = np.maximum(least, np.partition(np.where(alive, low, -np.inf), -k, axis=1)[:, -k])
        return high >= least[:, None]

    for at in range(0, len(y), BLOCK):
        alive = refine(xs, _part(ys, at, at + BLOCK), own[:, None] != other[None, at : at + BLOCK], keep)
        a, r, score = exact(x, y[at : at + BLOCK], alive)
        more = rows.iloc[at + r][["row", "none", "id"]].assign(a=a, score=score)
        found = best(more if found is None else pd.concat([found, more]), ["a"], k)
        floor = least_kept(found, found["a"].to_numpy(), len(x), k)
    return found


def windowed(anchors: pd.DataFrame, rows: pd.DataFrame, n: int, k: int, low: int, high: int) -> pd.DataFrame:
    """(a, slot, row, none, id, score): the best ``n`` of ``rows`` of another label within the window of each positive (slot) of an anchor.

    A window holds the scores s with low · positive <= 100 · s <= high · positive.
    """
    (x, xs), (y, ys) = _unpacked(anchors), _unpacked(rows)
    _, kinds = np.unique(np.concatenate([anchors["label"], rows["label"]]).astype(str), return_inverse=True)
    mine, theirs = kinds[: len(x)], kinds[len(x) :]
    bottom, top = np.full((len(x), k), np.inf), np.full((len(x), k), -np.inf)
    for a, scores in enumerate(anchors["scores"]):
        for w, p in enumerate(scores):
            bottom[a, w], top[a, w] = -((-low * int(p)) // 100), (high * int(p)) // 100
    found, floor = None, bottom.copy()

    def keep(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> np.ndarray:
        some = np.zeros(alive.shape, bool)
        for w in range(k):
            some |= (hi >= floor[a, w, None]) & (lo <= top[a, w, None])
        return some

    for at in range(0, len(y), BLOCK):
        alive = refine(xs, _part(ys, at, at + BLOCK), mine[:, None] != theirs[None, at : at + BLOCK], keep)
        a, r, score = exact(x, y[at : at + BLOCK], alive)
        parts = [] if found is None else [found]
        for w in range(k):
            ok = np.flatnonzero((score >= floor[a, w]) & (score <= top[a, w]))
            parts.append(rows.iloc[at + r[ok]][["row", "none", "id"]].assign(a=a[ok], slot=w, score=score[ok]))
        found = best(pd.concat(parts), ["a", "slot"], n)
        full = least_kept(found, (found["a"] * k + found["slot"]).to_numpy(np.int64), len(x) * k, n).reshape(len(x), k)
        floor = np.maximum(bottom, full)
    return found


def vector_index(vectors: DataFrame, anchor: Column, key: str, vector: str, label: str, factor: int) -> DataFrame:
    """The usable rows, written once: number, id, label, integer vector and segment summaries."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x")).filter("label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").filter(~bad)
    rows = rows.select(
        "row", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "label", "anchor", F.size("x").alias("dim"),
        F.transform("x", lambda c: F.floor(c * factor).cast("bigint")).alias("v"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            dims, flat = batch.column("dim").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(dims)
            packed: list = [None] * batch.num_rows
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                m = flat[(ends[of] - dim)[:, None] + np.arange(dim)]
                s = summaries(m)
                both = np.concatenate([*(a for a, _ in s), *(d for _, d in s)], 1)
                for k, one, two in zip(of, m, both, strict=True):
                    packed[k] = (one.tobytes(), two.tobytes())
            cols = [batch.column(c) for c in ("row", "none", "id", "label", "anchor", "dim")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                                             names=["row", "none", "id", "label", "anchor", "dim", "v", "summary"])

    return stored(in_batches(rows, summed, "row bigint, none boolean, id bigint, label string, anchor boolean, dim int, v binary, summary binary"))


def _tiles(rows: DataFrame, anchors: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out: a row goes to its run with every set of anchors, an anchor to its set with every run."""
    size = rows.groupBy(*by).agg(F.ceil(F.count("*") / TILE_ROWS).alias("runs"))
    size = size.join(anchors.groupBy(*by).agg(F.ceil(F.count("*") / TILE_ANCHORS).alias("sets")), by)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    left = rows.join(size, by).withColumn("run", place("runs")).withColumn("part", each("sets"))
    right = anchors.toDF(*anchors.columns).join(size, by).withColumn("part", place("sets")).withColumn("run", each("runs"))
    return left, right.toDF(*right.columns)


def mine_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", factor: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that meet ``anchor``.

    Scores are inner products of floor(``factor`` · component). A negative's score is between ``low`` and ``high`` percent of the positive's.
    """
    rows = vector_index(vectors, anchor, key, vector, label, factor)
    anchors = rows.filter("anchor")
    k, n = positives, negatives

    def near(_, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a_row", "row", "id", "score")} | {"none": np.zeros(0, bool)})
        found = nearest(asked, index, k)
        return found.assign(a_row=asked["row"].to_numpy()[found["a"]])[["a_row", "row", "none", "id", "score"]]

    left, right = _tiles(rows.drop("anchor"), anchors.drop("anchor"), ["dim", "label"])
    by = ("dim", "label", "run", "part")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, "a_row bigint, row bigint, none boolean, id bigint, score bigint")
    order = Window.partitionBy("a_row").orderBy(F.desc("score"), "none", "id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    goals = found.groupBy(F.col("a_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "none", "id", "score"))).alias("p"))
    goals = stored(goals)
    asked = anchors.drop("anchor").join(goals.select("row", F.col("p.score").alias("scores")), "row")

    def hard(_, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a_row", "slot", "row", "id", "score")} | {"none": np.zeros(0, bool)})
        found = windowed(asked, index, n, k, low, high)
        return found.assign(a_row=asked["row"].to_numpy()[found["a"]])[["a_row", "slot", "row", "none", "id", "score"]]

    left, right = _tiles(rows.drop("anchor"), asked, ["dim"])
    by = ("dim", "run", "part")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        hard, "a_row bigint, slot int, row bigint, none boolean, id bigint, score bigint")
    order = Window.partitionBy("a_row", "slot").orderBy(F.desc("score"), "none", "id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    named = lambda none, ident: F.when(~none, ident)
    goals = goals.join(anchors.select("row", F.col("none").alias("a_none"), F.col("id").alias("a_id")), "row").withColumnRenamed("row", "a_row")
    out = found.join(goals, "a_row").withColumn("p", F.get("p", F.col("slot")))
    return out.select(
        named(F.col("a_none"), F.col("a_id")).alias("anchor_id"), named(F.col("p.none"), F.col("p.id")).alias("positive_id"), "rank",
        named(F.col("none"), F.col("id")).alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
