"""Runs of repeated words: every maximal stretch with smallest period q that is at least ``POWER`` · q and ``LEAST`` words long.

A run of period q and length L is a maximal pair of occurrences (i, i + q) of one string of l = L - q words: the words left of the two
differ, and so do the words right of them. Pairs are enumerated on the LCP-interval tree of the text's words:

1. Suffixes are ordered by prefix doubling over names of five-word windows, which starts at words whose window occurs again in the
   same text. A suffix is left out if no occurrence of its window is near enough for its longest common prefix with any other suffix
   (3 · distance <= prefix): it is in no pair that counts, nor between the two of one.
2. The tree is walked bottom-up. An interval holds the positions of its suffixes in order, each listed with its class, the word to its
   left. When a child joins (the smaller list goes into the larger), two neighbours of the joined list that come from
   different children share exactly the l words of the interval; they are a maximal pair if their left classes differ.
3. With the distance at most l / 3, such a pair of neighbours is a run, and its distance is the smallest period: a smaller one would put
   another occurrence between them. So each run comes once and nothing is extended.

Words are runs of characters other than ASCII white space, compared as they are.

Defined results: a null text is an empty one (no words, no runs, empty collapsed text); null and repeated ids are carried along, one row
for each row; a text may have any length, time grows with n log n; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import in_batches, mix, slices

#: A run has at least so many words, and so many times its period.
LEAST, POWER = 6, 4
#: Words of the windows that name a position: a pair that counts shares as many at least.
WINDOW = 5
_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def window_names(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of the window at each word, positions whose window occurs more than once in their text)."""
    n = len(words)
    h = mix(doc.astype(np.uint64) + np.uint64(1))
    last = np.append(doc, np.full(WINDOW, -1))
    whole = last[WINDOW - 1 : n + WINDOW - 1] == doc
    padded = np.append(words, np.zeros(WINDOW, words.dtype)).astype(np.uint64)
    for k in range(WINDOW):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + n])
    order = np.argsort(h, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    starts = np.flatnonzero(~same)
    name = np.empty(n, np.int64)
    name[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    # A window that runs over the end of its text is like no other.
    name[~whole] = n + np.flatnonzero(~whole)
    size = np.bincount(name, minlength=2 * n)
    return name, np.flatnonzero(size[name] > 1)


def suffix_order(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions ``at`` in suffix order, words each shares with the one before it; 0 where their windows differ)."""
    n = len(name)
    rank, levels, active, step = name.copy(), [], at, 1
    while len(active):
        levels.append(rank)
        ahead = active + step
        far = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((far, rank[active]))
        active, far = active[order], far[order]
        own = rank[active]
        head = np.ones(len(active), bool)
        head[1:] = own[1:] != own[:-1]
        new = head.copy()
        new[1:] |= far[1:] != far[:-1]
        place = np.arange(len(active))
        group = np.maximum.accumulate(np.where(head, place, 0))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[active] = own + first - group
        alone = new & np.append(new[1:], True)
        active, step = active[~alone], 2 * step
    order = at[np.argsort(rank[at], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        shared[1:][ok] += 1 << k
        a[ok] += 1 << k
        b[ok] += 1 << k
    shared[shared > 0] += WINDOW - 1
    return order, shared


def near_enough(name: np.ndarray, order: np.ndarray, shared: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """``order`` and ``shared`` without the suffixes that can be in no pair at a distance of at most shared / ``times``."""
    by = np.lexsort((order, name[order]))
    pos = order[by]
    gap = np.full(len(pos), np.iinfo(np.int64).max)
    twin = name[pos[1:]] == name[pos[:-1]]
    step = np.where(twin, pos[1:] - pos[:-1], np.iinfo(np.int64).max)
    gap[1:] = step
    gap[:-1] = np.minimum(gap[:-1], step)
    nearest = np.empty_like(gap)
    nearest[by] = gap
    longest = np.maximum(shared, np.append(shared[1:], 0))
    keep = np.flatnonzero(nearest <= longest // times)
    if not len(keep):
        return order[:0], shared[:0]
    # The prefix that two kept neighbours share is the least over the suffixes left out between them.
    low = np.minimum.reduceat(shared[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
    low[0] = 0
    return order[keep], low


def maximal_pairs(order: list[int], shared: list[int], left: list[int], times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal pairs of neighbouring occurrences at a distance of at most shared / ``times``."""
    found, stack = [], []

    def join(big: list[int], small: list[int], l: int) -> list[int]:
        if len(big) < len(small):
            big, small = small, big
        most, p, end = l // times, 0, len(small) - 1
        for t, x in enumerate(small):
            p = bisect_left(big, x)
            if p:
                b = big[p - 1]
                if x - b <= most and left[b] != left[x] and (not t or small[t - 1] < b):
                    found.append((b, l + x - b, x - b))
            if p < len(big):
                b = big[p]
                if b - x <= most and left[b] != left[x] and (t == end or small[t + 1] > b):
                    found.append((x, l + b - x, b - x))
        if not end:
            big.insert(p, small[0])
        else:
            big += small
            big.sort()  # two ascending runs: one merge
        return big

    for x, h in zip(order, [*shared[1:], 0], strict=True):
        node = [x]
        while stack and stack[-1][0] > h:
            l, held = stack.pop()
            node = join(held, node, l)
        if not h:
            continue
        if stack and stack[-1][0] == h:
            stack[-1] = (h, join(stack[-1][1], node, h))
        else:
            stack.append((h, node))
    return found


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) over the words of many texts in a row, ordered; ``doc`` numbers the text of each word."""
    name, at = window_names(words, doc)
    order, shared = suffix_order(name, at)
    order, shared = near_enough(name, order, shared, power - 1)
    if not len(order):
        return np.zeros((0, 3), np.int64)
    left = np.append(-1, words[:-1])
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    left[first] = -1 - np.arange(len(first))  # nothing to the left: a class of its own
    found = np.array(maximal_pairs(order.tolist(), shared.tolist(), left.tolist(), power - 1), np.int64).reshape(-1, 3)
    found = found[found[:, 1] >= least]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row. A run's words after its first period are left out of ``collapsed``.

    ``least`` and ``power`` must leave no run whose pair shares fewer than five words: least >= 6 and power >= 3.
    """
    if least < WINDOW + 1 or power < 3:
        raise ValueError("runs of at least six words and three periods")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            code: dict[bytes, int] = {}
            texts = [t.encode().split() for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            words = np.array([code.setdefault(w, len(code)) for t in texts for w in t], np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            runs = runs_of(words, doc, least, power) if len(words) else np.zeros((0, 3), np.int64)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            ends = np.cumsum(sizes)
            owner = doc[runs[:, 0]]
            cut = np.bincount(owner, minlength=len(texts)) > 0
            collapsed = [b" ".join(compress(t, kept[e - len(t) : e].tolist()) if c else t).decode() for t, e, c in zip(texts, ends, cut, strict=True)]
            offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
            flat = [pa.array(c) for c in (runs[:, 0] - (ends - sizes)[owner], runs[:, 1], runs[:, 2])]
            rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes), rows.cast(_RUN_TYPE), pa.array(collapsed, pa.string())], names=["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return in_batches(rows, find, f"key {kind}, n_words bigint, runs {_RUN}, collapsed string").withColumnRenamed("key", key)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly; ties to the smallest start, then period. Null if there is none."""
    return F.expr(f"aggregate({runs}, get({runs}, 0), (b, x) -> if(x.length * b.period > b.length * x.period, x, b))")
