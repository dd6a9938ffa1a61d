"""Benchmark items inside documents, also with edits: CGK embedding, bit-sampling LSH, exact edit distance.

Symbols are words (ASCII white space parts them, A-Z lower-cased, punctuation at their ends left out). The CGK walk copies a window's symbol at a
pointer and moves the pointer on by a random bit of (step, symbol): windows at a small edit distance get strings at a small Hamming
distance. A key hashes a few sampled places of that string.

An item of L words may lose ``most_edits(L)`` of them, and its windows are chosen by what is left then (``size_class``). Below
``LONG`` words the edits leave a run of ``intact(L)`` words as it was, wherever they fall: windows are no longer than that run, documents
give one at every word, and one key hashes the whole string and window, so no such item is missed. Longer items are met by windows of 8 or 16 words (longer ones
hold too many edits): documents give one every ``stride(size)`` words, so that even the shortest occurrence holds several whole ones, and ``WALKS`` × ``SAMPLES`` keys per window reach the target recall (measured by the tests for each length and
kind of edit). Items give a window at every place. What meets is verified: the smallest number of word edits that turn the item into
some run of the document's words must be at most ``1 - SIMILARITY`` of the item's length.

A bitmap of the items' keys filters windows in the tasks; the rest meet the items in a join. Its size follows the number of keys, between
2^``LEAST_BITS`` and 2^``MOST_BITS`` bits (32 MB).

Defined results: null, empty or blank texts and items match nothing; repeated rows of an id count as one document, repeated items are found
one by one; rows without an id are told apart by their texts and reported with a null doc_id; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import Words, in_batches, mix, slices, stored, string_bytes, word_hashes

SIMILARITY = 0.8
WALKS, SAMPLES, PLACES = 4, 8, 6
#: Words of the shortest item that is met by windows in which edits are allowed for.
LONG = 28
#: Words of a window, at most.
WIDEST = 16
LEAST_BITS, MOST_BITS = 24, 28
#: Windows whose walks are made at once, a power of two; they fit a core's cache.
AT_ONCE = 1 << 13
_MARKS = ".,;:!?\"'()[]{}<>*#%&$-_/\\|"


def most_edits(length: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * length + 1e-9)


def intact(length: int) -> int:
    """Words of the longest run of an item that its edits leave as it was, at least."""
    edits = most_edits(length)
    return -(-(length - edits) // (edits + 1))


def size_class(length: int) -> int:
    """Class of the items of this many words, the words of its windows up to ``WIDEST``; 0 for none."""
    if length < LONG:
        return min(4, intact(length)) if length else 0
    size = 8
    while 7 * size <= length:
        size *= 2
    return size


def width(size: int) -> int:
    """Words of the windows of a class."""
    return min(size, WIDEST)


def reach(size: int) -> int:
    """Words that the longest occurrence of an item of this class may have before or after a window of it."""
    longest = 7 * size - 1 if size > 4 else max(n for n in range(1, LONG) if size_class(n) == size)
    return longest + most_edits(longest) - width(size)


def stride(size: int) -> int:
    return min(size // 2, WIDEST) if size > 4 else 1


def symbols(words: Words) -> np.ndarray:
    data, offsets = string_bytes(pc.ascii_trim(words.distinct, characters=_MARKS))
    return word_hashes(data, offsets)[words.codes]


def _plan(w: int) -> list[tuple[int, list[list[int]]]]:
    """For each walk, its seed and the sampled places of each key: one in each of as many equal parts of the walk.

    Places next to each other often copy one word, and a key of few words, frequent ones at that, tells nothing. Windows
    that are looked for whole have one key of all places.
    """
    rng = np.random.default_rng(w)
    if w <= 4:
        return [(int(rng.integers(1 << 62)), [list(range(2 * w))])]
    ends = np.linspace(0, 2 * w, PLACES + 1).astype(int)
    key = lambda: [int(rng.integers(a, b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [(int(rng.integers(1 << 62)), [key() for _ in range(SAMPLES)]) for _ in range(WALKS)]


def window_keys(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """key × window: hashes of sampled places of the CGK strings of h[start : start + width(size)]; starts ascend."""
    w = width(size)
    plan = _plan(w)
    out = np.empty((sum(len(samples) for _, samples in plan), len(starts)), np.uint64)
    out[:] = mix(np.arange(len(out), dtype=np.uint64) + np.uint64(size << 20))[:, None]
    table, spot, symbol = (np.empty(n * AT_ONCE, np.int64) for n in (w + 1, 1, 1))
    for a in range(0, len(starts), AT_ONCE):
        _add_walks(h, starts[a : a + AT_ONCE], w, plan, out[:, a : a + AT_ONCE], table, spot, symbol)
    return out


def _add_walks(h: np.ndarray, starts: np.ndarray, w: int, plan: list, out: np.ndarray, table: np.ndarray, spot: np.ndarray, symbol: np.ndarray) -> None:
    """Add to each key of ``out`` the copied symbols at its places, each times an odd number of the place.

    ``table`` holds word p of window i at p * AT_ONCE + i, so a pointer moves on by adding AT_ONCE, a bit of the symbol where it stands. A
    symbol is mixed with the walk's seed: its bits are the random bits of the steps. Below the words lie zeros, where a pointer stays.
    Windows that are looked for whole add all their words too: a walk that rests on a frequent word copies few others.
    """
    n, low = len(starts), int(starts[0])
    h, starts = h[low : int(starts[-1]) + w], starts - low
    rows, at, symbol = table.reshape(w + 1, AT_ONCE), spot[:n], symbol[:n]
    rows[w] = 0
    for k, (seed, samples) in enumerate(plan):
        walked = mix(h ^ np.uint64(seed)).view(np.int64)
        for p in range(w):
            walked.take(starts + p if p else starts, out=rows[p, :n], mode="clip")
        at[:] = np.arange(n)
        factors = mix(np.arange(3 * w, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
        if w <= 4:
            for p in range(w):
                out[k] += rows[p, :n].view(np.uint64) * factors[2 * w + p]
        for j in range(max(max(places) for places in samples) + 1):
            table.take(at, out=symbol, mode="clip")
            used = [s for s, places in enumerate(samples) if j in places]
            if used:
                term = symbol.view(np.uint64) * factors[j]
                for s in used:
                    out[k * len(samples) + s] += term
            symbol >>= j
            symbol &= AT_ONCE
            at += symbol


def _starts(counts: np.ndarray, w: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every window of ``w`` words that a text holds whole."""
    each = np.where(counts >= w, (counts - w) // step + 1, 0)
    text = np.repeat(np.arange(len(counts)), each)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * step


def item_keys(items: DataFrame) -> DataFrame:
    """(key, w, item_id) for every window of every item; items: (item_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 17):
            words = Words(batch.column(1))
            h, first = symbols(words), np.cumsum(words.counts) - words.counts
            sizes = np.array([size_class(int(n)) for n in words.counts])
            for w in np.unique(sizes[sizes > 0]):
                text, at = _starts(np.where(sizes == w, words.counts, 0), width(int(w)), 1)
                keys = window_keys(h, first[text] + at, int(w)).view(np.int64)
                ids = batch.column(0).take(pa.array(np.tile(text, len(keys))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.full(keys.size, w, np.int32)), ids], names=["key", "w", "item_id"])

    return in_batches(items, cut, "key bigint, w int, item_id bigint").distinct()


def _bit(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds the bits; ``place`` is used up."""
    octet = bits.view(np.uint8).take((place >> np.uint64(3)).view(np.int64), mode="clip")
    place &= np.uint64(7)
    octet >>= place.astype(np.uint8)
    octet &= np.uint8(1)
    return octet.view(bool)


def known_keys(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in ``keys`` of those that the bitmap holds both bits of."""
    size = len(bits).bit_length() + 5
    top = np.uint64(64 - size)
    at = np.flatnonzero(_bit(bits, keys >> top))
    return at[_bit(bits, (keys[at] << np.uint64(size)) >> top)]


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """Two bits for each key in a bitmap of about sixteen bits a key; at most 2 ** (MOST_BITS - 6) words reach the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    place = [F.shiftrightunsigned("key", 64 - size), F.shiftrightunsigned(F.shiftleft("key", size), 64 - size)]
    bit = keys.select(F.explode(F.array(*place)).alias("p"))
    words = bit.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << (size - 6), np.int64)
    got = words.toArrow()  # columns; as rows they would be a hundred times the bytes in the driver
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def suspects(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, first, region, keys): keys of items in windows, and the words around the windows that could hold such an item.

    Windows that start in one block of words share a region.
    """
    held = docs.sparkSession.sparkContext.broadcast((bitmap, sizes))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, classes = held.value
        for batch in slices(batches):
            words = Words(batch.column(1))
            h, begin = symbols(words), np.cumsum(words.counts) - words.counts
            for size in classes:
                w, beside = width(size), reach(size)
                wide = beside + w
                text, at = _starts(words.counts, w, stride(size))
                for a in range(0, len(text), 1 << 16):
                    t, s = text[a : a + (1 << 16)], at[a : a + (1 << 16)]
                    keys = window_keys(h, begin[t] + s, size).ravel()
                    spot = known_keys(bits, keys)
                    if not len(spot):
                        continue
                    block = t[spot % len(t)] * (int(words.counts.max()) // wide + 1) + s[spot % len(t)] // wide
                    order = np.lexsort((keys[spot], block))
                    spot, block = spot[order], block[order]
                    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                    k, place = spot[cuts] % len(t), s[spot % len(t)]
                    lo = np.maximum(0, np.minimum.reduceat(place, cuts) - beside)
                    hi = np.minimum(words.counts[t[k]], np.maximum.reduceat(place, cuts) + w + beside)
                    n = hi - lo
                    place = np.repeat(begin[t[k]] + lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    around = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), words.distinct.take(pa.array(words.codes[place])))
                    once = np.r_[True, keys[spot[1:]] != keys[spot[:-1]]]
                    once[cuts] = True
                    own = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.add.reduceat(once, cuts, dtype=np.int64))], pa.int32()), pa.array(keys[spot[once]].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(t[k])), pa.array(lo), pc.binary_join(around, " "), own], names=["doc_id", "first", "region", "keys"])

    return in_batches(docs, find, "doc_id string, first bigint, region string, keys array<bigint>")


def best_match(item: np.ndarray, n: np.ndarray, region: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, first, end) of the run of each region that is nearest to its item. Rows are padded; n and m are the true lengths."""
    rows, width = region.shape
    unit = np.int64(1 << 32)  # edits above, first word below
    place = np.arange(width + 1, dtype=np.int64)
    d = np.broadcast_to(place, (rows, width + 1)).copy()
    for i in range(item.shape[1]):
        new = np.empty_like(d)
        new[:, 0] = d[:, 0] + unit
        new[:, 1:] = np.minimum(d[:, :-1] + unit * (region != item[:, i, None]), d[:, 1:] + unit)
        new = np.minimum.accumulate(new - place * unit, axis=1) + place * unit
        d = np.where((i < n)[:, None], new, d)
    d[place[None, :] > m[:, None]] = np.iinfo(np.int64).max
    end = d.argmin(1)
    best = d[np.arange(rows), end]
    return best // unit, best % unit, end


def verify(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, first_word, last_word) of the pairs (doc_id, item_id, first, region, item) that match."""

    def padded(words: Words) -> np.ndarray:
        h = symbols(words)
        out = np.zeros((len(words.counts), max(1, int(words.counts.max(initial=0)))), np.uint64)
        out[np.arange(out.shape[1]) < words.counts[:, None]] = h
        return out

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "region", 1 << 17):
            item, region = Words(batch.column("item")), Words(batch.column("region"))
            most = np.floor((1 - similarity) * item.counts + 1e-9)
            a, b = padded(item), padded(region)
            # A word of the item that the region lacks costs an edit at least.
            lack = np.zeros(len(a), np.int64)
            for k in range(a.shape[1]):
                lack += (k < item.counts) & ~(a[:, k, None] == b).any(1)
            near = np.flatnonzero(lack <= most)
            edits, first, end = best_match(a[near], item.counts[near], b[near], region.counts[near])
            ok = edits <= most[near]
            rows = pa.array(near[ok])
            base = batch.column("first").to_numpy()[near[ok]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("item_id").take(rows), pa.array(edits[ok]), pa.array(base + first[ok]), pa.array(base + end[ok] - 1)],
                names=["doc_id", "item_id", "edits", "first_word", "last_word"])

    return in_batches(pairs, check, "doc_id string, item_id bigint, edits bigint, first_word bigint, last_word bigint")


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, first_word, last_word): the nearest run of each document's words for each item it holds."""
    asked = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = asked.filter("item_id IS NOT NULL AND text IS NOT NULL")
    keys = stored(item_keys(asked))
    sizes = sorted(r[0] for r in keys.select("w").distinct().collect())
    own = F.concat(F.lit("i"), F.col(key).cast("bigint").cast("string"))  # a row without an id goes by its text
    own = F.coalesce(own, F.concat(F.lit("t"), F.xxhash64(text).cast("string")))
    plain = docs.select(own.alias("doc_id"), F.col(text).cast("string").alias("text"))
    near = stored(suspects(plain, key_bitmap(keys), sizes).withColumn("hash", F.xxhash64("region")))
    met = near.select("doc_id", "first", "hash", F.explode("keys").alias("key")).join(keys.drop("w"), "key")
    met = met.select("doc_id", "first", "hash", "item_id").distinct()
    regions = near.select("doc_id", "first", "hash", "region").dropDuplicates(["doc_id", "first", "hash"])
    pairs = regions.join(met, ["doc_id", "first", "hash"]).join(asked.withColumnRenamed("text", "item"), "item_id")
    best = verify(pairs, similarity).groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "last_word")).alias("x"))
    ident = F.when(F.col("doc_id").startswith("i"), F.expr("cast(substring(doc_id, 2) AS bigint)")).alias("doc_id")
    return best.select(ident, "item_id", "x.*")
