"""Near copies: all pairs of texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

1. Texts with the same words are one node with a weight. 2. A MinHash LSH forest: every node has ``TREES`` labels of up to ``DEPTH``
minima; in a tree's sorted prefix trie, nodes that share a prefix meet. The prefix is shortened from ``DEPTH``
until a pair at the threshold meets in some tree with probability ``RECALL``; what meets on a longer prefix is joined there, and only
its leader goes on to the shorter one. 3. Joined nodes form candidate groups. 4. Groups are verified exactly, in tiles of at
most ``TILE`` by ``TILE`` nodes: a matrix product of shared shingles gives every intersection. Links are counted in the tile,
so pairs are never written, however large a group is; a tile keeps the number of links of each node and a spanning link.

Words are runs between ASCII white space, A-Z lower-cased. Texts of one to four words are one shingle.

Defined results: null, empty or blank texts have no shingles, no links and a class of their own; every row is compared by
its text alone, whether its id is null or repeated; a class without any id has a null class_id; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import Words, in_batches, mix, powers, slices, stored
from cloakframe.llm.components import connected_components
from cloakframe.llm.membership import matching

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH, RECALL = 20, 8, 0.98
TILE = 128
_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def depth_for(recall: float, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, from ``depth`` down, at which a pair at the threshold meets with this probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, shingles of each text); repeated shingles stay."""
    w, c = words.hashes()[words.codes], words.counts
    each = np.where(c == 0, 0, np.maximum(c - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(c)), each)
    at = np.repeat(np.cumsum(c) - c, each) + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    h, p = np.zeros(len(doc), np.uint64), powers(SHINGLE)
    last = max(0, len(w) - 1)
    for k in range(SHINGLE):
        if len(w):
            h += np.where(k < c[doc], w[np.minimum(at + k, last)] * p[k], np.uint64(0))
    return mix(h), each


def contents(words: Words) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words."""
    w, c = words.hashes()[words.codes], words.counts
    out = np.zeros((len(c), 2), np.uint64)
    full = c > 0
    if full.any():
        first = np.cumsum(c) - c
        place = np.arange(len(w)) - np.repeat(first, c)
        for k, base in enumerate(_BASES):
            out[full, k] = np.add.reduceat(w * powers(int(c.max()), base)[place], first[full])
    return mix(out + c.astype(np.uint64)[:, None]).view(np.int64)


def labels(words: Words, levels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows with shingles, level × row × tree hashes of label prefixes)."""
    h, each = shingles(words)
    rows = np.flatnonzero(each)
    if not len(rows):
        return rows, np.zeros((len(levels), 0, TREES), np.int64)
    low = (h >> np.uint64(32)).astype(np.uint32)
    start = (np.cumsum(each) - each)[rows]
    sig = np.empty((len(rows), TREES * DEPTH), np.uint64)
    for p in range(TREES * DEPTH):
        sig[:, p] = np.minimum.reduceat((low ^ _XOR[p]) * _MUL[p], start)
    sig = mix(sig.reshape(len(rows), TREES, DEPTH) + (np.arange(TREES, dtype=np.uint64) << np.uint64(40))[:, None])
    sums = np.cumsum(sig * powers(DEPTH), axis=2, dtype=np.uint64)
    return rows, np.stack([mix(sums[:, :, d - 1] + np.uint64(d)) for d in levels]).view(np.int64)


def forest(docs: DataFrame, levels: list[int]) -> DataFrame:
    """(id, doc, c1, c2, n0 …) of (id, text, doc): content hashes and, for each level, the trie node of every tree."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(1))
            c = contents(words)
            rows, nodes = labels(words, levels)
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            offsets[1:][rows] = TREES
            offsets = pa.array(np.cumsum(offsets), pa.int32())
            none = words.counts == 0
            cols = {"id": batch.column(0), "doc": batch.column("doc"), "c1": pa.array(c[:, 0], mask=none), "c2": pa.array(c[:, 1], mask=none)}
            for k in range(len(levels)):
                cols[f"n{k}"] = pa.ListArray.from_arrays(offsets, pa.array(nodes[k].ravel()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = "id bigint, doc bigint, c1 bigint, c2 bigint" + "".join(f", n{k} array<bigint>" for k in range(len(levels)))
    return in_batches(docs, sign, schema)


def candidate_links(nodes: DataFrame, levels: int) -> DataFrame:
    """(a, b) links between a trie node's members and its leader, from the longest prefix to the shortest."""
    trees = nodes.select("id", F.explode(F.arrays_zip(*[f"n{k}" for k in range(levels)])).alias("x")).select("id", "x.*")
    last = f"n{levels - 1}"
    shared = trees.groupBy(last).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select(last)
    left = stored(trees.join(shared, last))
    links = None
    for k in range(levels):
        heads = left.groupBy(f"n{k}").agg(F.min("id").alias("lead"), F.max("id").alias("hi")).filter("lead <> hi").drop("hi")
        met = left.join(heads, f"n{k}", "left")
        found = met.filter("lead <> id").select(F.col("id").alias("a"), F.col("lead").alias("b"))
        links = found if links is None else links.unionByName(found)
        left = met.filter("lead IS NULL OR lead = id").drop("lead")
    return links.distinct()


def verify_tile(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links weighted by copies, smallest id connected inside the tile) of each node. side 2: pairs inside it count; else pairs across sides."""
    n = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[col] > 1
    row, col = row[keep], np.unique(col[keep], return_inverse=True)[1]
    shared = np.zeros((n, n), np.float32)
    width = int(col.max()) + 1 if len(col) else 0
    for a in range(0, width, 8192):
        part = (col >= a) & (col < a + 8192)
        x = np.zeros((n, min(8192, width - a)), np.float32)
        x[row[part], col[part] - a] = 1
        shared += x @ x.T  # counts below 2^24 are exact
    union = size[:, None] + size[None, :] - shared
    link = shared >= threshold * union - 1e-6
    link &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    np.fill_diagonal(link, False)
    links = link @ weight
    root = ids.copy()
    while True:
        best = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(1))
        if (best == root).all():
            return links.astype(np.int64), root
        root = best


def shingle_sets(members: DataFrame) -> DataFrame:
    """``members`` (id, grp, tiles, copies, text) with the sorted set of shingles of each text instead of the text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h, each = shingles(words)
            parts = [np.unique(x) for x in np.split(h.view(np.int64), np.cumsum(each)[:-1])]
            out = [batch.column(k) for k in ("id", "grp", "tiles", "copies")]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([*out, flat], names=["id", "grp", "tiles", "copies", "shingles"])

    return in_batches(members, sets, "id bigint, grp bigint, tiles int, copies bigint, shingles array<bigint>")


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links, root) of the members of candidate groups, one row per tile of a member."""
    block = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    other = F.explode(F.expr("sequence(0, tiles - 1)"))
    rows = shingle_sets(members).withColumn("block", block).withColumn("x", other)
    rows = rows.select("id", "copies", "shingles", "grp", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"),
                       F.when(F.col("block") == F.col("x"), 2).otherwise((F.col("block") > F.col("x")).cast("int")).alias("side"))
    rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> pa.RecordBatch:
            ids, first = np.unique(np.array([h[0] for h in held], np.int64), return_index=True)
            own = [held[k] for k in first]
            links, root = verify_tile(ids, np.array([h[1] for h in own], np.int64), np.array([h[2] for h in own]), [h[3] for h in own], threshold)
            return pa.RecordBatch.from_pydict({"id": pa.array(ids), "links": pa.array(links), "root": pa.array(root)})

        for batch in batches:
            out = []
            plain = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("grp", "i", "j", "id", "copies", "side")]
            lists = batch.column("shingles")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k, (g, i, j, ident, copies, side) in enumerate(zip(*plain, strict=True)):
                if key is not None and key != (g, i, j):
                    out.append(close())
                    held = []
                key = (g, i, j)
                held.append((ident, copies, side, flat[off[k] : off[k + 1]].copy()))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if held:
            yield close()

    return in_batches(rows, check, "id bigint, links bigint, root bigint")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links) of every row: the smallest id connected by links, and the number of other rows at the threshold or above.

    Rows are numbered, and a node is the smallest number of the rows with its words; ids are only carried along.
    """
    kind = docs.schema[key].dataType
    plain = stored(docs.select(F.monotonically_increasing_id().alias("id"), F.col(text).cast("string").alias("text"), F.col(key).cast("bigint").alias("doc")))
    out = near_classes(plain, threshold, recall)
    return out.select(F.col("doc").cast(kind).alias(key), F.col("class_id").cast(kind).alias("class_id"), "n_links")


def near_classes(plain: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, doc, class_id, n_links) of (id, text, doc), a written table whose ``id`` numbers its rows; class_id is the smallest ``doc`` of a class."""
    levels = list(range(DEPTH, depth_for(recall, threshold) - 1, -1))
    signed = stored(forest(plain, levels))
    classes = signed.filter("c1 IS NOT NULL").groupBy("c1", "c2").agg(
        F.min("id").alias("rep"), F.min("doc").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes)
    first = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    groups = connected_components(candidate_links(first, len(levels)))
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    groups = groups.join(sizes, "root").select("id", F.col("root").alias("grp"), "tiles")
    members = stored(groups.join(classes.select(F.col("rep").alias("id"), "copies"), "id"))
    found = stored(verified(matching(plain, members, "id").select("id", "grp", "tiles", "copies", "text"), threshold))
    roots = stored(connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).join(
        classes.select(F.col("rep").alias("id"), "least"), "id"))
    heads = stored(roots.groupBy("root").agg(F.min("least").alias("class_id")))
    named = roots.join(heads, "root").select("id", "root", "class_id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reps = classes.withColumnRenamed("rep", "id").join(links, "id", "left").join(named, "id", "left")
    reps = reps.select("c1", "c2", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
                       (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("id", "doc", "c1", "c2").join(reps, ["c1", "c2"], "left")
    own = F.when(F.col("c1").isNull(), F.col("doc")).otherwise(F.col("class_id"))
    return out.select("id", "doc", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
