"""Exact top-k inner products by block-at-a-time pruning.

Vectors are numbered by likeness: the nearest of some centres, fitted on a bounded sample, then their row. Ranges of that order are cut into
blocks; a block is a forward index (its integer matrix) with the largest and smallest value of each term. A query orders blocks by the
sum of its best term products and scores them block by block until the bound falls below its k-th score.

Runs of blocks have such bounds too. Every query first searches the run with its highest bound, which gives a first
k-th score; then it goes only to the runs whose bound reaches that score, and starts there from it. Tiles are (run of blocks, set of
queries): a fixed number of each, so memory in a task does not grow with the tables. Each tile keeps k rows per query; a
window keeps the best k over all tiles.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of one length are compared;
every row of ``queries`` is a query with a list of its own, also where ids repeat, and skips all candidates of its id; a row without an
id is a candidate like any other (null vec_id); ties go to smaller ids, null ids last; fewer than k candidates give fewer rows;
empty tables give no rows. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import in_batches, stored

BLOCK = 128
#: Blocks of a run, and queries of a tile.
TILE_BLOCKS, TILE_QUERIES = 128, 2048
#: Vectors on which the centres are fitted, and centres.
SAMPLE, CENTRES = 4096, 256
#: Bounds that are sent to tasks (64 MB for vectors of 64 components); runs share one where there are more.
MOST_BOUNDS = 1 << 16
_INDEX = "dim int, run bigint, ids array<bigint>, values binary, top array<double>, low array<double>"
_NULL_ID = np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, key: str, vector: str, factor: int = 256) -> DataFrame:
    """(row, vec_id, dim, v): floor(factor * x) of every component; unusable vectors are left out. A null id is the largest long."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    own = F.coalesce(F.col(key).cast("bigint"), F.lit(int(_NULL_ID)))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), own.alias("vec_id"), x.alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    rows = rows.filter(~bad)
    return rows.select("row", "vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * factor).cast("bigint")).alias("v"))


def centres(rows: DataFrame, count: int, seed: int = 3) -> dict[int, np.ndarray]:
    """Centres of each vector length by a few rounds of nearest means on a sample of about ``SAMPLE`` of ``count`` rows."""
    share = min(1.0, SAMPLE / max(1, count))
    kept = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 20)) < int(share * (1 << 20))).select("dim", "v").limit(4 * SAMPLE).collect()
    out = {}
    for dim in {r["dim"] for r in kept}:
        m = np.array([r["v"] for r in kept if r["dim"] == dim], float)
        rng = np.random.default_rng(seed)
        c = m[rng.choice(len(m), min(CENTRES, max(1, len(m) // 16)), replace=False)]
        for _ in range(5):
            near = nearest_centre(m, c)
            sizes = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, m)
            c = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], c)
        out[dim] = c
    return out


def nearest_centre(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None, :] - 2 * m @ c.T).argmin(1)


def block_index(rows: DataFrame, model: dict[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` vectors of one centre, numbered into runs of ``TILE_BLOCKS``."""
    held_model = rows.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            near = np.zeros(len(dims), np.int64)
            lists = batch.column("v")
            for dim in np.unique(dims):
                if dim in held_model.value:
                    of = np.flatnonzero(dims == dim)
                    m = lists.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
                    near[of] = nearest_centre(m.astype(float), held_model.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*batch.schema.names, "centre"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        made = 0

        def flush() -> dict:
            nonlocal made
            ids, vs = zip(*((h[2], h[3]) for h in held), strict=True)
            m = np.array(vs, np.int64)
            run = (TaskContext.get().partitionId() << 32) + made // TILE_BLOCKS
            made += 1
            return {"dim": held[0][0], "run": run, "ids": list(ids), "values": m.tobytes(), "top": m.max(0).astype(float).tolist(), "low": m.min(0).astype(float).tolist()}

        schema = pa.schema([("dim", pa.int32()), ("run", pa.int64()), ("ids", pa.list_(pa.int64())), ("values", pa.binary()),
                            ("top", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in ("dim", "centre", "vec_id", "v")), strict=True):
                if held and (len(held) == block or held[0][:2] != row[:2]):
                    out.append(flush())
                    held.clear()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([flush()], schema=schema)

    placed = in_batches(rows, place, "row bigint, vec_id bigint, dim int, v array<bigint>, centre bigint")
    return in_batches(placed.repartitionByRange("dim", "centre", "row").sortWithinPartitions("dim", "centre", "row"), cut, _INDEX)


def bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """An upper bound of each query's products with what lies between ``low`` and ``top``."""
    q = queries.astype(np.float64)
    out = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    return out + np.abs(out) * 1e-12  # only matters beyond 2^52


def search_tile(blocks: list[tuple], queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the best k of each query. blocks: (ids, matrix, top, low); floor: a score each query need not fall below."""
    nq = len(queries)
    big = max(1.0, max(float(np.abs(b[1]).max()) for b in blocks)) * max(1.0, float(np.abs(queries).max())) * queries.shape[1]
    kind = np.float64 if big < 2.0**52 else np.int64  # products in doubles are exact up to here
    qs = queries.astype(kind)
    bound = bounds(queries, np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    score, ids = np.full((nq, k), none), np.full((nq, k), np.iinfo(np.int64).max)
    mats = [b[1].astype(kind) for b in blocks]
    live = np.arange(nq)
    for step in range(len(blocks)):
        b = order[live, step]
        kth = score[live, k - 1]
        keep = (kth == none) | (bound[live, b] >= kth)  # equal bounds may hold a smaller id
        if floor is not None:
            keep &= bound[live, b] >= floor[live]
        live, b = live[keep], b[keep]
        if not len(live):
            break
        for block in np.unique(b):
            rows = live[b == block]
            s = (qs[rows] @ mats[block].T).astype(np.int64)
            cand = np.broadcast_to(blocks[block][0], s.shape)
            s = np.where(cand == own[rows, None], none, s)
            all_s, all_i = np.concatenate([score[rows], s], 1), np.concatenate([ids[rows], cand], 1)
            all_i = np.where(all_s == none, np.iinfo(np.int64).max, all_i)
            best = np.lexsort((all_i, np.where(all_s == none, np.iinfo(np.int64).max, -all_s)), axis=1)[:, :k]
            score[rows], ids[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
    row, rank = np.nonzero(score != none)
    return row, ids[row, rank], score[row, rank]


def run_bounds(index: DataFrame, most: int = MOST_BOUNDS) -> dict[int, tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """For each vector length: groups of runs, and the largest and smallest value of each term in a group. At most about ``most`` groups."""

    def widest(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "run": [key[1]], "top": [np.stack(blocks["top"].to_numpy()).max(0)], "low": [np.stack(blocks["low"].to_numpy()).min(0)]})

    runs = stored(index.select("dim", "run", "top", "low").groupBy("dim", "run").applyInPandas(widest, "dim int, run bigint, top array<double>, low array<double>"))
    share = -(-runs.count() // most)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (dim, _), g in pdf.sort_values(["dim", "run"]).assign(n=np.arange(len(pdf)) // max(1, share)).groupby(["dim", "n"]):
                yield pd.DataFrame({"dim": [dim], "runs": [g["run"].tolist()], "top": [np.stack(g["top"].to_numpy()).max(0)], "low": [np.stack(g["low"].to_numpy()).min(0)]})

    out: dict = {}
    for r in runs.mapInPandas(merged, "dim int, runs array<bigint>, top array<double>, low array<double>").collect():
        out.setdefault(r["dim"], []).append(r)
    return {d: ([np.array(r["runs"], np.int64) for r in rs], np.array([r["top"] for r in rs]), np.array([r["low"] for r in rs])) for d, rs in out.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries`` by integer inner product."""
    rows, asked = stored(integer_vectors(vectors, key, vector)), stored(integer_vectors(queries, key, vector))
    index = stored(block_index(rows, centres(rows, rows.count())))
    known = asked.sparkSession.sparkContext.broadcast(run_bounds(index))
    n_sets = max(1, -(-asked.count() // TILE_QUERIES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_sets)))
    fields = "row bigint, vec_id bigint, dim int, v array<bigint>, part bigint, floor double, runs array<bigint>"

    def aim(first: bool):
        """The runs a query goes to: the group with its highest bound at first, then all others that reach its k-th score."""

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                runs: list[list[int]] = [[] for _ in range(len(pdf))]
                dims, floor = pdf["dim"].to_numpy(), np.full(len(pdf), -np.inf) if first else pdf["floor"].to_numpy()
                for dim in set(dims.tolist()) & set(known.value):
                    groups, top, low = known.value[dim]
                    of = np.flatnonzero(dims == dim)
                    b = bounds(np.stack(pdf["v"].to_numpy()[of]), top, low)
                    for i, line, best in zip(of, b, b.argmax(1), strict=True):
                        to = [best] if first else [x for x in np.flatnonzero(line >= floor[i]) if x != best]
                        runs[i] = [int(r) for x in to for r in groups[x]]
                out = pdf.assign(floor=floor)
                out["runs"] = pd.Series(runs, index=out.index, dtype=object)
                yield out[["row", "vec_id", "dim", "v", "part", "floor", "runs"]]

        return pick

    def search(_, blocks: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(wanted):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q", "query_id", "vec_id", "score")})
        held = [(np.asarray(i, np.int64), np.frombuffer(v, np.int64).reshape(len(i), -1), t, w)
                for i, v, t, w in zip(blocks["ids"], blocks["values"], blocks["top"], blocks["low"], strict=True)]
        ids = wanted["vec_id"].to_numpy(np.int64)
        own = np.where(ids == _NULL_ID, np.iinfo(np.int64).min, ids)  # a query without an id skips nothing
        row, found, score = search_tile(held, np.stack(wanted["v"].to_numpy()).astype(np.int64), own, k, wanted["floor"].to_numpy())
        return pd.DataFrame({"q": wanted["row"].to_numpy()[row], "query_id": ids[row], "vec_id": found, "score": score})

    def searched(aimed: DataFrame) -> DataFrame:
        """k rows at most for each query and run."""
        by = ("dim", "run", "part")
        right = aimed.withColumn("run", F.explode("runs")).drop("runs")
        sets = right.select(*by).distinct()
        left = index.join(sets.toDF(*sets.columns), ["dim", "run"])
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "q bigint, query_id bigint, vec_id bigint, score bigint")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    start = asked.withColumn("floor", F.lit(0.0)).mapInPandas(aim(True), fields)
    near = stored(ranked(searched(start)))
    kth = near.filter(F.col("rank") == k).select(F.col("q").alias("row"), F.col("score").cast("double").alias("floor"))
    rest = asked.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).mapInPandas(aim(False), fields)
    found = ranked(near.drop("rank").unionByName(searched(rest)))
    plain = lambda c: F.when(F.col(c) != int(_NULL_ID), F.col(c)).alias(c)
    return found.select(plain("query_id"), "rank", plain("vec_id"), "score")
