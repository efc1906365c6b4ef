"""Nearest neighbours by a block matrix join with int8 product tiles and exact bounds.

Vectors are dealt to cells of queries and cells of candidates of bounded size; within a pair of cells a block of
queries meets a block of candidates as one tile.
Each vector a is quantised to int8 codes q with a scale s, so a = s q + e with a known error length |e|. A tile's
integer products (computed exactly, as float matrix products of small integers) give s t <q, r>, which is off
from <a, b> by at most |e||b| + |s q||f|. For each query the k-th largest lower bound seen so far is a floor that pairs must
reach with their upper bound; the pairs that do are recomputed in double precision from the original vectors and
merged into the query's heap of k. Nothing else is dropped, so the result is exact, ties to the smaller id included.

A pair of cells gives one heap for each query, not a row for each tile; a query's heaps are then merged by a
window that limits each group before the shuffle. Equal rows are one row with a count before they are dealt, as no more of them than k can be in a result; equal vectors
of a cell are computed once, and only as many of their smallest ids as can be in a result are kept.

Cells are sized in bytes, so each candidate goes to ceil(queries / query cell) tasks: the rows shuffled grow with the product, as the products do.

Cases: vectors that are null, zero or hold null or non-finite components take no part, and vectors of different
lengths don't meet; a query's own row (same id) is no candidate; repeated ids are one candidate each time; an id with two vectors asks
with both, each with its own ranks; fewer candidates than k are all returned;
where products leave the range of doubles the bounds give way and the exact sums decide, infinite ones tied, those that are no number last;
null ids take no part; empty input gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import plain, to_arrow


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that take part: v is array<double> without null, non-finite or only zero components."""
    rows = plain(vectors, id_col, vector_col).toDF("id", "v").select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


class Quantised:
    """A block's int8 codes, scales and error lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.scale = np.maximum(np.abs(vectors).max(axis=1) / 127, np.finfo(float).tiny)
        unit = vectors / self.scale[:, None]
        codes = np.rint(unit).astype(np.int8)
        # sums of products of codes are integers that float32 holds exactly up to 1040 dimensions
        self.codes = codes.astype(np.float32 if vectors.shape[1] <= 1040 else np.float64)
        norm = lambda x: np.sqrt((x * x).sum(axis=1)) * self.scale * (1 + 1e-9)
        self.error, self.length, self.near_length = norm(unit - codes), norm(unit), norm(codes.astype(float))


class Heaps:
    """The k best (score, -id) of each query of a block."""

    def __init__(self, queries: Quantised, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]

    def tile(self, c: Quantised) -> None:
        q, k = self.q, self.k
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            middle = (q.codes @ c.codes.T).astype(np.float64) * q.scale[:, None] * c.scale[None, :]
            slack = q.error[:, None] * c.length[None, :] + q.near_length[:, None] * c.error[None, :] + 1e-9 * q.length[:, None] * c.length[None, :] + 1e-300
            lower, upper = middle - slack, middle + slack
        wild = ~(np.isfinite(lower) & np.isfinite(upper))
        lower[wild], upper[wild] = -np.inf, np.inf
        own = q.ids[:, None] == c.ids[None, :]
        lower[own] = -np.inf
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in self.heaps])
        if c.ids.size > k:
            floor = np.maximum(floor, -np.partition(-lower, k - 1, axis=1)[:, k - 1])
        at, other = np.nonzero((upper >= floor[:, None]) & ~own)
        for a in range(0, len(at), 65536):  # pairs recomputed at a time
            i, j = at[a : a + 65536], other[a : a + 65536]
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                scores = np.cumsum(q.vectors[i] * c.vectors[j], axis=1)[:, -1]  # summed from the first component on, as SQL does
            scores[np.isnan(scores)] = -np.inf
            for row, score, ident in zip(i.tolist(), scores.tolist(), c.ids[j].tolist(), strict=True):
                heap = self.heaps[row]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -ident))
                elif (score, -ident) > heap[0]:
                    heapq.heapreplace(heap, (score, -ident))


def _unique(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of equal vectors only the rows of the keep smallest ids: no result of keep - 1 neighbours and the query itself needs more."""
    _, group = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new_group = np.concatenate(([True], g[1:] != g[:-1]))
    new_id = np.cumsum(new_group | np.concatenate(([True], i[1:] != i[:-1])))
    rank = new_id - np.repeat(new_id[new_group], np.diff(np.append(np.flatnonzero(new_group), len(order))))
    return np.sort(order[rank < keep])


QUERY_BYTES, CANDIDATE_BYTES = 8 << 20, 32 << 20  # of a cell's vectors


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_cell: int | None = None, candidate_cell: int | None = None, tile: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k rows of vectors with the largest inner product.

    Queries and candidates are dealt by hash to cells of about the given numbers of rows (else of bounded bytes); each query cell meets each candidate cell.
    """
    rows = usable(vectors, id_col, vector_col).groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    asked = usable(queries, id_col, vector_col).distinct()
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    query_cell = query_cell or max(256, QUERY_BYTES // (8 * (dim or 1)))
    # no fewer candidate cells than can be worked on at once, as long as they aren't small
    at_once = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 4096))
    q_cells = max(1, -(-asked.count() // query_cell))
    c_cells = max(1, -(-n // (candidate_cell or max(1024, CANDIDATE_BYTES // (8 * (dim or 1))))), 1 if candidate_cell else -(-at_once // q_cells))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = asked.select("id", "v", F.size("v").alias("dim"), cell(q_cells).alias("q"), every(c_cells).alias("c"))
    right = rows.select("id", "v", "times", F.size("v").alias("dim"), cell(c_cells).alias("c"), every(q_cells).alias("q"))
    target = to_arrow(FOUND)

    def join(_, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return target.empty_table()
        own, other = _matrix(a), _matrix(b)
        chosen = _unique(*other, k + 1)
        chosen = np.repeat(chosen, b.column("times").to_numpy()[chosen])
        other = other[0][chosen], other[1][chosen]
        out = []
        tiles = [Quantised(other[0][t : t + 2 * tile], other[1][t : t + 2 * tile]) for t in range(0, len(other[0]), 2 * tile)]
        for s in range(0, len(own[0]), tile):
            heaps = Heaps(Quantised(own[0][s : s + tile], own[1][s : s + tile]), k)
            for t in tiles:
                heaps.tile(t)
            out += [(s + i, -ident, score) for i, heap in enumerate(heaps.heaps) for score, ident in heap]
        at, ids, scores = zip(*out, strict=True) if out else ([], [], [])
        at = np.array(at, np.int64)
        marks = a.column("mark").to_numpy()
        return pa.table({"query_id": own[0][at], "mark": marks[at], "vec_id": np.array(ids, np.int64), "score": np.array(scores, float)}, schema=target)

    left = left.withColumn("mark", F.xxhash64("v"))
    found = left.groupBy("q", "c", "dim").cogroup(right.groupBy("q", "c", "dim")).applyInArrow(join, FOUND)
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id bigint, mark bigint, vec_id bigint, score double"


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    ids, lists = t.column("id").to_numpy(), t.column("v").chunk(0)
    return ids, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
