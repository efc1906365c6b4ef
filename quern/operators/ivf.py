"""An inverted-file index of vectors by cosine: lists around centroids, laid out as folders, searched by probing the nearest lists or exactly.

Centroids are fitted by spherical k-means on at most SAMPLE vectors, chosen by a hash of their keys; every vector is in the list of its nearest centroid. A search reads the folders of the
lists that its queries probe. The exact mode then uses each list's radius (the largest distance of a unit vector from its centroid): by the triangle
inequality no vector of a list is nearer to a query than the centroid's distance less the radius, so lists that can't reach a query's k-th best so far are skipped for it.

Vectors that are null, zero, hold a null or a non-finite component, or have another length than the first one of the sample are in no list. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.retrieval import DIGITS
from quern.scratch import written

SAMPLE = 20_000
LISTS = 100
SLACK = 1e-6  # what rounding may add to a similarity


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and which rows have one."""
    rows = [x if x is not None and len(x) == width and None not in x else [0.0] * width for x in column.to_pylist()]
    m = np.array(rows, float).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        m /= np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
        norms = np.linalg.norm(m, axis=1)
        good = np.isfinite(norms) & (norms > 0)
        m[~good] = 0
        return m / np.where(good, norms, 1.0)[:, None], good


def centroids(vectors: DataFrame, lists: int = LISTS, key: str = "chunk_id", vector: str = "embedding", sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centroids of at most sample vectors; fewer than lists if there are fewer different ones, none without vectors."""
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    chosen = vectors.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else vectors
    rows = [r[0] for r in chosen.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).collect()] if n else []
    if not rows:
        return np.zeros((0, 0))
    m, good = _matrix(pa.array(rows, pa.list_(pa.float64())), len(rows[0]))
    m = m[good]
    out = np.unique(m, axis=0)
    out = out[np.random.default_rng(0).permutation(len(out))[:lists]]
    for _ in range(rounds):
        near = (m @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, m)
        norms = np.linalg.norm(sums, axis=1)
        out = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1.0)[:, None], out)
    return out


@dataclass
class Index:
    path: str
    centroids: np.ndarray
    radius: np.ndarray  # of each list; -1 if it is empty


def build(vectors: DataFrame, path: str, lists: int = LISTS, key: str = "chunk_id", vector: str = "embedding") -> Index:
    """Writes every vector into its list's folder."""
    c = centroids(vectors, lists, key, vector)
    kind = vectors.schema[key].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, good = _matrix(batch.column(1), sent.value.shape[1])
            if not len(sent.value) or not good.any():
                continue
            rows = np.flatnonzero(good)
            sims = m[rows] @ sent.value.T
            near = sims.argmax(axis=1)
            far = np.sqrt(np.maximum(2 - 2 * sims[np.arange(len(rows)), near], 0))
            unit = pa.FixedSizeListArray.from_arrays(pa.array(m[rows].ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), unit, pa.array(far), pa.array(near.astype(np.int32))], names=["key", "unit", "far", "list"])

    placed = vectors.select(key, vector).mapInArrow(assign, f"key {kind}, unit array<double>, far double, list int")
    # equal lists side by side, large ones in several files
    placed.repartition("list", F.pmod(F.xxhash64("key"), F.lit(4))).write.partitionBy("list").parquet(path)
    radius = np.full(len(c), -1.0)
    if len(c):
        for r in vectors.sparkSession.read.schema("far double, list int").parquet(path).groupBy("list").agg(F.max("far").alias("r")).collect():
            radius[r.list] = r.r
    return Index(path, c, radius)


def _pass(spark: SparkSession, index: Index, kind: str, ids: list, units: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """(query_id, key, similarity): the best of each batch for the queries that probe its lists; probes: (queries, lists) of booleans."""
    wanted = np.flatnonzero(probes.any(axis=0)).tolist()
    rows = spark.read.schema(f"key {kind}, unit array<double>, list int").parquet(index.path).where(F.col("list").isin(wanted)) if wanted else spark.createDataFrame([], f"key {kind}, unit array<double>, list int")
    sent = spark.sparkContext.broadcast((np.array(ids), units, probes))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, asked = sent.value
        for batch in batches:
            lists = batch.column("list").to_numpy()
            m = batch.column("unit").flatten().to_numpy().reshape(-1, q.shape[1])
            order = pc.rank(batch.column("key"), tiebreaker="first").to_numpy()
            for at in np.unique(lists).tolist():
                mine, who = np.flatnonzero(lists == at), np.flatnonzero(asked[:, at])
                sims = np.round(q[who] @ m[mine].T, DIGITS)
                for i, s in zip(who, sims, strict=True):
                    top = np.lexsort((order[mine], -s))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), own[i])), batch.column("key").take(pa.array(mine[top])), pa.array(s[top])], names=["query_id", "key", "similarity"])

    return rows.mapInArrow(best, f"query_id bigint, key {kind}, similarity double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, block: int = 4096, vector: str = "embedding", kind: str = "bigint") -> DataFrame:
    """(query_id, rank, key, similarity) of a stated set of queries (query_id, vector), read in blocks; exact: the lists that may still matter are read, too."""
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col(vector).alias("v")).where("query_id IS NOT NULL AND v IS NOT NULL")
    n = max(1, -(-asked.count() // block))
    parts = []
    for b in range(n):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).collect() if len(index.centroids) else []
        if not rows:
            continue
        units, good = _matrix(pa.array([list(r.v) for r in rows], pa.list_(pa.float64())), index.centroids.shape[1])
        ids, units = [r.query_id for r, g in zip(rows, good, strict=True) if g], units[good]
        if not ids:
            continue
        sims = np.where(index.radius[None] >= 0, units @ index.centroids.T, -np.inf)
        nearest = np.argsort(-sims, axis=1)[:, :probes]
        first = np.zeros(sims.shape, bool)
        np.put_along_axis(first, nearest, True, axis=1)
        first &= np.isfinite(sims)
        found = _ranked(_pass(spark, index, kind, ids, units, first, k), k)
        if exact:
            found = written(found)
            worst = {r.query_id: r.s for r in found.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("s")).collect()}
            reached = np.array([worst.get(i, -np.inf) for i in ids])
            least = np.maximum(np.sqrt(np.maximum(2 - 2 * np.where(np.isfinite(sims), sims, -1.0), 0)) - index.radius[None], 0)
            more = np.isfinite(sims) & ~first & (1 - least**2 / 2 >= reached[:, None] - SLACK)
            found = _ranked(found.drop("rank").unionByName(_pass(spark, index, kind, ids, units, more, k)), k)
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, rank int, key {kind}, similarity double")
    return reduce(DataFrame.unionByName, parts).select("query_id", "rank", "key", "similarity")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's true hits (query_id, key) that were found."""
    hit = truth.select("query_id", "key").join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
