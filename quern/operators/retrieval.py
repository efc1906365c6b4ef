"""Retrieval: exact vector search, full-text search, rank fusion, token budgets and result shaping.

Every ordered result ends with a key, so ties are settled. Scores are rounded before they are ordered, so that both
legs rank alike whatever the order of a sum.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V

DIGITS = 6


def scored(chunks: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """chunks with similarity; those without one (no vector, a zero vector, or none asked for) go."""
    return chunks.withColumn("similarity", F.round(V.cosine(F.col(vector), V.literal(query)), DIGITS)).where("similarity IS NOT NULL")


def vector_topk(chunks: DataFrame, query: list[float], k: int = 10, key: str = "chunk_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows of the largest cosine similarity to one query vector; where filters before the cut."""
    rows = chunks if where is None else chunks.where(where)
    return scored(rows, query, vector).orderBy(F.desc("similarity"), key).limit(k)


def vector_topk_batch(chunks: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query, chunk, similarity, rank) for many query rows (query_id, vector).

    Queries are a stated set: they are read in blocks of at most about block rows, each broadcast to one pass over the chunks;
    a pass keeps the k best of every batch and a window keeps the k best of all, limiting groups before the shuffle.
    """
    asked = queries.select(F.col("query_id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    n = max(1, -(-asked.count() // block))
    parts = []
    for b in range(n):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).collect()
        if rows:
            parts.append(_pass(chunks.select(F.col(key).alias("chunk_id"), F.col(vector).alias("v")), [r.query_id for r in rows], [r.v for r in rows], k))
    if not parts:
        return chunks.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, similarity double, rank int")
    found = reduce(DataFrame.unionAll, parts)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pass(rows: DataFrame, ids: list, vectors: list, k: int) -> DataFrame:
    q = np.array(vectors, float)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    sent = rows.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), q))

    def best(batches):
        own, matrix = sent.value
        for batch in batches:
            lists, keys = batch.column(1), batch.column(0).to_numpy()
            m = np.array([v if v is not None and len(v) == matrix.shape[1] else np.zeros(matrix.shape[1]) for v in (x.as_py() for x in lists)], float).reshape(-1, matrix.shape[1])
            norms = np.linalg.norm(m, axis=1)
            sims = np.round(matrix @ (m / np.maximum(norms, 1e-300)[:, None]).T, DIGITS)
            sims[:, norms == 0] = -np.inf
            for i in range(len(own)):
                top = np.lexsort((keys, -sims[i]))[:k]
                top = top[np.isfinite(sims[i][top])]
                if len(top):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), own[i])), pa.array(keys[top]), pa.array(sims[i][top])], names=["query_id", "chunk_id", "similarity"])

    return rows.mapInArrow(best, "query_id bigint, chunk_id bigint, similarity double")


def topk_per_group(hits: DataFrame, group: str, k: int, score: str = "similarity", key: str = "chunk_id") -> DataFrame:
    """The k best rows of every group."""
    order = W.partitionBy(group).orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, term, tf, words): how often each term occurs in each chunk, and the chunk's words."""
    words = chunks.select(key, T.tokens(F.col(text)).alias("w"))
    return words.select(key, F.size("w").alias("words"), F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("words").alias("words"))


def _matching(chunks: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """Postings of the query terms in chunks that hold all of them: row-local, so no shuffle before the filter."""
    # through a generator, which filters aren't pushed below: a text is cut into words once, not for each use
    words = chunks.select(key, F.explode(F.array(T.tokens(F.col(text)))).alias("w"))
    all_of = reduce(lambda a, b: a & b, [F.array_contains("w", t) for t in terms])
    return words.where(all_of)


def _tf(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def fulltext_tf(chunks: DataFrame, query: str, k: int | None = 20, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Chunks that hold all query words, by their number per word of the chunk."""
    terms = sorted(set(query.lower().split()))
    score = sum((_tf(t) for t in terms), F.lit(0)) / F.size("w")
    out = _matching(chunks, terms, key, text).select(key, F.round(score, DIGITS).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def fulltext_bm25(chunks: DataFrame, query: str, k: int | None = 20, key: str = "chunk_id", text: str = "content", k1: float = 1.2, b: float = 0.75, corpus: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 over chunks that hold all query words; statistics over the whole corpus (chunks by default)."""
    terms = sorted(set(query.lower().split()))
    whole = (chunks if corpus is None else corpus).select(T.tokens(F.col(text)).alias("w"))
    stats = whole.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg"), *[F.count_if(F.array_contains("w", t)).alias(f"df{j}") for j, t in enumerate(terms)]).first()
    score = F.lit(0.0)
    for j, t in enumerate(terms):
        df = stats[f"df{j}"]
        idf = float(np.log(1 + (stats.n - df + 0.5) / (df + 0.5)))
        tf = _tf(t).cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("w") / float(stats.avg or 1)))
    out = _matching(chunks, terms, key, text).select(key, F.round(score, DIGITS).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def phrase(column: Column, words: str) -> Column:
    """Whether a text holds the words next to one another."""
    return F.concat(F.lit(" "), F.array_join(T.tokens(column), " "), F.lit(" ")).contains(" " + " ".join(words.lower().split()) + " ")


def ranked(hits: DataFrame, score: str, key: str = "chunk_id") -> DataFrame:
    """1-based ranks of a short list of hits (at most a few times k rows)."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int = 10, constant: int = 60, weights: tuple[float, float] = (1.0, 1.0), key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists; ties keep the vector leg's order, then the text leg's."""
    a = vector_hits.select(key, F.col("rank").alias("vector_rank"))
    b = text_hits.select(key, F.col("rank").alias("text_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(constant) + F.col(r)), F.lit(0.0))
    both = a.join(b, key, "full_outer").withColumn("rrf", F.round(part(weights[0], "vector_rank") + part(weights[1], "text_rank"), 8))
    return both.orderBy(F.desc("rrf"), F.asc_nulls_last("vector_rank"), "text_rank").limit(k)


def budget_prefix(hits: DataFrame, limit: int, tokens: str = "token_count", order: str = "rank", group: str | None = None) -> DataFrame:
    """Rows in order until their tokens would pass the limit; nothing behind the first overflow is taken."""
    w = (W.partitionBy(group) if group else W.partitionBy()).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= limit)


def combine(primary: DataFrame, related: DataFrame, limit: int, score: str = "similarity", key: str = "chunk_id") -> DataFrame:
    """Both lists without repeated keys (the primary's row wins), by score."""
    both = primary.withColumn("leg", F.lit(0)).unionByName(related.withColumn("leg", F.lit(1)))
    once = both.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("leg", F.desc(score)))).where("n = 1").drop("n")
    return once.orderBy(F.desc(score), key).limit(limit)


def weighted_relevance(hits: DataFrame, group: str, score: str = "similarity", rank: str = "rank") -> DataFrame:
    """Mean score with weights 1 / rank, per group."""
    return hits.groupBy(group).agg(F.round(F.sum(F.col(score) / F.col(rank)) / F.sum(1 / F.col(rank)), DIGITS).alias("relevance"))
