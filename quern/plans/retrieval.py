"""Queries for vector, full-text and hybrid retrieval. A chunk is a line of a document; embeddings belong to documents of the same id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import fulltext as X
from quern.operators import ivf as I
from quern.operators import retrieval as R
from quern.plans.catalog import ORACLES, register, table
from quern.scratch import new_scratch

QUERY = "the and of"
PHRASE = "of the"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("idx", "content"))
    return lines.withColumn("chunk_id", F.concat_ws("-", "doc_id", "idx"))


CHUNKS = """chunks AS (SELECT doc_id, source, lang, i - 1 AS idx, l[i] AS content, doc_id || '-' || (i - 1) AS chunk_id
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents)))"""
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The stored vector of id 0; empty where there is none."""
    row = table(spark, d, "embeddings").where("vec_id = 0").first()
    return list(row.embedding or []) if row else []


SCORED = """scored AS (SELECT e.vec_id AS chunk_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def _vector(spark, d):
    return R.vector_topk(embedded(spark, d), query_vector(spark, d)).select("chunk_id", "similarity")


register("ret_vector_topk", _vector, f"WITH {SCORED} SELECT chunk_id, similarity FROM scored ORDER BY similarity DESC, chunk_id LIMIT 10")
register(
    "ret_vector_topk_filtered",
    lambda s, d: R.vector_topk(embedded(s, d), query_vector(s, d), where=F.col("label") == 1).select("chunk_id", "similarity"),
    f"WITH {SCORED} SELECT chunk_id, similarity FROM scored WHERE label = 1 ORDER BY similarity DESC, chunk_id LIMIT 10",
)


def _semi(spark, d):
    english = table(spark, d, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 200)).select(F.col("doc_id").alias("chunk_id"))
    return R.vector_topk(embedded(spark, d).join(english, "chunk_id", "left_semi"), query_vector(spark, d)).select("chunk_id", "similarity")


register(
    "ret_vector_topk_metadata_semi",
    _semi,
    f"WITH {SCORED} SELECT chunk_id, similarity FROM scored WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 200) ORDER BY similarity DESC, chunk_id LIMIT 10",
)


def _batch(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return R.vector_topk_batch(embedded(spark, d), asked, k=10).select("query_id", "rank", "chunk_id", "similarity")


register(
    "ret_vector_topk_batch",
    _batch,
    """SELECT query_id, rank, chunk_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0))
  WHERE rank <= 10""",
)


def _listed(spark, d, exact):
    """The batch search in a new index: exact, or with the nearest lists only."""
    index = I.build(embedded(spark, d), new_scratch(spark))
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return I.search(spark, index, asked, probes=8 if exact else 60, exact=exact).withColumnRenamed("key", "chunk_id")


register("ret_ivf_exact", lambda s, d: _listed(s, d, True), ORACLES["ret_vector_topk_batch"])
# these vectors hardly cluster, so 60 of 100 lists are probed; which hits that finds is the index's affair, and tests/test_ivf measures its recall
register("ret_ivf_topk", lambda s, d: _listed(s, d, False))


def _per_group(spark, d):
    return R.topk_per_group(R.scored(embedded(spark, d), query_vector(spark, d)), "label", 5).select("label", "rank", "chunk_id", "similarity")


register(
    "ret_vector_topk_per_group",
    _per_group,
    f"WITH {SCORED} SELECT label, rank, chunk_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM scored) WHERE rank <= 5",
)

_TOKENS = WORDS.format("content")
_HAS_ALL = "list_has_all(w, ['the', 'and', 'of'])"
_TF = "len(list_filter(w, lambda x: x = '{}'))"
_SUM_TF = "(" + " + ".join(_TF.format(t) for t in ("the", "and", "of")) + ")"
register("ret_fulltext_tf", lambda s, d: R.fulltext_tf(chunks(s, d), QUERY).select("chunk_id", "score"), f"WITH {CHUNKS}, t AS (SELECT chunk_id, {_TOKENS} AS w FROM chunks) SELECT chunk_id, round({_SUM_TF} / len(w), 6) AS score FROM t WHERE {_HAS_ALL} ORDER BY score DESC, chunk_id LIMIT 20")


def bm25_sql(rows: str, key: str) -> str:
    """BM25 in SQL over a table of (key, w)."""
    df = ", ".join(f"count(*) FILTER (list_contains(w, '{t}')) AS df{j}" for j, t in enumerate(("and", "of", "the")))
    part = " + ".join(f"ln(1 + (n - df{j} + 0.5) / (df{j} + 0.5)) * {_TF.format(t)} * 2.2 / ({_TF.format(t)} + 1.2 * (0.25 + 0.75 * len(w) / mean))" for j, t in enumerate(("and", "of", "the")))
    return f"SELECT {key}, round({part}, 6) AS score FROM {rows}, (SELECT count(*) AS n, avg(len(w)) AS mean, {df} FROM {rows}) WHERE {_HAS_ALL}"


register("ret_fulltext_bm25", lambda s, d: R.fulltext_bm25(chunks(s, d), QUERY).select("chunk_id", "score"), f"WITH {CHUNKS}, t AS (SELECT chunk_id, {_TOKENS} AS w FROM chunks) {bm25_sql('t', 'chunk_id')} ORDER BY score DESC, chunk_id LIMIT 20")
register(
    "ret_fulltext_phrase",
    lambda s, d: R.fulltext_tf(chunks(s, d).where(R.phrase(F.col("content"), PHRASE)), QUERY, None).select("chunk_id", "score"),
    f"WITH {CHUNKS}, t AS (SELECT chunk_id, {_TOKENS} AS w FROM chunks) SELECT chunk_id, round({_SUM_TF} / len(w), 6) AS score FROM t WHERE {_HAS_ALL} AND contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')",
)


def _indexed(spark, d, search):
    """A search in a new index of all chunks."""
    path = new_scratch(spark)
    X.build(chunks(spark, d), path)
    return search(spark, path).withColumnRenamed("key", "chunk_id")


register("ret_index_all_terms", lambda s, d: _indexed(s, d, lambda s, p: X.all_terms(s, p, QUERY)), f"WITH {CHUNKS}, t AS (SELECT chunk_id, {_TOKENS} AS w FROM chunks) SELECT chunk_id, round({_SUM_TF} / len(w), 6) AS score FROM t WHERE {_HAS_ALL}")
register(
    "ret_index_phrase",
    lambda s, d: _indexed(s, d, lambda s, p: X.phrase(s, p, PHRASE)),
    f"WITH {CHUNKS}, t AS (SELECT chunk_id, {_TOKENS} AS w FROM chunks) SELECT chunk_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))::INTEGER AS n FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')",
)
register("ret_index_bm25", lambda s, d: _indexed(s, d, lambda s, p: X.bm25_topk(s, p, QUERY)), ORACLES["ret_fulltext_bm25"])


def _legs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    vec = R.ranked(R.vector_topk(embedded(spark, d), query_vector(spark, d), 20), "similarity")
    txt = R.ranked(R.fulltext_bm25(docs, QUERY, 20), "score")
    return vec, txt


def _hybrid(weights=(1.0, 1.0)):
    def run(spark, d):
        return R.fuse(*_legs(spark, d), weights=weights).select("chunk_id", "vector_rank", "text_rank", "rrf")

    return run


def _hybrid_sql(a: float, b: float) -> str:
    return f"""WITH {SCORED}, t AS (SELECT doc_id AS chunk_id, {WORDS.format('text')} AS w FROM documents),
  v AS (SELECT chunk_id, row_number() OVER (ORDER BY similarity DESC, chunk_id)::INTEGER AS vector_rank FROM scored ORDER BY similarity DESC, chunk_id LIMIT 20),
  b AS ({bm25_sql('t', 'chunk_id')}), f AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id)::INTEGER AS text_rank FROM b ORDER BY score DESC, chunk_id LIMIT 20)
  SELECT chunk_id, vector_rank, text_rank, round(coalesce({a} / (60 + vector_rank), 0) + coalesce({b} / (60 + text_rank), 0), 8) AS rrf FROM v FULL JOIN f USING (chunk_id)
  ORDER BY rrf DESC, vector_rank NULLS LAST, text_rank LIMIT 10"""


register("ret_hybrid_rrf", _hybrid(), _hybrid_sql(1.0, 1.0))
register("ret_hybrid_rrf_weighted", _hybrid((0.5, 1.5)), _hybrid_sql(0.5, 1.5))


def _context(spark, d):
    hits = R.fulltext_bm25(chunks(spark, d), QUERY).join(chunks(spark, d).select("chunk_id", "source", "content"), "chunk_id")
    return hits.select("chunk_id", F.concat(F.lit("[Source: "), F.col("source"), F.lit("]\n"), T.preview(F.col("content"))).alias("context"), T.rough_tokens(F.col("content")).alias("tokens"))


register(
    "ret_context_rows",
    _context,
    f"""WITH {CHUNKS}, t AS (SELECT chunk_id, {_TOKENS} AS w FROM chunks), h AS (SELECT * FROM ({bm25_sql('t', 'chunk_id')}) ORDER BY score DESC, chunk_id LIMIT 20)
  SELECT chunk_id, '[Source: ' || source || ']' || chr(10) || CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS context, (length(content) // 4 + 1)::INTEGER AS tokens FROM h JOIN chunks USING (chunk_id)""",
)


def _budget(spark, d):
    turns = table(spark, d, "conversations").distinct().withColumn("tokens", F.size(T.tokens(F.col("text"))))
    return R.budget_prefix(turns, 300, "tokens", "turn", "conv_id").select("conv_id", "turn", "used")


register(
    "ret_token_budget_prefix",
    _budget,
    f"SELECT * FROM (SELECT conv_id, turn, (sum(len({WORDS.format('text')})) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM (SELECT DISTINCT * FROM conversations)) WHERE used <= 300",
)


def _combine(spark, d):
    q = query_vector(spark, d)
    primary = R.vector_topk(embedded(spark, d), q, 10).select("chunk_id", "similarity")
    related = R.vector_topk(embedded(spark, d), q, 12, where=F.col("label") == 2).select("chunk_id", "similarity")
    return R.combine(primary, related, 14).select("chunk_id", "similarity", "leg")


register(
    "ret_combine_dedup_topk",
    _combine,
    f"""WITH {SCORED}, u AS (SELECT chunk_id, similarity, 0 AS leg FROM (SELECT * FROM scored ORDER BY similarity DESC, chunk_id LIMIT 10) UNION ALL SELECT chunk_id, similarity, 1 FROM (SELECT * FROM scored WHERE label = 2 ORDER BY similarity DESC, chunk_id LIMIT 12))
  SELECT chunk_id, similarity, min(leg)::INTEGER AS leg FROM u GROUP BY ALL ORDER BY similarity DESC, chunk_id LIMIT 14""",
)
register(
    "ret_weighted_relevance",
    lambda s, d: R.weighted_relevance(_per_group(s, d), "label"),
    f"WITH {SCORED} SELECT label, round(sum(similarity / rank) / sum(1.0 / rank), 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5 GROUP BY label",
)
