"""Queries of text functions and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.operators.knowledge import reference_id
from quern.plans.catalog import register, table
from quern.plans.retrieval import CHUNKS, WORDS, chunks

_W = WORDS.format("text")
register(
    "txt_tokens_shingles",
    lambda s, d: table(s, d, "documents").withColumn("w", T.tokens(F.col("text"))).select("doc_id", F.size("w").alias("tokens"), F.size(T.shingles(F.col("w"), 3)).alias("shingles")),
    f"WITH t AS (SELECT doc_id, {_W} AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS tokens, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i+2], ' ')))) END::INTEGER AS shingles FROM t",
)
register("txt_content_hash", lambda s, d: chunks(s, d).select("chunk_id", T.content_hash(F.col("content")).alias("hash")), f"WITH {CHUNKS} SELECT chunk_id, left(sha256(content), 16) AS hash FROM chunks")
register(
    "txt_sentences",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).select("doc_id", "n", F.length("sentence").alias("length")),
    "SELECT doc_id, (i - 1)::INTEGER AS n, length(trim(l[i], ' '))::INTEGER AS length FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]+') AS l FROM documents))",
)
register("txt_preview", lambda s, d: table(s, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview")), "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
register("txt_rough_tokens", lambda s, d: table(s, d, "documents").select("doc_id", T.rough_tokens(F.col("text")).alias("tokens")), "SELECT doc_id, (length(text) // 4 + 1)::INTEGER AS tokens FROM documents")
register(
    "txt_slug",
    lambda s, d: table(s, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug")),
    r"SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s-]', '', 'g'), '[\s-]+', '-', 'g'), 50) AS slug FROM documents",
)
register(
    "txt_reference_id",
    lambda s, d: table(s, d, "documents").select("doc_id", reference_id(F.col("text")).alias("ref")),
    r"""WITH t AS (SELECT doc_id, text, regexp_replace(trim(lower(left(text, 100)), ' '), '\s+', ' ', 'g') AS t, regexp_extract(text, '(?i)arXiv[:\s]*(\d{4}\.\d{4,5}(?:v\d+)?)', 1) AS a, regexp_extract(text, '10\.\d{4,}/[^\s]+') AS d FROM documents) SELECT doc_id, CASE WHEN a <> '' THEN 'arxiv:' || a WHEN d <> '' THEN 'doi:' || d WHEN length(t) > 20 THEN 'ref:' || left(md5(t), 12) END AS ref FROM t""",
)


def _numbered(spark, d):
    """Texts that mention proposals, made of the orders' keys."""
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("See EIP-"), F.col("o_orderkey") % 50, F.lit(" and eip "), F.col("o_custkey") % 7, F.lit(", eip-"), F.col("o_orderkey") % 50, F.lit(" as of "), F.col("o_orderdate").cast("date"), F.lit(" ["), F.col("o_orderkey") % 5, F.lit(", 2] or ["), F.col("o_custkey") % 9, F.lit("].")).alias("t"))


_N = "n AS (SELECT o_orderkey, 'See EIP-' || (o_orderkey % 50) || ' and eip ' || (o_custkey % 7) || ', eip-' || (o_orderkey % 50) || ' as of ' || o_orderdate::DATE || ' [' || (o_orderkey % 5) || ', 2] or [' || (o_custkey % 9) || '].' AS t FROM orders)"
register(
    "txt_mention_numbers",
    lambda s, d: _numbered(s, d).select("o_orderkey", F.array_join(T.numbers(F.col("t")).cast("array<string>"), ",").alias("numbers")),
    f"WITH {_N} SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)eip[- ]?(\\d+)', 1), lambda x: x::INTEGER))), ',') AS numbers FROM n",
)
register(
    "txt_citation_markers",
    lambda s, d: _numbered(s, d).select("o_orderkey", F.explode(T.markers(F.col("t"))).alias("marker")),
    f"WITH {_N} SELECT o_orderkey, unnest(flatten(list_transform(regexp_extract_all(t, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda m: list_transform(regexp_extract_all(m, '\\d+'), lambda x: x::INTEGER)))) AS marker FROM n",
)
register(
    "txt_word_f1",
    lambda s, d: chunks(s, d).withColumn("b", F.lead("content").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("doc_id").orderBy("idx"))).where("b IS NOT NULL").select("chunk_id", F.round(T.word_f1(T.tokens(F.col("content")), T.tokens(F.col("b"))), 6).alias("f1"), F.round(T.jaccard(T.tokens(F.col("content")), T.tokens(F.col("b"))), 6).alias("jaccard")),
    f"""WITH {CHUNKS}, p AS (SELECT chunk_id, list_distinct({WORDS.format('content')}) AS a, list_distinct({WORDS.format('b')}) AS b FROM (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM chunks) WHERE b IS NOT NULL),
  q AS (SELECT chunk_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i FROM p)
  SELECT chunk_id, CASE WHEN i = 0 THEN 0.0 ELSE round(2 * (i / na) * (i / nb) / (i / na + i / nb), 6) END::DOUBLE AS f1, CASE WHEN na + nb - i = 0 THEN 0.0 ELSE round(i / (na + nb - i), 6) END::DOUBLE AS jaccard FROM q""",
)
register(
    "chk_fixed_windows",
    lambda s, d: C.fixed(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), 512, 64).select("document_id", "chunk_index", "token_count", "content"),
    f"""WITH t AS (SELECT doc_id, text, {_W} AS w FROM documents), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, greatest(len(w) - 64, 1), 448) END) AS start FROM t)
  SELECT doc_id AS document_id, (start // 448)::INTEGER AS chunk_index, len(w[start + 1:start + 512])::INTEGER AS token_count, array_to_string(w[start + 1:start + 512], ' ') AS content FROM s""",
)
register(
    "chk_packed_lines",
    lambda s, d: C.packed(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), 128).select("document_id", "chunk_index", "token_count", F.md5("content").alias("hash")),
    f"""WITH RECURSIVE items AS (SELECT k, i, l[i] AS p, len({WORDS.format('l[i]')}) AS n FROM (SELECT k, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id AS k, string_split(text, chr(10)) AS l FROM documents))),
  g AS (SELECT k, i, n, 0 AS c, n AS used FROM items WHERE i = 1 UNION ALL SELECT t.k, t.i, t.n, CASE WHEN g.used + t.n > 128 THEN g.c + 1 ELSE g.c END, CASE WHEN g.used + t.n > 128 THEN t.n ELSE g.used + t.n END FROM g JOIN items t ON t.k = g.k AND t.i = g.i + 1),
  a AS (SELECT k, c, sum(n) AS n, string_agg(p, chr(10) ORDER BY i) AS t FROM (SELECT g.*, p FROM g JOIN items USING (k, i)) GROUP BY k, c) SELECT k AS document_id, (row_number() OVER (PARTITION BY k ORDER BY c) - 1)::INTEGER AS chunk_index, n::INTEGER AS token_count, md5(t) AS hash FROM a WHERE n > 0""",
)
_OVER = "x.n > 512 OR (g.open AND g.used + x.n > 512)"
register(
    "chk_conversation_pack",
    lambda s, d: C.packed_turns(table(s, d, "conversations").distinct().select(F.col("conv_id").alias("document_id"), "turn", F.concat_ws(": ", "role", "text").alias("text")), 512),
    f"""WITH RECURSIVE t AS (SELECT conv_id AS k, turn, concat_ws(': ', role, text) AS t FROM (SELECT DISTINCT * FROM conversations)), x AS (SELECT k, turn, row_number() OVER (PARTITION BY k ORDER BY turn, t) AS i, len({WORDS.format('t')}) AS n FROM t),
  g AS (SELECT k, i, n, turn, 0::BIGINT AS c, CASE WHEN n > 512 THEN CAST(ceil(n / 462) AS BIGINT) ELSE 0 END AS next, CASE WHEN n > 512 THEN 0 ELSE n END AS used, n <= 512 AS open FROM x WHERE i = 1
   UNION ALL SELECT x.k, x.i, x.n, x.turn, CASE WHEN {_OVER} THEN g.next + g.open::INTEGER ELSE g.next END, CASE WHEN x.n > 512 THEN g.next + g.open::INTEGER + CAST(ceil(x.n / 462) AS BIGINT) WHEN {_OVER} THEN g.next + 1 ELSE g.next END, CASE WHEN x.n > 512 THEN 0 WHEN g.open AND g.used + x.n <= 512 THEN g.used + x.n ELSE x.n END, x.n <= 512 FROM g JOIN x ON x.k = g.k AND x.i = g.i + 1)
  SELECT k AS document_id, c::INTEGER AS chunk_index, count(*) AS turns, sum(n)::BIGINT AS token_count, arg_min(turn, i) AS first_turn, arg_max(turn, i) AS last_turn FROM g WHERE n <= 512 GROUP BY k, c UNION ALL SELECT k, (c + u)::INTEGER, 1, least(462, n - u * 462), turn, turn FROM (SELECT *, unnest(range(0, CAST(ceil(n / 462) AS BIGINT))) AS u FROM g WHERE n > 512)""",
)
register(
    "chk_standard_chunk",
    lambda s, d: chunks(s, d).select("chunk_id", T.first_section(F.lit(""), F.col("lang"), F.col("source")).alias("section"), F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")).alias("token_count")),
    f"WITH {CHUNKS} SELECT chunk_id, coalesce(nullif('', ''), nullif(lang, ''), source) AS section, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))::INTEGER AS token_count FROM chunks",
)
