"""Queries of augmented retrieval. Embeddings are chunks of proposals (their number modulo 120); parts are the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import augmented as A
from quern.operators import retrieval as R
from quern.plans.catalog import register, table
from quern.plans.knowledge import _EDGES, _graph
from quern.plans.phrases import ASKED, asked, sql_any
from quern.plans.retrieval import query_vector

MENTIONS = [24, 10]


def chunks(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 120).alias("number"), "embedding", (F.col("vec_id") % 7 * 150 + 50).cast("int").alias("tokens"))


def _scored(vec: int) -> str:
    return f"(SELECT e.vec_id AS chunk_id, e.vec_id % 120 AS number, (e.vec_id % 7 * 150 + 50)::INTEGER AS tokens, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) q)"


def _seeds(ids: str) -> str:
    """Closures of depth 2 both ways and supersessions of seeds, and their order."""
    return f"""seeds AS ({ids}), e AS (SELECT src, dst FROM edges WHERE type = 'REQUIRES'), u AS (SELECT src, dst FROM edges WHERE type = 'SUPERSEDES'),
  d1 AS (SELECT id AS seed, dst AS id FROM seeds JOIN e ON src = seeds.id), d2 AS (SELECT seed, dst FROM d1 JOIN e ON src = d1.id), r1 AS (SELECT seeds.id AS seed, src AS id FROM seeds JOIN e ON dst = seeds.id), r2 AS (SELECT seed, src FROM r1 JOIN e ON dst = r1.id), s1 AS (SELECT seeds.id AS seed, dst AS id FROM seeds JOIN u ON src = seeds.id), s2 AS (SELECT seeds.id AS seed, src AS id FROM seeds JOIN u ON dst = seeds.id),
  related AS (SELECT id FROM d1 UNION SELECT dst FROM d2 UNION SELECT id FROM r1 UNION SELECT src FROM r2 UNION SELECT id FROM s1 UNION SELECT id FROM s2),
  near AS (SELECT id, min(seed * 10 + k) AS rank FROM (SELECT *, 0 AS k FROM d1 UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM s1 UNION ALL SELECT *, 3 FROM s2) GROUP BY id)"""


register(
    "aug_graph_retrieval",
    lambda s, d: A.graph_augmented(chunks(s, d), _graph(s, d)[1], query_vector(s, d), MENTIONS),
    f"""WITH {_EDGES}, scored AS {_scored(0)}, p AS (SELECT * FROM scored ORDER BY similarity DESC, chunk_id LIMIT 10), {_seeds("SELECT DISTINCT number AS id FROM (SELECT number FROM p ORDER BY similarity DESC, chunk_id LIMIT 3) UNION SELECT unnest([24, 10])")},
  few AS (SELECT id FROM related LEFT JOIN near USING (id) ORDER BY rank NULLS LAST, id LIMIT 5), n AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY similarity DESC, chunk_id) AS k FROM scored WHERE number IN (SELECT id FROM few)),
  b AS (SELECT chunk_id, number, similarity, false AS related FROM p UNION ALL SELECT chunk_id, number, similarity, true FROM n WHERE k <= 5 AND chunk_id NOT IN (SELECT chunk_id FROM p)) SELECT * FROM b ORDER BY similarity DESC, chunk_id LIMIT (SELECT 10 + 2 * count(*) FROM few)""",
)


def _seed_rows(spark):
    return spark.createDataFrame([(n,) for n in (24, 10, 5000001)], "root bigint")


def _context(spark, d):
    nodes, edges = _graph(spark, d)
    return A.graph_context(edges, nodes, _seed_rows(spark))


_LISTS = {"dependencies": "SELECT seed, id FROM d1", "dependents": "SELECT seed, id FROM r1", "supersedes": "SELECT seed, id FROM s1", "superseded_by": "SELECT seed, id FROM s2", "all_dependencies": "SELECT seed, id FROM d1 UNION SELECT seed, dst FROM d2", "all_dependents": "SELECT seed, id FROM r1 UNION SELECT seed, src FROM r2"}
_CONTEXT = f"{_EDGES}, {_seeds('SELECT unnest([24, 10, 5000001]) AS id')}, context AS (SELECT id AS root, id IN (SELECT number FROM props) AS known, " + ", ".join(f"coalesce((SELECT list(DISTINCT x.id ORDER BY x.id) FROM ({q}) x WHERE x.seed = seeds.id), []) AS {n}" for n, q in _LISTS.items()) + " FROM seeds)"
register(
    "aug_graph_context",
    lambda s, d: _context(s, d).select("root", "known", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in _LISTS]),
    f"WITH {_CONTEXT} SELECT root::BIGINT AS root, known, " + ", ".join(f"array_to_string({n}, ',') AS {n}" for n in _LISTS) + " FROM context",
)
_SPELL = "array_to_string(list_transform({}, lambda x: 'EIP-' || x), ', ')"
register(
    "aug_relationship_summary",
    lambda s, d: A.relationship_summary(_context(s, d), 2),
    f"""WITH {_CONTEXT} SELECT root::BIGINT AS root, array_to_string(list_filter([CASE WHEN len(dependencies) > 0 THEN '- EIP-' || root || ' requires: ' || {_SPELL.format('dependencies')} END, CASE WHEN len(dependents) > 0 THEN '- EIP-' || root || ' is required by: ' || {_SPELL.format('dependents[1:2]')} || CASE WHEN len(dependents) > 2 THEN ' (and ' || (len(dependents) - 2) || ' more)' ELSE '' END END,
  CASE WHEN len(supersedes) > 0 THEN '- EIP-' || root || ' supersedes: ' || {_SPELL.format('supersedes')} END, CASE WHEN len(superseded_by) > 0 THEN '- EIP-' || root || ' is superseded by: ' || {_SPELL.format('superseded_by')} END], lambda x: x IS NOT NULL), chr(10)) AS summary FROM context""",
)
_PARTS = (("What is EIP-24?", "EIP-24", 0), ("How does it work", "eip-7", 3), ("And then", None, 8), ("At last", None, 21))


def _staged(spark, d):
    vectors = {r.vec_id: list(r.embedding or []) for r in table(spark, d, "embeddings").where(F.col("vec_id").isin(*[v for *_, v in _PARTS])).collect()}
    return A.staged(chunks(spark, d), [(t, e, vectors.get(v, [])) for t, e, v in _PARTS], 5, 14, 4000)


def _staged_sql() -> str:
    """Each sub-question's share follows from what the ones before it used."""
    out = ""
    total_c, total_t = "0", "0"
    for j, (text, entity, v) in enumerate(_PARTS):
        query = text if not entity or entity.upper() in text.upper() else f"{entity}: {text}"
        left, room, open_ = f"(14 - ({total_c}))", f"(4000 - ({total_t}))", len(_PARTS) - j
        out += f"""{', ' if out else ''}o{j} AS (SELECT chunk_id, similarity, tokens, row_number() OVER o AS rank, sum(tokens) OVER o AS s FROM {_scored(v)} WINDOW o AS (ORDER BY similarity DESC, chunk_id)), k{j} AS (SELECT * FROM o{j} WHERE {left} > 0 AND {room} > 0 AND rank <= greatest(1, least(5, {left} // {open_})) AND s <= greatest(500, {room} // {open_})),
  u{j} AS (SELECT CASE WHEN count(*) <= {left} AND coalesce(sum(tokens), 0) <= {room} THEN count(*) ELSE 0 END AS c, CASE WHEN count(*) <= {left} AND coalesce(sum(tokens), 0) <= {room} THEN coalesce(sum(tokens), 0) ELSE 0 END AS t, '{query}' AS q FROM k{j})"""
        total_c, total_t = f"{total_c} + (SELECT c FROM u{j})", f"{total_t} + (SELECT t FROM u{j})"
    return "WITH " + out + " " + " UNION ALL ".join(f"SELECT {j}::INTEGER AS part, u{j}.q AS query, chunk_id, similarity, tokens, rank::INTEGER AS rank FROM k{j}, u{j}" for j in range(len(_PARTS)))


register("aug_staged_retrieval", _staged, _staged_sql())
register("aug_staged_summary", lambda s, d: A.staged_summary(_staged(s, d)), f"SELECT part, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, round(avg(similarity), 6) AS mean FROM ({_staged_sql()}) GROUP BY part")
_NAMES = ("getFee", "NewBlob", "test_merge", "setState", "is_valid", "handleTx", "decodeRlp", "marshalJson", "Header", "feeOf")


def _code(spark, d):
    n = F.col("chunk_id")
    rows = R.vector_topk(chunks(spark, d), query_vector(spark, d), 20).select("chunk_id", "similarity")
    name = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (n % 10 + 1).cast("int")), F.when(n % 4 == 0, "Eip24").otherwise(""))
    return rows.select("chunk_id", "similarity", name.alias("name"), F.concat(F.lit("func "), name, F.when(n % 3 == 0, F.lit("() { // EIP-24 }")).when(n % 3 == 1, F.lit("() { struct }")).otherwise(F.lit("() {}"))).alias("content"))


_CODE = f"""code AS (SELECT *, 'func ' || name || CASE chunk_id % 3 WHEN 0 THEN '() {{ // EIP-24 }}' WHEN 1 THEN '() {{ struct }}' ELSE '() {{}}' END AS content FROM (SELECT chunk_id, similarity, ({list(_NAMES)})[chunk_id % 10 + 1] || CASE WHEN chunk_id % 4 = 0 THEN 'Eip24' ELSE '' END AS name FROM {_scored(0)} ORDER BY similarity DESC, chunk_id LIMIT 20))"""
register(
    "aug_code_implementations",
    lambda s, d: A.boosted(_code(s, d), 24, 12),
    f"WITH {_CODE} SELECT chunk_id, name, content, round(least(similarity + CASE WHEN regexp_matches(lower(content), 'eip-?24') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(name), 'eip-?24') THEN 0.1 ELSE 0 END, 1.0), 6)::DOUBLE AS similarity FROM code ORDER BY similarity DESC, chunk_id LIMIT 12",
)
register("aug_code_by_name", lambda s, d: A.named(_code(s, d), "getfee").select("chunk_id", "name", "exact"), f"WITH {_CODE} SELECT chunk_id, name, lower(name) = 'getfee' AS exact FROM code WHERE contains(lower(name), 'getfee') ORDER BY exact DESC, similarity DESC, chunk_id LIMIT 10")
_KIND = "CASE " + " ".join(f"WHEN {sql_any(words, 'lower(name)')} THEN '{kind}'" for kind, words in A.NAME_KINDS) + " WHEN contains(lower(content), 'struct') OR contains(lower(content), 'type ') THEN 'type_definition' ELSE 'function' END"
register("aug_code_kinds", lambda s, d: _code(s, d).select("chunk_id", A.code_kind(F.col("name"), F.col("content")).alias("kind")), f"WITH {_CODE} SELECT chunk_id, {_KIND} AS kind FROM code")
register(
    "aug_code_text",
    lambda s, d: _code(s, d).select("chunk_id", A.code_text(F.concat(F.lit("src/"), "chunk_id"), F.col("name"), F.when(F.col("chunk_id") % 2 == 0, F.array(*[F.lit(x) for x in "abcdef"])).otherwise(F.array().cast("array<string>")), F.lit("go"), F.col("content")).alias("text")),
    f"WITH {_CODE} SELECT chunk_id, 'File: src/' || chunk_id || chr(10) || 'Function: ' || name || CASE WHEN chunk_id % 2 = 0 THEN chr(10) || 'Dependencies: a, b, c, d, e' ELSE '' END || chr(10) || chr(10) || '```go' || chr(10) || content || chr(10) || '```' AS text FROM code",
)
register("aug_code_query", lambda s, d: asked(s, d).select("o_orderkey", A.code_query(F.col("q")).alias("q")), f"WITH {ASKED} SELECT o_orderkey, CASE WHEN {sql_any(A.CODE_WORDS, 'lower(q)')} THEN q ELSE 'Ethereum client code implementation: ' || q END AS q FROM q")
_QUERY = "func newblob with a struct"
_WORDSET = "list_distinct(regexp_extract_all(lower({}), '[^ \\t\\n\\f\\r\\x0b]+'))"
register(
    "aug_rerank",
    lambda s, d: A.reranked(_code(s, d), _QUERY, A.lexical, 8).select("chunk_id", "original_index", "relevance"),
    f"""WITH {_CODE}, r AS (SELECT chunk_id, (row_number() OVER (ORDER BY similarity DESC, chunk_id) - 1)::INTEGER AS original_index, {_WORDSET.format(f"'{_QUERY}'")} AS a, {_WORDSET.format('content')} AS b FROM code)
  SELECT chunk_id, original_index, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS relevance FROM r ORDER BY relevance DESC, original_index LIMIT 8""",
)
register(
    "aug_agent_graph",
    lambda s, d: A.agent_graph(chunks(s, d), _graph(s, d)[1], query_vector(s, d), MENTIONS),
    f"""WITH {_EDGES}, scored AS {_scored(0)}, p AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS place FROM scored), {_seeds('SELECT unnest([24, 10]) AS id')}, few AS (SELECT id FROM related ORDER BY id LIMIT 3),
  n AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY similarity DESC, chunk_id) AS k FROM scored WHERE number IN (SELECT id FROM few)), l AS (SELECT chunk_id, number, similarity, 5 + row_number() OVER (ORDER BY number, k) AS place FROM n WHERE k <= 2)
  SELECT chunk_id, number, similarity, place::INTEGER AS place FROM (SELECT chunk_id, number, similarity, place FROM p WHERE place <= 5 UNION ALL SELECT * FROM l WHERE chunk_id NOT IN (SELECT chunk_id FROM p WHERE place <= 5)) ORDER BY place LIMIT 10""",
)
register("aug_agent_modes", lambda s, d: A.agent_retrieval("hybrid", {"vector": lambda: R.vector_topk(chunks(s, d), query_vector(s, d), 5)}).select("chunk_id"), f"SELECT chunk_id FROM {_scored(0)} ORDER BY similarity DESC, chunk_id LIMIT 5")
register(
    "aug_headline",
    lambda s, d: table(s, d, "documents").select("doc_id", A.headline(F.col("text"), ["the", "de", "der"]).alias("headline")),
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0b]+') AS w FROM documents), h AS (SELECT doc_id, w, list_transform(w, lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}_]', '', 'g')) IN ('the', 'de', 'der')) AS h FROM w),
  b AS (SELECT doc_id, w, h, greatest(least(coalesce(nullif(list_position(h, true), 0), 1), len(w) - 24), 1) AS b FROM h) SELECT doc_id, array_to_string(list_transform(range(b, least(b + 49, len(w)) + 1), lambda i: CASE WHEN h[i] THEN '<mark>' || w[i] || '</mark>' ELSE w[i] END), ' ') AS headline FROM b""",
)


def _lines(spark, d):
    """Turns as hits of their conversations."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("content"))
    return c.select("conv_id", (F.col("turn") + 1).cast("int").alias("rank"), (F.col("turn") % 3).cast("int").alias("part"), F.concat(F.lit("doc-"), F.col("turn") % 2).alias("document_id"), F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, None).otherwise("Sec").alias("section"), F.coalesce("content", F.lit("")).alias("content"))


_LINES = "l AS (SELECT conv_id, (turn + 1)::INTEGER AS rank, (turn % 3)::INTEGER AS part, 'doc-' || (turn % 2) AS document_id, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Sec' END AS section, coalesce(min(text), '') AS content FROM conversations GROUP BY ALL)"
register(
    "aug_agent_context",
    lambda s, d: A.agent_context(_lines(s, d), "conv_id", 5),
    f"WITH {_LINES} SELECT conv_id, string_agg('[' || rank || '] [' || upper(document_id) || CASE WHEN coalesce(section, '') <> '' THEN ' (' || section || ')' ELSE '' END || ']' || chr(10) || left(content, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM l WHERE rank <= 5 GROUP BY conv_id",
)
register(
    "aug_staged_context",
    lambda s, d: A.staged_context(_lines(s, d).withColumn("question", F.concat(F.lit("q"), "part")).withColumn("entity", F.when(F.col("part") == 1, "EIP-1")), "conv_id"),
    f"""WITH {_LINES}, p AS (SELECT conv_id, part, '=== Sub-question ' || (part + 1) || ': q' || part || ' ===' || CASE WHEN part = 1 THEN ' [Entity: EIP-1]' ELSE '' END || chr(10) || chr(10) || string_agg('[' || (part + 1) || '.' || rank || '] ' || upper(document_id) || CASE WHEN coalesce(section, '') <> '' THEN ' - ' || section ELSE '' END || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS t FROM l GROUP BY conv_id, part)
  SELECT conv_id, chr(10) || chr(10) || repeat('=', 60) || string_agg(t, chr(10) || chr(10) ORDER BY part) AS context FROM p GROUP BY conv_id""",
)
register(
    "aug_code_context",
    lambda s, d: A.code_context(_lines(s, d).select("conv_id", "rank", F.lit("function").alias("kind"), F.concat(F.lit("f"), "rank").alias("name"), F.lit("a.go").alias("path"), F.col("rank").alias("start_line"), (F.col("rank") + 4).alias("end_line"), "content"), "conv_id"),
    f"WITH {_LINES} SELECT conv_id, string_agg('[FUNCTION] f' || rank || ' (a.go:' || rank || '-' || (rank + 4) || ')' || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM l GROUP BY conv_id",
)
register("aug_unique_documents", lambda s, d: A.unique_documents(_lines(s, d), "conv_id"), f"WITH {_LINES} SELECT conv_id, document_id, arg_min(struct_pack(s := section), rank).s AS section, row_number() OVER (PARTITION BY conv_id ORDER BY min(rank))::INTEGER AS place FROM l GROUP BY conv_id, document_id")
