"""Queries of prompts, replies of models, dependency views and the service's functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scoring as S
from quern.operators import generation as G
from quern.plans.augmented import _scored, chunks
from quern.plans.catalog import register, table
from quern.plans.decisions import _replies
from quern.plans.knowledge import _EDGES, _graph
from quern.plans.phrases import ASKED, asked
from quern.plans.retrieval import query_vector
from quern.plans.scoring import CLASSIFIED


def _hits(spark, d):
    """Turns as hits of questions that have the conversations' numbers."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("content"))
    return c.select(F.col("conv_id").alias("o_orderkey"), (F.col("turn") + 1).cast("int").alias("rank"), F.concat(F.lit("doc-"), F.col("turn") % 2).alias("document_id"), F.when(F.col("turn") % 2 == 0, "Sec").alias("section"), "content", (F.length("content") / 4).cast("int").alias("tokens"))


_PROMPTS = f"""{ASKED}, h AS (SELECT conv_id AS o_orderkey, (turn + 1)::INTEGER AS rank, 'doc-' || (turn % 2) AS document_id, CASE WHEN turn % 2 = 0 THEN 'Sec' END AS section, coalesce(min(text), '') AS content FROM conversations GROUP BY conv_id, turn), t AS (SELECT *, sum(length(content) // 4) OVER (PARTITION BY o_orderkey ORDER BY rank) AS t FROM h),
  c AS (SELECT o_orderkey, string_agg('[' || rank || '] ' || upper(document_id) || CASE WHEN section <> '' THEN ', ' || section ELSE '' END || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS hits FROM t WHERE t <= 60 GROUP BY o_orderkey),
  p AS (SELECT o_orderkey, '{G.MODES['cited']}' || chr(10) || chr(10) || '<context>' || chr(10) || coalesce(context, '') || chr(10) || '</context>' || chr(10) || chr(10) || '<question>' || chr(10) || q || chr(10) || '</question>' AS prompt, coalesce(hits, 0) AS hits FROM q LEFT JOIN c USING (o_orderkey))"""


def _prompts(spark, d):
    return G.prompts(asked(spark, d).select("o_orderkey", "q"), _hits(spark, d), "o_orderkey", "q", "cited", 60)


register("svc_prompts", _prompts, f"WITH {_PROMPTS} SELECT * FROM p")
_FOUND = "regexp_extract_all(prompt, '(?m)^\\[(\\d+)\\] [^\\n]*\\n([^.!?]+[.!?])', {})"
register(
    "svc_answers",
    lambda s, d: G.completed(_prompts(s, d)).select("o_orderkey", "response", "tokens_in", "tokens_out"),
    f"""WITH {_PROMPTS}, f AS (SELECT o_orderkey, prompt, {_FOUND.format(1)}[1:2] AS n, {_FOUND.format(2)}[1:2] AS s FROM p), r AS (SELECT o_orderkey, prompt, CASE WHEN len(n) = 0 THEN 'The context doesn''t say.' ELSE array_to_string(list_transform(range(1, len(n) + 1), lambda i: left(trim(s[i], ' ' || chr(10) || chr(9) || chr(13)), length(trim(s[i], ' ' || chr(10) || chr(9) || chr(13))) - 1) || ' [' || n[i] || '].'), ' ') END AS response FROM f)
  SELECT o_orderkey, response, (length(prompt) // 4 + 1)::INTEGER AS tokens_in, (length(response) // 4 + 1)::INTEGER AS tokens_out FROM r""",
)
_KINDS = ('Sure: {"query_type": "COMPLEX", "confidence": 0.{a}, "estimated_sub_questions": 3}', '{"query_type": "odd"}', "no json {a}", '{"query_type": ')


def _classified(spark, d):
    both = _replies(spark, d, _KINDS).join(asked(spark, d).select("o_orderkey", "q"), "o_orderkey")
    return both.select("o_orderkey", G.classified_reply(F.col("r"), S.classified(F.col("q"))).alias("k")).select("o_orderkey", "k.*")


register(
    "svc_model_classification",
    _classified,
    f"""WITH {CLASSIFIED} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'complex' WHEN 1 THEN 'simple' ELSE kind END AS kind, CASE o_orderkey % 4 WHEN 0 THEN ('0.' || (o_orderkey % 97))::DOUBLE WHEN 1 THEN 0.8 ELSE confidence END::DOUBLE AS confidence, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE sub_questions END::INTEGER AS sub_questions, o_orderkey % 4 < 2 AS parsed FROM classified""",
)
_PARTS = ('Well: {"sub_questions": [{"text": "a {a}", "entity": "EIP-{a}", "focus": "f"}, {"text": "b"}], "synthesis_strategy": "Comparison"}', '{"sub_questions": [{"text": "x"}], "synthesis_strategy": "odd"}', "broken {a}")


def _parts(spark, d):
    return G.decomposed_reply(_replies(spark, d, _PARTS).join(asked(spark, d).select("o_orderkey", "q"), "o_orderkey"), "o_orderkey", "r", "q")


register(
    "svc_model_decomposition",
    _parts,
    f"""WITH {ASKED} SELECT o_orderkey, n::INTEGER AS index, CASE WHEN k = 2 THEN q ELSE replace(text, '{{a}}', (o_orderkey % 97)::VARCHAR) END AS text, replace(entity, '{{a}}', (o_orderkey % 97)::VARCHAR) AS entity, focus, strategy FROM q JOIN (VALUES (0, 0, 'a {{a}}', 'EIP-{{a}}', 'f', 'comparison'), (0, 1, 'b', NULL, NULL, 'comparison'), (1, 0, 'x', NULL, NULL, 'explanation'), (2, 0, '', NULL, NULL, 'explanation')) v(k, n, text, entity, focus, strategy) ON o_orderkey % 3 = k""",
)
_FACTS = ('{"facts": ["one {a}", "  ", " two "]}', "As asked: {\"facts\": [\"three\"]} ok", "none {a}")
register(
    "svc_model_facts",
    lambda s, d: G.fact_reply(_replies(s, d, _FACTS).withColumn("claim", F.concat(F.lit("claim "), "o_orderkey")), "o_orderkey", "r", "claim"),
    "SELECT o_orderkey, n::INTEGER AS n, CASE WHEN k = 2 THEN 'claim ' || o_orderkey ELSE replace(f, '{a}', (o_orderkey % 97)::VARCHAR) END AS fact FROM orders JOIN (VALUES (0, 0, 'one {a}'), (0, 1, 'two'), (1, 0, 'three'), (2, 0, '')) v(k, n, f) ON o_orderkey % 3 = k",
)
_LISTS = ('["Gas {a}", "", "Status"]', "x [\"A\"] y", "nothing {a}")
register(
    "svc_dimensions",
    lambda s, d: _replies(s, d, _LISTS).select("o_orderkey", F.array_join(G.dimensions(F.col("r")), "|").alias("dimensions")),
    f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Gas ' || (o_orderkey % 97) || '|Status' WHEN 1 THEN 'A' ELSE '{'|'.join(G.DIMENSIONS)}' END AS dimensions FROM orders",
)
_EVENTS = ('Here: [{"date": "2021-03-04", "event": "e{a}", "source": "Source 2", "confidence": "High"}, {"date": "", "event": "x"}, {"date": "Q2 2020", "event": "f", "source": 9}]', '[{"date": "March 5, 2022", "event": "g", "confidence": "odd"}, {"date": "soon", "event": "h", "source": "0", "confidence": "low"}]', "no events")


def _events(spark, d):
    sources = table(spark, d, "orders").select("o_orderkey", F.array(F.lit("eip-1"), F.lit("eth-magicians-2"), F.lit("Research/3")).alias("documents"))
    return G.events(_replies(spark, d, _EVENTS), sources, "o_orderkey", "r").withColumn("day", F.col("day").cast("string"))


register(
    "svc_timeline_events",
    _events,
    "SELECT o_orderkey, day, date, replace(event, '{a}', (o_orderkey % 97)::VARCHAR) AS event, document_id, source_type, confidence::DOUBLE AS confidence FROM orders JOIN (VALUES (0, '2021-03-04', '2021-03-04', 'e{a}', 'eth-magicians-2', 'forum', 0.9), (0, '2020-04-01', 'Q2 2020', 'f', 'Research/3', 'research', 0.7), (1, '2022-03-05', 'March 5, 2022', 'g', 'eip-1', 'eip', 0.7), (1, NULL, 'soon', 'h', 'eip-1', 'eip', 0.5)) v(k, day, date, event, document_id, source_type, confidence) ON o_orderkey % 3 = k",
)


def _roots(spark):
    return spark.createDataFrame([(n,) for n in (24, 10)], "root bigint")


_VIEW = f"""{_EDGES}, r(root) AS (VALUES (24::BIGINT), (10::BIGINT)), e AS (SELECT src, dst FROM edges WHERE type = 'REQUIRES'), u AS (SELECT src, dst FROM edges WHERE type = 'SUPERSEDES'), up(id, depth) AS (SELECT dst, 1 FROM e JOIN r ON src = root UNION SELECT e.dst, up.depth + 1 FROM up JOIN e ON e.src = up.id WHERE up.depth < 3), down(id, depth) AS (SELECT src, 1 FROM e JOIN r ON dst = root UNION SELECT e.src, down.depth + 1 FROM down JOIN e ON e.dst = down.id WHERE down.depth < 3),
  a AS (SELECT id, min(depth) AS depth FROM up GROUP BY id), b AS (SELECT id, min(depth) AS depth FROM down GROUP BY id), x AS (SELECT root AS id, 0 AS k, NULL AS depth FROM r UNION ALL SELECT id, 1, depth FROM a UNION ALL SELECT id, 2, depth FROM b UNION ALL SELECT dst, 3, NULL FROM u JOIN r ON src = root UNION ALL SELECT src, 4, NULL FROM u JOIN r ON dst = root)"""
register(
    "svc_view_nodes",
    lambda s, d: G.view_nodes(_graph(s, d)[1], _graph(s, d)[0], _roots(s)),
    f"WITH RECURSIVE {_VIEW}, n AS (SELECT id, min(k) AS k FROM x GROUP BY id) SELECT n.id, 'EIP-' || n.id AS label, ({list(G._KINDS)})[n.k + 1] AS kind, (SELECT min(x.depth) FROM x WHERE x.id = n.id AND x.k = n.k)::INTEGER AS depth, title, status FROM n LEFT JOIN props ON number = n.id",
)
register(
    "svc_view_edges",
    lambda s, d: G.view_edges(_graph(s, d)[1], _roots(s)),
    f"""WITH RECURSIVE {_VIEW}, w AS (SELECT src, dst, 'REQUIRES' AS type, 1.0 AS weight FROM e WHERE src IN (SELECT root FROM r) OR dst IN (SELECT root FROM r) UNION ALL SELECT src, dst, 'SUPERSEDES', 0.8 FROM u WHERE src IN (SELECT root FROM r) OR dst IN (SELECT root FROM r)
  UNION ALL SELECT min(src), dst, 'REQUIRES', round(1 / any_value(depth), 6) FROM e JOIN a ON dst = id WHERE depth > 1 AND src IN (SELECT id FROM x) GROUP BY dst UNION ALL SELECT src, min(dst), 'REQUIRES', round(1 / any_value(depth), 6) FROM e JOIN b ON src = id WHERE depth > 1 AND dst IN (SELECT id FROM x) GROUP BY src) SELECT src, dst, type, max(weight)::DOUBLE AS weight FROM w GROUP BY ALL""",
)
register("svc_view_d3", lambda s, d: G.d3(G.view_nodes(_graph(s, d)[1], _graph(s, d)[0], _roots(s)), G.view_edges(_graph(s, d)[1], _roots(s))).groupBy("part").agg(F.count("*").alias("n"), F.max(F.get_json_object("json", "$.target")).alias("last")), f"""WITH RECURSIVE {_VIEW}, w AS (SELECT src, dst, 1 AS k FROM e WHERE src IN (SELECT root FROM r) OR dst IN (SELECT root FROM r) UNION SELECT src, dst, 2 FROM u WHERE src IN (SELECT root FROM r) OR dst IN (SELECT root FROM r) UNION SELECT min(src), dst, 1 FROM e JOIN a ON dst = id WHERE depth > 1 AND src IN (SELECT id FROM x) GROUP BY dst UNION SELECT src, min(dst), 1 FROM e JOIN b ON src = id WHERE depth > 1 AND dst IN (SELECT id FROM x) GROUP BY src)
  SELECT 'nodes' AS part, count(DISTINCT id) AS n, NULL AS last FROM x UNION ALL SELECT 'links', count(*), max('eip-' || dst) FROM w""")


def _served(spark, d):
    c = chunks(spark, d)
    return c.select("chunk_id", F.concat(F.lit("eip-"), "number").alias("document_id"), "embedding", F.concat(F.lit("chunk "), "chunk_id").alias("content"), F.expr("chunk_id div 120").alias("chunk_index"))


register("svc_search", lambda s, d: G.search(_served(s, d), query_vector(s, d), 3, "eip-7"), f"SELECT chunk_id, 'eip-7' AS document_id, similarity, 'chunk ' || chunk_id AS preview FROM {_scored(0)} WHERE number = 7 ORDER BY similarity DESC, chunk_id LIMIT 3")


def _documents(spark, d):
    return _graph(spark, d)[0].select(F.concat(F.lit("eip-"), "number").alias("document_id"), "title")


register("svc_proposal", lambda s, d: G.proposal(_documents(s, d), _served(s, d), 9).select("document_id", "title", F.array_join(F.transform("chunks", lambda c: c["preview"]), "|").alias("chunks")), "SELECT 'eip-9' AS document_id, p_name AS title, (SELECT string_agg('chunk ' || vec_id, '|' ORDER BY vec_id) FROM embeddings WHERE vec_id % 120 = 9) AS chunks FROM part WHERE p_partkey = 9")
register("svc_stats", lambda s, d: G.corpus_stats(_documents(s, d), _served(s, d)), "SELECT (SELECT count(*) FROM part) AS documents, (SELECT count(*) FROM embeddings) AS chunks")
register("svc_price_list", lambda s, d: G.price_list(s), "SELECT * FROM (VALUES ('fast', 0.8::DOUBLE, 4.0::DOUBLE), ('balanced', 3.0, 15.0), ('powerful', 15.0, 75.0)) v(model, input, output)")
register("svc_query_modes", lambda s, d: G.query("simple", {"simple": lambda: G.search(_served(s, d), query_vector(s, d), 10)}).select("chunk_id"), f"SELECT chunk_id FROM {_scored(0)} ORDER BY similarity DESC, chunk_id LIMIT 10")
