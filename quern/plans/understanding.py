"""Queries of query understanding: decomposition, complexity, triggers, escalation, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import understanding as U
from quern.plans.catalog import register, table
from quern.plans.phrases import ASKED, asked, sql_any, sql_sum
from quern.plans.scoring import CLASSIFIED, OUTPUT_TYPES

_IDS = "list_transform(regexp_extract_all(q, '(?i)eip-?(\\d+)', 1), lambda x: 'EIP-' || x)"
_STRATEGY = f"CASE WHEN len(ids) >= 2 AND regexp_matches(lower(q), '{U.COMPARES}') THEN 'comparison' WHEN len(ids) >= 2 AND regexp_matches(lower(q), '{U.EVOLVES}') THEN 'timeline' WHEN len(ids) >= 2 THEN 'aggregation' ELSE 'explanation' END"
register(
    "qry_decomposition",
    lambda s, d: U.decomposed(asked(s, d), "o_orderkey"),
    f"""WITH {ASKED}, i AS (SELECT o_orderkey, q, {_IDS} AS ids FROM q), t AS (SELECT *, {_STRATEGY} AS strategy FROM i),
  u AS (SELECT o_orderkey, q, strategy, unnest(range(0, len(e))) AS j, e FROM (SELECT *, CASE strategy WHEN 'comparison' THEN ids[1:2] WHEN 'explanation' THEN [NULL] ELSE ids END AS e FROM t)), v AS (SELECT o_orderkey, q, strategy, j::INTEGER AS index, e[j + 1] AS entity FROM u)
  SELECT o_orderkey, index, entity, strategy, CASE strategy """
    + " ".join(f"WHEN '{n}' THEN '{a}' || entity || '{b}'" for n, (a, b, _) in U.SUB_QUESTIONS.items())
    + " ELSE q END AS text, CASE strategy "
    + " ".join(f"WHEN '{n}' THEN '{f}'" for n, (*_, f) in U.SUB_QUESTIONS.items())
    + " END AS focus FROM v",
)
register(
    "qry_sub_question_estimate",
    lambda s, d: asked(s, d).select("o_orderkey", U.sub_question_estimate(F.col("q")).alias("n")),
    f"WITH {ASKED} SELECT o_orderkey, (greatest(1, len(regexp_extract_all(lower(q), 'eip-?\\d+'))) + regexp_matches(q, '(?i)\\b(compare|versus|vs\\.?|difference)\\b')::INTEGER)::INTEGER AS n FROM q",
)


def _analysed(spark, d):
    out = U.analysed(asked(spark, d), "o_orderkey")
    return out.withColumn("signals", F.array_join("signals", ","))


_FOUND = ", ".join(f"{sql_sum(p, 'q')} > 0 AS f_{n}" for n, p in U.SIGNALS.items())
_LEVEL = "CASE WHEN f_simple AND NOT (f_multi_hop OR f_comparison OR f_timeline) THEN 'simple' WHEN s >= 6 THEN 'research' WHEN s >= 4 THEN 'complex' WHEN s >= 2 THEN 'moderate' ELSE 'simple' END"
register(
    "qry_complexity",
    _analysed,
    f"""WITH {ASKED}, f AS (SELECT o_orderkey, {_FOUND}, len(regexp_extract_all(lower(q), 'eip-?\\d+')) AS m, len(regexp_extract_all(q, '\\S+')) AS w FROM q),
  s AS (SELECT *, 2 * f_multi_hop::INTEGER + 2 * f_comparison::INTEGER + 2 * f_timeline::INTEGER + f_graph::INTEGER + greatest(m - 1, 0) + (w > 20)::INTEGER AS s FROM f), l AS (SELECT *, {_LEVEL} AS complexity FROM s)
  SELECT o_orderkey, complexity, CASE WHEN complexity = 'simple' THEN 'simple' WHEN f_graph THEN 'graph' WHEN complexity IN ('complex', 'research') THEN 'agentic' ELSE 'hybrid' END AS mode,
  array_to_string(list_filter([CASE WHEN f_simple THEN 'simple_pattern_match' END, CASE WHEN f_multi_hop THEN 'multi_hop_reasoning' END, CASE WHEN f_comparison THEN 'comparison_query' END, CASE WHEN f_timeline THEN 'timeline_query' END, CASE WHEN f_graph THEN 'graph_traversal_needed' END, CASE WHEN m > 1 THEN 'multiple_eip_refs_' || m END], lambda x: x IS NOT NULL), ',') AS signals,
  b.r AS max_retrievals, b.t AS max_tokens, b.c AS max_calls FROM l JOIN (VALUES {', '.join(f"('{n}', {r}, {t}, {c})" for n, (r, t, c) in U.BUDGETS.items())}) b(n, r, t, c) ON b.n = complexity""",
)


def _sure(spark, d):
    return asked(spark, d).withColumn("confidence", (F.col("o_custkey") % 100) / 100)


_STAKES = f"least({sql_sum(U.HIGH_STAKES, 'lower(q)')} * 0.25, 1.0)::DOUBLE"
TRIGGERS = f"""{CLASSIFIED}, x AS (SELECT *, (o_custkey % 100) / 100 AS sure, {_STAKES} AS stakes FROM classified),
  t AS (SELECT o_orderkey, 0 AS n, ((0.7::DOUBLE - sure) * 100) AS p, 'merge' AS strategy FROM x WHERE sure < 0.7 UNION ALL SELECT o_orderkey, 1, stakes * 50, 'vote' FROM x WHERE stakes >= 0.5 UNION ALL SELECT o_orderkey, 2, 40, 'merge' FROM x WHERE {sql_sum(U.THOROUGH, 'lower(q)')} > 0
  UNION ALL SELECT o_orderkey, 3, 45, 'vote' FROM x WHERE {sql_sum(U.CONFLICTS, 'lower(q)')} > 0 UNION ALL SELECT o_orderkey, 4, 35, 'merge' FROM x WHERE kind = 'multi_hop' UNION ALL SELECT o_orderkey, 5, 25, 'best' FROM x WHERE kind = 'complex' AND confidence < 0.7)"""
register("qry_triggers", lambda s, d: U.triggers(_sure(s, d), "o_orderkey"), f"WITH {TRIGGERS} SELECT o_orderkey, n::INTEGER AS n, trunc(p)::INTEGER AS priority, strategy FROM t")
register(
    "qry_ensemble",
    lambda s, d: U.ensembles(_sure(s, d), "o_orderkey"),
    f"""WITH {TRIGGERS}, r AS (SELECT o_orderkey, trunc(p)::INTEGER AS priority, strategy, row_number() OVER (PARTITION BY o_orderkey ORDER BY trunc(p) DESC, n) AS rank FROM t),
  v AS (SELECT o_orderkey, strategy, sum(priority) AS votes, min(rank) AS rank, max(priority) AS most FROM r GROUP BY ALL), b AS (SELECT o_orderkey, arg_max(strategy, votes * 1000 - rank) AS strategy, max(most) AS priority FROM v GROUP BY o_orderkey)
  SELECT x.o_orderkey, b.priority IS NOT NULL AS use_ensemble, coalesce(b.strategy, 'best') AS strategy, coalesce(b.priority, 0)::INTEGER AS priority, CASE WHEN b.priority IS NULL THEN '' WHEN b.priority >= 50 OR stakes >= 0.75 THEN 'fast,balanced,powerful' WHEN b.priority >= 35 THEN 'balanced,powerful' ELSE 'fast,balanced' END AS models FROM x LEFT JOIN b USING (o_orderkey)""",
)
_ANSWER = " This is unclear, it may be so and possibly uncertain."


def _escalated(spark, d):
    """Documents as answers, every third one unsure, to the question of the order of the same number."""
    answers = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.lit(_ANSWER)).otherwise(F.lit(""))).alias("response"), ((F.col("doc_id") % 10) / 10).alias("c"))
    both = answers.join(asked(spark, d), F.col("doc_id") == F.col("o_orderkey"))
    return both.select("doc_id", U.escalation(F.col("response"), F.col("c"), F.col("q")).alias("e")).select("doc_id", "e.*")


register(
    "qry_escalation",
    _escalated,
    f"""WITH {ASKED}, a AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '{_ANSWER}' ELSE '' END AS r, (doc_id % 10) / 10 AS c, q FROM documents JOIN q ON doc_id = o_orderkey),
  f AS (SELECT doc_id, list_filter([CASE WHEN c < 0.5 THEN {{'p': 60, 'r': 'low_confidence'}} END, CASE WHEN {_STAKES} >= 0.5 AND c < 0.8 THEN {{'p': 55, 'r': 'high_stakes'}} END, CASE WHEN {' + '.join(f"contains(lower(r), '{p.replace(chr(39), chr(39) * 2)}')::INTEGER" for p in U.UNSURE)} >= 2 THEN {{'p': 50, 'r': 'uncertain'}} END, CASE WHEN len(regexp_extract_all(r, '\\S+')) < 50 THEN {{'p': 40, 'r': 'short'}} END], lambda x: x IS NOT NULL) AS f FROM a)
  SELECT doc_id, len(f) > 0 AS escalate, array_to_string(list_transform(f[1:2], lambda x: x.r), '; ') AS reasons, coalesce(f[1].p, 0)::INTEGER AS priority FROM f""",
)
_VERSUS = U.VERSUS
register(
    "qry_comparison_entities",
    lambda s, d: asked(s, d).select("o_orderkey", F.array_join(U.entities(F.col("q")), "|").alias("entities")),
    f"""WITH {ASKED}, e AS (SELECT o_orderkey, q, list_transform(regexp_extract_all(lower(q), 'eip[- ]?(\\d+)', 1), lambda x: 'EIP-' || x) AS n, list_filter([{', '.join(f"CASE WHEN contains(lower(q), '{t}') THEN '{label}' END" for t, label in U.ENTITIES)}], lambda x: x IS NOT NULL) AS m FROM q)
  SELECT o_orderkey, array_to_string(CASE WHEN len(n) >= 2 THEN n WHEN len(n) + len(list_filter(m, lambda x: NOT list_contains(n, x))) >= 2 THEN list_concat(n, list_filter(m, lambda x: NOT list_contains(n, x))) WHEN regexp_matches(q, '{_VERSUS}') THEN [trim(regexp_extract(q, '{_VERSUS}', 1)), trim(regexp_extract(q, '{_VERSUS}', 2))] ELSE ['Entity A', 'Entity B'] END, '|') AS entities FROM e""",
)
register(
    "qry_structured_plan",
    lambda s, d: asked(s, d).select("o_orderkey", U.structured_plan(F.col("q")).alias("p")).select("o_orderkey", "p.*"),
    f"""WITH {ASKED}, {OUTPUT_TYPES}, n AS (SELECT *, TRY_CAST(regexp_extract(lower(q), 'eip[- ]?(\\d+)', 1) AS INTEGER) AS n FROM types), b AS (SELECT *, CASE WHEN type = 'dependency' AND n IS NULL THEN 'timeline' ELSE type END AS t FROM n)
  SELECT o_orderkey, t AS type, CASE WHEN t = 'dependency' THEN n END AS number, CASE WHEN t = 'dependency' THEN CASE WHEN {sql_any(('deep', 'all'), 'lower(q)')} THEN 5 WHEN contains(lower(q), 'direct') THEN 1 ELSE 3 END END AS depth FROM b""",
)
