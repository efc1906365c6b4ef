"""Queries of agent control, trends and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import control as K
from quern.plans.catalog import register, table
from quern.plans.retrieval import WORDS


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "ts", "event_type", F.concat_ws(" ", "event_type", F.col("event_id") % 5).alias("query"), F.col("value").alias("results"))


register(
    "ctl_attempt_summary",
    lambda s, d: K.attempts(_log(s, d), "user_id", F.col("event_type") != "error", "query"),
    """SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS rate,
  count(DISTINCT event_type || ' ' || (event_id % 5)) AS queries FROM events GROUP BY user_id""",
)
register(
    "ctl_last_n_trend",
    lambda s, d: K.trend(_log(s, d).withColumn("results", F.when(F.col("event_type") != "view", F.col("results"))), "user_id", ["ts", "event_id"], "results", 5),
    """WITH l AS (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
  SELECT user_id, count(v) AS points, round(avg(v), 6) AS mean FROM l WHERE n <= 5 GROUP BY user_id""",
)
register(
    "ctl_last_three_failed",
    lambda s, d: K.last_failed(_log(s, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3).select("event_id", "stuck"),
    "SELECT event_id, sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) = 3 AS stuck FROM events",
)


def _turns(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").distinct()
    return K.repeated_queries(turns, "conv_id", "turn", "text", 0.1).groupBy("conv_id").agg(F.count("*").alias("repeats"))


register(
    "ctl_circular_queries",
    _turns,
    f"""WITH t AS (SELECT DISTINCT conv_id, turn, list_distinct({WORDS.format('text')}) AS w FROM conversations WHERE role = 'user'),
  p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn)
  SELECT conv_id, count(*) AS repeats FROM (SELECT DISTINCT conv_id, turn FROM p WHERE n > i AND i / (n - i) > 0.1) GROUP BY conv_id""",
)
register(
    "ctl_eval_summary",
    lambda s, d: K.summary(table(s, d, "orders").withColumn("ok", F.col("o_orderstatus") != "P"), "o_orderpriority", "ok", "o_totalprice"),
    """SELECT coalesce(o_orderpriority, 'all') AS phase, count(*) AS runs, count(*) FILTER (o_orderstatus = 'P') AS failures, round(avg(o_totalprice) FILTER (o_orderstatus <> 'P'), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority)""",
)
register(
    "ctl_hard_caps",
    lambda s, d: K.capped(_log(s, d).withColumn("tokens", F.floor("results").cast("bigint")), "user_id", ["ts", "event_id"], "tokens", 1500).select("event_id", "used"),
    "SELECT event_id, used FROM (SELECT event_id, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS used FROM events) WHERE used <= 1500",
)


def _coverage(spark, d):
    """The share of each conversation's first question's words that some answer of it holds."""
    c = table(spark, d, "conversations").distinct()
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("q"))
    return K.term_coverage(first, c.where("role = 'assistant'").select("conv_id", F.col("text").alias("hit")), "conv_id", "q", "hit")


register(
    "ctl_coverage_terms",
    _coverage,
    """WITH c AS (SELECT DISTINCT * FROM conversations), f AS (SELECT conv_id, arg_min(text, ROW(turn, text)) AS q FROM c WHERE role = 'user' GROUP BY conv_id), h AS (SELECT conv_id, lower(text) AS hit FROM c WHERE role = 'assistant'),
  t AS (SELECT DISTINCT conv_id, unnest(list_filter(string_split_regex(lower(q), '\\s+'), lambda x: x <> '' AND x NOT IN ('what', 'how', 'why', 'when', 'which', 'is', 'are', 'the', 'a', 'an', 'in', 'of', 'to', 'for'))) AS t FROM f),
  m AS (SELECT t.conv_id, t.t, coalesce(bool_or(contains(hit, t.t)), false) AS found FROM t LEFT JOIN h USING (conv_id) GROUP BY ALL)
  SELECT conv_id, round(count(*) FILTER (found) / count(*), 6) AS coverage FROM m GROUP BY conv_id""",
)
