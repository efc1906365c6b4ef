"""Queries of scores, experiments, gates and query understanding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import scoring as S
from quern.functions import text as T
from quern.operators import experiments as X
from quern.operators.quantiles import exact
from quern.plans.catalog import register, table
from quern.plans.phrases import ASKED, asked, sql_any, sql_sum

WEIGHTS = [("a", 0.5), ("b", 0.3), ("c", 0.2)]
_BUCKET = "(('0x' || left(sha256(user_id::VARCHAR), 8))::UBIGINT % 1000)::DOUBLE / 1000"
_VARIANT = f"CASE WHEN {_BUCKET} < 0.5::DOUBLE THEN 'a' WHEN {_BUCKET} < 0.8::DOUBLE THEN 'b' ELSE 'c' END"


register(
    "sco_ab_assignment",
    lambda s, d: table(s, d, "events").select("event_id", S.bucket(F.col("user_id").cast("string")).alias("bucket"), S.variant(S.bucket(F.col("user_id").cast("string")), WEIGHTS).alias("variant")),
    f"SELECT event_id, {_BUCKET} AS bucket, {_VARIANT} AS variant FROM events",
)


def results(spark, d):
    e = table(spark, d, "events")
    return e.select(S.variant(S.bucket(F.col("user_id").cast("string")), WEIGHTS).alias("variant"), F.when(F.col("event_type") != "view", F.col("value") / 100).alias("quality"), F.col("value").alias("latency"), (F.col("value") / 1000).alias("cost"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).alias("feedback"))


_RESULTS = f"r AS (SELECT {_VARIANT} AS variant, CASE WHEN event_type <> 'view' THEN value / 100 END AS quality, value AS latency, value / 1000 AS cost, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS feedback FROM events)"
_ANALYSIS = """a AS (SELECT variant, count(*) AS trials, round(avg(quality), 6) AS quality_mean, min(quality) AS quality_least, max(quality) AS quality_most, count(quality) AS quality_count, round(avg(latency), 6) AS latency_mean, min(latency) AS latency_least, max(latency) AS latency_most, count(latency) AS latency_count,
  round(sum(cost), 4) AS cost_total, count(*) FILTER (feedback > 0) AS positive, count(*) FILTER (feedback < 0) AS negative FROM r GROUP BY variant)"""
register("sco_experiment_analysis", lambda s, d: X.analysis(results(s, d)), f"WITH {_RESULTS}, {_ANALYSIS} SELECT * FROM a")
register("sco_experiment_winner", lambda s, d: X.winner(X.analysis(results(s, d))), f"WITH {_RESULTS}, {_ANALYSIS}, b AS (SELECT variant, quality_mean, lead(quality_mean) OVER o AS nx, row_number() OVER o AS n FROM a WHERE trials >= 30 WINDOW o AS (ORDER BY quality_mean DESC, variant)) SELECT variant, CASE WHEN nx IS NULL THEN 50.0 ELSE least(round(100 * coalesce((quality_mean - nx) / nullif(abs(quality_mean), 0), 0), 4), 99.0) END::DOUBLE AS confidence FROM b WHERE n = 1")


def predictions(spark, d):
    labels = table(spark, d, "labels")
    return table(spark, d, "documents").join(labels, "doc_id").select("lang", F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("predicted"), F.col("quality").cast("double").alias("actual"))


_POINTS = "p AS (SELECT lang, least(n_chars / 5000, 1.0)::DOUBLE AS predicted, quality::DOUBLE AS actual FROM documents JOIN labels USING (doc_id))"
_CURVE = "SELECT {by}least(floor(predicted * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(predicted), 6) AS predicted, round(avg(actual), 6) AS actual FROM p GROUP BY ALL"
register("sco_reliability_curve", lambda s, d: X.reliability(predictions(s, d)), f"WITH {_POINTS} {_CURVE.format(by='')}")
register("sco_ece_by_type", lambda s, d: X.calibration_error(X.reliability(predictions(s, d), "predicted", "actual", 10, "lang"), "lang"), f"WITH {_POINTS}, c AS ({_CURVE.format(by='lang, ')}) SELECT lang, round(sum(n * abs(predicted - actual)) / sum(n), 6) AS ece FROM c GROUP BY lang")


def _snapshot(rows):
    means = rows.groupBy("variant").agg(F.avg("quality").alias("accuracy"), F.avg((F.col("quality") > 0.5).cast("int")).alias("recall"), F.avg(F.lit(1.0)).alias("coverage"), F.sum("cost").alias("cost"))
    return means.join(exact(rows, "latency", {"latency_p50": 0.5, "latency_p99": 0.99}, ("variant",)), "variant").drop("variant")


def _gate(spark, d):
    r = results(spark, d)
    return X.gate(_snapshot(r.where("variant = 'b'")), _snapshot(r.where("variant = 'a'")))


_SNAP = "SELECT avg(quality) AS accuracy, avg((quality > 0.5)::INTEGER) AS recall, 1.0::DOUBLE AS coverage, quantile_disc(latency, 0.5)::DOUBLE AS latency_p50, quantile_disc(latency, 0.99)::DOUBLE AS latency_p99, sum(cost) AS cost FROM r WHERE variant = '{}'"
_QUANTILES = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
register(
    "sco_latency_quantiles",
    lambda s, d: exact(results(s, d), "latency", _QUANTILES, ("variant",)),
    f"WITH {_RESULTS} SELECT variant, " + ", ".join(f"quantile_disc(latency, {p})::DOUBLE AS {n}" for n, p in _QUANTILES.items()) + " FROM r GROUP BY variant",
)
register(
    "sco_regression_gate",
    _gate,
    f"""WITH {_RESULTS}, n AS (UNPIVOT ({_SNAP.format('b')}) ON COLUMNS(*) INTO NAME metric VALUE now), t AS (UNPIVOT ({_SNAP.format('a')}) ON COLUMNS(*) INTO NAME metric VALUE before),
  m AS (SELECT * FROM (VALUES ('accuracy', 0.02, -1), ('recall', 0.03, -1), ('coverage', 0.05, -1), ('latency_p50', 0.20, 1), ('latency_p99', 0.30, 1), ('cost', 0.15, 1)) v(metric, lim, sign)),
  j AS (SELECT metric, (now - before) / abs(before) AS change, lim, sign FROM n JOIN t USING (metric) JOIN m USING (metric) WHERE before <> 0)
  SELECT metric, round(change, 6) AS change, CASE WHEN sign * change > lim THEN 'regression' WHEN sign * change < -lim / 2 THEN 'improvement' ELSE 'stable' END AS status FROM j""",
)
register(
    "sco_breaker_windowed",
    lambda s, d: X.breaker(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures", "open"),
    """WITH i AS (SELECT *, (event_type = 'error')::INTEGER AS f, sum((event_type <> 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
  r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS failures FROM i)
  SELECT event_id, failures, max((failures >= 3)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS open FROM r""",
)
def _damaged(spark, d):
    """Documents, some with marks of bad extraction behind them."""
    bad = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("\ufffd"), 13)).when(F.col("doc_id") % 5 == 1, F.repeat(F.lit(S.MOJIBAKE[0] + " " + S.MOJIBAKE[3]), 4)).when(F.col("doc_id") % 5 == 2, F.repeat(F.lit("\x01"), 40))
    bad = F.coalesce(bad.otherwise(F.when(F.col("doc_id") % 5 == 3, F.repeat(F.lit(" bcdfgh |||||   #####"), 60))), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.concat("text", bad).alias("text"))


_DAMAGED = f"""t AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN repeat('\ufffd', 13) WHEN 1 THEN repeat('{S.MOJIBAKE[0]} {S.MOJIBAKE[3]}', 4) WHEN 2 THEN repeat(chr(1), 40) WHEN 3 THEN repeat(' bcdfgh |||||   #####', 60) ELSE '' END AS text FROM documents)"""
_PAIRS = " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)}" for m in S.MOJIBAKE)
register(
    "sco_encoding_quality",
    lambda s, d: _damaged(s, d).select("doc_id", F.round(S.encoding_quality(F.col("text")), 6).alias("quality")),
    f"""WITH {_DAMAGED}, c AS (SELECT doc_id, length(text) - length(replace(text, '\ufffd', '')) AS r, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS k, {_PAIRS} AS m FROM t)
  SELECT doc_id, round(greatest(0.0, 1 - CASE WHEN r > 10 THEN least(0.3, r / 100) ELSE 0 END - CASE WHEN k > 10 THEN least(0.2, k / 100) ELSE 0 END - CASE WHEN m > 5 THEN least(0.2, m / 50) ELSE 0 END), 6)::DOUBLE AS quality FROM c""",
)
_MARKS = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in S.ARTIFACTS)
register(
    "sco_text_quality",
    lambda s, d: _damaged(s, d).select("doc_id", F.round(S.text_quality(F.col("text")), 6).alias("quality")),
    f"""WITH {_DAMAGED}, c AS (SELECT doc_id, ({_MARKS}) / length(text) * 1000 AS r, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) / length(text) * 100 AS w, len(regexp_extract_all(lower(text), '[bcdfghjklmnpqrstvwxz]{{6,}}')) AS g, regexp_split_to_array(text, '[.!?]+') AS s FROM t WHERE length(text) > 0)
  SELECT doc_id, round(greatest(0.0, 1 - (CASE WHEN r > 10 THEN least(0.3, r / 100) ELSE 0 END + CASE WHEN w < 10 THEN 0.2 WHEN w > 25 THEN 0.1 ELSE 0 END + CASE WHEN g > 5 THEN 0.2 ELSE 0 END + CASE WHEN len(list_filter(s, lambda x: len(regexp_extract_all(x, '\\S+')) BETWEEN 11 AND 99 AND regexp_matches(x, '[a-zA-Z]'))) / len(s) < 0.3 THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS quality FROM c
  UNION ALL SELECT doc_id, 0.0 FROM t WHERE length(text) = 0""",
)


def _confidence(spark, d):
    hits = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.avg(F.col("value") / 1000).alias("relevance"), F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.5)).alias("authority"))
    score = F.round(S.retrieval_confidence(F.col("relevance"), F.col("kinds") / 5, S.diversity(F.col("kinds"), F.col("n")), F.col("authority"), F.col("n")), 6)
    return hits.select("user_id", score.alias("score"), S.recommendation(score).alias("recommendation"))


register(
    "sco_retrieval_confidence",
    _confidence,
    """WITH h AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, avg(value / 1000) AS relevance, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.5 END::DOUBLE) AS authority FROM events GROUP BY user_id),
  s AS (SELECT user_id, 0.4::DOUBLE * relevance + 0.2::DOUBLE * (kinds / 5) + 0.2::DOUBLE * CASE WHEN kinds <= 1 THEN 0.2::DOUBLE ELSE least(1.5::DOUBLE * kinds / n, 1.0) END + 0.2::DOUBLE * authority AS s, n FROM h), r AS (SELECT user_id, round(least(CASE WHEN n < 3 THEN s * n / 3 ELSE s END, 1.0), 6) AS score FROM s)
  SELECT user_id, score, CASE WHEN score >= 0.85 THEN 'High confidence - single model response should be sufficient' WHEN score >= 0.7 THEN 'Good confidence - consider ensemble for critical queries' WHEN score >= 0.5 THEN 'Moderate confidence - ensemble recommended for better coverage' ELSE 'Low confidence - ensemble strongly recommended; consider query reformulation' END AS recommendation FROM r""",
)

_MENTIONS = "len(regexp_extract_all(lower(q), 'eip-?\\d+'))"
_COUNTS = f"n AS (SELECT *, {sql_sum(S.COMPARISON, 'lower(q)')} AS c, {sql_sum(S.EVOLUTION, 'lower(q)')} AS e, {sql_sum(S.MULTI_HOP, 'lower(q)')} AS h, {_MENTIONS} AS m FROM q)"
CLASSIFIED = f"""{ASKED}, {_COUNTS}, k AS (SELECT o_orderkey, o_custkey, q, h, c, e, m, CASE WHEN h >= 1 OR (m >= 2 AND (c > 0 OR e > 0)) THEN 'multi_hop' WHEN c > 0 OR e > 0 OR m >= 2 THEN 'complex' ELSE 'simple' END AS kind FROM n),
  classified AS (SELECT *, round(CASE kind WHEN 'multi_hop' THEN least(0.7::DOUBLE + h * 0.1::DOUBLE, 0.95) WHEN 'complex' THEN least(0.6::DOUBLE + (c + e + m) * 0.1::DOUBLE, 0.9) ELSE 0.8 END, 6)::DOUBLE AS confidence, CASE kind WHEN 'multi_hop' THEN greatest(2, m + 1) WHEN 'complex' THEN greatest(2, m) ELSE 1 END::INTEGER AS sub_questions FROM k)"""
register(
    "sco_query_classification",
    lambda s, d: asked(s, d).select("o_orderkey", S.classified(F.col("q")).alias("k")).select("o_orderkey", "k.*"),
    f"WITH {CLASSIFIED} SELECT o_orderkey, kind, confidence, sub_questions, kind <> 'simple' AS decompose FROM classified",
)


def _routed(spark, d):
    rows = asked(spark, d).withColumn("kind", S.query_class(F.col("q"))).withColumn("tier", S.tier(F.col("kind"), F.col("o_custkey") * 100, (F.col("o_custkey") % 10) / 10))
    tokens_in = F.col("o_custkey") * 100 + F.size(F.filter(F.split("q", r"\s+"), lambda w: w != "")) * 2
    tokens_out = F.when(F.col("kind") == "simple", 500).when(F.col("kind") == "complex", 1500).otherwise(2500)
    return rows.select("o_orderkey", "tier", F.round(S.cost(F.col("tier"), tokens_in.cast("double"), tokens_out.cast("double")), 8).alias("cost"))


register(
    "sco_tier_routing_cost",
    _routed,
    f"""WITH {CLASSIFIED}, t AS (SELECT *, CASE WHEN kind = 'simple' THEN CASE WHEN o_custkey * 100 > 50000 OR o_custkey % 10 < 5 THEN 'balanced' ELSE 'fast' END WHEN kind = 'complex' THEN 'balanced' ELSE 'powerful' END AS tier, CASE kind WHEN 'simple' THEN 500 WHEN 'complex' THEN 1500 ELSE 2500 END AS o,
  o_custkey * 100 + 2 * len(regexp_extract_all(q, '\\S+')) AS i FROM classified)
  SELECT o_orderkey, t.tier, round(i::DOUBLE / 1000 * a + o::DOUBLE / 1000 * b, 8) AS cost FROM t JOIN (VALUES ('fast', 0.0008::DOUBLE, 0.004::DOUBLE), ('balanced', 0.003::DOUBLE, 0.015::DOUBLE), ('powerful', 0.015::DOUBLE, 0.075::DOUBLE)) p(tier, a, b) ON p.tier = t.tier""",
)
_NUMBERED = "len(regexp_extract_all(lower(q), 'eip[- ]?\\d+'))"
_OUT = {n: " + ".join(f"contains(lower(q), '{i}')::INTEGER * {1 + S.BONUS.get(i, 0)}" for i in w) for n, w in S.OUTPUTS.items()}
_OUT["comparison"] += f" + CASE WHEN {_NUMBERED} >= 2 THEN 3 ELSE 0 END"
_OUT["dependency"] += f" + CASE WHEN {_NUMBERED} = 1 AND {sql_any(S.DEPENDS, 'lower(q)')} THEN 3 ELSE 0 END"
OUTPUT_TYPES = f"s AS (SELECT o_orderkey, q, {', '.join(f'{e} AS {n}' for n, e in _OUT.items())} FROM q), types AS (SELECT o_orderkey, q, CASE greatest(timeline, argument_map, comparison, dependency) WHEN timeline THEN 'timeline' WHEN argument_map THEN 'argument_map' WHEN comparison THEN 'comparison' ELSE 'dependency' END AS type FROM s)"
register("sco_output_type", lambda s, d: asked(s, d).select("o_orderkey", S.output_type(F.col("q")).alias("type")), f"WITH {ASKED}, {OUTPUT_TYPES} SELECT o_orderkey, type FROM types")


def _enforced(spark, d):
    """Sentences as claims; every third one is cited."""
    claims = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).withColumn("has", F.col("n") % 3 == F.col("doc_id") % 3)
    out = claims.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if("has").alias("cited"), F.count_if(~F.col("has") & S.needs_citation(F.col("sentence"))).alias("uncited_factual"))
    return out.withColumn("compliant", S.compliant(F.col("claims"), F.col("cited"), F.col("uncited_factual"), 0.3))


_FACTUAL = f"(length(s) >= 20 AND {sql_sum(S.NOT_FACTUAL, 's')} = 0 AND ({sql_sum(S.FACTUAL, 's')} > 0 OR {sql_any(S.TECHNICAL, 'lower(s)')}))"
register(
    "sco_citation_enforcement",
    _enforced,
    f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]+') AS l FROM documents), s AS (SELECT doc_id, i - 1 AS n, trim(l[i], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
  g AS (SELECT doc_id, count(*) AS claims, count(*) FILTER (n % 3 = doc_id % 3) AS cited, count(*) FILTER (n % 3 <> doc_id % 3 AND {_FACTUAL}) AS uncited_factual FROM s GROUP BY doc_id) SELECT *, cited / claims >= 0.3 AND uncited_factual <= claims * 0.1 AS compliant FROM g""",
)


def _support(spark, d):
    level = S.support_level(F.col("l_discount") * 10, F.col("l_tax") * 10)
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("e"), level.alias("level"))
    g = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "contradiction").alias("c"), F.count_if(F.col("level") == "strong").alias("s"), F.count_if(F.col("level") == "partial").alias("p"), F.round(F.avg("e"), 6).alias("entailment"))
    return g.select("l_orderkey", S.aggregate_support(F.col("c"), F.col("s"), F.col("p"), F.col("n")).alias("support"), "entailment")


register(
    "sco_claim_support_aggregate",
    _support,
    """WITH l AS (SELECT l_orderkey, l_discount * 10 AS e, CASE WHEN l_tax * 10 > 0.7::DOUBLE THEN 'contradiction' WHEN l_discount * 10 > 0.7::DOUBLE THEN 'strong' WHEN l_discount * 10 > 0.4::DOUBLE THEN 'partial' ELSE 'weak' END AS level FROM lineitem),
  g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (level = 'contradiction') AS c, count(*) FILTER (level = 'strong') AS s, count(*) FILTER (level = 'partial') AS p, round(avg(e), 6) AS entailment FROM l GROUP BY l_orderkey)
  SELECT l_orderkey, CASE WHEN c > 0 THEN 'contradiction' WHEN s / n >= 0.8 THEN 'strong' WHEN s / n >= 0.5 OR (s + p) / n >= 0.8 THEN 'partial' ELSE 'weak' END AS support, entailment FROM g""",
)


def _winner_sql(metric: str, way: str) -> str:
    return f"""SELECT '{metric}' AS metric, variant, score, CASE WHEN nx IS NULL THEN 50.0 ELSE least(round(100 * coalesce(abs(score - nx) / nullif(abs(score), 0), 0), 4), 99.0) END::DOUBLE AS confidence
  FROM (SELECT variant, score, lead(score) OVER o AS nx, row_number() OVER o AS n FROM (SELECT variant, round(avg({metric}), 6) AS score FROM r GROUP BY variant HAVING count(*) >= 30 AND count({metric}) > 0) WINDOW o AS (ORDER BY score {way}, variant)) WHERE n = 1"""


_WAYS = {"quality": "DESC", "latency": "", "cost": ""}
register(
    "sco_winner_by_metric",
    lambda s, d: reduce(DataFrame.unionByName, [X.winner_by(results(s, d), m) for m in _WAYS]),
    f"WITH {_RESULTS} " + " UNION ALL ".join(_winner_sql(m, way) for m, way in _WAYS.items()),
)
