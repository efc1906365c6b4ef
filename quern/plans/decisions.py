"""Queries of calibration, breakers, gates, experiments, budgets, agent control and ensembles. Events are logs of their users."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import decisions as D
from quern.operators import experiments as X
from quern.operators.isotonic import fit, interpolated
from quern.operators.quantiles import exact
from quern.plans.catalog import ORACLES, register, table
from quern.plans.phrases import ASKED, asked
from quern.plans.scoring import _POINTS, predictions

KNOTS = ((0.1, 0.053), (0.31, 0.3), (0.6, 0.57), (0.93, 0.951))
_KNOTS = f"(VALUES {', '.join(map(str, KNOTS))}) k(x, y)"


def _line(knots: str, where: str = "") -> str:
    """The value on the knots' line at p."""
    near = lambda f, c, op: f"(SELECT {f}(y, x) FROM {knots} WHERE x {op} p {where})"
    low, high = f"(SELECT max(x) FROM {knots} WHERE x <= p {where})", f"(SELECT min(x) FROM {knots} WHERE x >= p {where})"
    a, b = near("arg_max", "y", "<="), near("arg_min", "y", ">=")
    return f"CASE WHEN {low} IS NULL THEN {b} WHEN {high} IS NULL OR {high} = {low} THEN {a} ELSE {a} + (p - {low}) / ({high} - {low}) * ({b} - {a}) END"


def _predicted(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", (F.col("value") / 1000).alias("predicted"))


register(
    "dec_interpolated",
    lambda s, d: D.calibrated(_predicted(s, d), s.createDataFrame(list(KNOTS), "boundary double, value double")).select("event_id", F.round("calibrated", 6).alias("calibrated")),
    f"SELECT event_id, round({_line(_KNOTS)}, 6)::DOUBLE AS calibrated FROM (SELECT event_id, value / 1000 AS p FROM events)",
)
_TYPED = (("view", 0.2, 0.1), ("view", 0.7, 0.9), ("click", 0.5, 0.4), (None, 0.0, 0.1), (None, 1.0, 0.6))
_TYPED_SQL = "(VALUES " + ", ".join(f"({'NULL' if k is None else repr(k)}, {x}, {y})" for k, x, y in _TYPED) + ") k(kind, x, y)"
register(
    "dec_calibrated_by_type",
    lambda s, d: D.calibrated_by_type(_predicted(s, d), s.createDataFrame(list(_TYPED), "kind string, boundary double, value double"), kind="event_type").select("event_id", F.round("calibrated", 6).alias("calibrated")),
    f"SELECT event_id, round({_line(_TYPED_SQL, 'AND kind IS NOT DISTINCT FROM t')}, 6)::DOUBLE AS calibrated FROM (SELECT event_id, value / 1000 AS p, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS t FROM events)",
)


def _isotonic(spark, d):
    points = predictions(spark, d)
    return D.calibrated(points.select("predicted").distinct(), X.isotonic(points)).select("predicted", F.round("calibrated", 6).alias("calibrated"))


def _fit_sql(points: str) -> str:
    """The min-max formula over all runs of predictions (kind, predicted, actual): r has the fitted value v of each."""
    return f"""g AS (SELECT kind, predicted, sum(actual) AS s, count(*) AS w FROM {points} GROUP BY ALL), o AS (SELECT kind, predicted, row_number() OVER q AS i, sum(s) OVER q AS s, sum(w) OVER q AS w, s AS s0, w AS w0 FROM g WINDOW q AS (PARTITION BY kind ORDER BY predicted)),
  m AS (SELECT a.kind, a.i AS a, b.i AS b, (b.s - a.s + a.s0) / (b.w - a.w + a.w0) AS v FROM o a JOIN o b ON a.i <= b.i AND a.kind = b.kind), l AS (SELECT kind, a, b, min(v) OVER (PARTITION BY kind, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM m), r AS (SELECT kind, b AS i, max(v) AS v FROM l GROUP BY ALL)"""


register("dec_isotonic_fit", _isotonic, f"WITH {_POINTS}, x AS (SELECT '' AS kind, * FROM p), {_fit_sql('x')} SELECT predicted, round(v, 6) AS calibrated FROM o JOIN r USING (kind, i)")


register(
    "sco_isotonic_calibration",
    lambda s, d: X.isotonic(predictions(s, d)),
    f"WITH {_POINTS}, x AS (SELECT '' AS kind, * FROM p), {_fit_sql('x')}, b AS (SELECT v, min(predicted) AS low, max(predicted) AS high FROM o JOIN r USING (kind, i) GROUP BY v) SELECT low AS boundary, v AS value FROM b UNION SELECT high, v FROM b",
)


def _isotonic_by_type(spark, d):
    """A fit for each language of 60 labels or more, and that of all labels for the others; each prediction under its language."""
    points = predictions(spark, d)
    return D.calibrated_by_type(points.select("lang", "predicted").distinct(), fit(points, kind="lang", least=60), kind="lang").select("lang", "predicted", F.round("calibrated", 6).alias("calibrated"))


register(
    "dec_isotonic_by_type",
    _isotonic_by_type,
    f"""WITH {_POINTS}, n AS (SELECT lang FROM p GROUP BY lang HAVING count(*) >= 60), x AS (SELECT lang AS kind, predicted, actual FROM p SEMI JOIN n USING (lang) UNION ALL SELECT '', predicted, actual FROM p WHERE (SELECT count(*) FROM p) >= 60), {_fit_sql('x')}
  SELECT DISTINCT lang, p.predicted, round(v, 6) AS calibrated FROM p JOIN o ON o.predicted = p.predicted AND o.kind = CASE WHEN lang IN (SELECT lang FROM n) THEN lang ELSE '' END JOIN r USING (kind, i)""",
)
register(
    "dec_interpolated_by_join",
    lambda s, d: interpolated(_predicted(s, d), s.createDataFrame(list(_TYPED), "kind string, boundary double, value double"), kind="event_type").select("event_id", F.round("calibrated", 6).alias("calibrated")),
    ORACLES["dec_calibrated_by_type"],
)


def _checks(spark, d):
    n, v = F.col("event_id"), F.col("value") / 1000
    return table(spark, d, "events").select("event_id", D.breaker_decision(v, n % 3 > 0, F.when(n % 7 > 0, n % 5), F.when(n % 4 > 0, (n % 10) / 10), n % 11 == 0).alias("b")).select("event_id", "b.*")


_RULES = "{'k': 0, 'gap': CASE WHEN s < 0.4 THEN 0.4::DOUBLE - s END, 'r': 'low_evidence'}, {'k': 1, 'gap': CASE WHEN event_id % 3 = 0 THEN 0.3::DOUBLE END, 'r': 'no_relevant_results'}, {'k': 2, 'gap': CASE WHEN event_id % 7 > 0 AND event_id % 5 < 2 THEN 0.5::DOUBLE END, 'r': 'no_relevant_results'}, {'k': 3, 'gap': CASE WHEN event_id % 4 > 0 AND (event_id % 10) / 10 < 0.5 THEN 0.5::DOUBLE - (event_id % 10) / 10 END, 'r': 'no_relevant_results'}, {'k': 4, 'gap': CASE WHEN event_id % 11 = 0 THEN 0.2::DOUBLE END, 'r': 'conflicting_sources'}"
register(
    "dec_breaker_decision",
    _checks,
    f"""WITH f AS (SELECT event_id, list_filter([{_RULES}], lambda x: x.gap IS NOT NULL) AS f FROM (SELECT *, value / 1000 AS s FROM events)), u AS (SELECT event_id, unnest(f) AS x FROM f), b AS (SELECT event_id, arg_max(x.r, round(x.gap, 6) * 10 - x.k / 1000000.0) AS reason, round(max(x.gap), 6) AS gap, count(*) AS n FROM u GROUP BY event_id)
  SELECT event_id, b.n IS NULL AS allow, reason, coalesce(b.n, 0)::INTEGER AS reasons, gap, CASE reason {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ADVICE.items())} END AS advice FROM events LEFT JOIN b USING (event_id)""",
)
_OPS = {"view": "pass", "error": "fail", "click": "failure", "signup": "half_open", "purchase": "success"}


def _ops(spark, d):
    op = F.when(F.col("event_id") % 37 == 0, "reset")
    for kind, name in _OPS.items():
        op = op.when(F.col("event_type") == kind, name)
    return table(spark, d, "events").select("user_id", "event_id", op.alias("op"))


_SEQUENCE = "SELECT user_id, event_id, {0}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events"
_OP = "CASE WHEN event_id % 37 = 0 THEN 'reset' ELSE CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPS.items()) + " END END AS op"
_NEXT = "CASE WHEN {o} = 'reset' THEN {{'s': 'closed', 'f': 0, 't': {p}.t}} WHEN {o} = 'half_open' THEN {{'s': CASE WHEN {p}.s = 'open' THEN 'half_open' ELSE {p}.s END, 'f': {p}.f, 't': {p}.t}} WHEN {o} = 'success' THEN {{'s': CASE WHEN {p}.s = 'half_open' THEN 'closed' ELSE {p}.s END, 'f': 0, 't': {p}.t}} WHEN {p}.s = 'open' AND {o} <> 'failure' THEN {p} WHEN {o} = 'pass' THEN {{'s': {p}.s, 'f': 0, 't': {p}.t}} ELSE {{'s': CASE WHEN {p}.f + 1 >= 3 THEN 'open' ELSE {p}.s END, 'f': {p}.f + 1, 't': {p}.t + ({p}.f + 1 >= 3)::INTEGER}} END"
_START = "{'s': 'closed', 'f': 0, 't': 0}"
register(
    "dec_breaker_states",
    lambda s, d: D.breaker_states(_ops(s, d), "user_id", ["event_id"]).select("event_id", "state", "failures", "trips"),
    f"""WITH RECURSIVE x AS ({_SEQUENCE.format(_OP)}), z AS (SELECT *, {_START} AS p FROM x WHERE i = 1), g AS (SELECT user_id, event_id, i, {_NEXT.format(o='op', p='p')} AS s FROM z UNION ALL SELECT x.user_id, x.event_id, x.i, {_NEXT.format(o='x.op', p='g.s')} FROM g JOIN x ON x.user_id = g.user_id AND x.i = g.i + 1)
  SELECT event_id, s.s AS state, s.f::INTEGER AS failures, s.t::INTEGER AS trips FROM g""",
)


def _evaluations(spark, d, late):
    """Snapshots by order priority, of orders of even or odd keys."""
    orders = table(spark, d, "orders").where(F.col("o_orderkey") % 2 == late).withColumnRenamed("o_orderpriority", "version")
    agg = orders.groupBy("version").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("accuracy"), F.avg((F.col("o_custkey") % 3 == 0).cast("int")).alias("recall_at_10"), F.lit(0.5).alias("recall_at_k"), F.avg((F.col("o_custkey") % 2 == 0).cast("int")).alias("citation_accuracy"), F.count_if(F.col("o_orderkey") % 9 == 0).alias("eval_count"))
    agg = agg.join(exact(orders, "o_totalprice", {"latency_p50_ms": 0.5, "latency_p99_ms": 0.99}, ("version",)), "version")
    return agg.withColumn("recall_at_10", F.when(F.col("version") == "2-HIGH", 0.0).otherwise(F.col("recall_at_10"))).withColumn("latency_p99_ms", F.when(F.col("version") == "5-LOW", None).otherwise(F.col("latency_p99_ms")))


def _snapshot_sql(late: int) -> str:
    return f"""SELECT o_orderpriority AS version, avg((o_orderstatus = 'F')::INTEGER) AS accuracy, CASE WHEN o_orderpriority = '2-HIGH' OR avg((o_custkey % 3 = 0)::INTEGER) = 0 THEN 0.5 ELSE avg((o_custkey % 3 = 0)::INTEGER) END::DOUBLE AS recall_at_k, avg((o_custkey % 2 = 0)::INTEGER) AS citation_accuracy, quantile_disc(o_totalprice, 0.5)::DOUBLE AS latency_p50_ms,
  CASE WHEN o_orderpriority <> '5-LOW' THEN quantile_disc(o_totalprice, 0.99) END::DOUBLE AS latency_p99_ms, NULL::DOUBLE AS cost_per_query, count(*) FILTER (o_orderkey % 9 = 0)::INTEGER AS eval_count FROM orders WHERE o_orderkey % 2 = {late} GROUP BY o_orderpriority"""


def _rounded(rows):
    return rows.select("version", *[F.round(c, 6).alias(c) for c in D.THRESHOLDS], "eval_count")


_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in D.THRESHOLDS)
register("dec_snapshots", lambda s, d: _rounded(D.snapshots(_evaluations(s, d, 1))), f"SELECT version, {_SIX}, eval_count FROM ({_snapshot_sql(1)})")


def _both(spark, d):
    return D.snapshots(_evaluations(spark, d, 1)), D.snapshots(_evaluations(spark, d, 0)).where("version <> '1-URGENT'")


_CHANGE = {m: (f"(n.{m} - b.{m}) / b.{m}" if m in D.LOWER else f"(b.{m} - n.{m}) / b.{m}", limit) for m, limit in D.THRESHOLDS.items()}
_PICK = lambda test: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test.format(x=x, limit=limit)} THEN '{m}' END" for m, (x, limit) in _CHANGE.items()) + "], lambda z: z IS NOT NULL), ',')"
_GATE = f"""n AS ({_snapshot_sql(1)}), b AS ({_snapshot_sql(0)}), gated AS (SELECT n.version, CASE WHEN b.version IS NULL THEN '' ELSE {_PICK('{x} > {limit}')} END AS regressions, CASE WHEN b.version IS NULL THEN '' ELSE {_PICK('{x} < -{limit} * 0.5')} END AS improvements, CASE WHEN b.version IS NULL THEN 'no_baseline' WHEN n.eval_count < 20 THEN 'low_eval_count' ELSE '' END AS warnings FROM n LEFT JOIN (SELECT * FROM b WHERE version <> '1-URGENT') b ON n.version = b.version)"""
register(
    "dec_gate",
    lambda s, d: D.gate(*_both(s, d), "version").select("version", "passed", *[F.array_join(c, ",").alias(c) for c in ("regressions", "improvements", "warnings")]),
    f"WITH {_GATE} SELECT version, regressions = '' AS passed, regressions, improvements, warnings FROM gated",
)
register(
    "dec_replaced_baseline",
    lambda s, d: _rounded(D.replaced_baseline(*_both(s, d), "version")),
    f"WITH {_GATE} SELECT version, {_SIX}, eval_count FROM (SELECT * FROM n WHERE version IN (SELECT version FROM gated WHERE regressions = '') UNION ALL SELECT * FROM b WHERE version <> '1-URGENT' AND version NOT IN (SELECT version FROM gated WHERE regressions = ''))",
)

register(
    "dec_deployable",
    lambda s, d: D.deployable(*_both(s, d), "version", F.col("version") != "3-MEDIUM", F.col("version") == "2-HIGH", 400).withColumn("blockers", F.array_join("blockers", ";")),
    f"""WITH {_GATE}, b2 AS (SELECT version, list_concat(list_filter([CASE WHEN version = '3-MEDIUM' THEN 'Tests failed' END, CASE WHEN eval_count < 400 THEN 'Insufficient eval count (' || eval_count || ' < 400)' END], lambda z: z IS NOT NULL), CASE WHEN regressions = '' THEN [] ELSE list_transform(string_split(regressions, ','), lambda z: 'Regression: ' || z) END) AS l FROM n JOIN gated USING (version))
  SELECT version, version = '2-HIGH' OR len(l) = 0 AS allowed, CASE WHEN version = '2-HIGH' THEN 'Manual override enabled' ELSE array_to_string(l, ';') END AS blockers FROM b2""",
)


def _assigned(spark, d):
    variants = spark.createDataFrame([("e1", 0, "a", 2.0), ("e1", 1, "b", 1.0), ("e1", 2, "c", 1.0), ("e0", 0, "x", 3.0), ("e0", 1, "y", 1.0), ("e2", 0, "z", 1.0)], "experiment string, place int, variant string, weight double")
    status = spark.createDataFrame([("e0", "active", 1), ("e1", "active", 1), ("e2", "active", 1), ("e2", "stopped", 2)], "experiment string, status string, changed int")
    keys = table(spark, d, "events").select("event_id", F.concat(F.lit("e"), F.col("event_id") % 3).alias("experiment"), "user_id")
    from quern.functions.scoring import bucket

    return D.assigned(keys, variants, status, bucket(F.col("user_id").cast("string"))).select("event_id", "variant")


register(
    "dec_assignments",
    _assigned,
    "WITH b AS (SELECT event_id, event_id % 3 AS e, (('0x' || left(sha256(user_id::VARCHAR), 8))::UBIGINT % 1000)::DOUBLE / 1000 AS b FROM events) SELECT event_id, CASE e WHEN 1 THEN CASE WHEN b < 0.5 THEN 'a' WHEN b < 0.75 THEN 'b' ELSE 'c' END ELSE CASE WHEN b < 0.75 THEN 'x' ELSE 'y' END END AS variant FROM b WHERE e < 2",
)
register(
    "dec_experiment_ids",
    lambda s, d: table(s, d, "orders").select("o_orderkey", D.experiment_id(F.concat(F.lit("New Test "), "o_orderkey"), F.col("o_orderdate")).alias("id")),
    "SELECT o_orderkey, 'new_test_' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS id FROM orders",
)


def _requests(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 6).cast("int").alias("chunks"), (F.col("event_id") % 5 * 400).cast("int").alias("tokens"))


register(
    "dec_recorded_usage",
    lambda s, d: D.recorded(_requests(s, d), "user_id", ["event_id"]).select("event_id", "accepted", "used_chunks", "used_tokens"),
    f"""WITH RECURSIVE x AS ({_SEQUENCE.format('event_id % 6 AS c, event_id % 5 * 400 AS t')}), g AS (SELECT user_id, event_id, i, true AS ok, c AS uc, t AS ut FROM x WHERE i = 1 UNION ALL
  SELECT x.user_id, x.event_id, x.i, g.uc + x.c <= 20 AND g.ut + x.t <= 8000, CASE WHEN g.uc + x.c <= 20 AND g.ut + x.t <= 8000 THEN g.uc + x.c ELSE g.uc END, CASE WHEN g.uc + x.c <= 20 AND g.ut + x.t <= 8000 THEN g.ut + x.t ELSE g.ut END FROM g JOIN x ON x.user_id = g.user_id AND x.i = g.i + 1) SELECT event_id, ok AS accepted, uc::INTEGER AS used_chunks, ut::INTEGER AS used_tokens FROM g""",
)


def _allocated(spark, d):
    n = F.col("event_id")
    share = D.allocation((n % 23).cast("int"), (n % 90 * 100).cast("int"), (n % 4).cast("int"), F.lit(4))
    rows = table(spark, d, "events").select("event_id", share.alias("a"), D.fair_share((n % 8).cast("int")).alias("f")).select("event_id", "a.*", F.col("f.chunks").alias("fair_chunks"), F.col("f.tokens").alias("fair_tokens"))
    return rows.withColumn("expanded", D.expanded(F.col("max_chunks"), (n % 10) / 10, (20 - n % 23).cast("int")))


register(
    "dec_allocation",
    _allocated,
    """WITH x AS (SELECT event_id, 20 - event_id % 23 AS l, 8000 - event_id % 90 * 100 AS r, greatest(1, 4 - event_id % 4) AS o, event_id % 8 AS k, event_id % 10 / 10 AS q FROM events), a AS (SELECT *, l <= 0 OR r <= 0 AS done, greatest(1, least(5, l // o)) AS c FROM x), b AS (SELECT *, CASE WHEN done THEN 0 ELSE c END AS m FROM a)
  SELECT event_id, m::INTEGER AS max_chunks, CASE WHEN done THEN 0 ELSE greatest(500, r // o) END::INTEGER AS max_tokens, done OR c < 5 OR l < 10 AS limited, done AS exhausted, greatest(0, r - 2000)::INTEGER AS for_synthesis, CASE WHEN k = 0 THEN 5 ELSE least(20 // k, 5) END::INTEGER AS fair_chunks, CASE WHEN k = 0 THEN 8000 ELSE 6000 // k END::INTEGER AS fair_tokens, CASE WHEN q < 0.7 AND l > 0 THEN least(m + m // 2, l) ELSE m END::INTEGER AS expanded FROM b""",
)
_REPLIES = ("ANSWER: it is {a}", "retrieve:  blobs {a}", "Let me see.\nThink: more {a}\nANSWER: no", "no action {a}", "x\n  Retrieve: late {a}", "THINK:{a}")


def _replies(spark, d, texts):
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.replace(t, F.lit("{a}"), (F.col("o_orderkey") % 97).cast("string")).alias("r"))


def _replied(texts) -> str:
    literal = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"r AS (SELECT o_orderkey, replace(([{literal}])[o_orderkey % {len(texts)} + 1], '{{a}}', (o_orderkey % 97)::VARCHAR) AS r FROM orders)"


_ACTION = "regexp_matches(upper({x}), '^(ANSWER|RETRIEVE|THINK):')"
register(
    "dec_agent_actions",
    lambda s, d: _replies(s, d, _REPLIES).select("o_orderkey", D.action(F.col("r")).alias("a")).select("o_orderkey", "a.action", "a.input"),
    f"""WITH {_replied(_REPLIES)}, l AS (SELECT *, CASE WHEN {_ACTION.format(x='r')} THEN r ELSE list_filter(string_split(r, chr(10)), lambda x: {_ACTION.format(x="trim(x)")})[1] END AS l FROM r)
  SELECT o_orderkey, CASE WHEN l IS NULL THEN 'think' ELSE lower(regexp_extract(upper(trim(l)), '^(ANSWER|RETRIEVE|THINK):', 1)) END AS action, CASE WHEN l IS NULL THEN r ELSE trim(substr(l, length(regexp_extract(upper(trim(l)), '^(ANSWER|RETRIEVE|THINK):', 1)) + 2)) END AS input FROM l""",
)
_REFLECTIONS = ('{"sufficient": true, "confidence": 0.9, "missing_info": [], "reasoning": "r{a}"}', '```json\n{"sufficient": false, "missing_info": ["specific fee {a}", "an example", "how it works", "the end"]}\n```', "not json {a}", '{"missing_info": ["the blob count {a}", "more DETAIL"], "confidence": 0.3}')


def _reflections(spark, d):
    rows = _replies(spark, d, _REFLECTIONS).select("o_orderkey", D.reflection(F.col("r")).alias("f")).select("o_orderkey", "f.*")
    return rows.select("o_orderkey", "sufficient", "confidence", "reasoning", F.array_join(D.follow_ups(F.col("missing")), "|").alias("follow_ups"))


register(
    "dec_agent_reflections",
    _reflections,
    """WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 97 AS a FROM orders) SELECT o_orderkey, k = 0 AS sufficient, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 0.3 END::DOUBLE AS confidence, CASE k WHEN 0 THEN 'r' || a WHEN 2 THEN 'Parse error' ELSE '' END AS reasoning,
  CASE k WHEN 0 THEN '' WHEN 1 THEN 'What are the specific details of specific fee ' || a || '?|Show examples of an example|how it works' WHEN 2 THEN 'Explain Unable to parse reflection response' ELSE 'Explain the blob count ' || a || '|What are the specific details of more DETAIL?' END AS follow_ups FROM r""",
)
_W = "regexp_extract_all({}, '\\S+')"
_ALTERNATIVE = f"CASE WHEN len({_W.format('q')}) > 5 THEN array_to_string({_W.format('q')}[1:5], ' ') WHEN len(list_filter({_W.format('q')}, lambda w: lower(w) IN ('how', 'what', 'why', 'when'))) > 0 THEN 'explain ' || array_to_string({_W.format('q')}[2:], ' ') ELSE 'details about ' || q END"
_DIFFERENT = f"CASE WHEN contains(lower(q), 'eip') THEN replace(replace(lower(q), 'eip-', 'EIP '), 'eip ', '') WHEN len({_W.format('q')}) > 3 THEN array_to_string({_W.format('q')}[1:3], ' ') ELSE 'overview of ' || q END"
register("dec_rewritten_queries", lambda s, d: asked(s, d).select("o_orderkey", D.alternative_query(F.col("q")).alias("alternative"), D.different_query(F.col("q")).alias("different")), f"WITH {ASKED} SELECT o_orderkey, {_ALTERNATIVE} AS alternative, {_DIFFERENT} AS different FROM q")


def _attempts(spark, d):
    """A session for each customer: its orders' questions."""
    n = F.col("o_orderkey")
    return asked(spark, d).select("o_custkey", "o_orderkey", F.when(n % 4 == 0, "what is a blob").otherwise(F.col("q")).alias("query"), (n % 3 == 0).alias("useful"), (n % 5).cast("int").alias("hits"), (n % 6).cast("int").alias("budget"))


register(
    "dec_backtracking",
    lambda s, d: D.backtracking(_attempts(s, d), "o_custkey", ["o_orderkey"]),
    f"""WITH {ASKED}, a AS (SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'what is a blob' ELSE q END AS q, o_orderkey % 3 = 0 AS useful, o_orderkey % 5 AS hits, o_orderkey % 6 AS budget, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM q), w AS (SELECT *, list_distinct({_W.format('lower(q)')}) AS w FROM a),
  l AS (SELECT x.*, y.w AS v, y.q AS lq, y.budget AS lb FROM w x JOIN w y ON x.o_custkey = y.o_custkey AND y.n = 1), g AS (SELECT o_custkey, count(*) AS c, count(*) FILTER (n <= 3 AND NOT useful) AS f, bool_or(n > 1 AND len(w) > 0 AND len(v) > 0 AND len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) > 0.8) AS a, count(*) FILTER (n <= 3 AND useful) AS u, avg(hits) FILTER (n <= 3) AS h, any_value(lq) AS q, any_value(lb) AS b FROM l GROUP BY o_custkey),
  r AS (SELECT o_custkey, q, CASE WHEN c >= 3 AND f = 3 THEN 'failures' WHEN a THEN 'circular' WHEN c >= 3 AND (u = 0 OR h < 1) THEN 'diminishing' WHEN b <= 1 THEN 'budget' ELSE 'none' END AS reason FROM g)
  SELECT o_custkey, reason <> 'none' AS backtrack, reason, CASE reason WHEN 'failures' THEN {_ALTERNATIVE} WHEN 'circular' THEN {_DIFFERENT} END AS alternative FROM r""",
)


def _runs(spark, d):
    """Documents as answers of three models to each of the questions that their numbers give."""
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.floor(n / 3).cast("bigint").alias("question"), (n % 3).cast("int").alias("place"), F.element_at(F.array(*map(F.lit, ("fast", "balanced", "powerful"))), (n % 3 + 1).cast("int")).alias("model"), F.when(n % 13 == 0, "timeout").alias("error"), F.when(n % 17 == 0, "").otherwise(F.concat(F.coalesce("text", F.lit("")), F.when(n % 4 == 0, "\n1. gas [2]").otherwise(""))).alias("response"), F.when(n % 5 == 0, (n % 10) / 10).alias("quality"), ((n % 7) / 100).alias("cost"), ((n % 9) * 10.0).alias("latency"))
    return rows


_QUALITY = f"CASE WHEN length(trim(response)) < 50 THEN 0.2 ELSE least(0.5 + CASE WHEN n BETWEEN 100 AND 1500 THEN 0.15 WHEN n > 50 THEN 0.1 ELSE 0 END + CASE WHEN {' OR '.join(f'''contains(response, {chr(39) + m.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) + chr(39)})''' for m in D.STRUCTURE)} THEN 0.1 ELSE 0 END + least(({' + '.join(f'''contains(lower(response), '{t}')::INTEGER''' for t in D.TERMS)}) * 0.02, 0.15) + CASE WHEN regexp_matches(response, '\\[\\d+\\]|\\[Source:') THEN 0.1 ELSE 0 END, 1.0) END"
_RUNS = f"""y AS (SELECT doc_id, doc_id // 3 AS question, doc_id % 3 AS place, (['fast', 'balanced', 'powerful'])[doc_id % 3 + 1] AS model, CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS error, CASE WHEN doc_id % 17 = 0 THEN '' ELSE coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '1. gas [2]' ELSE '' END END AS response, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 10) / 10 END AS given, (doc_id % 7) / 100 AS cost, (doc_id % 9) * 10.0::DOUBLE AS latency FROM documents),
  w AS (SELECT *, len({_W.format('response')}) AS n FROM y), runs AS (SELECT *, round(coalesce(given, {_QUALITY}), 6)::DOUBLE AS s, round({_QUALITY}, 6)::DOUBLE AS h FROM w)"""
register("dec_answer_quality", lambda s, d: _runs(s, d).select("doc_id", F.round(D.answer_quality(F.col("response")), 6).alias("quality")), f"WITH {_RUNS} SELECT doc_id, h AS quality FROM runs")
register(
    "dec_best_answer",
    lambda s, d: D.best_answer(_runs(s, d), "question", "place").select("question", "model", "confidence", "strategy", "cost", F.md5("response").alias("hash")),
    f"""WITH {_RUNS}, f AS (SELECT * FROM runs WHERE error IS NULL AND response <> ''), b AS (SELECT question, count(*) AS n, sum(cost) AS c, arg_min({{'m': model, 's': s, 'g': given, 'r': response}}, {{'a': -s, 'b': place}}) AS b FROM f GROUP BY question)
  SELECT question, b.m AS model, coalesce(CASE WHEN n = 1 THEN coalesce(nullif(b.g, 0), 0.7) ELSE b.s END, 0.0)::DOUBLE AS confidence, CASE WHEN n = 1 THEN 'single' ELSE 'best' END AS strategy, round(coalesce(c, 0.0), 6)::DOUBLE AS cost, md5(coalesce(b.r, 'Unable to generate response - all models failed.')) AS hash FROM (SELECT DISTINCT question FROM runs) LEFT JOIN b USING (question)""",
)
register(
    "dec_cascade",
    lambda s, d: D.cascade(_runs(s, d), "question"),
    f"""WITH {_RUNS}, f AS (SELECT *, CASE WHEN error IS NULL THEN s END AS q, sum(CASE WHEN error IS NULL THEN cost ELSE 0 END) OVER o AS c, sum(CASE WHEN error IS NULL THEN latency ELSE 0 END) OVER o AS l FROM runs WINDOW o AS (PARTITION BY question ORDER BY place)), p AS (SELECT question, min(place) FILTER (q >= 0.7) AS a, max(place) AS z FROM f GROUP BY question)
  SELECT f.question, model, q AS quality, round(c, 6)::DOUBLE AS cost, round(l, 6)::DOUBLE AS latency FROM f JOIN p ON f.question = p.question AND place = coalesce(a, z)""",
)
register("dec_merged_confidence", lambda s, d: D.merged_confidence(_runs(s, d), "question"), f"WITH {_RUNS} SELECT question, round(least(avg(coalesce(nullif(given, 0), {_QUALITY})) + 0.1, 1.0), 6)::DOUBLE AS merge, 0.85::DOUBLE AS vote FROM runs WHERE error IS NULL AND response <> '' GROUP BY question")
