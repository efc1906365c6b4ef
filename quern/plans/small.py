"""Queries of smaller operators: JSON out of text, tolerant times, score normalisation, completeness and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.catalog import register, table

register(
    "sml_json_block",
    lambda s, d: table(s, d, "events").select("event_id", F.from_json(F.regexp_extract(F.concat(F.lit("Here you are: "), "props", F.lit(" - done")), r"(?s)(\{.*?\})", 1), "k int").alias("j")).select("event_id", "j.k"),
    "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events",
)
register(
    "sml_tolerant_time",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.try_to_timestamp(F.regexp_replace(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("+00:00")), "Z$", "+00:00")).cast("timestamp_ntz").cast("string").alias("t")),
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders",
)


def _normalised(spark, d):
    """RRF scores times 30 up to 1, else similarity, else 0.5: one scale for all kinds of hits."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("value") / 10000).alias("rrf"), F.when(F.col("event_type") == "click", F.col("value") / 1000).alias("similarity"))
    return e.select("event_id", F.round(F.coalesce(F.when(F.col("rrf").isNotNull(), F.least(F.col("rrf") * 30, F.lit(1.0))), "similarity", F.lit(0.5)), 6).alias("score"))


register(
    "sml_score_normalisation",
    _normalised,
    "SELECT event_id, round(CASE event_type WHEN 'view' THEN least(value / 10000 * 30, 1.0) WHEN 'click' THEN value / 1000 ELSE 0.5 END, 6)::DOUBLE AS score FROM events",
)
register(
    "sml_top_discussions",
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("posts"), F.max("turn").alias("last")).orderBy(F.desc("posts"), "conv_id").limit(50),
    "SELECT conv_id, count(*) AS posts, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY posts DESC, conv_id LIMIT 50",
)


def _completeness(spark, d):
    """Pages as extractions of as many pages as their title has words."""
    from quern.functions.scoring import completeness

    p = table(spark, d, "pages").withColumn("t", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    score = completeness(F.length("html"), F.size(F.split("t", " ")), F.regexp_count("html", F.lit('href="')), F.col("t"))
    return p.select("page_id", F.round(score, 6).alias("score"))


register(
    "sml_completeness",
    _completeness,
    """WITH p AS (SELECT page_id, length(html) AS c, len(regexp_extract_all(html, 'href="')) AS r, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages), q AS (SELECT *, len(string_split(t, ' ')) * 500 AS least FROM p)
  SELECT page_id, round(greatest(0.0, 1.0 - CASE WHEN c < least THEN (1 - c / least) * 0.3 ELSE 0 END - CASE WHEN r = 0 THEN 0.1 WHEN r < 5 THEN 0.05 ELSE 0 END - CASE WHEN t IN ('', 'Untitled') THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM q""",
)


def _inferred(spark, d):
    from quern.plans.graph import _calibrated

    kind = F.when(F.col("src") % 3 == 0, "extends").when(F.col("src") % 3 == 1, "conflicts").otherwise("related_to")
    return _calibrated(spark, d).withColumn("kind", kind).where("confidence >= 0.3").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean"))


def _inferred_sql() -> str:
    from quern.plans.catalog import ORACLES

    return f"SELECT CASE src % 3 WHEN 0 THEN 'extends' WHEN 1 THEN 'conflicts' ELSE 'related_to' END AS kind, count(*) AS n, round(avg(confidence), 4) AS mean FROM ({ORACLES['graph_edge_confidence_calibrated']}) WHERE confidence >= 0.3 GROUP BY kind"


register("sml_inference_stats", _inferred, _inferred_sql())
