"""Queries of evidence, structured outputs and streams run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import evidence as E
from quern.operators import structured as S
from quern.plans.catalog import register, table

_WINDOWS = """SELECT doc_id, s AS start, (s + size)::INTEGER AS "end", left(sub, size) AS span FROM (SELECT *, CASE WHEN s + length(sub) < length(text) AND strpos(reverse(sub), ' ') > 0 AND length(sub) - strpos(reverse(sub), ' ') > 50 THEN length(sub) - strpos(reverse(sub), ' ') ELSE length(sub) END AS size
  FROM (SELECT *, substr(text, s + 1, 500) AS sub FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 500 THEN [0] ELSE range(0, length(text) - 50, 450) END)::INTEGER AS s FROM documents)))"""
_WORDSET = "list_distinct(regexp_extract_all(lower({}), '[^ \\t\\n\\f\\r\\x0b]+'))"
register("evi_windows", lambda s, d: E.windows(table(s, d, "documents")).select("doc_id", "start", "end", F.sha2("span", 256).alias("hash")), f'SELECT doc_id, start, "end", sha256(span) AS hash FROM ({_WINDOWS}) WHERE length(span) >= 50 OR start = 0')


def _best(spark, d):
    claim = F.try_element_at(T.sentences(F.col("text")), F.lit(1))
    return E.best_spans_inside(table(spark, d, "documents"), claim).select("doc_id", "rank", "start", "score")


register(
    "evi_best_spans",
    _best,
    f"""WITH w AS (SELECT * FROM ({_WINDOWS}) WHERE length(span) >= 50 OR start = 0), c AS (SELECT doc_id, trim(regexp_extract_all(text, '[^.!?]+[.!?]+')[1], ' ') AS claim FROM documents),
  t AS (SELECT doc_id, start, {_WORDSET.format('claim')} AS a, {_WORDSET.format('span')} AS b FROM c JOIN w USING (doc_id) WHERE claim IS NOT NULL),
  s AS (SELECT doc_id, start, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END::DOUBLE AS score FROM t)
  SELECT doc_id, rank, start, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start)::INTEGER AS rank FROM s) WHERE rank <= 3""",
)


def _answers(spark, d):
    """Answers about lines of orders, with markers; some sentences of some have none."""
    second = F.when(F.col("l_linenumber") % 2 == 0, " It is cheap [7].").otherwise(" It is cheap.")
    c = F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" was shipped [1, "), F.col("l_linenumber"), F.lit("]."), second, F.lit(" Supplier "), F.col("l_suppkey"), F.when(F.col("l_suppkey") % 3 == 0, F.lit(" sent it!")).otherwise(F.concat(F.lit(" sent it ["), F.col("l_quantity").cast("int"), F.lit("]!"))))
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("answer_id"), c.alias("text"))


_ANSWERS = "a AS (SELECT l_orderkey || '-' || l_linenumber AS answer_id, 'Part ' || l_partkey || ' was shipped [1, ' || l_linenumber || '].' || CASE WHEN l_linenumber % 2 = 0 THEN ' It is cheap [7].' ELSE ' It is cheap.' END || ' Supplier ' || l_suppkey || CASE WHEN l_suppkey % 3 = 0 THEN ' sent it!' ELSE ' sent it [' || l_quantity::INTEGER || ']!' END AS text FROM lineitem)"
register(
    "evi_citation_coverage",
    lambda s, d: E.coverage(E.ledger(_answers(s, d))),
    f"""WITH {_ANSWERS}, l AS (SELECT answer_id, regexp_extract_all(text, '[^.!?]+[.!?]+') AS l FROM a), s AS (SELECT answer_id, i, l[i] AS s FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)), n AS (SELECT answer_id, i, bool_or(regexp_matches(s, '\\[\\d+(\\s*,\\s*\\d+)*\\]')) AS m FROM s GROUP BY answer_id, i), g AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (m) AS cited FROM n GROUP BY answer_id) SELECT answer_id, claims, cited, round(cited / claims, 6) AS ratio FROM g""",
)
register(
    "evi_citation_accuracy",
    lambda s, d: _answers(s, d).select("answer_id", F.round(E.citation_accuracy(T.markers(F.col("text")), F.lit(5)), 6).alias("accuracy")),
    f"""WITH {_ANSWERS}, m AS (SELECT answer_id, flatten(list_transform(regexp_extract_all(text, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda m: list_transform(regexp_extract_all(m, '\\d+'), lambda x: x::INTEGER))) AS m FROM a) SELECT answer_id, CASE WHEN len(m) = 0 THEN 1.0 ELSE round(len(list_filter(m, lambda x: x BETWEEN 1 AND 5)) / len(m), 6) END::DOUBLE AS accuracy FROM m""",
)


def _pivot(spark, d):
    cells = table(spark, d, "documents").select(F.col("source").alias("feature"), F.col("lang").alias("entity"), F.col("doc_id").cast("string").alias("value"))
    return S.comparison(cells, ["de", "en", "es", "fr"])


register("evi_comparison_pivot", _pivot, "SELECT source AS feature, " + ", ".join(f"coalesce(min(doc_id::VARCHAR) FILTER (lang = '{x}'), 'N/A') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")


def _timeline(spark, d):
    texts = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Ordered on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and again in Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate")).alias("text"))
    return S.timeline(texts, "o_orderkey").select("o_orderkey", "found", F.col("day").cast("string").alias("day"))


register(
    "evi_timeline",
    _timeline,
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS a, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS b, year(o_orderdate)::VARCHAR AS y, o_orderdate FROM orders)
  SELECT o_orderkey, a AS found, o_orderdate::DATE::VARCHAR AS day FROM o UNION ALL SELECT o_orderkey, b, (date_trunc('quarter', o_orderdate)::DATE)::VARCHAR FROM o UNION ALL SELECT o_orderkey, y, y || '-01-01' FROM o, range(2)""",
)


def _expanded(spark, d):
    from quern.plans.phrases import asked

    names = spark.createDataFrame([(1559, ["fee market", "pros"]), (20, ["chain", "evolve"])], "number int, names array<string>")
    return S.expand(asked(spark, d), names, "o_orderkey").select("o_orderkey", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


def _expansion_sql() -> str:
    from quern.plans.phrases import ASKED

    return f"""WITH {ASKED} SELECT o_orderkey, array_to_string(list_concat(e, list_filter(n, lambda x: NOT list_contains(e, x))), ',') AS numbers FROM (SELECT o_orderkey, list_sort(list_distinct(list_transform(regexp_extract_all(q, '(?i)eip[- ]?(\\d+)', 1), lambda x: x::INTEGER))) AS e,
  list_concat(CASE WHEN contains(lower(q), 'chain') OR contains(lower(q), 'evolve') THEN [20] ELSE [] END, CASE WHEN contains(lower(q), 'fee market') OR contains(lower(q), 'pros') THEN [1559] ELSE [] END) AS n FROM q)"""


register("evi_query_expansion", _expanded, _expansion_sql())
register(
    "str_window_counts",
    lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").cast("string").alias("start"), "event_type", "n"),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
)


def _recall(spark, d):
    """The languages of a source's short documents, searched for among its long ones."""
    docs = table(spark, d, "documents")
    per = lambda rows, name, case: rows.where("lang IS NOT NULL").groupBy("source").agg(F.collect_set(case("lang")).alias(name))
    both = docs.select("source").distinct().join(per(docs.where("n_chars < 200"), "expected", F.upper), "source", "left").join(per(docs.where("n_chars > 3000"), "found", F.lower), "source", "left")
    return both.select("source", F.round(E.source_recall(F.col("expected"), F.col("found")), 6).alias("recall"))


register(
    "evi_source_recall",
    _recall,
    """WITH s AS (SELECT DISTINCT source FROM documents), e AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars < 200 AND lang IS NOT NULL), f AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 3000 AND lang IS NOT NULL)
  SELECT s.source, CASE WHEN count(e.lang) = 0 THEN 1.0 ELSE round(count(f.lang) / count(e.lang), 6) END::DOUBLE AS recall FROM s LEFT JOIN e ON e.source = s.source LEFT JOIN f ON f.source = s.source AND f.lang = e.lang GROUP BY s.source""",
)


def _inline(spark, d):
    """Turns with a citation in their middle and two at their end; every fifth turn has none."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    n = F.length("text")
    marks = F.array(F.struct((n / 2).cast("int").alias("end"), F.lit("[A-1]").alias("citation")), F.struct(n.alias("end"), F.lit("[C-3]").alias("citation")), F.struct((n + 9).alias("end"), F.lit("[D-4]").alias("citation")), F.struct(n.alias("end"), F.lit("[B-2]").alias("citation")))
    claims = turns.where("turn % 5 <> 0").select("id", F.inline(marks))
    return E.cited_inline(turns.select("id", "text"), claims, "id")


register(
    "evi_cited_inline",
    _inline,
    """SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 5 = 0 OR text IS NULL THEN text ELSE left(text, length(text) // 2) || ' [A-1]' || substr(text, length(text) // 2 + 1) || ' [B-2] [C-3] [D-4]' END AS text FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)""",
)
