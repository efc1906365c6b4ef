"""Queries of filters, joins, set operations, keyed writes and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import tables as B
from quern.plans.catalog import ORACLES, register, table
from quern.scratch import new_scratch
from quern.sources.keyed import KeyedTable

register(
    "tab_metadata_filter",
    lambda s, d: B.metadata_filter(table(s, d, "orders"), one_of={"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, between={"o_orderdate": ("1993-01-01", "1996-12-31 23")}).select("o_orderkey", "o_orderstatus"),
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::VARCHAR >= '1993-01-01' AND o_orderdate::VARCHAR <= '1996-12-31 23'",
)
register(
    "tab_author_ilike_any",
    lambda s, d: B.metadata_filter(table(s, d, "part"), like_any={"p_name": ["AL", "ar_"], "p_type": ["small", "E%N"]}).select("p_partkey", "p_name"),
    "SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%AL%' OR p_name ILIKE '%ar_%') AND (p_type ILIKE '%small%' OR p_type ILIKE '%E%N%')",
)
register("tab_filter_without_fields", lambda s, d: B.metadata_filter(table(s, d, "nation")).select("n_nationkey"), "SELECT n_nationkey FROM nation")


def _requires(spark, d):
    docs = table(spark, d, "part").select("p_partkey", F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3")).alias("requires"))
    return B.metadata_filter(docs, contains={"requires": 7}).select("p_partkey")


register("tab_array_contains_requires", _requires, "SELECT p_partkey FROM part WHERE p_partkey // 2 = 7 OR p_partkey // 3 = 7")
register(
    "tab_domain_validation",
    lambda s, d: table(s, d, "documents").select("doc_id", B.valid(F.col("lang"), ("en", "de", "fr")).alias("valid")),
    "SELECT doc_id, coalesce(lang IN ('en', 'de', 'fr'), false) AS valid FROM documents",
)
register(
    "tab_json_field_distinct",
    lambda s, d: table(s, d, "events").select(F.get_json_object("props", "$.k").try_cast("int").alias("k")).where("k IS NOT NULL").distinct(),
    "SELECT DISTINCT try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL",
)
register("tab_skip_existing_anti", lambda s, d: B.unseen(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), "doc_id"), "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def _enriched(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    url = F.when(F.col("source").startswith("src1"), F.concat(F.lit("https://one.example/"), F.col("doc_id"))).otherwise(F.concat_ws("/", F.lit("https://other.example"), "source", "doc_id"))
    return docs.join(labels, "doc_id", "left").select("doc_id", url.alias("url"), "quality")


register(
    "tab_source_enrichment",
    _enriched,
    "SELECT d.doc_id, CASE WHEN starts_with(source, 'src1') THEN 'https://one.example/' || d.doc_id ELSE 'https://other.example/' || source || '/' || d.doc_id END AS url, quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id",
)


def _precedence(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("who")).distinct()
    b = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("who")).distinct()
    return B.precedence_union([a, b], "k")


register("tab_precedence_union", _precedence, "WITH b AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) SELECT k, 'customer' AS who FROM b UNION SELECT s_nationkey, 'supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT k FROM b)")


def _drift(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 3").select("doc_id", "text")
    new = docs.where("doc_id % 10 <> 4").select("doc_id", F.when(F.col("doc_id") % 10 == 5, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return B.drift(old, new, "doc_id", "text")


register(
    "tab_drift_report",
    _drift,
    """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 10 = 4 THEN 'removed' WHEN doc_id % 10 = 5 AND upper(text) <> text THEN 'modified' ELSE 'unchanged' END AS change FROM documents""",
)
register(
    "tab_staleness",
    lambda s, d: B.stale(table(s, d, "events"), "2024-02-01 00:00:00", 24 * 7, "ts").select("event_id", "age_hours"),
    "SELECT event_id, datediff_hours AS age_hours FROM (SELECT event_id, floor(epoch(TIMESTAMP '2024-02-01 00:00:00' - ts) / 3600)::BIGINT AS datediff_hours FROM events) WHERE datediff_hours >= 168",
)


def _upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    target = docs.where("lang <> 'fr'")
    source = docs.withColumn("source", F.concat("source", F.lit("!"))).withColumn("lang", F.upper("lang")).withColumn("v", F.col("doc_id"))
    return B.upsert(target, source, "doc_id", ["source"], "v").select("doc_id", "source", "lang")


register("tab_upsert_last_write", _upsert, "SELECT doc_id, source || '!' AS source, CASE WHEN lang <> 'fr' THEN lang ELSE upper(lang) END AS lang FROM documents")


def _kept_table(spark, d):
    """The same upsert into a stored keyed table, in three batches, one of them twice."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.col("doc_id").alias("v"))
    stored = KeyedTable(spark, new_scratch(spark), "doc_id", "doc_id bigint, source string, lang string, v bigint")
    stored.upsert(docs.where("lang <> 'fr'"), ["source"], "v")
    source = docs.withColumn("source", F.concat("source", F.lit("!"))).withColumn("lang", F.upper("lang"))
    for part in (0, 1, 2, 1):
        stored.upsert(source.where(F.col("doc_id") % 3 == part), ["source"], "v")
    return stored.read().select("doc_id", "source", "lang")


register("tab_keyed_table", _kept_table, ORACLES["tab_upsert_last_write"])


def _cascade(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return B.cascade_delete(table(spark, d, "orders"), table(spark, d, "lineitem"), gone, "o_orderkey", "l_orderkey")[1].groupBy("l_returnflag").agg(F.count("*").alias("n"))


register("tab_cascade_delete", _cascade, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag")
register(
    "tab_migration_pending",
    lambda s, d: B.pending_migrations(table(s, d, "nation").select(F.col("n_nationkey").alias("version")), table(s, d, "region").select(F.col("r_regionkey").alias("version"))),
    "SELECT n_nationkey AS version FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)",
)


def _cursor(spark, d):
    rows, top = B.since(table(spark, d, "events"), "ts", "2024-01-20 00:00:00")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), top.cast("string").alias("cursor"))


register("tab_cursor_sync", _cursor, "SELECT event_type, count(*) AS n, rtrim(rtrim(strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS cursor FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY event_type")
register("tab_corpus_counts", lambda s, d: table(s, d, "documents").agg(F.count("*").alias("documents"), F.sum(F.size(F.split("text", "\n"))).alias("chunks")), "SELECT count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents")
register("tab_counts_by_type", lambda s, d: table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
register(
    "tab_cache_stats",
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("entries"), F.sum(F.octet_length("text")).alias("bytes"), F.round(F.sum(F.octet_length("text")) / 1048576, 2).alias("mb")),
    "SELECT source, count(*) AS entries, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text))::BIGINT / 1048576::DOUBLE, 2) AS mb FROM documents GROUP BY source",
)
register(
    "tab_unique_sources",
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")),
    "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source",
)
register(
    "tab_similarity_stats",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most")),
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, round(avg(l_discount), 6) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL",
)
register(
    "tab_chunks_per_document_total",
    lambda s, d: table(s, d, "documents").where(F.col("source").startswith("src1")).select("source", F.size(F.split("text", "\n")).alias("c")).groupBy("source").agg(F.sum("c").alias("chunks")).withColumn("total", F.expr("sum(chunks) OVER ()")),
    "WITH c AS (SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents WHERE starts_with(source, 'src1') GROUP BY source) SELECT source, chunks, (sum(chunks) OVER ())::BIGINT AS total FROM c",
)
register(
    "tab_max_posts_wins",
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey")),
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
)
register(
    "tab_metadata_merge",
    lambda s, d: table(s, d, "events").select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("type"))).alias("merged")),
    """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}' AS merged FROM events""",
)


def _maps(spark, d):
    """Event properties under a newer record, which has k for even ids only."""
    new = F.create_map(F.lit("type"), F.col("event_type"))
    right = F.when(F.col("event_id") % 2 == 0, B.merged_maps(new, F.create_map(F.lit("k"), F.lit("new")))).otherwise(new)
    merged = F.map_entries(B.merged_maps(F.from_json("props", "map<string,string>"), right))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("merged"))


register(
    "tab_map_merge",
    _maps,
    """SELECT event_id, array_to_string(list_sort(list_concat(list_transform(list_filter(coalesce(json_keys(props), []), lambda k: k <> 'type' AND (k <> 'k' OR event_id % 2 = 1)), lambda k: k || '=' || json_extract_string(props, '$.' || k)), list_filter(['type=' || event_type, CASE WHEN event_id % 2 = 0 THEN 'k=new' END], lambda x: x IS NOT NULL))), ';') AS merged FROM events""",
)


def _backfilled(spark, d):
    from quern.operators.sync import with_backfill

    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return with_backfill(events.where("ts >= TIMESTAMP_NTZ '2024-01-25 00:00:00'"), events, events.where("event_id % 3 = 0").select("event_id"), "event_id").select("event_id", "backfill")


register("src_backfill", _backfilled, "SELECT event_id, ts < TIMESTAMP '2024-01-25' AS backfill FROM events WHERE ts >= TIMESTAMP '2024-01-25' OR event_id % 3 <> 0")
