"""Graph queries. Parts are nodes and part p requires p div 2 and p div 3; orders discuss parts; pages cite link targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.plans.catalog import register, table

ROOT, GOAL = 200, 1
EDGES = """e AS (SELECT DISTINCT p_partkey AS src, p_partkey // k AS dst, 'REQUIRES' AS type FROM part, (VALUES (2), (3)) t(k) WHERE p_partkey // k >= 1)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
    return p.select("src", F.expr("src div k").alias("dst"), F.lit("REQUIRES").alias("type")).where("dst >= 1").distinct()


def _roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root bigint")


def _closure_sql(root: int, depth: int, a: str = "src", b: str = "dst", name: str = "c") -> str:
    return f"{name}(id, depth) AS (SELECT {b}, 1 FROM e WHERE {a} = {root} UNION SELECT e.{b}, {name}.depth + 1 FROM {name} JOIN e ON e.{a} = {name}.id WHERE {name}.depth < {depth})"


register("graph_edges_checked", lambda s, d: G.checked_edges(edges(s, d), table(s, d, "part"), "p_partkey"), f"WITH {EDGES} SELECT * FROM e WHERE dst IN (SELECT p_partkey FROM part)")
register("graph_upstream_min_depth", lambda s, d: G.closure(edges(s, d), _roots(s, ROOT)).select("id", "depth"), f"WITH RECURSIVE {EDGES}, {_closure_sql(ROOT, 10)} SELECT id, min(depth)::INTEGER AS depth FROM c GROUP BY id")
register("graph_downstream_min_depth", lambda s, d: G.closure(edges(s, d), _roots(s, 3), 4, reverse=True).select("id", "depth"), f"WITH RECURSIVE {EDGES}, {_closure_sql(3, 4, 'dst', 'src')} SELECT id, min(depth)::INTEGER AS depth FROM c GROUP BY id")


def _both(spark, d):
    up = G.closure(edges(spark, d), _roots(spark, 12), 2).select("id", "depth", F.lit("upstream").alias("direction"))
    return up.unionByName(G.closure(edges(spark, d), _roots(spark, 12), 2, reverse=True).select("id", "depth", F.lit("downstream").alias("direction")))


register("graph_both_directions", _both, f"WITH RECURSIVE {EDGES}, {_closure_sql(12, 2)}, {_closure_sql(12, 2, 'dst', 'src', 'r')} SELECT id, min(depth)::INTEGER AS depth, 'upstream' AS direction FROM c GROUP BY id UNION ALL SELECT id, min(depth)::INTEGER, 'downstream' FROM r GROUP BY id")
_PATHS = """p(id, path, nodes) AS (SELECT {root}::BIGINT, '{root}', [{root}::BIGINT] UNION ALL SELECT e.dst, p.path || '>' || e.dst, list_append(p.nodes, e.dst) FROM p JOIN e ON e.src = p.id WHERE NOT list_contains(p.nodes, e.dst) AND len(p.nodes) <= {depth})"""
register(
    "graph_shortest_path",
    lambda s, d: G.shortest_path(edges(s, d), ROOT, GOAL).select(F.array_join("path", ">").alias("path"), "length"),
    f"WITH RECURSIVE {EDGES}, {_PATHS.format(root=ROOT, depth=10)} SELECT path, (len(nodes) - 1)::INTEGER AS length FROM p WHERE id = {GOAL} ORDER BY len(nodes), nodes LIMIT 1",
)
register("graph_tree_paths", lambda s, d: G.tree_paths(edges(s, d), ROOT), f"WITH RECURSIVE {EDGES}, {_PATHS.format(root=ROOT, depth=3)} SELECT id, path, (len(nodes) - 1)::INTEGER AS depth FROM p WHERE len(nodes) > 1")


def _common(spark, d):
    both = G.closure(edges(spark, d), _roots(spark, 180, 200))
    return both.groupBy("id").agg(F.countDistinct("root").alias("n")).where("n = 2").select("id")


register("graph_common_dependencies", _common, f"WITH RECURSIVE {EDGES}, {_closure_sql(180, 10)}, {_closure_sql(200, 10, name='r')} SELECT id FROM c INTERSECT SELECT id FROM r")


def _ends(key: str, other: str):
    def run(spark, d):
        ids = table(spark, d, "part").select(F.col("p_partkey").alias("id")).distinct()
        e = edges(spark, d).select(F.col(key).alias("id"))
        return ids.join(e, "id", "left_anti")

    return run


register("graph_leaf_nodes", _ends("src", "dst"), f"WITH {EDGES} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM e)")
register("graph_root_nodes", _ends("dst", "src"), f"WITH {EDGES} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT dst FROM e)")
register("graph_degree_top_n", lambda s, d: edges(s, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents")).orderBy(F.desc("dependents"), "id").limit(20), f"WITH {EDGES} SELECT dst AS id, count(*) AS dependents FROM e GROUP BY dst ORDER BY dependents DESC, id LIMIT 20")
register(
    "graph_co_mentions",
    lambda s, d: G.co_mentions(table(s, d, "lineitem"), "l_orderkey", "l_partkey").orderBy(F.desc("shared"), "a", "b").limit(20),
    "WITH m AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem) SELECT x.t AS a, y.t AS b, count(*) AS shared FROM m x JOIN m y ON x.s = y.s AND x.t < y.t GROUP BY ALL ORDER BY shared DESC, a, b LIMIT 20",
)


def _replies(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    target = c.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
    return c.join(target, (c["conv_id"] == target["_c"]) & (c["turn"] - 1 == target["_t"])).select("conv_id", "turn", F.col("_t").alias("reply_to"))


register("graph_reply_edges", _replies, "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT a.conv_id, a.turn, b.turn AS reply_to FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
register(
    "graph_participants",
    lambda s, d: table(s, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("posts")),
    "SELECT conv_id, role, count(*) AS posts FROM conversations GROUP BY ALL",
)


def _confident(spark, d):
    return edges(spark, d).withColumn("confidence", 0.8 + (F.col("src") % 5) * 0.05)


register(
    "graph_bounded_confidence",
    lambda s, d: G.bounded_search(_confident(s, d), ROOT),
    f"""WITH RECURSIVE {EDGES}, l1 AS (SELECT dst AS id, 1 AS depth, max(round(1.0 * (0.8 + (src % 5) * 0.05), 6))::DOUBLE AS confidence FROM e WHERE src = {ROOT} GROUP BY dst HAVING max(round(1.0 * (0.8 + (src % 5) * 0.05), 6)) >= 0.7),
  l2 AS (SELECT dst AS id, 2 AS depth, max(round(confidence * (0.8 + (src % 5) * 0.05), 6))::DOUBLE AS confidence FROM e JOIN l1 ON src = l1.id WHERE round(confidence * (0.8 + (src % 5) * 0.05), 6) >= 0.7 AND dst NOT IN (SELECT id FROM l1) AND dst <> {ROOT} GROUP BY dst),
  l3 AS (SELECT dst AS id, 3 AS depth, max(round(confidence * (0.8 + (src % 5) * 0.05), 6))::DOUBLE AS confidence FROM e JOIN l2 ON src = l2.id WHERE round(confidence * (0.8 + (src % 5) * 0.05), 6) >= 0.7 AND dst NOT IN (SELECT id FROM l1 UNION SELECT id FROM l2) AND dst <> {ROOT} GROUP BY dst)
  SELECT id, depth::INTEGER AS depth, confidence FROM l1 UNION ALL SELECT id, depth::INTEGER, confidence FROM l2 UNION ALL SELECT id, depth::INTEGER, confidence FROM l3""",
)


def _calibrated(spark, d):
    e = edges(spark, d)
    c = G.edge_confidence((F.col("src") % 10) / 10, (F.col("dst") % 7) / 7, (F.col("src") % 3) / 3, (F.col("dst") % 4) / 4, F.col("src") % 6, F.col("dst") % 90)
    return e.select("src", "dst", F.round(G.calibrated(c, F.col("src") % 11 == 0, F.col("src") % 7 == 0, 3, 10), 6).alias("confidence"))


register(
    "graph_edge_confidence_calibrated",
    _calibrated,
    f"""WITH {EDGES}, c AS (SELECT src, dst, 0.4::DOUBLE * least((dst % 7)::DOUBLE / 7 + least((src % 6) * 0.05::DOUBLE, 0.2::DOUBLE) + least((dst % 90) / 500, 0.1::DOUBLE), 1.0) + 0.25::DOUBLE * coalesce(nullif((src % 10)::DOUBLE / 10, 0), 0.5) + 0.2::DOUBLE * coalesce(nullif((src % 3)::DOUBLE / 3, 0), 0.5) + 0.15::DOUBLE * coalesce(nullif((dst % 4)::DOUBLE / 4, 0), 0.5) AS c FROM e)
  SELECT src, dst, round(CASE WHEN src % 11 = 0 THEN c * 0.3::DOUBLE WHEN src % 7 = 0 THEN least(c * 1.2::DOUBLE, 1.0) ELSE c * (0.8::DOUBLE + 0.4::DOUBLE * 0.3::DOUBLE) END, 6) AS confidence FROM c""",
)


def citations(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("citing"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("cited"))


CITED = "c AS (SELECT page_id AS citing, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS cited FROM pages)"
register("graph_citation_edges", citations, f"WITH {CITED} SELECT citing, cited FROM c")
register("graph_citation_degree", lambda s, d: citations(s, d).groupBy("cited").agg(F.count("*").alias("citations")), f"WITH {CITED} SELECT cited, count(*) AS citations FROM c GROUP BY cited")


def _division(spark, d):
    pairs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_mktsegment")
    return G.division(pairs, "n_regionkey", "c_mktsegment", table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey")))


register(
    "graph_relational_division",
    _division,
    "SELECT c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment HAVING count(DISTINCT n_regionkey) = (SELECT count(*) FROM region)",
)


def _counts(spark, d):
    kinds = spark.createDataFrame([("REQUIRES",), ("SUPERSEDES",), ("REPLACES",)], "type string")
    found = edges(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return kinds.join(found, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


register("graph_edge_counts_with_zeros", _counts, f"WITH {EDGES} SELECT t.type, count(e.src) AS n FROM (VALUES ('REQUIRES'), ('SUPERSEDES'), ('REPLACES')) t(type) LEFT JOIN e USING (type) GROUP BY t.type")


def _view(spark, d):
    up = G.closure(edges(spark, d), _roots(spark, ROOT), 3).select("id", "depth")
    return up.select("id", "depth", F.lit("dependency").alias("kind"), F.round(1 / F.col("depth"), 6).alias("weight"))


register("graph_dependency_view_nodes", _view, f"WITH RECURSIVE {EDGES}, {_closure_sql(ROOT, 3)} SELECT id, min(depth)::INTEGER AS depth, 'dependency' AS kind, round(1.0::DOUBLE / min(depth), 6) AS weight FROM c GROUP BY id")


def _degrees(spark, d):
    c = citations(spark, d).select(F.col("citing").cast("string").alias("citing"), "cited")
    ends = c.select(F.col("cited").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(c.select("citing", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("cited_by"), F.sum("o").alias("cites"))


register("graph_citation_degrees", _degrees, f"WITH {CITED} SELECT node, sum(i)::BIGINT AS cited_by, sum(o)::BIGINT AS cites FROM (SELECT cited AS node, 1 AS i, 0 AS o FROM c UNION ALL SELECT citing::VARCHAR, 0, 1 FROM c) GROUP BY node")
