"""Queries of graph building, forum and paper graphs, inference and links to code. Parts are proposals, conversations topics, pages papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import knowledge as K
from quern.plans.catalog import register, table

_STATUS = ("Draft", "Final", "Living")


def proposals(spark, d):
    p, n = table(spark, d, "part"), F.col("p_partkey")
    requires = F.when(n % 4 == 0, F.concat(F.lit("EIP-"), F.expr("p_partkey div 2"), F.lit(", eip "), F.expr("p_partkey div 3"))).when(n % 4 == 1, F.concat(F.lit("["), F.expr("p_partkey div 2"), F.lit("]"))).when(n % 4 == 2, F.expr("p_partkey div 5").cast("string"))
    return p.select(n.alias("number"), F.col("p_name").alias("title"), F.element_at(F.array(*map(F.lit, _STATUS)), (n % 3 + 1).cast("int")).alias("status"), F.col("p_type").alias("type"), F.col("p_brand").alias("category"), requires.alias("requires"), F.when(n % 10 == 0, F.concat(F.lit("eip"), n + 1)).alias("superseded_by"), F.when((n % 7 == 0) & (n > 0), (n - 1).cast("string")).alias("replaces"))


_PROPOSALS = f"""props AS (SELECT p_partkey AS number, p_name AS title, ({list(_STATUS)})[p_partkey % 3 + 1] AS status, p_type AS type, p_brand AS category, CASE p_partkey % 4 WHEN 0 THEN [p_partkey // 2, p_partkey // 3] WHEN 1 THEN [p_partkey // 2] WHEN 2 THEN [p_partkey // 5] ELSE [] END AS requires, CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 1 END AS succ, CASE WHEN p_partkey % 7 = 0 AND p_partkey > 0 THEN p_partkey - 1 END AS replaces FROM part)"""
_EDGES = f"""{_PROPOSALS}, raw AS (SELECT number AS src, unnest(requires) AS dst, 'REQUIRES' AS type FROM props UNION ALL SELECT succ, number, 'SUPERSEDES' FROM props WHERE succ IS NOT NULL UNION ALL SELECT number, replaces, 'REPLACES' FROM props WHERE replaces IS NOT NULL),
  edges AS (SELECT DISTINCT src, dst, type FROM raw WHERE src IN (SELECT number FROM props) AND dst IN (SELECT number FROM props))"""


def _graph(spark, d):
    p = proposals(spark, d)
    nodes = K.proposal_nodes(p)
    return nodes, K.proposal_edges(p, nodes)


register("know_nodes", lambda s, d: _graph(s, d)[0], f"WITH {_PROPOSALS} SELECT number, title, status, type, category FROM props")
register("know_edges", lambda s, d: _graph(s, d)[1], f"WITH {_EDGES} SELECT * FROM edges")
register("know_edges_of_type", lambda s, d: K.listed(_graph(s, d)[1], "REPLACES"), f"WITH {_EDGES} SELECT * FROM edges WHERE type = 'REPLACES'")
register("know_stats", lambda s, d: K.stats(*_graph(s, d)), f"WITH {_EDGES} SELECT 'nodes' AS what, count(*) AS n FROM props UNION ALL SELECT t.what, count(src) FROM (VALUES ('REQUIRES'), ('SUPERSEDES'), ('REPLACES')) t(what) LEFT JOIN edges ON type = t.what GROUP BY t.what")
register(
    "know_supersession",
    lambda s, d: K.supersession(_graph(s, d)[1], proposals(s, d)).select("number", F.array_join(F.col("supersedes").cast("array<string>"), ",").alias("supersedes"), F.array_join(F.col("superseded_by").cast("array<string>"), ",").alias("superseded_by")),
    f"WITH {_EDGES}, e AS (SELECT * FROM edges WHERE type = 'SUPERSEDES') SELECT number, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = number), '') AS supersedes, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = number), '') AS superseded_by FROM props",
)


def _grown(spark, d, part):
    """Half of the proposals first, then the others and a changed one."""
    p = proposals(spark, d)
    first, more = p.where("number % 2 = 0"), p.where("number % 2 = 1").unionByName(p.where("number = 10").withColumn("title", F.lit("changed")).withColumn("requires", F.lit("1, 3")))
    nodes = K.proposal_nodes(first)
    return K.added(nodes, K.proposal_edges(first, nodes), more)[part]


register("know_added_nodes", lambda s, d: _grown(s, d, 0), f"WITH {_PROPOSALS} SELECT number, CASE WHEN number = 10 THEN 'changed' ELSE title END AS title, status, type, category FROM props")
register(
    "know_added_edges",
    lambda s, d: _grown(s, d, 1),
    f"""WITH {_EDGES}, late AS (SELECT src, unnest([1, 3])::BIGINT AS dst, 'REQUIRES' AS type FROM (SELECT number AS src FROM props WHERE number = 10)),
  one AS (SELECT r.* FROM raw r JOIN props a ON a.number = src JOIN props b ON b.number = dst WHERE src % 2 = 0 AND dst % 2 = 0), two AS (SELECT r.* FROM raw r JOIN props a ON a.number = src JOIN props b ON b.number = dst WHERE CASE r.type WHEN 'SUPERSEDES' THEN dst % 2 = 1 OR dst = 10 ELSE src % 2 = 1 OR (src = 10 AND r.type = 'REPLACES') END)
  SELECT DISTINCT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM late WHERE dst IN (SELECT number FROM props))""",
)


def _upsert(spark, d):
    """Topics are conversations; later listings change titles and counts of known ones and bring new ones."""
    old = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("topic_id")).agg(F.lit("old").alias("title"), F.lit("c").alias("category"), F.count("*").alias("posts_count")).where("topic_id % 3 > 0")
    new = table(spark, d, "conversations").select(F.col("conv_id").alias("topic_id")).distinct().where("topic_id % 2 = 0").select("topic_id", F.lit("new").alias("title"), F.lit("d").alias("category"), F.lit(99).cast("bigint").alias("posts_count"))
    return K.upserted(old, new, ["topic_id"], ["title", "posts_count"])


register(
    "know_topic_upsert",
    _upsert,
    "SELECT conv_id AS topic_id, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN conv_id % 3 = 0 THEN 'd' ELSE 'c' END AS category, CASE WHEN conv_id % 2 = 0 THEN 99 ELSE count(*) END AS posts_count FROM conversations GROUP BY conv_id HAVING conv_id % 3 > 0 OR conv_id % 2 = 0",
)


def posts(spark, d):
    """Turns as posts: every third replies to nothing, others to the post before or to one that may not exist."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("r"))
    reply = F.when(F.col("turn") % 3 == 0, None).when(F.col("turn") % 3 == 1, F.col("turn") - 1).otherwise(F.col("turn") - 2)
    note = F.concat(F.coalesce("r.text", F.lit("")), F.lit(" EIP-"), (F.col("conv_id") % 60).cast("string"), F.lit(", eip "), (F.col("turn") * 7).cast("string"), F.lit(" xeip-3 EIP-9y"))
    return c.select(F.col("conv_id").alias("topic_id"), F.col("turn").alias("post_number"), reply.alias("reply_to"), F.col("r.role").alias("username"), note.alias("content"))


_POSTS = "c AS (SELECT conv_id, turn, min({'role': role, 'text': text}) AS r FROM conversations GROUP BY ALL), posts AS (SELECT conv_id AS topic_id, turn AS post_number, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN turn - 1 ELSE turn - 2 END AS reply_to, r.role AS username, coalesce(r.text, '') || ' EIP-' || (conv_id % 60) || ', eip ' || (turn * 7) || ' xeip-3 EIP-9y' AS content FROM c)"


def _topics(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("topic_id")).distinct().where("topic_id % 5 > 0").withColumn("title", F.concat(F.lit("On eip"), (F.col("topic_id") % 50).cast("string")))


_TOPICS = "topics AS (SELECT DISTINCT conv_id AS topic_id, 'On eip' || (conv_id % 50) AS title FROM conversations WHERE conv_id % 5 > 0)"
register(
    "know_forum_edges",
    lambda s, d: K.forum_edges(posts(s, d), _topics(s, d)),
    f"""WITH {_POSTS}, {_TOPICS} SELECT 'POSTED_IN' AS kind, topic_id || '#' || post_number AS from_id, topic_id::VARCHAR AS to_id FROM posts WHERE topic_id IN (SELECT topic_id FROM topics)
  UNION ALL SELECT 'REPLIES_TO', a.topic_id || '#' || a.post_number, a.topic_id || '#' || a.reply_to FROM posts a JOIN posts b ON a.topic_id = b.topic_id AND b.post_number = a.reply_to""",
)
register(
    "know_parent_chain",
    lambda s, d: K.parent_chain(_replied(s, d)),
    f"""WITH RECURSIVE {_POSTS}, e AS (SELECT a.topic_id, a.post_number, a.post_number - 1 AS reply_to FROM posts a JOIN posts b ON a.topic_id = b.topic_id AND b.post_number = a.post_number - 1), r AS (SELECT topic_id, post_number, reply_to AS parent, 1 AS depth FROM e UNION ALL SELECT r.topic_id, r.post_number, e.reply_to, r.depth + 1 FROM r JOIN e ON e.topic_id = r.topic_id AND e.post_number = r.parent WHERE r.depth < 10) SELECT topic_id, post_number, parent, depth::INTEGER AS depth FROM r""",
)


def _replied(spark, d):
    p = posts(spark, d)
    there = p.select("topic_id", (F.col("post_number") + 1).alias("post_number"), F.col("post_number").alias("reply_to"))
    return p.select("topic_id", "post_number").join(there, ["topic_id", "post_number"])


register(
    "know_user_posts",
    lambda s, d: K.latest_posts(posts(s, d).withColumn("created_at", F.col("post_number")), "user").select("topic_id", "post_number"),
    f"WITH {_POSTS} SELECT topic_id, post_number FROM posts WHERE username = 'user' ORDER BY post_number DESC, topic_id LIMIT 50",
)
_MENTIONED = "list_sort(list_distinct(list_transform(regexp_extract_all({}, '(?i)\\beip[- ]?(\\d+)\\b', 1), lambda x: x::BIGINT)))"
register(
    "know_discusses",
    lambda s, d: K.discusses(_topics(s, d), posts(s, d), proposals(s, d)),
    f"""WITH {_POSTS}, {_TOPICS}, m AS (SELECT topic_id, post_number, unnest({_MENTIONED.format('content')}) AS number FROM posts), t AS (SELECT topic_id, unnest({_MENTIONED.format('title')}) AS number FROM topics)
  SELECT * FROM (SELECT 'topic' AS level, topic_id, NULL::INTEGER AS post_number, number FROM (SELECT * FROM t UNION SELECT topic_id, number FROM m) UNION ALL SELECT 'post', topic_id, post_number::INTEGER, number FROM m) WHERE number IN (SELECT p_partkey FROM part)""",
)


def papers(spark, d):
    """Pages as papers: links and made-up references of each kind."""
    n = F.col("page_id")
    refs = F.array(F.concat(F.lit("A. Author, On Fees, arXiv:"), F.lpad((n % 7).cast("string"), 4, "1"), F.lit(".12345v2")), F.concat(F.lit("B. Author, doi 10.1000/x"), n % 11, F.lit(" 2020")), F.concat(F.lit("C.  Author, a long title\tof a paper number "), n % 5), F.lit("short"), F.concat(F.lit("again arxiv "), F.lpad((n % 7).cast("string"), 4, "1"), F.lit(".12345v2")))
    return table(spark, d, "pages").select(F.concat(F.lit("page:"), n).alias("paper_id"), F.col("url").alias("title"), refs.alias("references"))


_PAPERS = """papers AS (SELECT 'page:' || page_id AS paper_id, url AS title, ['A. Author, On Fees, arXiv:' || lpad((page_id % 7)::VARCHAR, 4, '1') || '.12345v2', 'B. Author, doi 10.1000/x' || (page_id % 11) || ' 2020', 'C.  Author, a long title' || chr(9) || 'of a paper number ' || (page_id % 5), 'short', 'again arxiv ' || lpad((page_id % 7)::VARCHAR, 4, '1') || '.12345v2'] AS refs FROM pages),
  refs AS (SELECT paper_id, i, refs[i] AS r FROM (SELECT *, unnest(range(1, len(refs) + 1)) AS i FROM papers)), ids AS (SELECT paper_id, i, r, regexp_extract(r, '(?i)arXiv[:\\s]*(\\d{4}\\.\\d{4,5}(?:v\\d+)?)', 1) AS a, regexp_extract(r, '10\\.\\d{4,}/[^\\s]+') AS d, regexp_replace(trim(lower(left(r, 100))), '\\s+', ' ', 'g') AS t FROM refs),
  cites AS (SELECT paper_id, i, r, CASE WHEN a <> '' THEN 'arxiv:' || a WHEN d <> '' THEN 'doi:' || d WHEN length(t) > 20 THEN 'ref:' || left(md5(t), 12) END AS cited FROM ids)"""
register("know_paper_edges", lambda s, d: K.citation_graph(papers(s, d))[1], f"WITH {_PAPERS} SELECT paper_id AS citing, cited, left(arg_min(r, i), 200) AS context FROM cites WHERE cited IS NOT NULL GROUP BY paper_id, cited")
register("know_paper_nodes", lambda s, d: K.citation_graph(papers(s, d))[0], f"WITH {_PAPERS} SELECT paper_id, title FROM papers UNION ALL SELECT DISTINCT cited, NULL FROM cites WHERE cited IS NOT NULL")
register("know_citation_context", lambda s, d: K.citation_graph(papers(s, d))[1].where("citing = 'page:3'").select("cited", "context"), f"WITH {_PAPERS} SELECT cited, left(arg_min(r, i), 200) AS context FROM cites WHERE cited IS NOT NULL AND paper_id = 'page:3' GROUP BY cited")


def _typed(spark, d):
    """Explicit edges, and inferred ones of changing confidence."""
    e = _graph(spark, d)[1].select("src", "dst", "type", F.lit(1.0).alias("confidence"), F.lit(False).alias("inferred"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 4 + 1").alias("dst"))
    kind = F.element_at(F.array(*map(F.lit, K.INFERRED)), (F.col("src") % 2 + 4).cast("int"))
    return e.unionByName(p.select("src", "dst", kind.alias("type"), (0.8 + (F.col("src") % 4) * 0.05).alias("confidence"), F.lit(True).alias("inferred")))


_TYPED = f"{_EDGES}, typed AS (SELECT src, dst, type, 1.0::DOUBLE AS confidence, false AS inferred FROM edges UNION ALL SELECT p_partkey, p_partkey // 4 + 1, ({list(K.INFERRED)})[p_partkey % 2 + 4], 0.8::DOUBLE + (p_partkey % 4) * 0.05::DOUBLE, true FROM part)"


def _levels(source: str, root: int, depth: int, ends: str = "src, dst") -> str:
    """Levels of a search that keeps a node's first level and best path there."""
    out = f"s AS (SELECT {ends.split(',')[0]} AS a, {ends.split(',')[1]} AS b, confidence AS c FROM {source}), l0 AS (SELECT {root}::BIGINT AS id, [{root}::BIGINT] AS path, 1.0::DOUBLE AS confidence, 0 AS depth)"
    for n in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{k}" for k in range(n))
        out += f", l{n} AS (SELECT id, path, confidence, {n} AS depth FROM (SELECT s.b AS id, list_append(path, s.b) AS path, round(l{n - 1}.confidence * s.c, 6) AS confidence, row_number() OVER (PARTITION BY s.b ORDER BY round(l{n - 1}.confidence * s.c, 6) DESC, list_append(path, s.b)) AS k FROM l{n - 1} JOIN s ON s.a = l{n - 1}.id WHERE round(l{n - 1}.confidence * s.c, 6) >= 0.7) WHERE k = 1 AND id NOT IN ({seen}))"
    return out


register(
    "know_bounded_path",
    lambda s, d: K.bounded_path(_typed(s, d), 120, 8).select(F.array_join("path", ">").alias("path"), "confidence", "depth"),
    f"WITH {_TYPED}, {_levels('typed', 120, 3)} SELECT array_to_string(path, '>') AS path, confidence, depth::INTEGER AS depth FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE id = 8",
)
register(
    "know_related_by_type",
    lambda s, d: K.related_by_type(_typed(s, d), 40, "builds_on"),
    f"WITH {_TYPED}, two AS (SELECT src, dst, confidence FROM typed WHERE type = 'builds_on' UNION ALL SELECT dst, src, confidence FROM typed WHERE type = 'builds_on'), {_levels('two', 40, 3)} SELECT id, depth::INTEGER AS depth, confidence, array_to_string(path, ' -> ') AS path FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)",
)
register(
    "know_typed_neighbours",
    lambda s, d: K.neighbours(_typed(s, d), s.createDataFrame([(6,), (15,)], "id bigint"), ("requires", "builds_on", "REPLACES")),
    f"WITH {_TYPED}, k AS (SELECT * FROM typed WHERE lower(type) IN ('requires', 'builds_on', 'replaces')) SELECT src AS id, dst AS neighbour, type, confidence, inferred FROM k WHERE src IN (6, 15) UNION ALL SELECT dst, src, type, confidence, inferred FROM k WHERE dst IN (6, 15)",
)


def _replies_of_model(spark, d):
    n = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("Builds_On", "odd", "conflicts_with"))), (n % 3 + 1).cast("int"))
    item = F.concat(F.lit('{"relationship_type": "'), kind, F.lit('", "confidence": '), (n % 10) / 10, F.lit(', "evidence": ["a"], "reasoning": "r"}'))
    return table(spark, d, "part").select(n.alias("src"), F.expr("p_partkey div 2").alias("dst"), F.when(n % 5 == 0, F.lit("no json")).otherwise(F.concat(F.lit("Here: ["), item, F.lit(', {"confidence": 0.4}] done'))).alias("reply"))


register(
    "know_inferred_relations",
    lambda s, d: K.parsed_relations(_replies_of_model(s, d), ["src", "dst"]).withColumn("evidence", F.array_join("evidence", ",")),
    """SELECT p_partkey AS src, p_partkey // 2 AS dst, CASE p_partkey % 3 WHEN 0 THEN 'builds_on' WHEN 1 THEN 'related_to' ELSE 'conflicts_with' END AS type, (p_partkey % 10) / 10 AS confidence, 'a' AS evidence, 'r' AS reasoning FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 10 >= 3
  UNION ALL SELECT p_partkey, p_partkey // 2, 'related_to', 0.4, '', '' FROM part WHERE p_partkey % 5 > 0""",
)


def _reinferred(spark, d):
    e = _typed(spark, d).where("inferred").select("src", "dst", "type", "confidence", F.lit("old").alias("source_hash"))
    changes = table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("number"), F.when(F.col("p_partkey") % 40 == 0, "removed").otherwise("modified").alias("kind"), F.concat(F.lit("h"), F.col("p_partkey")).alias("hash"))
    found = changes.select(F.col("number").alias("src"), F.explode(F.array(F.col("number"), F.col("number") + 1, F.col("number") - 1)).alias("dst")).select("src", "dst", F.lit("related_to").alias("type"), F.lit(0.5).alias("confidence"))
    return K.reinferred(e, changes, found)


register(
    "know_reinferred",
    _reinferred,
    f"""WITH {_TYPED} SELECT src, dst, type, confidence, 'old' AS source_hash FROM typed WHERE inferred AND NOT (src % 20 = 0 AND src IN (SELECT p_partkey FROM part)) AND NOT (dst % 20 = 0 AND dst IN (SELECT p_partkey FROM part))
  UNION ALL SELECT p_partkey, p_partkey + k, 'related_to', 0.5, 'h' || p_partkey FROM part, (VALUES (1), (-1)) v(k) WHERE p_partkey % 20 = 0 AND p_partkey % 40 > 0""",
)
register(
    "know_stale_inferences",
    lambda s, d: K.stale_inferences(table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("inferred_at")), F.lit("1998-08-01").cast("timestamp_ntz")).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 30 DAYS",
)


def _known(spark, d):
    rows = table(spark, d, "part").where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.when(F.col("p_partkey") % 2 == 0, "inspired_by").otherwise("x").alias("type"), (F.col("p_partkey") % 3 == 0) & (F.col("p_partkey") % 4 > 0)).toDF("src", "dst", "type", "valid")
    good, bad, factor = K.known_relations(rows)
    return good.select("src", "dst", "type", F.lit(True).alias("valid"), F.lit(round(factor, 6)).alias("factor")).unionByName(bad.select("src", "dst", F.lit("").alias("type"), F.lit(False).alias("valid"), F.lit(round(factor, 6)).alias("factor")))


register(
    "know_calibration_input",
    _known,
    "WITH r AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, p_partkey % 4 > 0 AS valid FROM part WHERE p_partkey % 9 = 0) SELECT src, dst, CASE WHEN NOT valid THEN '' WHEN src % 2 = 0 THEN 'inspired_by' ELSE 'related_to' END AS type, valid, (SELECT round(0.8::DOUBLE + 0.4::DOUBLE * count(*) FILTER (valid) / count(*), 6) FROM r) AS factor FROM r",
)


def files(spark, d):
    """Documents as code files, some in folders of tests, with spellings of proposals and keywords."""
    n = F.col("doc_id")
    path = F.concat(F.when(n % 6 == 0, "a/tests/").when(n % 6 == 1, "src/x_test.go.").otherwise("src/"), n, F.lit(".go"))
    spelled = F.concat(F.lit(" EIP"), F.element_at(F.array(*map(F.lit, ("", "-", "_", " ", "#"))), (n % 5 + 1).cast("int")), n % 17, F.when(n % 8 == 0, F.lit("42")).otherwise(""), F.when(n % 9 == 0, F.lit(" func BaseFee")).otherwise(""))
    return table(spark, d, "documents").select(path.alias("path"), F.concat(F.coalesce("text", F.lit("")), spelled).alias("content"))


_FILES = """files AS (SELECT CASE doc_id % 6 WHEN 0 THEN 'a/tests/' WHEN 1 THEN 'src/x_test.go.' ELSE 'src/' END || doc_id || '.go' AS path, coalesce(text, '') || ' EIP' || (['', '-', '_', ' ', '#'])[doc_id % 5 + 1] || (doc_id % 17) || CASE WHEN doc_id % 8 = 0 THEN '42' ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN ' func BaseFee' ELSE '' END AS content FROM documents)"""


def _numbers(spark, d):
    return spark.createDataFrame([(n,) for n in (*range(0, 17), 1559, 842)], "number bigint")


register(
    "know_candidate_files",
    lambda s, d: K.candidate_files(files(s, d), _numbers(s, d)),
    f"""WITH {_FILES}, n AS (SELECT unnest(list_concat(range(0, 17), [1559, 842])) AS number) SELECT number, path FROM files, n WHERE NOT regexp_matches(path, '_test\\.go|_test\\.rs|/test/|/tests/')
  AND (contains(lower(content), 'eip' || number) OR contains(lower(content), 'eip-' || number) OR contains(lower(content), 'eip_' || number) OR contains(lower(content), 'eip ' || number) OR (number = 1559 AND regexp_matches(lower(content), '{"|".join(w.lower() for w in K.KEYWORDS[1559])}')))""",
)
register(
    "know_mentions_in_code",
    lambda s, d: files(s, d).select("path", F.array_join(K.mentions_in_code(F.col("content")).cast("array<string>"), ",").alias("numbers")),
    f"WITH {_FILES} SELECT path, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(content, 'EIP[-_]?(\\d+)', 1), list_concat(regexp_extract_all(content, 'eip[-_]?(\\d+)', 1), regexp_extract_all(content, 'EIP\\s*#?\\s*(\\d+)', 1))), lambda x: x::BIGINT))), ',') AS numbers FROM files",
)


def _link_replies(spark, d):
    n = F.col("p_partkey")
    one = F.concat(F.lit("FUNCTION: f"), n, F.lit("\nCONFIDENCE: "), (n % 15) / 10, F.lit("\nEVIDENCE: it does "), n, F.lit("\n---\nFUNCTION: g\nCONFIDENCE: 1.2.3\n---\nnothing\n---\nFUNCTION: no confidence\n"))
    return table(spark, d, "part").select(n.alias("number"), F.when(n % 4 == 0, "NO_IMPLEMENTATIONS_FOUND").otherwise(one).alias("reply"))


register(
    "know_parsed_links",
    lambda s, d: K.parsed_links(_link_replies(s, d), ["number"]),
    "SELECT p_partkey AS number, 'f' || p_partkey AS function, least((p_partkey % 15) / 10, 1.0)::DOUBLE AS confidence, 'it does ' || p_partkey AS evidence FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 'g', 0.5, '' FROM part WHERE p_partkey % 4 > 0",
)
register(
    "know_weighted_average",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(K.weighted({"a": (F.col("l_discount") * 12, 0.4), "b": (F.col("l_tax") * 10, 0.25), "c": (F.col("l_quantity") / 50, 0.2), "d": (F.lit(0.5), 0.15)}), 6).alias("score")),
    "SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, l_discount * 12 * 0.4::DOUBLE + l_tax * 10 * 0.25::DOUBLE + l_quantity / 50 * 0.2::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE)), 6)::DOUBLE AS score FROM lineitem",
)
register(
    "know_truncated_tree",
    lambda s, d: K.truncated_tree(_graph(s, d)[1].where("type = 'REQUIRES'"), 120),
    f"""WITH {_EDGES}, e AS (SELECT src, dst FROM edges WHERE type = 'REQUIRES'), t0 AS (SELECT 120::BIGINT AS id, [120::BIGINT] AS path, 0 AS depth), t1 AS (SELECT dst AS id, list_append(path, dst) AS path, 1 AS depth FROM t0 JOIN e ON src = id WHERE NOT list_contains(path, dst)), t2 AS (SELECT dst AS id, list_append(path, dst) AS path, 2 AS depth FROM t1 JOIN e ON src = id WHERE NOT list_contains(path, dst))
  SELECT array_to_string(path, '>') AS path, depth::INTEGER AS depth, depth = 2 AND id IN (SELECT src FROM e) AS truncated FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)""",
)
