"""Building and querying the knowledge graph: proposals, forum, papers, inferred relations, links to code.

Nodes and edges are keyed tables; a write is a new version of such a table (union, newest row of a key), so nothing is
changed in place. An edge whose ends don't both exist isn't written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.graph import checked_edges
from quern.scratch import written

# fixed values: types of inferred and of explicit relations
INFERRED = ("conflicts_with", "addresses_concern", "inspired_by", "builds_on", "alternative_to", "related_to")
EXPLICIT = ("REQUIRES", "SUPERSEDES", "REPLACES")
# fixed values: words of code that implements a proposal
KEYWORDS = {
    1559: ("basefee", "base_fee", "BaseFee", "EIP1559", "eip1559", "dynamic fee"),
    4844: ("blob", "Blob", "BLOB", "kzg", "KZG", "EIP4844", "eip4844", "data_gas", "blob_gas"),
    4895: ("withdrawal", "Withdrawal", "EIP4895", "eip4895", "beacon_root"),
    2718: ("typed_transaction", "TypedTransaction", "EIP2718", "tx_type", "TransactionType"),
    2930: ("access_list", "AccessList", "EIP2930", "accessList"),
    3675: ("merge", "Merge", "pos", "proof_of_stake", "terminal_total_difficulty"),
    7516: ("blobbasefee", "blob_base_fee", "BLOBBASEFEE"),
}
# fixed values: paths of tests, which implement nothing
TESTS = ("_test.go", "_test.rs", "/test/", "/tests/")


def referenced(column: Column) -> Column:
    """Numbers of a reference field: an int, a list or a text of numbers with or without a name before them."""
    return F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(?i)(?:eip[- ]?)?(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def proposal_nodes(proposals: DataFrame) -> DataFrame:
    """One node a number, the row that sorts last of several."""
    fields = ["title", "status", "type", "category"]
    return proposals.groupBy("number").agg(F.max(F.struct(*fields)).alias("n")).select("number", *[F.col(f"n.{c}").alias(c) for c in fields])


def proposal_edges(proposals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type) of front matter: requires and replaces as they stand, superseded_by the other way round; both ends must exist."""
    kinds = (("requires", "REQUIRES", False), ("superseded_by", "SUPERSEDES", True), ("replaces", "REPLACES", False))
    parts = []
    for name, kind, turned in kinds:
        found = proposals.select(F.col("number").cast("bigint").alias("a"), F.explode(referenced(F.col(name))).alias("b"))
        parts.append(found.select(F.col("b" if turned else "a").alias("src"), F.col("a" if turned else "b").alias("dst"), F.lit(kind).alias("type")))
    return checked_edges(reduce(DataFrame.unionByName, parts), nodes, "number")


def added(nodes: DataFrame, edges: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with further proposals: nodes of the same number are replaced, edges are added once."""
    new = proposal_nodes(proposals)
    merged = nodes.join(new.select("number"), "number", "left_anti").unionByName(new)
    return merged, edges.unionByName(proposal_edges(proposals, merged)).distinct()


def listed(edges: DataFrame, kind: str | None = None) -> DataFrame:
    return (edges if kind is None else edges.where(F.col("type") == kind)).orderBy("src", "dst", "type")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): the number of nodes, and of edges by type, types without any included."""
    spark = nodes.sparkSession
    kinds = spark.createDataFrame([(k,) for k in EXPLICIT], "what string")
    counted = kinds.join(edges.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")), "what", "full").select("what", F.coalesce("n", F.lit(0)).alias("n"))
    return nodes.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")).unionByName(counted)


def supersession(edges: DataFrame, numbers: DataFrame, number: str = "number") -> DataFrame:
    """(number, supersedes, superseded_by): sorted lists, empty where there are none."""
    kept = edges.where("type = 'SUPERSEDES'")
    out = numbers.select(number).distinct()
    for a, b, name in (("src", "dst", "supersedes"), ("dst", "src", "superseded_by")):
        found = kept.groupBy(F.col(a).alias(number)).agg(F.array_sort(F.collect_set(b)).alias(name))
        out = out.join(found, number, "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    return out


def upserted(old: DataFrame, new: DataFrame, key: list[str], on_match: list[str]) -> DataFrame:
    """Nodes after a merge: new keys come in whole; of known ones only the columns of on_match change."""
    known = new.select(*key, *[F.col(c).alias(f"_{c}") for c in on_match], F.lit(True).alias("_hit"))
    merged = old.join(known, key, "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in on_match else F.col(c) for c in old.columns])
    return merged.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def forum_edges(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """(kind, from_id, to_id): POSTED_IN and REPLIES_TO where both ends exist. posts: topic_id, post_number, reply_to; topics: topic_id."""
    ident = F.concat_ws("#", "topic_id", "post_number")
    placed = posts.join(topics.select("topic_id").distinct(), "topic_id", "left_semi").select(F.lit("POSTED_IN").alias("kind"), ident.alias("from_id"), F.col("topic_id").cast("string").alias("to_id"))
    there = posts.select("topic_id", F.col("post_number").alias("reply_to")).distinct()
    replies = posts.where("reply_to IS NOT NULL").join(there, ["topic_id", "reply_to"], "left_semi").select(F.lit("REPLIES_TO").alias("kind"), ident.alias("from_id"), F.concat_ws("#", "topic_id", "reply_to").alias("to_id"))
    return placed.unionByName(replies).distinct()


def parent_chain(replies: DataFrame, depth: int = 10) -> DataFrame:
    """(topic_id, post_number, parent, depth): the posts that each reply goes back to. replies: topic_id, post_number, reply_to."""
    step = replies.select("topic_id", F.col("post_number").alias("parent"), "reply_to").distinct()
    level = replies.select("topic_id", "post_number", F.col("reply_to").alias("parent")).distinct()
    out = None
    for n in range(1, depth + 1):
        level = written(level)
        if level.isEmpty():
            break
        rows = level.withColumn("depth", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
        level = level.join(step, ["topic_id", "parent"]).select("topic_id", "post_number", F.col("reply_to").alias("parent"))
    return out if out is not None else level.withColumn("depth", F.lit(0))


def latest_posts(posts: DataFrame, user: str, most: int = 50) -> DataFrame:
    """A user's posts, the newest first."""
    return posts.where(F.col("username") == user).orderBy(F.desc("created_at"), "topic_id", "post_number").limit(most)


def mentioned(text: Column) -> Column:
    """Sorted distinct numbers that a forum text mentions as whole words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\beip[- ]?(\d+)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("bigint"))))


def discusses(topics: DataFrame, posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, topic_id, post_number, number): topics discuss what their title or any post mentions, posts what they mention; known proposals only."""
    by_post = posts.select("topic_id", "post_number", F.explode(mentioned(F.col("content"))).alias("number"))
    by_title = topics.select("topic_id", F.explode(mentioned(F.col("title"))).alias("number"))
    whole = by_title.unionByName(by_post.select("topic_id", "number")).distinct().select(F.lit("topic").alias("level"), "topic_id", F.lit(None).cast("int").alias("post_number"), "number")
    single = by_post.distinct().select(F.lit("post").alias("level"), "topic_id", F.col("post_number").cast("int").alias("post_number"), "number")
    return whole.unionByName(single).join(nodes.select(F.col("number").cast("bigint").alias("number")), "number", "left_semi").select("level", "topic_id", "post_number", "number")


def reference_id(reference: Column) -> Column:
    """An arXiv id, else a DOI, else a hash of the first 100 characters if these are over 20; else null."""
    arxiv = F.regexp_extract(reference, r"(?i)arXiv[:\s]*(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    doi = F.regexp_extract(reference, r"10\.\d{4,}/[^\s]+", 0)
    tidy = F.regexp_replace(F.trim(F.lower(F.left(reference, F.lit(100)))), r"\s+", " ")
    hashed = F.when(F.length(tidy) > 20, F.concat(F.lit("ref:"), F.left(F.md5(tidy), F.lit(12))))
    return F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(hashed)


def citation_graph(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (paper_id, title) and edges (citing, cited, context) of papers with an array of references; an edge keeps its first context."""
    refs = papers.select(F.col("paper_id").alias("citing"), F.posexplode("references").alias("n", "r"))
    found = refs.withColumn("cited", reference_id(F.col("r"))).where("cited IS NOT NULL")
    edges = found.groupBy("citing", "cited").agg(F.left(F.min_by("r", "n"), F.lit(200)).alias("context"))
    named = papers.groupBy("paper_id").agg(F.max("title").alias("title"))
    ids = edges.select(F.col("cited").alias("paper_id")).distinct().join(named, "paper_id", "left_anti")
    return named.unionByName(ids.withColumn("title", F.lit(None).cast("string"))), edges


def bounded_path(edges: DataFrame, start: int, goal: int, least: float = 0.7, depth: int = 3) -> DataFrame:
    """One row (path, confidence, depth) of a path along outgoing edges whose confidence product keeps least; none if there is none.

    A node keeps the path of the first level that reaches it, of the highest confidence, then the smallest.
    """
    spark = edges.sparkSession
    step = written(edges.select(F.col("src").alias("_from"), F.col("dst").cast("bigint").alias("_to"), F.col("confidence").alias("_c")))
    level = spark.createDataFrame([(start, [start], 1.0)], "id bigint, path array<bigint>, confidence double")
    seen = level.select("id")
    for n in range(depth + 1):
        found = level.where(F.col("id") == goal)
        if n == depth or not found.isEmpty():
            return found.select("path", "confidence", F.lit(n).alias("depth"))
        ahead = level.join(step, level["id"] == step["_from"]).select(F.col("_to").alias("id"), F.concat("path", F.array("_to")).alias("path"), F.round(F.col("confidence") * F.col("_c"), 6).alias("confidence"))
        best = ahead.where(F.col("confidence") >= least).withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("confidence"), "path"))).where("k = 1").drop("k")
        level = written(best.join(seen, "id", "left_anti").select("id", "path", "confidence"))
        seen = seen.unionByName(level.select("id"))
    return level.limit(0)


def neighbours(edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None = None, direction: str = "both") -> DataFrame:
    """(id, neighbour, type, confidence, inferred) of edges (src, dst, type, confidence, inferred) that touch ids, along the direction."""
    kept = edges if kinds is None else edges.where(F.lower("type").isin(*[k.lower() for k in kinds]))
    parts = [kept.select(F.col(a).alias("id"), F.col(b).alias("neighbour"), "type", "confidence", "inferred") for a, b, way in (("src", "dst", "outgoing"), ("dst", "src", "incoming")) if direction in (way, "both")]
    return reduce(DataFrame.unionByName, parts).join(ids.select("id").distinct(), "id", "left_semi")


def related_by_type(edges: DataFrame, root: int, kind: str, least: float = 0.7, depth: int = 3) -> DataFrame:
    """(id, depth, confidence, path) reached from root over edges of one type, both ways; the first level of a node and its best path count."""
    spark = edges.sparkSession
    both = edges.where(F.lower("type") == kind.lower())
    step = written(both.select(F.col("src").alias("_from"), F.col("dst").cast("bigint").alias("_to"), F.col("confidence").alias("_c")).unionByName(both.select(F.col("dst").alias("_from"), F.col("src").cast("bigint").alias("_to"), F.col("confidence").alias("_c"))))
    level = spark.createDataFrame([(root, [root], 1.0)], "id bigint, path array<bigint>, confidence double")
    seen = level.withColumn("depth", F.lit(0))
    for n in range(1, depth + 1):
        ahead = level.join(step, level["id"] == step["_from"]).select(F.col("_to").alias("id"), F.concat("path", F.array("_to")).alias("path"), F.round(F.col("confidence") * F.col("_c"), 6).alias("confidence"))
        best = ahead.where(F.col("confidence") >= least).withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("confidence"), "path"))).where("k = 1").drop("k")
        level = written(best.join(seen.select("id"), "id", "left_anti").select("id", "path", "confidence"))
        seen = seen.unionByName(level.withColumn("depth", F.lit(n)))
    return seen.where("depth > 0").select("id", "depth", "confidence", F.array_join("path", " -> ").alias("path"))


def parsed_relations(replies: DataFrame, key: list[str], reply: str = "reply") -> DataFrame:
    """(key, type, confidence, evidence, reasoning) of a model's replies: the first [...] block; confidence of 0.3 at least, unknown types as related_to."""
    block = F.regexp_extract(F.col(reply), r"(\[[\s\S]*\])", 1)
    items = F.from_json(block, "array<struct<relationship_type:string,confidence:double,evidence:array<string>,reasoning:string>>")
    out = replies.select(*key, F.explode(items).alias("i"))
    kind = F.lower(F.coalesce("i.relationship_type", F.lit("related_to")))
    rows = out.select(*key, F.when(kind.isin(*INFERRED), kind).otherwise("related_to").alias("type"), F.coalesce("i.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("i.evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce("i.reasoning", F.lit("")).alias("reasoning"))
    return rows.where("confidence >= 0.3")


def reinferred(inferred: DataFrame, changes: DataFrame, found: DataFrame) -> DataFrame:
    """Inferred edges after changes (number, kind, hash): those that touch a changed node go, those found for added or modified ones come in.

    inferred and found have src, dst, type, confidence; found ones carry the hash of their source. Of equal keys one row stays.
    """
    touched = changes.select(F.col("number").alias("_n")).distinct()
    kept = inferred.join(touched, inferred["src"] == touched["_n"], "left_anti")
    kept = kept.join(touched, kept["dst"] == touched["_n"], "left_anti")
    live = changes.where("kind <> 'removed'").groupBy(F.col("number").alias("src")).agg(F.max("hash").alias("source_hash"))
    new = found.where("src <> dst").join(live, "src").groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.max("source_hash").alias("source_hash"))
    return kept.select("src", "dst", "type", "confidence", F.col("source_hash")).unionByName(new)


def stale_inferences(inferred: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return inferred.where(F.col("inferred_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def known_relations(rows: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Positives, negatives and the factor 0.8 + 0.4 * share of positives (1 without any) of known relations (src, dst, type, valid)."""
    kind = F.lower(F.coalesce("type", F.lit("related_to")))
    good = rows.where("coalesce(valid, true)").select("src", "dst", F.when(kind.isin(*INFERRED), kind).otherwise("related_to").alias("type"))
    bad = rows.where("NOT coalesce(valid, true)").select("src", "dst")
    n, m = good.count(), bad.count()
    return good, bad, 0.8 + 0.4 * n / (n + m) if n + m else 1.0


def candidate_files(files: DataFrame, numbers: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(number, path): files that spell the number (eip1, eip-1, eip_1, eip 1) or hold one of its keywords; no tests.

    A file's own spellings and keywords meet the numbers by an equi-join; all beginnings of a spelled number count, as a number may go on.
    """
    kept = files.where(~reduce(lambda a, b: a | b, [F.contains(F.col(path), F.lit(t)) for t in TESTS])).select(path, F.lower(content).alias("_c"))
    digits = F.regexp_extract_all("_c", F.lit(r"eip[-_ ]?(\d+)"), F.lit(1))
    spelled = F.flatten(F.transform(digits, lambda x: F.transform(F.sequence(F.lit(1), F.least(F.length(x), F.lit(9))), lambda n: F.substring(x, F.lit(1), n))))
    words = [F.when(reduce(lambda a, b: a | b, [F.contains("_c", F.lit(w.lower())) for w in ws]), F.lit(str(n))) for n, ws in KEYWORDS.items()]
    named = F.array_distinct(F.concat(spelled, F.array_compact(F.array(*words))))
    own = kept.select(path, F.explode(named).alias("_n"))
    wanted = numbers.select("number", F.col("number").cast("string").alias("_n")).distinct()
    return own.join(wanted, "_n").select("number", path).distinct()


def parsed_links(replies: DataFrame, key: list[str], reply: str = "reply") -> DataFrame:
    """(key, function, confidence, evidence) of replies in blocks between dashes; blocks without a function or a confidence drop out."""
    block = F.explode(F.split(F.when(~F.contains(F.col(reply), F.lit("NO_IMPLEMENTATIONS_FOUND")), F.col(reply)).otherwise(""), "---")).alias("b")
    field = lambda name, p: F.regexp_extract("b", rf"{name}:\s*{p}", 1)
    rows = replies.select(*key, block).select(*key, F.trim(field("FUNCTION", "(.+)")).alias("function"), field("CONFIDENCE", r"([\d.]+)").alias("_c"), F.trim(field("EVIDENCE", "(.+)")).alias("evidence"))
    sure = F.greatest(F.least(F.coalesce(F.col("_c").try_cast("double"), F.lit(0.5)), F.lit(1.0)), F.lit(0.0))
    return rows.where("function <> '' AND _c <> ''").select(*key, "function", sure.alias("confidence"), "evidence").orderBy(F.desc("confidence"), *key, "function")


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """A weighted sum, held to 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [x * w for x, w in parts.values()])))


def truncated_tree(edges: DataFrame, root: int, depth: int = 2) -> DataFrame:
    """(path, depth, truncated): every path from the root, none through a node twice; truncated where the depth cuts off further children."""
    step = written(edges.select(F.col("src").alias("_from"), F.col("dst").cast("bigint").alias("_to")).distinct())
    level = edges.sparkSession.createDataFrame([(root, [root])], "id bigint, path array<bigint>")
    out = None
    for n in range(depth + 1):
        rows = level.select(F.array_join("path", ">").alias("path"), F.lit(n).alias("depth"), "id")
        out = rows if out is None else out.unionByName(rows)
        if n < depth:
            level = written(level.join(step, level["id"] == step["_from"]).where(~F.array_contains("path", F.col("_to"))).select(F.col("_to").alias("id"), F.concat("path", F.array("_to")).alias("path")))
    parents = step.select(F.col("_from").alias("id")).distinct().withColumn("_has", F.lit(True))
    return out.join(parents, "id", "left").select("path", "depth", (F.coalesce("_has", F.lit(False)) & (F.col("depth") == depth)).alias("truncated"))


def mentions_in_code(content: Column) -> Column:
    """Sorted distinct numbers of proposals that code names."""
    found = [F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in (r"EIP[-_]?(\d+)", r"eip[-_]?(\d+)", r"EIP\s*#?\s*(\d+)")]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda x: x.cast("bigint"))))

