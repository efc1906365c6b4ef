"""Graph operators over tables of edges (src, dst, type) and nodes: closures, paths, ranks and neighbourhoods.

Closures loop over levels: a frontier is joined with the edges, nodes already seen are anti-joined away, and each level
is written to the shared folder, so a lost executor costs one level and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.skew import pairs_within
from quern.scratch import written


def checked_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Distinct edges whose ends both exist."""
    ids = nodes.select(F.col(node).alias("_n")).distinct()
    kept = edges.join(ids, edges["src"] == ids["_n"], "left_semi")
    return kept.join(ids, kept["dst"] == ids["_n"], "left_semi").dropDuplicates(["src", "dst", "type"])


def closure(edges: DataFrame, roots: DataFrame, depth: int = 10, reverse: bool = False) -> DataFrame:
    """(root, id, depth): all nodes that each root (a column root) reaches, with their least depth.

    A root on a cycle reaches itself. reverse follows edges backwards (dependents).
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = written(edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct())
    frontier = roots.select("root", F.col("root").alias("id")).distinct()
    seen = None
    for level in range(1, depth + 1):
        reached = frontier.join(step, frontier["id"] == step["_from"]).select("root", F.col("_to").alias("id")).distinct()
        if seen is not None:
            reached = reached.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        frontier = written(reached)
        if frontier.isEmpty():
            break
        level_rows = frontier.withColumn("depth", F.lit(level))
        seen = level_rows if seen is None else seen.unionByName(level_rows)
    if seen is None:
        return roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).limit(0)
    return seen


def shortest_path(edges: DataFrame, start: int, goal: int, depth: int = 10) -> DataFrame:
    """One row (path, length) with a shortest path, the smallest of equals; none if there is none."""
    step = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct()
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [start])], "id bigint, path array<bigint>")
    for _ in range(depth):
        found = frontier.where(F.col("id") == goal)
        if not found.isEmpty():
            return found.select("path", (F.size("path") - 1).alias("length"))
        further = frontier.join(step, frontier["id"] == step["_from"]).where(~F.array_contains("path", F.col("_to")))
        # a node keeps its smallest path; all paths of a level have the same length
        frontier = written(further.select(F.col("_to").cast("bigint").alias("id"), F.concat("path", F.array(F.col("_to").cast("bigint"))).alias("path")).groupBy("id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
    return frontier.where(F.col("id") == goal).select("path", (F.size("path") - 1).alias("length"))


def tree_paths(edges: DataFrame, root: int, depth: int = 3) -> DataFrame:
    """All paths from the root up to a depth, none through the same node twice."""
    step = edges.select(F.col("src").alias("_from"), F.col("dst").cast("bigint").alias("_to")).distinct()
    frontier = edges.sparkSession.createDataFrame([(root, [root])], "id bigint, path array<bigint>")
    out = None
    for _ in range(depth):
        frontier = frontier.join(step, frontier["id"] == step["_from"]).where(~F.array_contains("path", F.col("_to"))).select(F.col("_to").alias("id"), F.concat("path", F.array("_to")).alias("path"))
        frontier = written(frontier)
        out = frontier if out is None else out.unionByName(frontier)
    return out.select("id", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("depth"))


def bounded_search(edges: DataFrame, root: int, least: float = 0.7, depth: int = 3) -> DataFrame:
    """(id, depth, confidence): nodes whose first path keeps a confidence product of at least least.

    Edges have src, dst and confidence (explicit edges 1.0). Within a level the first visit is the path of the highest
    confidence, then of the smaller node before.
    """
    step = written(edges.select(F.col("src").alias("_from"), F.col("dst").cast("bigint").alias("_to"), F.col("confidence").alias("_c")))
    frontier = edges.sparkSession.createDataFrame([(root, 1.0)], "id bigint, confidence double")
    seen = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        further = frontier.join(step, frontier["id"] == step["_from"]).select(F.col("_to").alias("id"), F.col("id").alias("via"), F.round(F.col("confidence") * F.col("_c"), 6).alias("confidence")).where(F.col("confidence") >= least)
        first = W.partitionBy("id").orderBy(F.desc("confidence"), "via")
        fresh = further.withColumn("n", F.row_number().over(first)).where("n = 1").join(seen.select("id"), "id", "left_anti")
        frontier = written(fresh.select("id", "confidence"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return seen.where("depth > 0").select("id", "depth", "confidence")


def edge_confidence(similarity: Column, evidence: Column, community: Column, recency: Column, evidence_count: Column, reasoning_length: Column) -> Column:
    """0.4 evidence (with bonuses for counts and length of reasoning) + 0.25 similarity + 0.2 community + 0.15 recency; null or 0 counts as 0.5 in the last three."""
    half = lambda x: F.coalesce(F.nullif(x.cast("double"), F.lit(0.0)), F.lit(0.5))
    bonus = F.least(evidence_count * 0.05, F.lit(0.2)) + F.least(reasoning_length / 500, F.lit(0.1))
    total = 0.4 * F.least(evidence + bonus, F.lit(1.0)) + 0.25 * half(similarity) + 0.2 * half(community) + 0.15 * half(recency)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def calibrated(confidence: Column, negative: Column, positive: Column, positives: int, total: int) -> Column:
    """Known negatives times 0.3, known positives times 1.2 up to 1, others by the share of positives (unchanged without known ones)."""
    factor = 0.8 + 0.4 * (positives / total) if total else 1.0
    return F.when(negative, confidence * 0.3).when(positive, F.least(confidence * 1.2, F.lit(1.0))).otherwise(confidence * factor)


def co_mentions(mentions: DataFrame, source: str, target: str) -> DataFrame:
    """(a, b, shared): ordered pairs of targets that share sources, and how many.

    mentions is a set of (source, target); the result holds a source's pairs, so its size is what the topics' sizes allow. A large
    topic's targets meet as pairs of blocks, and pairs are counted within tasks before they are dealt.
    """
    m = written(mentions.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct())
    pairs = pairs_within(m, "s").where("a_t < b_t")
    return pairs.groupBy(F.col("a_t").alias("a"), F.col("b_t").alias("b")).agg(F.count("*").alias("shared"))


def division(pairs: DataFrame, left: str, right: str, wanted: DataFrame) -> DataFrame:
    """The right values that go with every one of the wanted left values."""
    n = wanted.distinct().count()
    hit = pairs.join(F.broadcast(wanted.distinct()) if n <= 100_000 else wanted.distinct(), left, "left_semi")
    return hit.groupBy(right).agg(F.countDistinct(left).alias("n")).where(F.col("n") == n).select(right)
