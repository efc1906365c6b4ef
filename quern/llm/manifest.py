"""Merkle manifest of a dataset: leaves, trees per group, a root over all groups, and a proof for each leaf.

Leaves are hashed on the JVM, so texts are never shuffled. Their ranks within a group come from one range sort of the digests and the sums of the
sorted parts' sizes. Ranks are cut into aligned buckets of 2**DEPTH nodes, whatever the size of a group; executors take a bucket as an Arrow table
and run one DuckDB query for each level (ordered string_agg, then sha256), which leaves a bucket's root. Bucket roots are the nodes of the next
round, until each group has one node; the groups' roots, in the groups' order, are a tree of the same kind. Going back, each bucket gets the
siblings above its root from the round above (a cogroup by bucket), and DuckDB runs the levels once more to join the siblings inside.

A node's hash is H (lowercase hex sha256) of its children's digests as text; a run of one child is hashed alone, and a tree of one node is that node.

Cases: null values are '-', so they differ from empty ones; a null group is a group and comes first; null ids come before others; rows with equal ids are ordered by their leaves, so
repeated rows are leaves of their own; an empty table has no rows and no root. Texts of any length are read whole. Only the named columns are read.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import plain, written

DEPTH = 12  # levels of a bucket
MOST_BROADCAST = 100_000  # rows: parts of a sort


def leaf(*fields: Column) -> Column:
    """H of the fields: '-' if null, else the UTF-8 byte count, ':' and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def ranked(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """df with `rank` (from 0, by order within tree) and `n` (rows of the tree). Rows that are equal in all of these may be in any order."""
    keys = [tree, *order, "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())  # so that equal rows can be split
    placed = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.col(tree).alias("_tree"), F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    mine = W.partitionBy("_tree")  # a row for each part of the sort that holds rows of the tree
    before = F.coalesce(F.sum("_rows").over(mine.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = written(parts.select("_tree", "_part", (before - F.col("_first")).alias("_base"), F.sum("_rows").over(mine).alias("n")))
    bases = F.broadcast(bases) if bases.count() <= MOST_BROADCAST else bases.hint("merge")
    joined = placed.join(bases, (F.col(tree) == F.col("_tree")) & (F.shiftright("_at", 33) == F.col("_part")))
    return joined.withColumn("rank", F.col("_at") + F.col("_base")).drop("_tree", "_part", "_base", "_at")


@functools.cache
def _duck():
    """One DuckDB of a worker."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB"})
    return con


def _run(query: str, *given) -> list[tuple]:
    """A query's rows, all fetched, so that the connection is free again."""
    return _duck().execute(query, list(given)).fetchall()


def _levels(nodes: pa.Table, depth: int) -> int:
    """Builds table level (l, p, h) of a bucket's nodes (p, h) in DuckDB; returns the number of levels above the nodes."""
    n = nodes.column("n")[0].as_py()
    steps = depth if n > 1 << depth else max(n - 1, 0).bit_length()
    _duck().register("given", nodes)
    _run("CREATE OR REPLACE TEMP TABLE level AS SELECT 0 AS l, rank % (1::BIGINT << ?) AS p, h FROM given", depth)
    for step in range(steps):
        _run("INSERT INTO level SELECT l + 1, p >> 1, sha256(string_agg(h, '' ORDER BY p)) FROM level WHERE l = ? GROUP BY l, p >> 1", step)
    return steps


def roots(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tree, rank, h, n) of the roots of all buckets of nodes (tree, rank, h, n)."""

    def root(bucket: pa.Table) -> pa.Table:
        steps = _levels(bucket, depth)
        top = _run("SELECT h FROM level WHERE l = ?", steps)[0][0]
        first = bucket.slice(0, 1)
        return pa.table({"tree": first.column("tree"), "rank": pa.array([first.column("rank")[0].as_py() >> depth]), "h": [top], "n": pa.array([(first.column("n")[0].as_py() + (1 << depth) - 1) >> depth])})

    return nodes.select("tree", "rank", "h", "n").groupBy("tree", F.shiftright("rank", depth)).applyInArrow(root, "tree string, rank bigint, h string, n bigint")


PATH = "lefts array<string>, rights array<string>"  # of the levels above a node: the sibling on either side, empty if there is none


def _inside(steps: int) -> pa.Table:
    """(p, lefts, rights) of a bucket's nodes up to its root."""
    near = "LEFT JOIN level s ON s.l = k.l AND s.p = xor(n.p >> k.l, 1)"
    if not steps:
        return _duck().sql("SELECT p, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights FROM level WHERE l = 0").to_arrow_table()
    side = lambda bit: f"list(CASE WHEN (n.p >> k.l) % 2 = {bit} THEN coalesce(s.h, '') ELSE '' END ORDER BY k.l)"
    return _duck().sql(f"SELECT n.p, {side(1)} AS lefts, {side(0)} AS rights FROM level n CROSS JOIN (SELECT unnest(range(?))::INTEGER AS l) k {near} WHERE n.l = 0 GROUP BY n.p", params=[steps]).to_arrow_table()


def paths(nodes: DataFrame, above: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tree, rank, lefts, rights) of nodes up to the root of all, given those of their buckets' roots."""

    def path(bucket: pa.Table, over: pa.Table) -> pa.Table:
        steps = _levels(bucket, depth)
        inner, con = _inside(steps), _duck()
        con.register("inner_path", inner)
        con.register("over", over)
        return con.sql("SELECT g.tree, g.rank, i.lefts || o.lefts AS lefts, i.rights || o.rights AS rights FROM given g JOIN inner_path i ON g.rank % (1::BIGINT << ?) = i.p, over o", params=[depth]).to_arrow_table()

    return _beside(nodes, above, depth).applyInArrow(path, f"tree string, rank bigint, {PATH}")


def _beside(nodes: DataFrame, above: DataFrame, depth: int):
    return nodes.groupBy("tree", F.shiftright("rank", depth)).cogroup(above.groupBy("tree", "rank"))


def proofs(nodes: DataFrame, above: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Of leaves (tree, rank, h, n, altered, payload): payload, h, the proof's digest and the root that altered (or else h) and the siblings give."""

    def proof(bucket: pa.Table, over: pa.Table) -> pa.Table:
        steps = _levels(bucket, depth)
        lefts, rights = over.column("lefts")[0].as_py(), over.column("rights")[0].as_py()
        outside = "".join(a + b for a, b in zip(lefts, rights, strict=True))
        _run("CREATE OR REPLACE TEMP TABLE fold AS SELECT rank % (1::BIGINT << ?) AS p, coalesce(altered, h) AS f, '' AS seen FROM given", depth)
        for step in range(steps):
            _run("CREATE OR REPLACE TEMP TABLE fold AS SELECT f.p, sha256(CASE WHEN (f.p >> ?) % 2 = 1 THEN coalesce(s.h, '') || f ELSE f || coalesce(s.h, '') END) AS f, seen || coalesce(s.h, '') AS seen FROM fold f LEFT JOIN level s ON s.l = ? AND s.p = xor(f.p >> ?, 1)", step, step, step)
        for left, right in zip(lefts, rights, strict=True):
            _run("CREATE OR REPLACE TEMP TABLE fold AS SELECT p, sha256(? || f || ?) AS f, seen FROM fold", left, right)
        seen, folded = zip(*_run("SELECT sha256(seen || ?), f FROM fold ORDER BY p", outside), strict=True)
        rows = bucket.sort_by("rank")  # p counts the rows of a bucket
        return pa.table({"payload": rows.column("payload"), "tree": rows.column("tree"), "h": rows.column("h"), "proof": pa.array(seen, pa.string()), "folded": pa.array(folded, pa.string())})

    payload = nodes.schema["payload"].dataType.simpleString()
    return _beside(nodes, above, depth).applyInArrow(proof, f"payload {payload}, tree string, h string, proof string, folded string")


def _climbed(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round of buckets, and the single node that each tree ends in."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        top = written(roots(rounds[-1], depth))
        most = (most + (1 << depth) - 1) >> depth
        if most <= 1:
            return rounds, top
        rounds.append(top)


def _descended(rounds: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """The paths of the buckets of rounds[0], given those of each tree's single node."""
    for nodes in reversed(rounds[1:]):
        above = written(paths(nodes, above, depth))
    return above


def manifest(rows: DataFrame, fields: list[str], group: str, ident: str, altered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root) of every row.

    fields are hashed in this order, leaves ascend by ident in each group. altered is the digest to fold instead of the leaf, where it isn't null
    (an expression over rows' columns); the siblings are always the rows' own.
    """
    names = list(dict.fromkeys([*fields, group, ident]))
    given = plain(rows, *names)
    # a null group comes before all others, whose texts are compared bytewise
    tree = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("")).alias("tree")
    leaves = given.select(tree, F.col(ident).alias("payload"), leaf(*[F.col(c) for c in fields]).alias("h"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    nodes = written(ranked(leaves, "tree", "payload", "h"))
    rounds, subroots = _climbed(nodes, depth)
    # the groups' roots are the nodes of one more tree
    outer = written(ranked(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("group"), "h"), "tree", "group"))
    outer_rounds, top = _climbed(outer, depth)
    nothing = F.array().cast("array<string>")
    over = _descended(outer_rounds, top.select("tree", F.lit(0).cast("bigint").alias("rank"), nothing.alias("lefts"), nothing.alias("rights")), depth)
    over = paths(outer, over, depth)
    named = outer.select("tree", "rank", "group", F.col("h").alias("subroot")).join(over.hint("merge"), ["tree", "rank"])
    groups = written(named.join(F.broadcast(top.select("tree", F.col("h").alias("root"))), "tree"))  # top is one row
    above = groups.select(F.col("group").alias("tree"), F.lit(0).cast("bigint").alias("rank"), "lefts", "rights")
    found = proofs(nodes, _descended(rounds, above, depth), depth)
    ends = groups.select(F.col("group").alias("tree"), "subroot", "root")
    ends = F.broadcast(ends) if groups.count() <= MOST_BROADCAST else ends.hint("merge")
    return found.join(ends, "tree").select(F.col("payload").alias("id"), F.col("h").alias("leaf"), "subroot", "root", "proof", F.col("folded").alias("folded_root"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by lang; every seventh row (by checksum) is tampered with, which its folded root shows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a null id has no checksum and isn't tampered with; a null count stays null
    tampered = leaf(*[(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS])
    found = manifest(docs, FIELDS, "lang", "doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
