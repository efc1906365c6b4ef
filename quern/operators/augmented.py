"""Retrieval beyond one ranked list: graph-augmented, staged and code search, reranking, agent modes, headlines and contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.graph import closure
from quern.operators.retrieval import scored, topk_per_group, vector_topk
from quern.scratch import written

# fixed values: words that mark a query about code
CODE_WORDS = ("function", "method", "struct", "type", "interface", "implementation", "implements", "returns", "parameter", "go", "golang", "rust", "eip", "ethereum")
# fixed values: kinds of code by words of its name, in order
NAME_KINDS = (
    ("test", ("test", "bench", "example")),
    ("constructor", ("new", "create", "init", "build")),
    ("getter", ("get", "fetch", "load", "read", "query")),
    ("setter", ("set", "update", "write", "store", "save")),
    ("validator", ("validate", "verify", "check", "is_", "has_")),
    ("handler", ("process", "handle", "execute", "run", "apply")),
    ("parser", ("parse", "decode", "deserialize", "unmarshal")),
    ("encoder", ("encode", "serialize", "marshal", "format")),
)

def both_ways(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, id, way): what each seed (a column root) needs and what needs it, up to a depth, and what it supersedes or is superseded by."""
    needs = edges.where("type = 'REQUIRES'")
    parts = [closure(needs, seeds, depth, reverse).select(F.col("root").alias("seed"), "id", F.lit(way).alias("way")) for way, reverse in (("needs", False), ("needed", True))]
    kept = edges.where("type = 'SUPERSEDES'")
    for a, b in (("src", "dst"), ("dst", "src")):
        parts.append(kept.join(seeds, kept[a] == seeds["root"]).select(F.col("root").alias("seed"), F.col(b).alias("id"), F.lit("supersedes").alias("way")))
    return reduce(DataFrame.unionByName, parts).distinct()


def prioritised(related: DataFrame, edges: DataFrame, seeds: DataFrame, most: int = 5) -> DataFrame:
    """(id, place): the first related ids: by seed its direct dependencies, its dependents, what it supersedes; then all others; each in order of ids."""
    needs, kept = edges.where("type = 'REQUIRES'"), edges.where("type = 'SUPERSEDES'")
    steps = ((needs, "src", "dst", 0), (needs, "dst", "src", 1), (kept, "src", "dst", 2), (kept, "dst", "src", 3))
    near = reduce(DataFrame.unionByName, [e.join(seeds, e[a] == seeds["root"]).select(F.col(b).alias("id"), F.struct(F.col("root").alias("seed"), F.lit(n).alias("kind")).alias("rank")) for e, a, b, n in steps])
    first = related.select("id").distinct().join(near.groupBy("id").agg(F.min("rank").alias("rank")), "id", "left")
    return first.orderBy(F.asc_nulls_last("rank"), "id").limit(most).select("id", "rank")


def graph_augmented(chunks: DataFrame, edges: DataFrame, query: list[float], mentions: list[int], k: int = 10, depth: int = 2, most: int = 5, per: int = 5) -> DataFrame:
    """(chunk_id, number, similarity, related): the k best chunks and the per best of each of most related proposals, once each, best first.

    chunks: chunk_id, number, embedding. Seeds are the query's mentions and the proposals of the first three hits.
    """
    spark = chunks.sparkSession
    primary = written(vector_topk(chunks, query, k).select("chunk_id", "number", "similarity"))
    top = [r.number for r in primary.orderBy(F.desc("similarity"), "chunk_id").limit(3).collect()]
    seeds = spark.createDataFrame([(n,) for n in sorted({*mentions, *top} - {None})], "root bigint")
    few = written(prioritised(both_ways(edges, seeds, depth), edges, seeds, most))  # at most most rows
    near = topk_per_group(scored(chunks.join(F.broadcast(few.select(F.col("id").alias("number"))), "number", "left_semi"), query), "number", per)
    both = primary.select("chunk_id", "number", "similarity", F.lit(False).alias("related")).unionByName(near.select("chunk_id", "number", "similarity", F.lit(True).alias("related")))
    once = both.groupBy("chunk_id").agg(F.min(F.struct("related", "number", "similarity")).alias("r")).select("chunk_id", "r.number", "r.similarity", "r.related")
    return once.orderBy(F.desc("similarity"), "chunk_id").limit(k + 2 * few.count())


def _joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: F.concat(F.lit("EIP-"), x.cast("string"))), ", ")


def graph_context(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """A row for each seed (root): whether it is known, its direct and further neighbours and what it supersedes, as sorted lists."""
    needs, kept = edges.where("type = 'REQUIRES'"), edges.where("type = 'SUPERSEDES'")
    out = seeds.join(nodes.select(F.col("number").alias("root"), F.lit(True).alias("_known")).distinct(), "root", "left").select("root", F.coalesce("_known", F.lit(False)).alias("known"))
    direct = [(needs, "src", "dst", "dependencies"), (needs, "dst", "src", "dependents"), (kept, "src", "dst", "supersedes"), (kept, "dst", "src", "superseded_by")]
    lists = [(e.groupBy(F.col(a).alias("root")).agg(F.array_sort(F.collect_set(b)).alias(name)), name) for e, a, b, name in direct]
    lists += [(closure(needs, seeds, depth, reverse).groupBy("root").agg(F.array_sort(F.collect_set("id")).alias(name)), name) for reverse, name in ((False, "all_dependencies"), (True, "all_dependents"))]
    for found, name in lists:
        out = out.join(found, "root", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    return out


def relationship_summary(context: DataFrame, most: int = 5) -> DataFrame:
    """(root, summary): a line for each kind of relation there is; of dependents the first ones and how many more."""
    line = lambda text, ids, tail=None: F.when(F.size(ids) > 0, F.concat(F.lit("- EIP-"), F.col("root").cast("string"), F.lit(f" {text}: "), _joined(ids), F.lit("") if tail is None else tail))
    more = F.when(F.size("dependents") > most, F.concat(F.lit(" (and "), (F.size("dependents") - most).cast("string"), F.lit(" more)"))).otherwise("")
    lines = [line("requires", F.col("dependencies")), line("is required by", F.slice("dependents", 1, most), more), line("supersedes", F.col("supersedes")), line("is superseded by", F.col("superseded_by"))]
    return context.select("root", F.concat_ws("\n", *lines).alias("summary"))


def staged(chunks: DataFrame, parts: list[tuple[str, str | None, list[float]]], per: int = 5, chunks_in_all: int = 20, tokens_in_all: int = 8000) -> DataFrame:
    """(part, query, chunk_id, similarity, tokens, rank): sub-questions (text, entity, vector) in turn, each with its fair share of what is left.

    A share is at least one chunk and 500 tokens. Hits are kept in order while they fit the share's tokens; a sub-question whose
    hits would go beyond the whole budget is served but not charged. The sub-questions are a short list, each one a search.
    """
    used_chunks = used_tokens = 0
    out = []
    for j, (text, entity, vector) in enumerate(parts):
        left, room = chunks_in_all - used_chunks, tokens_in_all - used_tokens
        if left <= 0 or room <= 0:
            break
        share = max(1, min(per, left // (len(parts) - j)))
        tokens = max(500, room // (len(parts) - j))
        found = vector_topk(chunks, vector, share).select("chunk_id", "similarity", "tokens")
        order = W.orderBy(F.desc("similarity"), "chunk_id")  # a share's rows only
        kept = found.withColumn("rank", F.row_number().over(order)).withColumn("_sum", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
        kept = written(kept.where(F.col("_sum") <= tokens).drop("_sum"))
        n, t = kept.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        if used_chunks + n <= chunks_in_all and used_tokens + t <= tokens_in_all:
            used_chunks, used_tokens = used_chunks + n, used_tokens + t
        query = text if not entity or entity.upper() in text.upper() else f"{entity}: {text}"
        out.append(kept.select(F.lit(j).alias("part"), F.lit(query).alias("query"), "chunk_id", "similarity", "tokens", "rank"))
    return reduce(DataFrame.unionByName, out)


def staged_summary(found: DataFrame) -> DataFrame:
    """(part, chunks, tokens, mean): what each sub-question got."""
    return found.groupBy("part").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.round(F.avg("similarity"), 6).alias("mean"))


def boosted(hits: DataFrame, number: int, k: int = 20, name: str = "name", content: str = "content") -> DataFrame:
    """Code hits for a proposal: 0.2 for its number in the content and 0.1 in the name, at most 1 in all, best first."""
    spelled = lambda c: F.contains(F.lower(c), F.lit(f"eip{number}")) | F.contains(F.lower(c), F.lit(f"eip-{number}"))
    raised = F.col("similarity") + F.when(spelled(F.col(content)), 0.2).otherwise(0.0) + F.when(spelled(F.col(name)), 0.1).otherwise(0.0)
    return hits.withColumn("similarity", F.round(F.least(raised, F.lit(1.0)), 6)).orderBy(F.desc("similarity"), "chunk_id").limit(k)


def named(hits: DataFrame, wanted: str, k: int = 10, name: str = "name") -> DataFrame:
    """Hits whose name is the wanted one, then those whose name holds it; within each the most similar first."""
    low, target = F.lower(name), wanted.lower()
    exact = low == target
    return hits.where(F.contains(low, F.lit(target))).withColumn("exact", exact).orderBy(F.desc("exact"), F.desc("similarity"), "chunk_id").limit(k)


def reranked(hits: DataFrame, query: str, score, n: int | None = None, text: str = "content") -> DataFrame:
    """hits with relevance and their original_index (by similarity), by relevance; score is a function of two text columns."""
    order = W.orderBy(F.desc("similarity"), "chunk_id")  # of one query's hits
    rated = hits.withColumn("original_index", F.row_number().over(order) - 1).withColumn("relevance", F.round(score(F.lit(query), F.col(text)), 6))
    out = rated.orderBy(F.desc("relevance"), "original_index")
    return out if n is None else out.limit(n)


def lexical(a: Column, b: Column) -> Column:
    """Shared distinct words by all distinct words: a stand-in for a cross-encoder."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def agent_graph(chunks: DataFrame, edges: DataFrame, query: list[float], mentions: list[int], limit: int = 5) -> DataFrame:
    """(chunk_id, number, similarity, place): an agent's graph mode: the best chunks, then two of each of the first three related proposals."""
    spark = chunks.sparkSession
    order = W.orderBy(F.desc("similarity"), "chunk_id")
    primary = vector_topk(chunks, query, limit).select("chunk_id", "number", "similarity").withColumn("place", F.row_number().over(order))
    seeds = spark.createDataFrame([(n,) for n in sorted(set(mentions))], "root bigint")
    few = written(both_ways(edges, seeds).select("id").distinct().orderBy("id").limit(3))
    near = topk_per_group(scored(chunks.join(F.broadcast(few.select(F.col("id").alias("number"))), "number", "left_semi"), query), "number", 2)
    late = near.select("chunk_id", "number", "similarity", (F.lit(limit) + F.row_number().over(W.orderBy("number", "rank"))).alias("place"))
    both = primary.unionByName(late).groupBy("chunk_id").agg(F.min(F.struct("place", "number", "similarity")).alias("r"))
    return both.select("chunk_id", "r.number", "r.similarity", "r.place").orderBy("place").limit(limit + 5)


def agent_retrieval(mode: str, legs: dict) -> DataFrame:
    """The hits of a mode (vector, hybrid, graph), each leg a function without arguments; hybrid and graph fall back to vector."""
    if mode not in ("vector", "hybrid", "graph"):
        raise ValueError(f"unknown retrieval mode: {mode}")
    leg = legs.get(mode) or legs.get("vector")
    if leg is None:
        raise ValueError("no retriever configured")
    return leg()


def headline(text: Column, terms: list[str], most: int = 50, least: int = 25) -> Column:
    """Up to most words from the first query term on (started earlier so that there are at least least), query terms marked."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    plain = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    at = F.array_position(F.transform(words, lambda w: plain(w).isin(*terms)), True)
    begin = F.greatest(F.least(F.when(at > 0, at).otherwise(1), F.size(words) - least + 1), F.lit(1)).cast("int")
    return F.array_join(F.transform(F.slice(words, begin, F.lit(most)), lambda w: F.when(plain(w).isin(*terms), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")


def code_text(path: Column, name: Column, dependencies: Column, language: Column, content: Column) -> Column:
    """What is embedded of a code chunk; the first five dependencies."""
    deps = F.when(F.size(dependencies) > 0, F.concat(F.lit("\nDependencies: "), F.array_join(F.slice(dependencies, 1, 5), ", "))).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit("\nFunction: "), name, deps, F.lit("\n\n```"), language, F.lit("\n"), content, F.lit("\n```"))


def code_query(query: Column) -> Column:
    """The query, said to be about client code unless a word of it says so."""
    low = F.lower(query)
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in CODE_WORDS]), query).otherwise(F.concat(F.lit("Ethereum client code implementation: "), query))


def code_kind(name: Column, content: Column) -> Column:
    """The first kind whose words the name holds; else a type definition or a function by the content."""
    low, body, out = F.lower(name), F.lower(content), None
    for kind, words in NAME_KINDS:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(F.contains(body, F.lit("struct")) | F.contains(body, F.lit("type ")), "type_definition").otherwise("function")


def _ordered(order: str, line: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("_l")))), lambda x: x["_l"]), separator)


def code_context(hits: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """(key, context) of hits with kind, name, path, start_line, end_line, content."""
    head = F.concat(F.lit("["), F.upper("kind"), F.lit("] "), "name", F.lit(" ("), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    return hits.groupBy(key).agg(_ordered(order, F.concat(head, F.lit("\n```\n"), "content", F.lit("\n```")), "\n\n---\n\n").alias("context"))


def staged_context(hits: DataFrame, key: str) -> DataFrame:
    """(key, context) of hits with part (from 0), question, entity, rank (from 1), document_id, section, content: a section for each sub-question."""
    section = F.when(F.col("section") != "", F.concat(F.lit(" - "), "section")).otherwise("")
    line = F.concat(F.lit("["), (F.col("part") + 1).cast("string"), F.lit("."), F.col("rank").cast("string"), F.lit("] "), F.upper("document_id"), F.coalesce(section, F.lit("")), F.lit("\n"), "content")
    head = F.concat(F.lit("=== Sub-question "), (F.col("part") + 1).cast("string"), F.lit(": "), F.first("question"), F.lit(" ==="), F.coalesce(F.concat(F.lit(" [Entity: "), F.first("entity"), F.lit("]")), F.lit("")))
    parts = hits.groupBy(key, "part").agg(F.concat(head, F.lit("\n\n"), _ordered("rank", line, "\n\n")).alias("_s"))
    return parts.groupBy(key).agg(F.concat(F.lit("\n\n" + "=" * 60), _ordered("part", F.col("_s"), "\n\n")).alias("context"))


def agent_context(hits: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, context): the first hits by rank, 500 characters of each."""
    section = F.coalesce(F.when(F.col("section") != "", F.concat(F.lit(" ("), "section", F.lit(")"))), F.lit(""))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ["), F.upper("document_id"), section, F.lit("]\n"), F.left("content", F.lit(500)))
    return hits.where(F.col("rank") <= most).groupBy(key).agg(_ordered("rank", line, "\n\n---\n\n").alias("context"))


def unique_documents(hits: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """(key, document_id, section, place): each document once, with the section of its first hit, in order."""
    first = hits.groupBy(key, "document_id").agg(F.min(F.struct(order, "section")).alias("f"))
    return first.select(key, "document_id", F.col("f.section").alias("section"), F.row_number().over(W.partitionBy(key).orderBy(f"f.{order}")).alias("place"))
