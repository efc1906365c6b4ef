"""Around a completion model: prompts from hits, replies read back, views and the service's functions. The model itself is an interface."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.graph import closure
from quern.scratch import written

# fixed values: confidence of events by word, dimensions that comparisons fall back to
CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}
DIMENSIONS = ("Purpose", "Status", "Type", "Gas impact", "Backwards compatibility", "Key changes")
#: mode: what the model is told about citations
MODES = {
    "simple": "Answer from the context.",
    "cited": "Answer from the context and cite it with [n].",
    "validated": "Answer from the context and cite it with [n]; every sentence is checked against it.",
    "synthesis": "Put the answers to the sub-questions together and cite them with [n].",
}


def contexts(hits: DataFrame, key: str, most_tokens: int = 6000) -> DataFrame:
    """(key, context, hits): numbered contents of hits (rank, document_id, section, content, tokens) in order, as long as they fit."""
    upto = W.partitionBy(key).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    over = F.max((F.col("_t") > most_tokens).cast("int")).over(upto)
    kept = hits.withColumn("_t", F.sum("tokens").over(upto)).withColumn("_o", over).where("_o = 0")
    section = F.coalesce(F.when(F.col("section") != "", F.concat(F.lit(", "), "section")), F.lit(""))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.upper("document_id"), section, F.lit("\n"), "content")
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("l"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n\n---\n\n").alias("context"), F.count("*").alias("hits"))


def prompts(questions: DataFrame, hits: DataFrame, key: str, question: str, mode: str = "cited", most_tokens: int = 6000) -> DataFrame:
    """(key, prompt, hits): what a model is asked; questions without hits have an empty context."""
    made = contexts(hits, key, most_tokens)
    both = questions.join(made, key, "left")
    body = F.concat(F.lit(MODES[mode] + "\n\n<context>\n"), F.coalesce("context", F.lit("")), F.lit("\n</context>\n\n<question>\n"), F.col(question), F.lit("\n</question>"))
    return both.select(key, body.alias("prompt"), F.coalesce("hits", F.lit(0)).alias("hits"))


def extractive(prompts_: pd.Series) -> pd.Series:
    """A stand-in for a model: the first sentence of each of the first two hits, cited."""
    import re

    def one(p: str | None) -> str:
        found = re.findall(r"^\[(\d+)\] [^\n]*\n([^.!?]+[.!?])", p or "", re.M)[:2]
        return " ".join(f"{s.strip()[:-1]} [{n}]." for n, s in found) or "The context doesn't say."

    return prompts_.map(one)


def completed(asked: DataFrame, model: Callable[[pd.Series], pd.Series] = extractive, prompt: str = "prompt") -> DataFrame:
    """asked with response, tokens_in and tokens_out; the model sees Arrow batches of prompts."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return model(p)

    return asked.withColumn("response", run(F.col(prompt))).withColumn("tokens_in", T.rough_tokens(F.col(prompt))).withColumn("tokens_out", T.rough_tokens(F.col("response")))


def json_block(reply: Column, brackets: str = "{}") -> Column:
    """From the first opening bracket to the last closing one; the whole reply without any."""
    a, b = ("\\" + c for c in brackets)
    found = F.regexp_extract(reply, rf"({a}[\s\S]*{b})", 1)
    return F.when(found != "", found).otherwise(reply)


def classified_reply(reply: Column, fallback: Column) -> Column:
    """(kind, confidence, sub_questions, parsed) that a model says in JSON; the rules' (the same fields) where it can't be read."""
    found = F.regexp_extract(reply, r"(\{[^{}]*\})", 1)
    data = F.from_json(found, "query_type string, confidence double, estimated_sub_questions int, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    fine = (found != "") & data.isNotNull() & data["_bad"].isNull()
    kind = F.lower(F.coalesce(data["query_type"], F.lit("simple")))
    own = F.struct(F.when(kind.isin("simple", "complex", "multi_hop"), kind).otherwise("simple").alias("kind"), F.coalesce(data["confidence"], F.lit(0.8)).alias("confidence"), F.coalesce(data["estimated_sub_questions"], F.lit(1)).alias("sub_questions"), F.lit(True).alias("parsed"))
    return F.when(fine, own).otherwise(F.struct(fallback["kind"].alias("kind"), fallback["confidence"].alias("confidence"), fallback["sub_questions"].cast("int").alias("sub_questions"), F.lit(False).alias("parsed")))


def decomposed_reply(replies: DataFrame, key: str, reply: str, query: str) -> DataFrame:
    """(key, index, text, entity, focus, strategy) of a model's decomposition in JSON; the query itself where it can't be read."""
    parsed = F.from_json(json_block(F.col(reply)), "sub_questions array<struct<text:string,entity:string,focus:string>>, synthesis_strategy string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    # through a generator, so that a reply is read once and not for each use of its parts
    replies, data = replies.select(key, query, F.explode(F.array(parsed)).alias("_data")), F.col("_data")
    fine = data.isNotNull() & data["_bad"].isNull()
    alone = F.array(F.struct(F.col(query).alias("text"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("focus")))
    parts = F.when(fine, F.coalesce(data["sub_questions"], F.array().cast("array<struct<text:string,entity:string,focus:string>>"))).otherwise(alone)
    strategy = F.lower(F.coalesce(data["synthesis_strategy"], F.lit("explanation")))
    named = F.when(fine & strategy.isin("comparison", "timeline", "explanation", "aggregation"), strategy).otherwise("explanation")
    rows = replies.select(key, named.alias("strategy"), F.posexplode(parts).alias("index", "p"))
    return rows.select(key, "index", F.coalesce("p.text", F.lit("")).alias("text"), F.col("p.entity").alias("entity"), F.col("p.focus").alias("focus"), "strategy")


def fact_reply(replies: DataFrame, key: str, reply: str, claim: str) -> DataFrame:
    """(key, n, fact) of a model's atomic facts in JSON, blank ones dropped; the claim where it can't be read."""
    data = F.from_json(F.regexp_extract(F.col(reply), r"(\{[^{}]*\"facts\"[^{}]*\})", 1), "facts array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    fine = data.isNotNull() & data["_bad"].isNull() & data["facts"].isNotNull()
    facts = F.filter(F.transform(data["facts"], lambda x: T.strip(x)), lambda x: x != "")
    return replies.select(key, F.posexplode(F.when(fine, facts).otherwise(F.array(F.col(claim)))).alias("n", "fact"))


def dimensions(reply: Column) -> Column:
    """Names that a model lists in JSON, empty ones dropped; the default list where it can't be read."""
    found = F.from_json(F.regexp_extract(reply, r"(\[[\s\S]*\])", 1), "array<string>")
    return F.when(found.isNotNull(), F.filter(found, lambda x: F.coalesce(x, F.lit("")) != "")).otherwise(F.array(*map(F.lit, DIMENSIONS)))


def events(replies: DataFrame, sources: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, day, date, event, document_id, source_type, confidence) that a model lists in JSON, in order of day; sources: (key, documents array).

    A source's number is held to the documents there are; undated and empty events drop out, unknown days come last.
    """
    items = F.from_json(F.regexp_extract(F.col(reply), r"(\[[\s\S]*\])", 1), "array<struct<date:string,event:string,source:string,confidence:string>>")
    rows = replies.join(sources, key, "left").select(key, "documents", F.posexplode(items).alias("n", "i")).where("coalesce(i.date, '') <> '' AND coalesce(i.event, '') <> ''")
    n = F.coalesce(F.regexp_extract("i.source", r"(\d+)", 1).try_cast("int"), F.lit(1))
    at = F.greatest(F.least(n, F.size("documents")), F.lit(1))
    document = F.coalesce(F.try_element_at("documents", at), F.lit("unknown"))
    sure = reduce(lambda out, kv: F.when(F.lower("i.confidence") == kv[0], kv[1]).otherwise(out), CONFIDENCE.items(), F.lit(0.7))
    out = rows.select(key, T.date_key(F.col("i.date")).alias("day"), F.col("i.date").alias("date"), F.col("i.event").alias("event"), document.alias("document_id"), T.source_type(document).alias("source_type"), sure.alias("confidence"), "n")
    return out.orderBy(F.asc_nulls_last("day"), key, "n").drop("n")


# -- dependency views

_KINDS = ("root", "dependency", "dependent", "supersedes", "superseded_by")


def view_nodes(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(id, label, kind, depth, title, status) of what roots (a column root) need, what needs them and what they supersede.

    A node of several kinds has the first of them; a root is a root whatever else it is.
    """
    needs, kept = edges.where("type = 'REQUIRES'"), edges.where("type = 'SUPERSEDES'")
    parts = [roots.select(F.col("root").alias("id"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("depth"))]
    for k, reverse in ((1, False), (2, True)):
        parts.append(closure(needs, roots, depth, reverse).groupBy("id").agg(F.min("depth").cast("int").alias("depth")).select("id", F.lit(k).alias("kind"), "depth"))
    for k, a, b in ((3, "src", "dst"), (4, "dst", "src")):
        parts.append(kept.join(roots, kept[a] == roots["root"]).select(F.col(b).alias("id"), F.lit(k).alias("kind"), F.lit(None).cast("int").alias("depth")))
    one = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min(F.struct("kind", "depth")).alias("m"))
    named = one.join(nodes.select(F.col("number").alias("id"), "title", "status"), "id", "left")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("m.kind") + 1)
    return named.select("id", F.concat(F.lit("EIP-"), F.col("id").cast("string")).alias("label"), kind.alias("kind"), F.col("m.depth").alias("depth"), "title", "status")


def view_edges(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(src, dst, type, weight): direct needs of and for a root weigh 1, supersessions 0.8, and each further node hangs on its smallest neighbour in the view by 1 / depth."""
    needs, kept = edges.where("type = 'REQUIRES'"), edges.where("type = 'SUPERSEDES'")
    ends = roots.select(F.col("root").alias("_r")).distinct()
    direct = [needs.join(ends, needs["src"] == ends["_r"], "left_semi"), needs.join(ends, needs["dst"] == ends["_r"], "left_semi")]
    parts = [x.select("src", "dst", "type", F.lit(1.0).alias("weight")) for x in direct]
    parts += [kept.join(ends, kept[c] == ends["_r"], "left_semi").select("src", "dst", "type", F.lit(0.8).alias("weight")) for c in ("src", "dst")]
    far = {reverse: written(closure(needs, roots, depth, reverse).groupBy("id").agg(F.min("depth").alias("depth"))) for reverse in (False, True)}
    inside = reduce(DataFrame.unionByName, [t.select("id") for t in far.values()] + [roots.select(F.col("root").alias("id")), *[kept.join(ends, kept[a] == ends["_r"], "left_semi").select(F.col(b).alias("id")) for a, b in (("src", "dst"), ("dst", "src"))]]).distinct()
    for reverse, own, other in ((False, "dst", "src"), (True, "src", "dst")):
        deep = far[reverse].where("depth > 1")
        linked = needs.join(deep, needs[own] == deep["id"]).drop("id").join(inside.select(F.col("id").alias("_i")), F.col(other) == F.col("_i"), "left_semi")
        hung = linked.groupBy(own).agg(F.min(other).alias(other), F.first("depth").alias("depth"))
        parts.append(hung.select("src", "dst", F.lit("REQUIRES").alias("type"), F.round(1 / F.col("depth"), 6).alias("weight")))
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))


def layout(roots: list[int], several: bool) -> dict:
    """fixed values: hints for drawing"""
    ids = [f"eip-{n}" for n in roots]
    return {"algorithm": "force_directed", "root_nodes": ids, "charge": -300, "link_distance": 100} if several else {"algorithm": "hierarchical", "root_nodes": ids}


def d3(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json) of a view for D3: nodes with their group, links with their value."""
    name = lambda c: F.concat(F.lit("eip-"), F.col(c).cast("string"))
    n = nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct(name("id").alias("id"), "label", F.col("kind").alias("group"), "depth")).alias("json"))
    return n.unionAll(edges.select(F.lit("links"), F.to_json(F.struct(name("src").alias("source"), name("dst").alias("target"), F.col("type"), F.col("weight").alias("value")))))


# -- the service's functions


def search(chunks: DataFrame, vector: list[float], k: int = 10, document_id: str | None = None) -> DataFrame:
    """The k (1 to 50) nearest chunks, of one document if it is named, with previews."""
    from quern.operators.retrieval import vector_topk

    if not 1 <= k <= 50:
        raise ValueError("between 1 and 50 results")
    found = vector_topk(chunks, vector, k, where=None if document_id is None else F.col("document_id") == document_id)
    return found.select("chunk_id", "document_id", "similarity", T.preview(F.col("content")).alias("preview"))


def proposal(documents: DataFrame, chunks: DataFrame, number: int) -> DataFrame:
    """A document's metadata with its chunks' previews in order; no row for an unknown number."""
    ident = f"eip-{number}"
    parts = chunks.where(F.col("document_id") == ident).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", T.preview(F.col("content")).alias("preview")))).alias("chunks"))
    return documents.where(F.col("document_id") == ident).join(parts, "document_id", "left")


def corpus_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row each


def price_list(spark) -> DataFrame:
    """(model, input, output): prices of a million tokens."""
    from quern.functions.scoring import PRICES

    return spark.createDataFrame([(n, round(a * 1000, 2), round(b * 1000, 2)) for n, (a, b) in PRICES.items()], "model string, input double, output double")


def query(mode: str, handlers: dict[str, Callable[[], DataFrame]], has_nli: bool = True, has_graph: bool = True) -> DataFrame:
    """Dispatch of the five modes; unknown ones, and those whose model or graph is missing, are refused with a status."""
    if mode not in ("simple", "cited", "validated", "graph", "agentic"):
        raise ValueError("400: unknown mode")
    if mode == "validated" and not has_nli:
        raise RuntimeError("501: no entailment model")
    if mode in ("graph", "agentic") and not has_graph:
        raise RuntimeError("503: no graph")
    return handlers[mode]()
