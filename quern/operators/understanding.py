"""Query understanding by rules: decomposition, complexity, ensemble triggers, escalation and entities to compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scoring as S

# fixed values: openings of questions that are decomposed
COMPARES = r"compare\s+(?:the\s+)?(.+?)\s+(?:and|with|to|vs\.?)\s+(.+?)(?:\s*\?|$)"
EVOLVES = r"(?:how\s+did|evolution\s+of|history\s+of|timeline\s+of)\s+(.+?)(?:\s+evolve|\s+from|\s*\?|$)"
# fixed values: what is asked about each entity, by strategy: text before and after the entity, focus
SUB_QUESTIONS = {
    "comparison": ("What is the gas model/mechanism of ", "?", "gas_model"),
    "timeline": ("What does ", " propose and when was it created?", "timeline"),
    "aggregation": ("What is ", " and what does it propose?", "overview"),
}
# fixed values: signals of a query's complexity
SIGNALS = {
    "multi_hop": (
        r"(?:how|what)\s+.*\s+(?:affect|impact|influence|relate|depend)",
        r"(?:compare|contrast|difference|versus|vs\.?)",
        r"(?:evolution|history|timeline|progression)",
        r"(?:why|explain|reason|rationale)\s+.*\s+(?:chose|decided|proposed)",
        r"(?:pros\s+and\s+cons|trade-?offs?|advantages\s+and\s+disadvantages)",
    ),
    "comparison": (r"(?:compare|contrast|difference|versus|vs\.?)", r"(?:better|worse|preferred|alternative)", r"(?:advantages?\s+of\s+\w+\s+over)", r"eip-?\d+\s+(?:and|vs\.?|versus)\s+eip-?\d+"),
    "timeline": (r"(?:when|timeline|history|evolution|progression)", r"(?:first|earliest|original|initial)", r"(?:changed|evolved|developed|progressed)", r"(?:before|after|since|until)"),
    "graph": (r"(?:depends?\s+on|requires|needs)", r"(?:dependent|dependency|dependencies)", r"(?:related|relationship|connected)", r"(?:supersedes?|replaced|obsolete)", r"(?:eips?\s+that\s+(?:use|implement|require|depend))"),
    "simple": (r"^what\s+is\s+", r"^define\s+", r"^explain\s+(?:the\s+)?(?:concept|term|meaning)", r"^(?:gas\s+cost|fee|price)\s+of"),
}
# fixed values: retrievals, tokens and calls by complexity
BUDGETS = {"simple": (2, 4000, 3), "moderate": (4, 8000, 6), "complex": (6, 12000, 10), "research": (10, 20000, 15)}
# fixed values: marks of queries that are worth several models
HIGH_STAKES = (r"\broadmap\b", r"\barchitecture\b", r"\bdesign\s+decision\b", r"\bbreaking\s+change\b", r"\bsecurity\b", r"\bcritical\b", r"\bproduction\b", r"\bmainnet\b", r"\bupgrade\b", r"\bhard\s*fork\b", r"\bconsensus\s+change\b")
THOROUGH = (r"\bthorough(ly)?\b", r"\bcomprehensive\b", r"\bin[\-\s]?depth\b", r"\bdetailed\s+analysis\b", r"\bfull\s+picture\b", r"\ball\s+perspectives\b", r"\bexhaustive\b", r"\bcareful(ly)?\s+(analyze|examine|review)\b")
CONFLICTS = (r"\bcontradicts?\b", r"\bconflicting\b", r"\bdisagree(ment)?\b", r"\binconsistent\b", r"\bdispute[ds]?\b", r"\bopposing\s+views?\b", r"\bdebate[ds]?\b")
# fixed values: phrases of unsure answers
UNSURE = ("i'm not sure", "unclear", "may be", "might be", "possibly", "uncertain", "not enough information")
# fixed values: entities that are compared without numbers
ENTITIES = (("proof of work", "PoW"), ("proof of stake", "PoS"), ("eip-1559", "EIP-1559"), ("eip-4844", "EIP-4844"), ("layer 1", "L1"), ("layer 2", "L2"), ("optimistic rollup", "Optimistic Rollups"), ("zk rollup", "ZK Rollups"))
VERSUS = r"(?i)(\w+(?:\s+\w+)?)\s+(?:vs\.?|versus|or)\s+(\w+(?:\s+\w+)?)"


def decomposed(queries: DataFrame, key: str, text: str = "q") -> DataFrame:
    """(key, index, text, entity, focus, strategy): the sub-questions of each query; the query itself where there is nothing to take apart."""
    q = F.col(text)
    ids = F.transform(F.regexp_extract_all(q, F.lit(r"(?i)eip-?(\d+)"), F.lit(1)), lambda x: F.concat(F.lit("EIP-"), x))
    rows = queries.select(key, q.alias("_q"), ids.alias("_ids")).withColumn("strategy", strategy_of(F.col("_q"), F.col("_ids")))
    entities = F.when(F.col("strategy") == "comparison", F.slice("_ids", 1, 2)).when(F.col("strategy") != "explanation", F.col("_ids")).otherwise(F.array(F.lit(None).cast("string")))
    out = rows.select(key, "_q", "strategy", F.posexplode(entities).alias("index", "entity"))
    about, focus = F.col("_q"), F.lit(None).cast("string")
    for name, (before, after, what) in SUB_QUESTIONS.items():
        about = F.when(F.col("strategy") == name, F.concat(F.lit(before), "entity", F.lit(after))).otherwise(about)
        focus = F.when(F.col("strategy") == name, what).otherwise(focus)
    return out.select(key, "index", about.alias("text"), "entity", focus.alias("focus"), "strategy")


def strategy_of(query: Column, entities: Column) -> Column:
    """How the answers to sub-questions are put together."""
    many, low = F.size(entities) >= 2, F.lower(query)
    return F.when(many & low.rlike(COMPARES), "comparison").when(many & low.rlike(EVOLVES), "timeline").when(many, "aggregation").otherwise("explanation")


def sub_question_estimate(query: Column) -> Column:
    """Mentions, one at least, and one more for comparisons."""
    return F.greatest(F.lit(1), S.mention_count(query)) + query.rlike(r"(?i)\b(compare|versus|vs\.?|difference)\b").cast("int")


def analysed(queries: DataFrame, key: str, text: str = "q") -> DataFrame:
    """(key, complexity, mode, signals, max_retrievals, max_tokens, max_calls) of each query."""
    q = F.col(text)
    parts = [(S.hits(q, patterns) > 0).alias(name) for name, patterns in SIGNALS.items()]
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    # through generators, so that each pattern is matched once and the steps don't multiply
    rows = queries.select(key, F.explode(F.array(F.struct(*parts, S.mention_count(q).alias("n"), words.alias("words")))).alias("f"))
    f = {name: F.col(f"f.{name}") for name in (*SIGNALS, "n", "words")}
    score = sum((F.when(f[x], w).otherwise(0) for x, w in (("multi_hop", 2), ("comparison", 2), ("timeline", 2), ("graph", 1))), F.lit(0))
    score = score + F.when(f["n"] > 1, f["n"] - 1).otherwise(0) + F.when(f["words"] > 20, 1).otherwise(0)
    scored = rows.select(key, "f", F.explode(F.array(score)).alias("score"))
    plain = f["simple"] & ~(f["multi_hop"] | f["comparison"] | f["timeline"])
    level = F.when(plain, "simple").when(F.col("score") >= 6, "research").when(F.col("score") >= 4, "complex").when(F.col("score") >= 2, "moderate").otherwise("simple")
    graded = scored.select(key, "f", F.explode(F.array(level)).alias("complexity"))
    mode = F.when(F.col("complexity") == "simple", "simple").when(f["graph"], "graph").when(F.col("complexity").isin("complex", "research"), "agentic").otherwise("hybrid")
    names = (("simple", "simple_pattern_match"), ("multi_hop", "multi_hop_reasoning"), ("comparison", "comparison_query"), ("timeline", "timeline_query"), ("graph", "graph_traversal_needed"))
    signals = [F.when(f[x], F.lit(name)) for x, name in names] + [F.when(f["n"] > 1, F.concat(F.lit("multiple_eip_refs_"), f["n"].cast("string")))]
    budget = lambda j: reduce(lambda out, kv: F.when(F.col("complexity") == kv[0], kv[1][j]).otherwise(out), BUDGETS.items(), F.lit(None).cast("int"))
    return graded.select(key, "complexity", mode.alias("mode"), F.array_compact(F.array(*signals)).alias("signals"), *[budget(j).alias(c) for j, c in enumerate(("max_retrievals", "max_tokens", "max_calls"))])


def high_stakes(query: Column) -> Column:
    return F.least(S.hits(F.lower(query), HIGH_STAKES) * 0.25, F.lit(1.0))


def triggers(queries: DataFrame, key: str, text: str = "q", confidence: str = "confidence", conflicts: str | None = None, threshold: float = 0.7) -> DataFrame:
    """(key, n, priority, strategy): the reasons to ask several models, in the order of their rules."""
    clash = F.lit(False) if conflicts is None else F.coalesce(F.col(conflicts), F.lit(False))
    # through generators, so that each text is lower-cased and each pattern matched once
    asked = queries.select(key, F.col(confidence).alias("_c"), clash.alias("_clash"), F.explode(F.array(F.lower(F.col(text)))).alias("_low"))
    low, parts = F.col("_low"), {"stakes": HIGH_STAKES, "thorough": THOROUGH, "conflicts": CONFLICTS, "compare": S.COMPARISON, "evolve": S.EVOLUTION, "hop": S.MULTI_HOP}
    asked = asked.select(key, "_c", "_clash", F.explode(F.array(F.struct(*[S.hits(low, patterns).alias(name) for name, patterns in parts.items()], S.mention_count(low).alias("n")))).alias("f"))
    c, clash, stakes = F.col("_c"), F.col("_clash"), F.least(F.col("f.stakes") * 0.25, F.lit(1.0))
    kind = S.kind_of(*[F.col(f"f.{name}") for name in ("compare", "evolve", "hop", "n")])
    rules = (
        (c < threshold, ((F.lit(threshold) - c) * 100).cast("int"), "merge"),
        (stakes >= 0.5, (stakes * 50).cast("int"), "vote"),
        (F.col("f.thorough") > 0, F.lit(40), "merge"),
        (clash | (F.col("f.conflicts") > 0), F.lit(45), "vote"),
        (kind["kind"] == "multi_hop", F.lit(35), "merge"),
        ((kind["kind"] == "complex") & (kind["confidence"] < 0.7), F.lit(25), "best"),
    )
    rows = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(n).alias("n"), p.alias("priority"), F.lit(s).alias("strategy"))) for n, (hit, p, s) in enumerate(rules)]))
    return asked.select(key, F.explode(rows).alias("t")).select(key, "t.*")


def ensembles(queries: DataFrame, key: str, text: str = "q", confidence: str = "confidence", **more) -> DataFrame:
    """(key, use_ensemble, strategy, priority, models): one row a query; the strategy with most priority votes, ties to that of the first trigger."""
    fired = triggers(queries, key, text, confidence, **more)
    rank = W.partitionBy(key).orderBy(F.desc("priority"), "n")
    votes = fired.withColumn("rank", F.row_number().over(rank)).groupBy(key, "strategy").agg(F.sum("priority").alias("votes"), F.min("rank").alias("rank"), F.max("priority").alias("most"))
    best = votes.groupBy(key).agg(F.max_by("strategy", F.struct("votes", -F.col("rank"))).alias("strategy"), F.max("most").alias("priority"))
    out = queries.select(key, high_stakes(F.col(text)).alias("_s")).join(best, key, "left")
    models = F.when((F.col("priority") >= 50) | (F.col("_s") >= 0.75), "fast,balanced,powerful").when(F.col("priority") >= 35, "balanced,powerful").otherwise("fast,balanced")
    used = F.col("priority").isNotNull()
    return out.select(key, used.alias("use_ensemble"), F.coalesce("strategy", F.lit("best")).alias("strategy"), F.coalesce("priority", F.lit(0)).alias("priority"), F.when(used, models).otherwise("").alias("models"))


def escalation(response: Column, confidence: Column, query: Column) -> Column:
    """(escalate, reasons, priority) of an answer: low confidence, few words, unsure phrases, high stakes; the two strongest reasons."""
    words, low = F.size(F.filter(F.split(response, r"\s+"), lambda w: w != "")), F.lower(response)
    unsure = reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in UNSURE])
    rules = ((confidence < 0.5, 60, "low_confidence"), ((high_stakes(query) >= 0.5) & (confidence < 0.8), 55, "high_stakes"), (unsure >= 2, 50, "uncertain"), (words < 50, 40, "short"))
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"))) for hit, p, r in rules]))
    top = F.slice(found, 1, 2)
    return F.struct((F.size(found) > 0).alias("escalate"), F.array_join(F.transform(top, lambda x: x["r"]), "; ").alias("reasons"), F.coalesce(F.try_element_at(found, F.lit(1))["p"], F.lit(0)).alias("priority"))


def first_number(query: Column) -> Column:
    return F.regexp_extract(F.lower(query), r"eip[- ]?(\d+)", 1).try_cast("int")


def entities(query: Column) -> Column:
    """What a comparison is about: two numbers or more; else known terms too; else the sides of a versus; else placeholders."""
    low = F.lower(query)
    numbered = F.transform(F.regexp_extract_all(low, F.lit(r"eip[- ]?(\d+)"), F.lit(1)), lambda x: F.concat(F.lit("EIP-"), x))
    named = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(label)) for t, label in ENTITIES]))
    known = F.concat(numbered, F.array_except(named, numbered))
    sides = F.array(F.trim(F.regexp_extract(query, VERSUS, 1)), F.trim(F.regexp_extract(query, VERSUS, 2)))
    return F.when(F.size(numbered) >= 2, numbered).when(F.size(known) >= 2, known).when(query.rlike(VERSUS), sides).otherwise(F.array(F.lit("Entity A"), F.lit("Entity B")))


def dependency_depth(query: Column) -> Column:
    """How deep a dependency view goes: 5 for deep or all, 1 for direct, else 3."""
    low = F.lower(query)
    return F.when(F.contains(low, F.lit("deep")) | F.contains(low, F.lit("all")), 5).when(F.contains(low, F.lit("direct")), 1).otherwise(3)


def structured_plan(query: Column) -> Column:
    """(type, number, depth): what an orchestrated answer builds; a dependency view without a number becomes a timeline."""
    kind, number = S.output_type(query), first_number(query)
    built = F.when((kind == "dependency") & number.isNull(), "timeline").otherwise(kind)
    view = built == "dependency"
    return F.struct(built.alias("type"), F.when(view, number).alias("number"), F.when(view, dependency_depth(query)).alias("depth"))
