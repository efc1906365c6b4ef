"""Scores as column expressions: text quality, retrieval confidence, gates, budgets, query understanding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marks of badly extracted text
ARTIFACTS = (r"[^\x00-\x7F]{3,}", r"[\x{fffd}]{2,}", r"[|l1I]{4,}", r"\s{3,}", r"[^\p{L}\p{N}_\s]{5,}")
# fixed values: pairs of wrongly decoded text
MOJIBAKE = ("\u00c3\u00a9", "\u00c3\u00a8", "\u00e2\u20ac\u2122", '\u00e2\u20ac"')
# fixed values: weights of sources, the first that a document's id holds
AUTHORITY = {"eip": 1.0, "erc": 1.0, "execution-specs": 0.95, "consensus-specs": 0.95, "ethereum-research": 0.8, "eth-magicians": 0.7, "acd-transcript": 0.75, "arxiv": 0.85}
# fixed values: words of specific queries, and words of factual claims
SPECIFIC = ("gas", "block", "transaction", "validator", "beacon", "blob", "calldata")
TECHNICAL = ("gas", "wei", "gwei", "block", "transaction", "contract", "validator", "beacon", "slot", "epoch", "shard")
# fixed values: bonuses of indicators, and the words that make a single mention a dependency
BONUS = {"compare": 2, "vs": 2, "versus": 2, "comparison": 2, "timeline": 2, "history": 2, "chronolog": 2, "pros and cons": 2, "debate": 2, "argument": 2}
DEPENDS = ("depend", "require", "related")
# fixed values: sections that a paper should have, in order
SECTIONS = ("abstract", "introduction", "conclusion", "references")
# fixed values: query patterns by group
COMPARISON = (r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference\s+between\b", r"\bhow\s+does\s+.+\s+differ\b", r"\bsimilarities\s+between\b", r"\bcontrast\b")
EVOLUTION = (r"\bevolve[d]?\b", r"\bhistory\s+of\b", r"\bover\s+time\b", r"\bprogression\b", r"\btimeline\b", r"\bchanged?\s+from\b", r"\bdevelop(ed|ment)?\b")
MULTI_HOP = (r"\brelate\s+to\b", r"\bdepend(s|encies)?\s+on\b", r"\brequire[s]?\b.*\brequire[s]?\b", r"\bchain\s+of\b", r"\btransitive(ly)?\b", r"\bindirect(ly)?\b", r"\bimplications?\s+of\b")
# fixed values: indicators of structured outputs, in the order that settles ties
OUTPUTS = {
    "timeline": ("timeline", "history", "evolution", "when", "chronolog", "over time", "progression", "development of"),
    "argument_map": ("pro", "con", "debate", "argument", "opinion", "controversy", "tradeoff", "trade-off", "pros and cons", "advantages", "disadvantages"),
    "comparison": ("compare", "comparison", "difference", "vs", "versus", "contrast", "between", "similarities"),
    "dependency": ("depend", "require", "relationship", "relies on", "related to", "builds on", "based on", "prerequisite"),
}
# fixed values: statements that need a citation, and those that never do
FACTUAL = (r"\d+(?:\.\d+)?%", r"\$?\d+(?:,\d{3})*(?:\.\d+)?", r"EIP-\d+", r"ERC-\d+", r"(?:is|are|was|were)\s+(?:the|a|an)", r"(?:introduced|proposed|implemented)\s+(?:in|by)", r"(?:first|originally|initially)", r"according\s+to", r"(?:bytes?|bits?|gas)")
NOT_FACTUAL = (r"^(?:for example|e\.g\.|i\.e\.)", r"^(?:in summary|to summarize)", r"^(?:this means|this suggests)", r"(?:should|could|might|may)\s+be", r"^(?:let me|i will)")
# fixed values: query words that carry no topic
STOP_WORDS = ("what", "how", "why", "when", "which", "is", "are", "the", "a", "an", "in", "of", "to", "for")


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns a text matches, whatever the case."""
    return reduce(lambda a, b: a + b, [text.rlike("(?i)" + p).cast("int") for p in patterns])


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_quality(text: Column) -> Column:
    """1 less penalties: artifacts per 1000 characters, word density, runs without vowels, few valid sentences; 0 if empty."""
    n = F.length(text)
    rate = reduce(lambda a, b: a + b, [count(text, p) for p in ARTIFACTS]) / n * 1000
    density = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")) / n * 100
    parts = F.split(text, r"[.!?]+")
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    valid = F.size(F.filter(parts, lambda t: words(t).between(11, 99) & t.rlike("[a-zA-Z]")))
    penalty = F.when(rate > 10, F.least(F.lit(0.3), rate / 100)).otherwise(0.0)
    penalty = penalty + F.when(density < 10, 0.2).when(density > 25, 0.1).otherwise(0.0)
    penalty = penalty + F.when(count(F.lower(text), r"[bcdfghjklmnpqrstvwxz]{6,}") > 5, 0.2).otherwise(0.0)
    penalty = penalty + F.when(valid / F.size(parts) < 0.3, 0.2).otherwise(0.0)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - penalty))


def encoding_quality(text: Column) -> Column:
    """1 less capped penalties for more than 10 replacement or control characters or 5 wrongly decoded pairs."""
    found = lambda *marks: reduce(lambda a, b: a + b, [((F.length(text) - F.length(F.replace(text, F.lit(m)))) / len(m)).cast("int") for m in marks])
    out = 1.0
    for n, least, most, per in ((found("\ufffd"), 10, 0.3, 100), (count(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), 10, 0.2, 100), (found(*MOJIBAKE), 5, 0.2, 50)):
        out = out - F.when(n > least, F.least(F.lit(most), n / per)).otherwise(0.0)
    return F.greatest(F.lit(0.0), out)


def structure_quality(sections: Column) -> Column:
    """Of an array of (heading, content): a tenth for each expected section without a heading, a twentieth for each short one, a fifth for a wrong order."""
    heads = F.transform(sections, lambda x: F.lower(x["heading"]))
    # the headings as one text: no expected name spans two of them
    names = F.array_join(heads, "\n")
    missing = reduce(lambda a, b: a + b, [(~F.contains(names, F.lit(e))).cast("int") for e in SECTIONS])
    short = F.size(F.filter(sections, lambda x: F.length(F.trim(x["content"])) < 50))
    last = lambda name: F.size(heads) - F.array_position(F.reverse(heads), F.lit(name))
    both = F.array_contains(heads, F.lit("abstract")) & F.array_contains(heads, F.lit("references"))
    score = 1.0 - missing * 0.1 - short * 0.05 - F.when(both & (last("abstract") > last("references")), 0.2).otherwise(0.0)
    return F.when(F.size(sections) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), score))


def completeness(chars: Column, pages: Column, references: Column, title: Column) -> Column:
    """Up to 0.3 off below 500 characters a page, 0.1 without references (0.05 below five), 0.1 without a title."""
    least = pages * 500
    sparse = F.when(chars < least, (1 - chars / F.greatest(least, F.lit(1))) * 0.3).otherwise(0.0)
    refs = F.when(references == 0, 0.1).when(references < 5, 0.05).otherwise(0.0)
    untitled = F.when(F.coalesce(title, F.lit("")).isin("", "Untitled"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1.0 - sparse - refs - untitled)


def overall_quality(text: Column, structure: Column, completeness: Column, encoding: Column) -> Column:
    return 0.4 * text + 0.3 * structure + 0.2 * completeness + 0.1 * encoding


def acceptable(overall: Column, threshold: float = 0.6) -> Column:
    return overall >= threshold


def quality_suggestions(text: Column, structure: Column, completeness: Column, encoding: Column) -> Column:
    """What to mend, in order; one line where there is nothing."""
    checks = ((text, 0.6, "text_extraction"), (structure, 0.6, "structure"), (encoding, 0.8, "encoding"), (completeness, 0.7, "completeness"))
    found = F.array_compact(F.array(*[F.when(x < least, F.lit(name)) for x, least, name in checks]))
    return F.when(F.size(found) == 0, F.array(F.lit("none_needed"))).otherwise(found)


def diversity(distinct: Column, n: Column) -> Column:
    return F.when(distinct <= 1, 0.2).otherwise(F.least(1.5 * distinct / n, F.lit(1.0)))


def retrieval_confidence(relevance: Column, coverage: Column, spread: Column, authority: Column, n: Column) -> Column:
    score = 0.4 * relevance + 0.2 * coverage + 0.2 * spread + 0.2 * authority
    return F.least(F.when(n < 3, score * n / 3).otherwise(score), F.lit(1.0))


def authority(document_id: Column) -> Column:
    """The weight of the first source, in the table's order, that the id holds; 0.5 of others."""
    low, out = F.lower(document_id), None
    for name, w in AUTHORITY.items():
        hit = F.contains(low, F.lit(name))
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out.otherwise(0.5)


def specificity(query: Column) -> Column:
    """Words by 15, and parts for a mention and for technical terms, at most 1."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    low = F.lower(query)
    score = F.least(words / 15, F.lit(1.0))
    score = F.when(F.contains(low, F.lit("eip")), F.least(score + 0.2, F.lit(1.0))).otherwise(score)
    technical = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in SPECIFIC])
    return F.when(technical, F.least(score + 0.1, F.lit(1.0))).otherwise(score)


def recommendation(score: Column) -> Column:
    """fixed values: the advice for each range of scores"""
    return (
        F.when(score >= 0.85, "High confidence - single model response should be sufficient")
        .when(score >= 0.7, "Good confidence - consider ensemble for critical queries")
        .when(score >= 0.5, "Moderate confidence - ensemble recommended for better coverage")
        .otherwise("Low confidence - ensemble strongly recommended; consider query reformulation")
    )


def sufficient(score: Column, hits: Column, best: Column, threshold: float = 0.7) -> Column:
    """Three hits, one of the first three at 0.6 (best), and the score at the threshold."""
    return (hits >= 3) & (F.coalesce(best, F.lit(0.0)) >= 0.6) & (score >= threshold)


def improvement(score: Column, hits: Column, relevance: Column, coverage: Column, spread: Column, authority: Column) -> Column:
    """Names of what would raise the confidence, in order; of good retrievals one verdict."""
    checks = ((hits < 3, "broaden"), (relevance < 0.6, "rephrase"), (coverage < 0.5, "decompose"), (spread < 0.3, "more_sources"), (authority < 0.5, "better_sources"))
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(F.array(F.when(score < 0.8, "ensemble").otherwise("good"))), "; ")


def bucket(key: Column) -> Column:
    """SHA-256 of a key as one of 1000 steps in [0, 1)."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("bigint") % 1000 / 1000


def variant(at: Column, weights: list[tuple[str, float]]) -> Column:
    """The first variant whose cumulative weight exceeds the bucket."""
    total, out, upto = sum(w for _, w in weights), None, 0.0
    for name, w in weights[:-1]:
        upto += w / total
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def support_level(entail: Column, contradict: Column) -> Column:
    return F.when(entail.isNull(), "none").when(contradict > 0.7, "contradiction").when(entail > 0.7, "strong").when(entail > 0.4, "partial").otherwise("weak")


def aggregate_support(contradictions: Column, strong: Column, partial: Column, n: Column) -> Column:
    return F.when(contradictions > 0, "contradiction").when(strong / n >= 0.8, "strong").when((strong / n >= 0.5) | ((strong + partial) / n >= 0.8), "partial").otherwise("weak")


def needs_citation(sentence: Column) -> Column:
    """A statement of 20 characters or more with a factual mark or a technical term and none of the marks of others."""
    low = F.lower(sentence)
    technical = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in TECHNICAL])
    return (F.length(sentence) >= 20) & (hits(sentence, NOT_FACTUAL) == 0) & ((hits(sentence, FACTUAL) > 0) | technical)


def compliant(claims: Column, cited: Column, uncited_factual: Column, ratio: float = 0.7) -> Column:
    """Enough claims cited, and at most a tenth of them factual without a citation."""
    return (F.when(claims > 0, cited / claims).otherwise(1.0) >= ratio) & (uncited_factual <= claims * 0.1)


def mention_count(text: Column) -> Column:
    """Mentions of proposals, repeated ones too."""
    return F.regexp_count(F.lower(text), F.lit(r"eip-?\d+"))


def classified(text: Column) -> Column:
    """(kind, confidence, sub_questions, decompose) of a query by rules."""
    low = F.lower(text)
    return kind_of(hits(low, COMPARISON), hits(low, EVOLUTION), hits(low, MULTI_HOP), mention_count(text))


def kind_of(compare: Column, evolve: Column, hop: Column, n: Column) -> Column:
    """classified() from the numbers of patterns that match and of mentions."""
    multi = (hop >= 1) | ((n >= 2) & ((compare > 0) | (evolve > 0)))
    many = (compare > 0) | (evolve > 0) | (n >= 2)
    kind = F.when(multi, "multi_hop").when(many, "complex").otherwise("simple")
    sure = F.when(multi, F.least(0.7 + hop * 0.1, F.lit(0.95))).when(many, F.least(0.6 + (compare + evolve + n) * 0.1, F.lit(0.9))).otherwise(0.8)
    parts = F.when(multi, F.greatest(F.lit(2), n + 1)).when(many, F.greatest(F.lit(2), n)).otherwise(1)
    return F.struct(kind.alias("kind"), F.round(sure, 6).alias("confidence"), parts.alias("sub_questions"), (multi | many).alias("decompose"))


def query_class(text: Column) -> Column:
    return classified(text)["kind"]


def output_type(text: Column) -> Column:
    """The structured output with the most indicators and bonuses; ties by the fixed order, the first one without any."""
    low, n = F.lower(text), F.regexp_count(F.lower(text), F.lit(r"eip[- ]?\d+"))
    scores = [reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(i)), 1 + BONUS.get(i, 0)).otherwise(0) for i in words]) for words in OUTPUTS.values()]
    depends = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in DEPENDS])
    at = list(OUTPUTS)
    scores[at.index("comparison")] += F.when(n >= 2, 3).otherwise(0)
    scores[at.index("dependency")] += F.when((n == 1) & depends, 3).otherwise(0)
    best, out = F.greatest(*scores), None
    for name, s in zip(OUTPUTS, scores, strict=True):
        out = F.when(s == best, name) if out is None else out.when(s == best, name)
    return out


def tier(kind: Column, context_tokens: Column, confidence: Column) -> Column:
    base = F.when(kind == "simple", "fast").when(kind == "complex", "balanced").otherwise("powerful")
    return F.when((base == "fast") & ((context_tokens > 50_000) | (confidence < 0.5)), "balanced").otherwise(base)


# fixed values: prices of a tier's 1000 input and output tokens
PRICES = {"fast": (0.0008, 0.004), "balanced": (0.003, 0.015), "powerful": (0.015, 0.075)}


def cost(kind: Column, tokens_in: Column, tokens_out: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, (a, b) in PRICES.items():
        out = F.when(kind == name, tokens_in / 1000 * a + tokens_out / 1000 * b).otherwise(out)
    return out


def degradation(gap: Column) -> Column:
    return F.when(gap < 0.2, "proceed_with_notice").otherwise("refuse")
