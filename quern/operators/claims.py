"""Claims of answers: atomic facts, ledgers, suggested citations, verified and flagged responses, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scoring as S
from quern.functions import text as T

# fixed values: signs of a compound claim
COMPOUND = (r"\band\b", r"\bwhich\b", r"\bthat\b", r",\s*(?:and|or)\s*", r";\s*")
# fixed values: marks of support levels in reports and flags
MARKS = {"strong": "✅", "partial": "\U0001f7e1", "weak": "⚠️", "none": "❌", "contradiction": "\U0001f6ab"}
FLAGS = {"contradiction": " ⚠️ [CONTRADICTED BY EVIDENCE]", "none": " ⚠️ [NO SUPPORTING EVIDENCE]", "weak": " ⚠️ [WEAKLY SUPPORTED]"}
NOTICE = "\n\n---\n⚠️ **Validation Notice**: {} claim(s) may have insufficient evidence support."


def compound(claim: Column) -> Column:
    """How many signs of a compound claim there are; from two on a model would take it apart."""
    return S.hits(claim, COMPOUND)


def atomic_facts(claims: DataFrame, key: str, claim: str = "claim") -> DataFrame:
    """(key, n, fact, by_model): a compound claim is cut at each "and"; others are one fact."""
    c = F.col(claim)
    parts = F.filter(F.transform(F.split(c, r"(?i)\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")
    cut = (compound(c) > 0) & (F.size(F.split(c, r"(?i)\s+and\s+")) > 1)
    return claims.select(key, F.posexplode(F.when(cut, parts).otherwise(F.array(c))).alias("n", "fact"), (compound(c) >= 2).alias("by_model"))


def fact_levels(facts: DataFrame, entail: str = "entailment", contradict: str = "contradiction") -> DataFrame:
    """Each fact with its own support level."""
    return facts.withColumn("level", S.support_level(F.col(entail), F.col(contradict)))


def ledger(answers: DataFrame, hits: DataFrame, key: str = "answer_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The claims (key, n, claim, kind, start, end, markers) and their evidence (key, n, marker, and the columns of hits).

    hits has a row for each (key, marker). A claim is a sentence without its markers; it is factual if it is cited, and its place is
    that of its first occurrence (null where cutting the markers changed the text).
    """
    plain = lambda s: F.trim(F.regexp_replace(s, r"\[(\d+(?:\s*,\s*\d+)*)\]", ""))
    found = T.sentences(F.col(text))
    sentences = F.when(F.size(found) > 0, found).otherwise(F.array(F.col(text)))
    rows = answers.select(key, F.col(text).alias("_t"), F.posexplode(sentences).alias("n", "_s"))
    rows = rows.withColumn("claim", plain(F.col("_s"))).where("trim(claim) <> ''")
    at = F.expr("instr(_t, claim)") - 1
    claims = rows.select(key, "n", "claim", F.when(F.size(T.markers(F.col("_s"))) > 0, "factual").otherwise("interpretive").alias("kind"), F.when(at >= 0, at).alias("start"), F.when(at >= 0, at + F.length("claim")).alias("end"), T.markers(F.col("_s")).alias("markers"))
    cited = claims.select(key, "n", F.explode("markers").alias("marker"))
    return claims, cited.join(hits, [key, "marker"])


def suggestions(claims: DataFrame, sources: DataFrame, key: str, claim: str = "claim", document_id: str = "document_id") -> DataFrame:
    """(key, document_id): sources whose id holds the number of a proposal or token standard that an uncited claim names."""
    def names_of(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(claim), F.lit(rf"(?i){kind}-(\d+)"), F.lit(1)), lambda x: F.concat(F.lit(kind + "-"), x))

    names = [names_of("eip"), names_of("erc")]
    wanted = claims.select(key, F.explode(F.array_distinct(F.concat(*names))).alias("_w"))
    # an id holds a name if one of its own names begins with it, so both sides meet by all beginnings of the numbers in ids
    low = F.lower(F.col(document_id))
    own = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"((?:eip|erc)-\d+)"), F.lit(1)), lambda x: F.transform(F.sequence(F.lit(5), F.length(x)), lambda n: F.substring(x, F.lit(1), n)))))
    held = sources.select(low.alias(document_id), F.explode(own).alias("_w")).distinct()
    return wanted.join(held, "_w").select(key, document_id).distinct()


def _edited(claims: Column, text: Column, edit) -> Column:
    """text with each claim (start, end, level; sorted, not overlapping) replaced by what edit makes of (claim's text, level)."""

    def piece(c: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(claims, i)["end"])
        return F.concat(F.substring(text, before + 1, c["start"] - before), edit(F.substring(text, c["start"] + 1, c["end"] - c["start"]), c["level"]))

    tail = F.when(F.size(claims) > 0, F.try_element_at(claims, F.lit(-1))["end"]).otherwise(0)
    return F.concat(F.array_join(F.transform(claims, piece), ""), F.substring(text, tail + 1, F.length(text) - tail + 1))


def _gathered(responses: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """responses with their located claims in order, without those that start inside an earlier one; an answer's claims are one row, as an answer is."""
    upto = W.partitionBy(key).orderBy("start", "end", "n").rowsBetween(W.unboundedPreceding, -1)
    apart = claims.where("start IS NOT NULL").withColumn("_before", F.max("end").over(upto)).where("_before IS NULL OR start >= _before")
    parts = apart.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "level", "claim"))).alias("_c"))
    return responses.join(parts, key, "left").withColumn("_c", F.coalesce("_c", F.array().cast(parts.schema["_c"].dataType)))


def verified(responses: DataFrame, claims: DataFrame, key: str, text: str = "text", remove: bool = True, tag: bool = True) -> DataFrame:
    """(key, text, removed): contradicted claims are cut, unsupported ones tagged, white space and doubled stops made one."""

    def edit(c: Column, level: Column) -> Column:
        out = F.when((level == "contradiction") & F.lit(remove), F.lit("")).when((level == "none") & F.lit(tag), F.concat(c, F.lit(" [unverified]")))
        return out.otherwise(c)

    whole = _edited(F.col("_c"), F.col(text), edit)
    tidy = F.regexp_replace(F.regexp_replace(whole, r"\s+", " "), r"\.\s*\.", ".")
    return _gathered(responses, claims, key).select(key, tidy.alias("text"), F.size(F.filter("_c", lambda c: c["level"] == "contradiction")).alias("removed"))


def flagged(level: Column) -> Column:
    return level.isin(*FLAGS)


def flagged_response(responses: DataFrame, claims: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, flagged): warnings behind weak, unsupported and contradicted claims, and a notice with their number."""

    def edit(c: Column, level: Column) -> Column:
        return F.concat(c, reduce(lambda out, kv: F.when(level == kv[0], kv[1]).otherwise(out), FLAGS.items(), F.lit("")))

    n = F.size(F.filter("_c", lambda c: flagged(c["level"])))
    before, after = NOTICE.split("{}")
    notice = F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after))).otherwise("")
    return _gathered(responses, claims, key).select(key, F.concat(_edited(F.col("_c"), F.col(text), edit), notice).alias("text"), n.alias("flagged"))


def report(claims: DataFrame, key: str) -> DataFrame:
    """(key, report): counts by support level and a line for each claim, in order."""
    mark = reduce(lambda out, kv: F.when(F.col("level") == kv[0], kv[1]).otherwise(out), MARKS.items(), F.lit("?"))
    line = F.concat_ws("\n", F.concat(F.lit("### "), mark, F.lit(" claim-"), (F.col("n") + 1).cast("string")), F.concat(F.lit("**Claim**: "), "claim"), F.concat(F.lit("**Support Level**: "), "level"))
    count = lambda *levels: F.count_if(F.col("level").isin(*levels)).cast("string")
    head = F.concat_ws("\n", F.lit("# Citation Validation Report"), F.concat(F.lit("- Total claims: "), F.count("*").cast("string")), F.concat(F.lit("- Supported (strong/partial): "), count("strong", "partial")), F.concat(F.lit("- Weakly supported: "), count("weak")), F.concat(F.lit("- Unsupported: "), count("none")), F.concat(F.lit("- Contradicted: "), count("contradiction")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n\n")
    return claims.groupBy(key).agg(F.concat_ws("\n\n", head, body).alias("report"))


def verification_summary(removed: Column, warnings: Column) -> Column:
    """One line for each kind of action; a confirmation where there was none."""
    lines = F.array_compact(F.array(F.when(removed > 0, F.concat(F.lit("**Removed Claims ("), removed.cast("string"), F.lit(")**: Claims contradicted by evidence were removed."))), F.when(warnings > 0, F.concat(F.lit("**Citation Warnings ("), warnings.cast("string"), F.lit(")**: Some factual claims lack citations.")))))
    return F.array_join(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("**Verification**: All claims are supported by cited evidence."))), "\n")
