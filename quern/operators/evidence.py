"""Evidence: candidate spans, best spans, ledgers of cited answers, coverage and citation accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T


def windows(texts: DataFrame, most: int = 500, overlap: int = 50, least: int = 50, key: str = "doc_id", text: str = "text", beside: tuple[str, ...] = ()) -> DataFrame:
    """(key, start, end, span, and the columns named in beside): the whole text if it is short, else sliding windows that end at their last blank (if that is behind least characters)."""
    n, step = F.length(text), most - overlap
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - least - 1, F.lit(0)), F.lit(step)))
    # cut once into pieces between the starts, as a substring of a long text is counted from its beginning each time
    pieces = texts.select(key, *beside, n.alias("n"), starts.alias("_starts"), F.explode(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))).alias("_p"))
    cut = F.transform("_starts", lambda at, i: F.struct(at.alias("start"), F.left(F.array_join(F.slice("_p", i + 1, F.lit(-(-most // step))), ""), F.lit(most)).alias("_s")))
    out = pieces.where("n IS NOT NULL").select(key, *beside, "n", F.inline(cut))
    behind = F.locate(" ", F.reverse("_s"))
    blank = F.length("_s") - behind
    size = F.when((F.col("start") + F.length("_s") < F.col("n")) & (behind > 0) & (blank > least), blank).otherwise(F.length("_s")).cast("int")
    spans = out.select(key, *beside, "start", (F.col("start") + size).alias("end"), F.left("_s", size).alias("span"))
    return spans.where((F.length("span") >= least) | (F.col("start") == 0))


def _words(text: Column) -> Column:
    """The distinct words between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def best_spans_inside(texts: DataFrame, claim: Column, key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(key, rank, start, end, score): the n windows of each text that share most words with a claim, an expression over the text's own row; without a claim none.

    Windows are scored beside their claim, so only keys, places and scores are shuffled, and at most n of each key and task.
    """
    rows = texts.where(claim.isNotNull()).select(key, F.col(text).alias("_text"), _words(claim).alias("_a"))
    spans = windows(rows, key=key, text="_text", beside=("_a",))
    # through a generator, so that a window's words are made once
    worded = spans.select(key, "start", "end", "_a", F.explode(F.array(_words(F.col("span")))).alias("_b"))
    both = worded.select(key, "start", "end", F.size("_a").alias("_m"), F.size("_b").alias("_k"), F.size(F.array_intersect("_a", "_b")).alias("_i"))
    union = F.col("_m") + F.col("_k") - F.col("_i")
    scored = both.select(key, "start", "end", F.round(F.when(union == 0, 0.0).otherwise(F.col("_i") / union), 6).alias("score"))
    order = W.partitionBy(key).orderBy(F.desc("score"), "start")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(key, "rank", "start", "end", "score")


def best_spans(claims: DataFrame, spans: DataFrame, on: str, claim: str = "claim", n: int = 3) -> DataFrame:
    """The n spans that share most words (between white space) with each claim, within the equal-join column on; ties to the first span."""
    # word sets are columns of both sides, so that each is made once
    left = claims.withColumn("_a", _words(F.col(claim)))
    scored = left.join(spans.withColumn("_b", _words(F.col("span"))), on).withColumn("score", F.round(T.jaccard(F.col("_a"), F.col("_b")), 6)).drop("_a", "_b")
    order = W.partitionBy(on).orderBy(F.desc("score"), "start")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def span_hash(text: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.substring(text, start + 1, end - start), 256)


def drifted(spans: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Spans whose text no longer hashes to their span_hash (or is gone)."""
    joined = spans.join(texts.select(key, F.col(text).alias("_t")), key, "left")
    return joined.where(~F.coalesce(span_hash(F.col("_t"), F.col("start"), F.col("end")) == F.col("span_hash"), F.lit(False))).drop("_t")


def ledger(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, n, sentence, marker): sentences of an answer and the citation markers of each; marker null where uncited."""
    sentences = answers.select(key, F.posexplode(T.sentences(F.col(text))).alias("n", "sentence"))
    return sentences.select(key, "n", "sentence", F.explode_outer(T.markers(F.col("sentence"))).alias("marker"))


def coverage(entries: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, claims, cited, ratio): claims with at least one marker."""
    claims = entries.groupBy(key, "n").agg(F.count("marker").alias("m"))
    return claims.groupBy(key).agg(F.count("*").alias("claims"), F.count_if(F.col("m") > 0).alias("cited")).withColumn("ratio", F.round(F.col("cited") / F.col("claims"), 6))


def citation_accuracy(markers: Column, hits: Column) -> Column:
    """Share of markers that name a hit; 1 without markers."""
    good = F.size(F.filter(markers, lambda m: (m >= 1) & (m <= hits)))
    return F.when(F.size(markers) == 0, 1.0).otherwise(good / F.size(markers))


def insert_citations(sentences: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, text): an answer's sentences in order, each with its markers behind it. An answer is one row."""
    marked = sentences.groupBy(key, "n", "sentence").agg(F.array_sort(F.collect_set("marker")).alias("m"))
    one = F.when(F.size("m") > 0, F.concat("sentence", F.lit(" ["), F.array_join(F.col("m").cast("array<string>"), ", "), F.lit("]"))).otherwise(F.col("sentence"))
    rows = marked.select(key, "n", one.alias("s")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("text"))


def source_recall(expected: F.Column, retrieved: F.Column) -> F.Column:
    """Share of the distinct expected sources that were retrieved, whatever the case; 1 where none are expected."""
    names = lambda a: F.array_distinct(F.transform(F.array_compact(F.coalesce(a, F.array().cast("array<string>"))), F.lower))
    return F.when(F.size(names(expected)) == 0, 1.0).otherwise(F.size(F.array_intersect(names(expected), names(retrieved))) / F.size(names(expected)))


def cited_inline(responses: DataFrame, claims: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, text): each response with its claims' citations (key, end, citation) behind the offsets where the claims end; the text between is kept.

    Citations of one offset stand in their order as texts; offsets beyond the text count as its end. A response's claims are one row's list.
    """
    noted = claims.where("end IS NOT NULL AND citation IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("end", "citation"))).alias("_c"))
    whole, length = F.col(text), F.length(text)

    def put(done: F.Column, claim: F.Column) -> F.Column:
        end = F.least(claim["end"].cast("int"), length)
        return F.struct(end.alias("at"), F.concat(done["out"], F.substring(whole, done["at"] + 1, end - done["at"]), F.lit(" "), claim["citation"]).alias("out"))

    placed = F.aggregate("_c", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda done: F.concat(done["out"], F.substring(whole, done["at"] + 1, length)))
    return responses.join(noted, key, "left").select(key, F.when(F.col("_c").isNotNull(), placed).otherwise(whole).alias(text))
