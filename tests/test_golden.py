"""Literal cases of the rules, at and around their thresholds; expected values are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quern.functions import scoring as S
from quern.operators import chunkers, claims, decisions, graph, located, retrieval, understanding


def column(spark, expression, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_queries_are_classified(spark):
    texts = ("what chain of things", "compare EIP-1 and EIP-2", "compare gas and blobs", "EIP-1, eip2", "all the several things", "What is EIP-1?", "eip-1 eip-1")
    found = column(spark, S.classified, *texts)
    assert [r.kind for r in found] == ["multi_hop", "multi_hop", "complex", "complex", "simple", "simple", "complex"]
    assert [r.confidence for r in found] == pytest.approx([0.8, 0.7, 0.7, 0.8, 0.8, 0.8, 0.8])
    assert [r.sub_questions for r in found] == [2, 3, 2, 2, 1, 1, 2] and [r.decompose for r in found] == [True] * 4 + [False] * 2 + [True]


def test_output_types_have_bonuses(spark):
    texts = ("Which pros and cons, EIP-1 vs EIP-2?", "history of EIP-1 depend", "nothing at all", "timeline", "what does EIP-1 require", "a debate on fees")
    assert column(spark, S.output_type, *texts) == ["comparison", "dependency", "timeline", "timeline", "dependency", "argument_map"]


def test_strategies(spark):
    texts = ("Compare EIP-1 with EIP-2 and EIP-3", "history of EIP-1 from EIP-2", "EIP-1 EIP-2", "Compare fees with tips", "eip 1 and eip 2")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    found = {}
    for r in understanding.decomposed(rows, "id").collect():
        found.setdefault(r.id, []).append((r.strategy, r.entity))
    assert found[0] == [("comparison", "EIP-1"), ("comparison", "EIP-2")] and found[1] == [("timeline", "EIP-1"), ("timeline", "EIP-2")]
    assert found[2] == [("aggregation", "EIP-1"), ("aggregation", "EIP-2")] and found[3] == found[4] == [("explanation", None)]


def test_dates_of_every_spelling(spark):
    rows = spark.createDataFrame([(1, "2021/03/04 or 4 March 2021, 1850, 1850, q3 2020, 2020-01-02, May 5 2019, 12345")], "id int, text string")
    found = [r.found for r in located.dated(rows, "id").orderBy("pattern", "n").collect()]
    assert found == ["2020-01-02", "2021/03/04", "May 5 2019", "4 March 2021", "q3 2020", "2021", "2021", "1850", "1850", "2020", "2020", "2019"]


def test_text_quality_counts_words_of_sentences(spark):
    ten, eleven = " ".join(["words"] * 10) + ".", " ".join(["words"] * 11) + "."
    low, high = column(spark, S.text_quality, ten, eleven)
    assert (low, high) == pytest.approx((0.8, 1.0))  # "words." splits into a sentence and an empty rest: shares 0 and 0.5
    assert column(spark, S.text_quality, "", None) == [0.0, 0.0]


def test_encoding_has_thresholds(spark):
    marks = ["�" * 10, "�" * 11, "\x01" * 11, S.MOJIBAKE[0] * 5, S.MOJIBAKE[0] * 6, "�" * 50]
    assert column(spark, S.encoding_quality, *marks) == pytest.approx([1.0, 0.89, 0.89, 1.0, 0.88, 0.7])


def test_support_at_its_bounds(spark):
    rows = spark.createDataFrame([(0.7, 0.0), (0.71, 0.0), (0.4, 0.0), (0.41, 0.7), (0.9, 0.71), (None, 0.0)], "e double, c double")
    assert [r[0] for r in rows.select(S.support_level(F.col("e"), F.col("c"))).collect()] == ["partial", "strong", "weak", "partial", "contradiction", "none"]
    rows = spark.createDataFrame([(1, 9, 0, 10), (0, 8, 0, 10), (0, 7, 0, 10), (0, 5, 3, 10), (0, 4, 4, 10), (0, 4, 3, 10)], "c int, s int, p int, n int")
    assert [r[0] for r in rows.select(S.aggregate_support(F.col("c"), F.col("s"), F.col("p"), F.col("n"))).collect()] == ["contradiction", "strong", "partial", "partial", "partial", "weak"]


def test_gate_at_its_bounds(spark):
    names = list(decisions.THRESHOLDS)
    then = spark.createDataFrame([("v", 100.0, 100.0, None, 100.0, 0.0, 100.0, 50)], "version string, " + ", ".join(f"{n} double" for n in names) + ", eval_count int")
    now = spark.createDataFrame([("v", 98.0, 96.0, 1.0, 80.0, 5.0, 116.0, 19), ("w", *[1.0] * 6, 99)], then.schema)
    found = {r.version: r for r in decisions.gate(now, then, "version").collect()}
    assert (found["v"].regressions, found["v"].improvements, found["v"].warnings) == (["recall_at_k", "cost_per_query"], ["latency_p50_ms"], ["low_eval_count"])
    assert found["w"].passed and found["w"].warnings == ["no_baseline"]


def test_nothing_behind_an_overflow_is_taken(spark):
    rows = spark.createDataFrame([(1, 60), (2, 40), (3, 1)], "rank int, token_count int")
    assert [r["rank"] for r in retrieval.budget_prefix(rows, 100).orderBy("rank").collect()] == [1, 2]
    assert [r["rank"] for r in retrieval.budget_prefix(rows, 99).orderBy("rank").collect()] == [1]


def test_edge_confidence_counts_reasoning_by_length(spark):
    score = lambda n, s=0.0: spark.range(1).select(graph.edge_confidence(F.lit(s), F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0), F.lit(9), F.lit(n))).first()[0]
    assert score(25) == pytest.approx(0.4 * 0.75 + 0.25 * 0.5 + 0.2 * 0.5 + 0.15) and score(500) == score(50)


def test_transcripts_are_packed_greedily(spark):
    segment = lambda name, n: (name, None, " ".join(["w"] * (n - 1)))
    rows = spark.createDataFrame([(1, 7, [segment("A", 500), segment("B", 500), segment("C", 24), segment("D", 600)])], "id int, call_number int, segments array<struct<speaker:string,time:string,text:string>>")
    found = chunkers.transcripts(rows, "id").orderBy("chunk_index").collect()
    assert [(r.speaker, r.segments) for r in found] == [("A", 1), ("B", 1), ("C", 1), ("D", 0), ("D", 0)]
    assert found[3].content.endswith("[continued...]") and found[4].content.startswith("[...continued]")


def test_citations_of_few_claims(spark):
    rows = spark.createDataFrame([(10, 7, 1), (10, 7, 2), (10, 6, 0), (0, 0, 0)], "n int, c int, u int")
    assert [r[0] for r in rows.select(S.compliant(F.col("n"), F.col("c"), F.col("u"))).collect()] == [True, False, False, True]
    assert column(spark, S.needs_citation, "The validator set grows quickly", "It might be 21000 gas in all", "For example, EIP-1 is one of them", "gas", "Nothing special in this sentence") == [True, False, False, False, False]
    assert column(spark, claims.compound, "a and b, and c", "one fact", "that which; is") == [2, 0, 3]


def test_breakers_take_the_largest_gap(spark):
    decide = lambda *x: spark.range(1).select(decisions.breaker_decision(*map(F.lit, x)).alias("d")).first().d
    one = decide(0.1, False, 1, 0.4, True)
    assert (one.allow, one.reason, one.reasons, one.gap) == (False, "no_relevant_results", 5, 0.5)
    assert decide(0.4, True, 2, 0.5, False).allow
