"""Costly expressions are evaluated once a row, not once for each use of their result."""

import re

from quern.operators import generation, understanding
from quern.plans import chunkers


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_split_once_a_text(spark, sf_dir):
    plan = _plan(chunkers._flagged(spark, sf_dir))
    assert plan.count("split(text") == 1


def test_patterns_of_triggers_are_matched_once(spark):
    rows = spark.createDataFrame([(1, "Compare EIP-1 and EIP-2 in depth", 0.5), (2, None, None), (3, "x", 0.9)], "k int, q string, confidence double")
    df = understanding.triggers(rows, "k")
    assert _plan(df).count("roadmap") == 1
    assert [(r.n, r.priority) for r in df.where("k = 1").orderBy("n").collect()][0] == (0, 19)
    assert df.where("k = 3").count() == 0


def test_a_reply_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"sub_questions": [{"text": "a"}], "synthesis_strategy": "Timeline"}', "q"), (2, "broken", "q"), (3, None, "q")], "k int, r string, q string")
    df = generation.decomposed_reply(rows, "k", "r", "q")
    assert len(re.findall(r"from_json\(|jsontostructs\(", _plan(df), re.I)) == 1
    assert sorted((r.k, r.text, r.strategy) for r in df.collect()) == [(1, "a", "timeline"), (2, "q", "explanation"), (3, "q", "explanation")]
