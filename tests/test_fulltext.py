"""The positional index against the scan, with blocks of a few documents and odd texts."""

import random

import pytest

from quern.operators import fulltext


@pytest.fixture
def texts():
    rng = random.Random(5)
    rows = [(f"k{i}", " ".join(rng.choices(["to", "be", "or", "not", "that", "is", "the", "question"], weights=[8, 6, 3, 3, 2, 2, 9, 1], k=rng.choice([0, 1, 5, 60])))) for i in range(150)]
    return [*rows, ("none", None), ("empty", ""), ("case", "To BE, or: not to be!"), (None, "to be")]


def test_searches_equal_the_scan(spark, tmp_path, monkeypatch, texts):
    monkeypatch.setattr(fulltext, "BLOCK_BITS", 3)
    df = spark.createDataFrame(texts, "chunk_id string, content string").repartition(3)
    path = f"{tmp_path}/index"
    fulltext.build(df, path)
    words = {k: [w.strip(",.:!").lower() for w in (t or "").split()] for k, t in texts}
    for query in ("to be", "be or not to be", "the", "question the question", "never seen", "to never"):
        q = query.split()
        expected = {k: n for k, w in words.items() if (n := sum(w[i : i + len(q)] == q for i in range(len(w))))}
        assert {r.key: r.n for r in fulltext.phrase(spark, path, query).collect()} == expected, query
        both = {k for k, w in words.items() if set(q) <= set(w)}
        assert {r.key for r in fulltext.all_terms(spark, path, query).collect()} == both
        every = fulltext.bm25_topk(spark, path, query, k=1000).collect()
        assert {r.key for r in every} == both
        for k, first in ((3, 1), (10, 2), (40, 8)):
            got = fulltext.bm25_topk(spark, path, query, k=k, first_blocks=first).collect()
            assert [(r.key, r.score) for r in got] == [(r.key, r.score) for r in every][:k]


def test_an_index_of_nothing(spark, tmp_path):
    fulltext.build(spark.createDataFrame([], "chunk_id string, content string"), f"{tmp_path}/index")
    assert fulltext.bm25_topk(spark, f"{tmp_path}/index", "to be").count() == fulltext.phrase(spark, f"{tmp_path}/index", "to be").count() == 0


def test_a_query_reads_its_buckets_only(spark, tmp_path, texts):
    path = f"{tmp_path}/index"
    fulltext.build(spark.createDataFrame(texts, "chunk_id string, content string"), path)
    plan = fulltext.blocks(spark, path, ["to"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,to)]" in plan or "In(term" in plan or "EqualTo(term,to)" in plan


def test_no_word_is_shuffled(spark, tmp_path, texts):
    """Each place of each word was shuffled, and gathered twice."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    df = spark.createDataFrame(texts, "chunk_id string, content string")
    before = sum(s.shuffleWriteBytes() for s in stages())
    fulltext.build(df, f"{tmp_path}/index")
    assert sum(s.shuffleWriteBytes() for s in stages()) == before
