"""The substring join against brute force, and groups that once lay behind a cap."""

import random

from pyspark.sql import functions as F

from quern.operators import augmented, retrieval, substrings


def test_every_name_in_every_text(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab é😀.\n") for _ in range(n))
    names = [word(rng.choice([1, 2, 3, 4, 5, 9])) for _ in range(60)] + ["", None, "never there", "a.*", "ab" * 20]
    texts = [(i % 25, word(rng.choice([0, 1, 3, 40]))) for i in range(40)] + [(90, None), (91, "ab" * 400), (92, "x a.* y")]
    expected = {(k, n) for k, t in texts for n in names if n and t and n in t}
    got = substrings.containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(texts, "key int, text string"))
    rows = [tuple(r) for r in got.select("key", "name").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    none = spark.createDataFrame([], "name string")
    assert substrings.containing(none, spark.createDataFrame(texts, "key int, text string")).count() == 0


def test_a_text_meets_only_names_whose_head_it_has(spark, monkeypatch):
    """Every q-gram of a text that any name had was stored, and every name met all texts that hold one of its q-grams."""
    stored = []
    monkeypatch.setattr(substrings, "written", lambda df: (lambda out: stored.append(out.count()) or out)(df.localCheckpoint()))
    names = spark.range(1000, 3000).select(F.concat(F.lit("T"), "id").alias("name"))
    texts = spark.range(20).select(F.col("id").alias("key"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1000), F.lit(1100)), lambda n: n.cast("string")), F.lit("T2999x")).alias("text"))
    assert {tuple(r) for r in substrings.containing(names, texts).select("key", "name").collect()} == {(i, "T2999") for i in range(20)}
    assert max(stored) <= 200


def test_names_are_sought_in_passes_and_parts_leave_in_bounded_sets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_HEADS", 2)
    monkeypatch.setattr(substrings, "MOST_PARTS", 2)
    test_every_name_in_every_text(spark)


def test_a_large_group_hides_no_small_one(spark):
    """The k best of each related group count, however many rows another group has."""
    many = spark.range(120_000).select(F.col("id").alias("chunk_id"), F.lit(1).cast("bigint").alias("number"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    few = spark.createDataFrame([(200_000, 2, [0.5, 0.5]), (200_001, 2, [0.4, 0.6]), (200_002, 9, [1.0, 0.1])], "chunk_id bigint, number bigint, embedding array<double>")
    edges = spark.createDataFrame([(9, 1, "REQUIRES"), (9, 2, "REQUIRES")], "src bigint, dst bigint, type string")
    chunks = many.unionByName(few)
    got = augmented.graph_augmented(chunks, edges, [1.0, 0.1], [9], k=2, per=2).collect()
    assert {200_000, 200_001} <= {r.chunk_id for r in got}
    assert {200_000, 200_001} <= {r.chunk_id for r in augmented.agent_graph(chunks, edges, [1.0, 0.1], [9], limit=2).collect()}
    assert retrieval.vector_topk(chunks, []).count() == 0
