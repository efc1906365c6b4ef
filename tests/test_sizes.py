"""What keeps queries in proportion to their tables."""

import pytest

from quern.operators import graph, located, skew
from quern.plans import load

CATALOG = load()


@pytest.mark.parametrize("name", ["src_openapi", "src_openrpc", "src_rpc_schemas"])
def test_costly_rows_of_small_files_are_spread(spark, sf_dir, name):
    """One file of few bytes was read, and so parsed, by one task."""
    assert CATALOG.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_yaml_is_read_by_libyaml(monkeypatch):
    import yaml

    from quern.sources.parsing import _loaded

    used = []
    monkeypatch.setattr(yaml, "CSafeLoader", lambda stream: used.append(stream) or yaml.SafeLoader(stream), raising=False)
    assert _loaded("a: {b: [1, x]}") == {"a": {"b": [1, "x"]}} and used
    monkeypatch.undo()
    assert _loaded("a: [") is None and _loaded(None) is None


def test_short_python_files_stay_short_whatever_their_number(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    spark.range(99_990, 100_020).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    name = "src_python_documentation"
    assert sorted(map(tuple, CATALOG.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(c.execute(CATALOG.ORACLES[name]).fetchall())


def test_generated_rows_are_handed_on_in_small_batches(spark):
    """A batch of rows was unpacked whole, and all it gave was held until its end."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    rows = spark.range(0, 50, 1, 1).selectExpr("id", "repeat('ab ', 1000) AS text")
    found = located.generated(rows, "id", ["text"], "n int, part string", lambda t: enumerate(t.split()))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= located.MOST_BATCH
    assert found.count() == 50_000
    assert found.groupBy("id").count().where("count = 1000").count() == 50


def test_tasks_of_a_self_join_grow_with_its_rows(spark, monkeypatch):
    """Rows were sorted for two sides by as few tasks as their compressed bytes gave."""
    monkeypatch.setattr(skew, "MOST_ROWS", 50)
    rows = spark.range(2000).selectExpr("id div 4 AS k", "id AS v")
    found = skew.pairs_within(rows, "k")
    assert found.rdd.getNumPartitions() == 40 and found.count() == 2000 * 4


def test_small_and_large_groups_are_paired_alike(spark):
    rows = [(None, 1), (None, 2), *[(1, v) for v in range(7)], *[(2, v) for v in range(3)], (3, 9)]
    expected = sorted((k, a, b) for k, a in rows for other, b in rows if k is not None and k == other)
    for block in (2, 3, 100):
        got = skew.pairs_within(spark.createDataFrame(rows, "k int, v int"), "k", block)
        assert got.columns == ["k", "a_v", "b_v"] and sorted(map(tuple, got.collect())) == expected
    twice = spark.createDataFrame([*rows, (1, 0)], "k int, v int")
    assert {tuple(r) for r in graph.co_mentions(twice, "k", "v").where("shared > 1").collect()} == {(0, 1, 2), (0, 2, 2), (1, 2, 2)}


def test_documents_hand_on_only_shingles_of_items(spark, tmp_path):
    """Every distinct shingle of the corpus was shuffled to meet those of a few items."""
    from quern.plans import dedup

    items = [(1, "a b c d"), (2, "X y"), (3, ""), (4, None), (5, "no such words here")]
    docs = [(1, "z a B c z"), (2, None), (3, ""), (4, "x Y"), (5, "x y z"), (6, "a b c a b c")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = CATALOG.QUERIES["dup_benchmark_overlap"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [s" in plan and "LeftSemi, BuildRight" in plan
    expected = {(1, 0.5), (2, 1.0), (5, 0.0)}
    assert {tuple(r) for r in found.collect()} == expected
    assert {tuple(r) for r in dedup._contaminated(spark, str(tmp_path), most=0).collect()} == expected
