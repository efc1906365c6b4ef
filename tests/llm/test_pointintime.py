"""Point-in-time join against brute force: blocks of a few rows, versions over many blocks, hot instants, nulls and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm.pointintime import Roots, point_in_time

VERSION = "source string, event bigint, arrival bigint, expiry bigint, doc_id bigint, name string"


def brute(versions, source, t):
    usable = [v for v in versions if None not in v[:4] and source is not None and t is not None and v[0] == source and v[1] <= t and v[2] <= t < v[3]]
    return max(((v[1], -v[2], v[4] is not None, v[4] or 0, v[3], v[5] or "") for v in usable), default=None)


def checked(spark, versions, asks, **more):
    got = point_in_time(spark.createDataFrame(versions, VERSION), spark.createDataFrame(asks, "source string, t bigint, `a.b` int, version string"), features=("name",), into="found", **more).collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == sorted(asks, key=repr)
    for r in got:
        best = brute(versions, r[0], r[1])
        found = r["found"]
        assert (found is None) == (best is None), r
        if best:
            assert (found.event, -found.arrival, found.id if best[2] else None, found.expiry, found.features.name or "") == (*best[:2], best[3] if best[2] else None, *best[4:]), r


@pytest.mark.parametrize("block", [3, 40, 50_000])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    versions = []
    for i in range(600):
        event = rng.randrange(200)
        arrival = event + rng.randrange(-20, 30)
        lasts = rng.choice([0, 3, 30, 30, 400, 10_000])
        versions.append((rng.choice("aaaaab"), event, arrival, event + lasts, i, f"n{i % 7}"))
    versions += [("a", 50, 50, 60 + j, 1000 + j, "same instant") for j in range(80)]  # all start at once
    versions += [("c", 0, 0, 1_000_000, 2000, "always"), *[("c", e, e, e + 1, 3000 + e, "short") for e in range(0, 400, 2)]]  # one version covers all blocks
    versions += versions[:50]  # repeated rows
    versions += [(None, 1, 1, 9, 1, "x"), ("a", None, 1, 9, 1, "x"), ("a", 1, None, 9, 1, "x"), ("a", 1, 1, None, 1, "x"), ("d", 5, 5, 9, None, None), ("d", 5, 5, 9, 4, None), ("e", 9, 9, 3, 1, "never")]
    asks = [(rng.choice("abcdez"), rng.randrange(-30, 450), 1, "own") for _ in range(300)] + [("a", 70, 2, "own")] * 40 + [(None, 5, 0, None), ("a", None, 0, None), ("d", 6, 0, None)]
    checked(spark, versions, asks, block=block)


def test_ties_go_by_arrival_id_and_expiry(spark):
    versions = [("a", 5, 4, 50, 1, "early"), ("a", 5, 5, 50, 9, "late"), ("b", 5, 5, 50, 1, "x"), ("b", 5, 5, 50, 2, "y"), ("c", 5, 5, 50, 1, "x"), ("c", 5, 5, 60, 1, "longer"), ("d", 5, 5, 50, 1, "x"), ("d", 5, 5, 50, 1, "y")]
    got = point_in_time(spark.createDataFrame(versions, VERSION), spark.createDataFrame([(s, 20) for s in "abcd"], "source string, t bigint"), features=("name",)).collect()
    assert {r.source: r.version.features.name for r in got} == {"a": "early", "b": "y", "c": "longer", "d": "y"}


def test_empty_sides(spark):
    versions, asks = spark.createDataFrame([("a", 1, 1, 9, 1, "x")], VERSION), spark.createDataFrame([("a", 5)], "source string, t bigint")
    assert point_in_time(versions, asks.limit(0)).count() == 0
    assert [r.version for r in point_in_time(versions.limit(0), asks).collect()] == [None]


def test_other_key_types_and_partitions(spark):
    versions = spark.range(400).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("event"), F.col("id").alias("arrival"), (F.col("id") + 100).alias("expiry"), F.col("id").cast("string").alias("name"))
    asks = spark.range(600).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("t"))
    got = point_in_time(versions.repartition(7), asks, key="k", ident="name", ask_key="k", block=16).collect()
    best = lambda t: max((i for i in range(400) if i % 3 == t % 3 and i <= t < i + 100), default=None)
    assert {r.t: r.version and int(r.version.id) for r in got} == {t: best(t) for t in range(600)}


def test_older_roots_stay():
    rng = random.Random(3)
    for size in (1, 2, 9, 64):
        tree, roots, sets = Roots(size), [0], [frozenset()]
        for _ in range(200):
            j, rank = rng.randrange(len(roots)), rng.randrange(size)
            on = rng.random() < 0.6
            roots.append(tree.edit(roots[j], rank, on))
            sets.append(sets[j] | {rank} if on else sets[j] - {rank})
        assert [tree.maximum(r) for r in roots] == [max(s, default=-1) for s in sets]
