"""State machines over blocks against a plain loop: hot keys over many blocks, null keys and operations, any partitions."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import automata, decisions, experiments


def plain_breaker(ops, most=3):
    state, failures, trips, out = "closed", 0, 0, []
    for op in ops:
        if op == "reset":
            state, failures = "closed", 0
        elif op == "half_open":
            state = "half_open" if state == "open" else state
        elif op == "success":
            state, failures = "closed" if state == "half_open" else state, 0
        elif op == "pass" and state != "open":
            failures = 0
        elif op == "failure" or (op == "fail" and state != "open"):
            failures += 1
            if failures >= most:
                state, trips = "open", trips + 1
        out.append((state, failures, trips))
    return out


@pytest.mark.parametrize(("block", "parts"), [(4096, 4), (7, 1), (1, 3), (50, 9)])
def test_long_logs_equal_a_loop(spark, block, parts):
    rng = random.Random(block)
    ops = ["pass", "fail", "fail", "failure", "success", "half_open", "reset", None, "odd"]
    rows = [(k, i, rng.choice(ops[:6] if k == 1 else ops)) for k in (1, 2, 3, None) for i in range({1: 400, 2: 60, 3: 1, None: 30}[k])]
    df = spark.createDataFrame(rows, "user bigint, at int, op string").repartition(parts)
    got = {(r.user, r.at): (r.state, r.failures, r.trips) for r in decisions.breaker_states(df, "user", ["at"], block=block).collect()}
    assert len(got) == len(rows)
    for k in (1, 2, 3, None):
        own = [r for r in rows if r[0] == k]
        assert [got[k, r[1]] for r in own] == plain_breaker([r[2] for r in own])


def test_one_user_has_all_events(spark, sf_dir):
    """The hot key's blocks are many tasks' work, with the rows of a plain fold."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user_id", F.lit(7)).withColumn("op", F.when(F.col("event_id") % 5 == 0, "success").when(F.col("event_id") % 7 == 0, "half_open").otherwise("fail"))
    got = {r.event_id: (r.state, r.failures, r.trips) for r in decisions.breaker_states(events, "user_id", ["event_id"], block=64).collect()}
    rows = events.orderBy("event_id").collect()
    assert [got[r.event_id] for r in rows] == plain_breaker([r.op for r in rows])
    assert decisions.breaker_states(events.limit(0), "user_id", ["event_id"]).count() == 0


def test_latches_of_null_outcomes(spark):
    rows = [(1, i, f) for i, f in enumerate([True, True, None, True, False, True])]
    got = experiments.breaker(spark.createDataFrame(rows, "k int, i int, f boolean"), "k", ["i"], F.col("f"), block=2).orderBy("i").collect()
    assert [(r.failures, r.open) for r in got] == [(1, False), (2, False), (2, False), (3, True), (0, True), (1, True)]


def test_effects_compose():
    rng = random.Random(1)
    machine = automata.breaker()
    for _ in range(50):
        parts = [rng.choices(machine.operations, k=rng.randint(0, 9)) for _ in range(4)]
        begins = machine.chained([machine.effect(p) for p in parts])
        whole = [(0, [0, 0]), *machine.run([op for p in parts for op in p], 0, [0, 0])]
        at = 0
        for p, (s, *counts) in zip(parts, begins, strict=True):
            assert whole[at] == (s, counts)
            at += len(p)
