"""State machines over long logs: a key's log may span any number of tasks.

A machine has few control states and some counters; an operation moves the control state and, depending on it, keeps or clears each counter and adds to it. So the effect of a run
of operations is a small table: for each control state that it may begin in, the one it ends in, and for each counter whether the old value is kept and what is added.
Effects compose, and that is how one key is scanned in parallel: the log is sorted by key and order over the cluster and cut into blocks; each block of a key that has
several becomes its effect, a key's effects (one row a block) are chained to the state that each block begins in, and then every block runs by itself.

Rows whose operation is null, or none of the machine's, change nothing. Null keys are one key. Rows that are equal in key and order may be taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from quern.scratch import written

Step = Callable[[Hashable, str], tuple[Hashable, list[tuple[bool, int]]]]


class Machine:
    """Built from its first state and a pure step: (state, operation) to the next state and a pair (kept, added) for each counter."""

    def __init__(self, first: Hashable, operations: list[str], counters: int, step: Step):
        self.operations, self.counters = operations, counters
        self.states, self.moves = [first], {op: [] for op in operations}
        at = {first: 0}
        for state in self.states:  # grows while it is read
            for op in operations:
                then, effects = step(state, op)
                if then not in at:
                    at[then] = len(self.states)
                    self.states.append(then)
                self.moves[op].append((at[then], [(int(kept), added) for kept, added in effects]))

    def run(self, operations: list[str | None], state: int, counts: list[int]) -> Iterator[tuple[int, list[int]]]:
        """The state and the counters behind each operation."""
        for op in operations:
            if op in self.moves:
                state, effects = self.moves[op][state]
                counts = [kept * c + added for (kept, added), c in zip(effects, counts, strict=True)]
            yield state, counts

    def effect(self, operations: list[str | None]) -> list[list[int]]:
        """For each state at the beginning: the state at the end, then kept and added of each counter."""
        out = []
        for begin in range(len(self.states)):
            state, kept, added = begin, [1] * self.counters, [0] * self.counters
            for op in operations:
                if op in self.moves:
                    state, effects = self.moves[op][state]
                    for j, (k, a) in enumerate(effects):
                        kept[j], added[j] = kept[j] * k, added[j] * k + a
            out.append([state, *kept, *added])
        return out

    def chained(self, effects: list[list[list[int]]]) -> list[list[int]]:
        """The state and the counters that each of a key's blocks begins with."""
        now, out = [0] * (1 + self.counters), []
        n = self.counters
        for table in effects:
            out.append(now)
            state, *rest = table[now[0]]
            now = [state, *[k * c + a for k, c, a in zip(rest[:n], now[1:], rest[n:], strict=True)]]
        return out


def _blocks(rows: DataFrame, key: str, order: list[str], block: int) -> DataFrame:
    """rows with _block, which ascends in the order of key and order, whatever the keys; written."""
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_task", F.spark_partition_id().cast("bigint"))
    schema = StructType(list(rows.schema)).add("_block", LongType())
    target = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if batch.num_rows:
                numbers = (np.arange(done, done + batch.num_rows) // block) + (batch.column("_task")[0].as_py() << 32)
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in target.names[:-1]], pa.array(numbers)], schema=target)

    return written(placed.mapInArrow(number, schema))


def _runs(group: pa.Table, key: str, order: list[str]) -> tuple[pa.Table, list[tuple[int, int]]]:
    """The rows of a block in order, and where each key's begin and end."""
    group = group.take(pc.sort_indices(group, sort_keys=[(c, "ascending") for c in (key, *order)], null_placement="at_start"))
    keys = group.column(key).to_pylist()
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    return group, list(pairwise(cuts))


def scanned(log: DataFrame, key: str, order: list[str], operation: str, machine: Machine, named: list[str], state: str = "state", block: int = 4096) -> DataFrame:
    """log with the machine's state (as text) and counters (named, bigint) behind each row."""
    names = log.columns
    rows = _blocks(log, key, order, block)
    effects = StructType.fromDDL(f"_key {rows.schema[key].dataType.simpleString()}, _block bigint, _leads boolean, _effect array<bigint>")
    entering = [f"_at{j}" for j in range(machine.counters + 1)]
    begin = StructType.fromDDL("_block bigint, _leads boolean, " + ", ".join(f"{c} bigint" for c in entering))

    def effect(group: pa.Table) -> pa.Table:
        """Of the runs that may go on beyond the block: its first and its last one."""
        group, runs = _runs(group, key, order)
        found = [(a, [x for row in machine.effect(group.column(operation).slice(a, b - a).to_pylist()) for x in row]) for a, b in dict.fromkeys((runs[0], runs[-1]))]
        at = pa.array([a for a, _ in found])
        return pa.table([group.column(key).take(at), group.column("_block").take(at), [a == 0 for a, _ in found], [e for _, e in found]], schema=to_arrow_schema(effects))

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("_block")
        tables = [np.array(x.as_py()).reshape(len(machine.states), -1).tolist() for x in group.column("_effect")]
        return pa.table([group.column("_block"), group.column("_leads"), *map(list, zip(*machine.chained(tables), strict=True))], schema=to_arrow_schema(begin))

    ends = written(rows.groupBy("_block").applyInArrow(effect, effects))
    begins = written(ends.groupBy("_key").applyInArrow(chain, begin)).where("_leads").drop("_leads")
    schema = StructType(list(log.schema)).add(state, StringType())
    for c in named:
        schema = schema.add(c, LongType())

    def follow(group: pa.Table) -> pa.Table:
        group, runs = _runs(group, key, order)
        states, counts = [], [[] for _ in named]
        for a, b in runs:
            at = [group.column(c)[0].as_py() if a == 0 else 0 for c in entering]
            for s, values in machine.run(group.column(operation).slice(a, b - a).to_pylist(), at[0], at[1:]):
                states.append(str(machine.states[s][0]))
                for out, v in zip(counts, values, strict=True):
                    out.append(v)
        return pa.table([*[group.column(c) for c in names], states, *counts], schema=to_arrow_schema(schema))

    return rows.join(begins, "_block").groupBy("_block").applyInArrow(follow, schema)


def breaker(most: int = 3) -> Machine:
    """A circuit breaker (state, failures up to most) with the counters failures and trips; operations pass and fail (checks), success, failure, half_open and reset."""

    def step(now: tuple[str, int], op: str) -> tuple[tuple[str, int], list[tuple[bool, int]]]:
        state, failures = now
        if op == "reset":
            return ("closed", 0), [(False, 0), (True, 0)]
        if op == "half_open":
            return ("half_open" if state == "open" else state, failures), [(True, 0), (True, 0)]
        if op == "success":
            return ("closed" if state == "half_open" else state, 0), [(False, 0), (True, 0)]
        if state == "open" and op != "failure":  # an open breaker doesn't check
            return now, [(True, 0), (True, 0)]
        if op == "pass":
            return (state, 0), [(False, 0), (True, 0)]
        trips = failures + 1 >= most
        return ("open" if trips else state, min(failures + 1, most)), [(True, 1), (True, int(trips))]

    return Machine(("closed", 0), ["pass", "fail", "success", "failure", "half_open", "reset"], 2, step)


def latch(limit: int = 3) -> Machine:
    """Runs of consecutive failures (operations fail and ok); open once a run reached the limit."""

    def step(now: tuple[bool, int], op: str) -> tuple[tuple[bool, int], list[tuple[bool, int]]]:
        run = min(now[1] + 1, limit) if op == "fail" else 0
        return (now[0] or run >= limit, run), [(True, 1) if op == "fail" else (False, 0)]

    return Machine((False, 0), ["fail", "ok"], 1, step)
