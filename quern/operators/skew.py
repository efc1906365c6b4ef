"""Self-joins of groups of any size: a small group is gathered once, a large one's rows are dealt to blocks and each pair of blocks meets in a task of its own."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.scratch import written

MOST_BROADCAST = 100_000  # keys with more than a block of rows
MOST_ROWS = 250_000  # rows of a task, on average


def pairs_within(rows: DataFrame, key: str, block: int = 2000) -> DataFrame:
    """Every ordered pair of rows of a key as (key, a_<column>, b_<column>); rows must differ.

    A key of up to block rows is gathered by one task, which pairs it; a larger one of n blocks goes to n * n tasks, each with a block of either side. Only the
    larger keys have a size to look up, at most rows / block of them: they are broadcast if they are few, so that no hot key is gathered to learn its own size.
    The number of tasks grows with the rows, so that the memory of one doesn't. rows are read several times: costly ones should be written.
    """
    columns = [c for c in rows.columns if c != key]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / MOST_ROWS))
    large = written(rows.groupBy(key).count().where(F.col("count") > block).select(F.col(key).alias("_key"), F.ceil(F.col("count") / block).cast("int").alias("_n")))
    n = large.count()
    large = F.broadcast(large) if n <= MOST_BROADCAST else large
    small = rows.join(large, rows[key] == large["_key"], "left_anti") if n else rows
    sides = small.where(F.col(key).isNotNull()).repartition(tasks, key).groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_x"))
    each = sides.select(key, F.explode("_x").alias("_a"), "_x").select(key, "_a", F.explode("_x").alias("_b"))
    within = each.select(key, *[F.col(f"{side}.{c}").alias(f"{side[1:]}_{c}") for side in ("_a", "_b") for c in columns])
    if not n:
        return within
    dealt = rows.join(large, rows[key] == large["_key"]).drop("_key").withColumn("_own", F.pmod(F.xxhash64(*columns), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = dealt.select(key, F.col("_own").alias("_i"), other.alias("_j"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = dealt.select(key, other.alias("_i"), F.col("_own").alias("_j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return within.unionByName(left.join(right, [key, "_i", "_j"]).drop("_i", "_j"))
