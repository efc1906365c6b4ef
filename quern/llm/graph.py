"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces links so that components stay the same while their members draw towards the smallest id; when a
round changes nothing every member is linked to it. All steps are aggregations and joins on the executors, the driver
sees two numbers a round, and each round is written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, written


def components(links: DataFrame, most_rounds: int = 60, hub: int = 1000, most_hubs: int = 100_000) -> DataFrame:
    """(node, component): every node of links (a, b) but a component's smallest, with that smallest id.

    Links of nodes with more than ``hub`` of them (a number that grows with the links, so that there are at most ``most_hubs`` such nodes)
    don't go to one task: such nodes' smallest neighbours are broadcast.
    """
    a, b = links.columns[:2]
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    n, before = edges.count(), None
    for turn in range(most_rounds):
        limit = max(hub, 2 * n // most_hubs)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        ahead = _with_least(both.where("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ahead.where("u <> v").distinct()  # links of each node to smaller ones
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # links given may have hubs among the larger ends; behind the first round the larger end has few links
        split = turn == 0 and n > hub
        if split:
            large, low = written(large), written(low)
        small = _with_least(large, low, limit) if split else large.join(low, "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, last = written(out.where("u <> v").distinct()), edges
        discard(last, least, *((large, low) if split else ()))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        n, before = now.n, now
    raise RuntimeError("the components haven't settled")


def _with_least(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """rows (u, v) with the m of their u; those of nodes with more than limit links without a shuffle."""
    hubs = least.where(F.col("n") > limit).select("u", "m")
    if hubs.isEmpty():
        return rows.join(least, "u")
    few = rows.join(F.broadcast(hubs), "u")
    return few.unionByName(rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u"))
