"""Quantiles of groups of any size: exactly by refining histograms, or by a mergeable sketch.

The exact one narrows the range that holds a quantile: a pass counts the values of BINS equal parts of each range, within tasks first, and the part in which the wanted rank
lies, cut to the values it really has, is the next range. It ends where a range is one value; a group's rows never meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.scratch import discard, written

BINS = 1024
MOST_BROADCAST = 100_000


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[f"_g{j}"].eqNullSafe(b[f"_k{j}"]) for j in range(len(by))], F.lit(True))


def exact(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., one column for each of shares): the smallest value that a share of a group's values doesn't exceed, as SQL's discrete quantile.

    Null and NaN values don't count; a group without others has nulls, and without rows there are no groups.
    """
    given = rows.select(*[F.col(c).alias(f"_g{j}") for j, c in enumerate(by)], F.col(value).cast("double").alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    groups, keys = [f"_g{j}" for j in range(len(by))], [f"_k{j}" for j in range(len(by))]
    sized = given.groupBy(*groups).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(float(p)) * F.col("n")), F.lit(1)).alias("rank")) for name, p in shares.items()])).alias("w")
    first = sized.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], wanted, "lo", "hi")
    state = written(first.select(*keys, "w.name", "w.rank", F.lit(0).cast("bigint").alias("below"), "lo", "hi"))
    while not (open_ := state.where("lo < hi")).isEmpty():
        asked = F.broadcast(open_) if open_.count() <= MOST_BROADCAST else open_
        inside = given.join(asked, _same(given, open_, list(by))).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        # halves, as the difference of two doubles may be beyond them
        place = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        counted = inside.groupBy(*keys, "name", "rank", "below", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = W.partitionBy(*keys, "name").orderBy("bin")  # at most BINS rows
        summed = counted.withColumn("to", F.sum("c").over(upto) + F.col("below")).where(F.col("to") >= F.col("rank"))
        hit = summed.withColumn("r", F.row_number().over(upto)).where("r = 1").select(*keys, "name", "rank", (F.col("to") - F.col("c")).alias("below"), "lo", "hi")
        state, last = written(state.where("NOT (lo < hi) OR lo IS NULL").unionByName(hit)), state
        discard(last)
    wide = state.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in shares])
    return wide.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *shares)


def sketched(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = (), error: float = 1e-4) -> DataFrame:
    """As exact, from a mergeable sketch of each group: a value whose rank is off by at most error times the group's size."""
    found = F.percentile_approx(F.col(value).cast("double"), list(shares.values()), round(1 / error))
    return rows.groupBy(*by).agg(found.alias("_q")).select(*by, *[F.col("_q")[j].alias(name) for j, name in enumerate(shares)])
