"""Agent control over action logs: attempts, trends, repeated queries, caps, term coverage and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.scoring import STOP_WORDS


def attempts(log: DataFrame, key: str, succeeded: Column, query: str) -> DataFrame:
    n = F.count("*")
    return log.groupBy(key).agg(n.alias("attempts"), F.count_if(succeeded).alias("successes"), F.count_if(~succeeded).alias("failures"), F.round(F.count_if(succeeded) / n, 6).alias("rate"), F.countDistinct(query).alias("queries"))


def trend(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """The mean of the last n values; nulls drop out after the cut."""
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_n") <= n)
    return last.groupBy(key).agg(F.count(value).alias("points"), F.round(F.avg(value), 6).alias("mean"))


def last_failed(log: DataFrame, key: str, order: list[str], failed: Column, n: int) -> DataFrame:
    """Adds stuck: whether this and the n - 1 actions before it failed."""
    upto = W.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return log.withColumn("stuck", F.sum(failed.cast("int")).over(upto) == n)


def repeated_queries(log: DataFrame, key: str, order: str, query: str, threshold: float = 0.8) -> DataFrame:
    """(key, order) of queries whose word set is more similar than threshold to that of an earlier one of the same key.

    A key's log is a session, whose length bounds the pairs.
    """
    words = log.select(key, order, F.array_distinct(T.tokens(F.col(query))).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{order}") < F.col(f"a.{order}")))
    return pairs.where(T.jaccard(F.col("a.w"), F.col("b.w")) > threshold).select(f"a.{key}", f"a.{order}").distinct()


def summary(runs: DataFrame, phase: str, succeeded: str, value: str) -> DataFrame:
    """Per phase and over all: runs, failures, and the mean value of those that didn't fail."""
    rolled = runs.rollup(phase).agg(F.count("*").alias("runs"), F.count_if(~F.col(succeeded)).alias("failures"), F.round(F.avg(F.when(F.col(succeeded), F.col(value))), 4).alias("mean"))
    return rolled.select(F.coalesce(phase, F.lit("all")).alias("phase"), "runs", "failures", "mean")


def capped(log: DataFrame, key: str, order: list[str], amount: str, limit: int) -> DataFrame:
    """Actions within a hard cap, with the amount used so far."""
    upto = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("used", F.sum(amount).over(upto)).where(F.col("used") <= limit)


def term_coverage(queries: DataFrame, hits: DataFrame, key: str, query: str, hit: str) -> DataFrame:
    """The share of a query's words, without stop words, that occur in some hit."""
    split = F.filter(F.split(F.lower(query), r"\s+"), lambda w: (w != "") & ~w.isin(list(STOP_WORDS)))
    terms = queries.select(key, F.explode(F.array_distinct(split)).alias("term"))
    low = hits.select(key, F.lower(hit).alias("_h"))
    found = terms.join(low, key, "left").groupBy(key, "term").agg(F.coalesce(F.bool_or(F.contains("_h", "term")), F.lit(False)).alias("found"))
    return found.groupBy(key).agg(F.round(F.count_if(F.col("found")) / F.count("*"), 6).alias("coverage"))
