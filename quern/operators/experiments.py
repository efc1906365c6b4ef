"""Experiments, calibration, regression gates, breakers and budgets over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.automata import latch, scanned
from quern.operators.isotonic import fit

# fixed values: thresholds of relative change by metric; lower is better for the last three
THRESHOLDS = {"accuracy": 0.02, "recall": 0.03, "coverage": 0.05, "latency_p50": 0.20, "latency_p99": 0.30, "cost": 0.15}
LOWER_IS_BETTER = ("latency_p50", "latency_p99", "cost")


def analysis(results: DataFrame) -> DataFrame:
    """Per variant: trials, quality, latency, cost and feedback; nulls don't count."""
    stats = [f(c).alias(f"{c}_{n}") for c in ("quality", "latency") for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("least", F.min), ("most", F.max), ("count", F.count))]
    return results.groupBy("variant").agg(F.count("*").alias("trials"), *stats, F.round(F.sum("cost"), 4).alias("cost_total"), F.count_if(F.col("feedback") > 0).alias("positive"), F.count_if(F.col("feedback") < 0).alias("negative"))


def winner(analysed: DataFrame, least: int = 30) -> DataFrame:
    """The variant of the best mean quality among those with enough trials, and 100 times the gap to the next by its own mean (at most 99, 50 if alone)."""
    order = W.orderBy(F.desc("quality_mean"), "variant")  # a row per variant
    best = analysed.where(F.col("trials") >= least).withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("quality_mean").over(order))
    rest = F.coalesce((F.col("quality_mean") - F.col("next")) / F.nullif(F.abs("quality_mean"), F.lit(0.0)), F.lit(0.0))
    gap = F.when(F.col("next").isNull(), 50.0).otherwise(F.least(F.round(100 * rest, 4), F.lit(99.0)))
    return best.where("n = 1").select("variant", gap.alias("confidence"))


def reliability(rows: DataFrame, predicted: str = "predicted", actual: str = "actual", bins: int = 10, *by: str) -> DataFrame:
    """Equal bins of the prediction, the last one closed; empty bins have no row."""
    at = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.round(F.avg(predicted), 6).alias("predicted"), F.round(F.avg(actual), 6).alias("actual"))


def calibration_error(curve: DataFrame, *by: str) -> DataFrame:
    return curve.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))) / F.sum("n"), 6).alias("ece"))


def isotonic(points: DataFrame, predicted: str = "predicted", actual: str = "actual", least: int = 20) -> DataFrame:
    """(boundary, value) of the exact isotonic fit; no rows with fewer than least points."""
    return fit(points, predicted, actual, least=least)


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, change, status) of two one-row snapshots: regression beyond the metric's threshold, improvement beyond half of it."""
    names = list(THRESHOLDS)
    long = lambda t, v: t.unpivot([], names, "metric", v)
    table = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])
    both = long(current, "now").join(long(baseline, "then"), "metric").where("now IS NOT NULL AND then IS NOT NULL AND then <> 0")
    change = (F.col("now") - F.col("then")) / F.abs("then")
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), change).otherwise(-change)
    limit = table[F.col("metric")]
    return both.select("metric", F.round(change, 6).alias("change"), F.when(worse > limit, "regression").when(worse < -limit / 2, "improvement").otherwise("stable").alias("status"))


def breaker(actions: DataFrame, key: str, order: list[str], failed: Column, limit: int = 3, block: int = 4096) -> DataFrame:
    """Adds failures (the current run of consecutive ones) and open (latched once a run reached the limit); a null outcome changes nothing. A key's actions may span many tasks."""
    log = actions.withColumn("_op", F.when(failed, "fail").when(~failed, "ok"))
    out = scanned(log, key, order, "_op", latch(limit), ["failures"], state="open", block=block)
    return out.withColumn("open", F.col("open") == "True").drop("_op")


def allocate(questions: int, used_chunks: int = 0, used_tokens: int = 0, each: int = 5, chunks: int = 20, tokens: int = 8000) -> tuple[int, int, bool]:
    """A sub-question's fair share: chunks, tokens, and whether the totals limit it."""
    left = max(1, questions)
    share = max(1, min(each, (chunks - used_chunks) // left))
    return share, max(500, (tokens - used_tokens) // left), share < each


def winner_by(results: DataFrame, metric: str, least: int = 30) -> DataFrame:
    """(metric, variant, score, confidence): the best mean of a metric (the largest quality, the least latency or cost) among variants with enough trials.

    The confidence is 100 times the gap to the next one by the best mean, at most 99, and 50 if there is no other; variants without a value of the metric don't count.
    """
    if metric not in ("quality", "latency", "cost"):
        raise ValueError(f"unknown metric: {metric}")
    means = results.groupBy("variant").agg(F.count("*").alias("trials"), F.round(F.avg(metric), 6).alias("score")).where((F.col("trials") >= least) & F.col("score").isNotNull())
    order = W.orderBy(F.desc("score") if metric == "quality" else F.asc("score"), "variant")  # a row per variant
    best = means.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("n = 1")
    gap = F.coalesce(F.abs(F.col("score") - F.col("next")) / F.nullif(F.abs("score"), F.lit(0.0)), F.lit(0.0))
    return best.select(F.lit(metric).alias("metric"), "variant", "score", F.when(F.col("next").isNull(), 50.0).otherwise(F.least(F.round(100 * gap, 4), F.lit(99.0))).alias("confidence"))
