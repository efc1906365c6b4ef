"""Exact quantiles by refined histograms and the sketch's stated error."""

import math

import numpy as np

from quern.operators import quantiles


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3000), "b": np.exp(rng.normal(size=800) * 30), "c": np.full(500, 7.0), None: rng.integers(0, 5, 400).astype(float), "d": np.array([1e308, -1e308, 0.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"least": 0.0, "p50": 0.5, "p99": 0.99, "most": 1.0}
    got = {r.g: r for r in quantiles.exact(df, "v", shares, ("g",)).collect()}
    assert set(got) == {*groups, "none"} and got["none"].p50 is None
    for g, vs in groups.items():
        ordered = sorted(vs.tolist())
        assert [got[g][n] for n in shares] == [ordered[max(math.ceil(p * len(ordered)), 1) - 1] for p in shares.values()], g
    ranks = quantiles.sketched(df.where("g = 'a'"), "v", {"p50": 0.5}, error=0.01).first().p50
    ordered = sorted(groups["a"].tolist())
    assert abs(np.searchsorted(ordered, ranks) - 1500) <= 0.01 * 3000 + 1
    assert quantiles.exact(df.limit(0), "v", shares, ("g",)).count() == 0
    assert quantiles.exact(df.where("g = 'c'"), "v", {"p50": 0.5}).first().p50 == 7.0
