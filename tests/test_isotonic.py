"""The isotonic fit merged over many ranges, and interpolation by a sort, against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import isotonic


def plain(points):
    """The fitted value of each prediction, by pooling one point after the other."""
    out = []
    for x in sorted({x for x, _ in points}):
        own = [y for a, y in points if a == x]
        out.append([[x], sum(own), len(own)])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            xs, s, w = out.pop()
            out[-1] = [out[-1][0] + xs, out[-1][1] + s, out[-1][2] + w]
    return {x: s / w for xs, s, w in out for x in xs}


@pytest.mark.parametrize("slope", [1.0, 0.0, -1.0, 0.2])
def test_ranges_merge_to_the_fit_of_all(spark, slope):
    rng = np.random.default_rng(int(slope * 10) + 20)
    points = [(float(x), float(slope * x + rng.normal())) for x in rng.random(700)] + [(0.5, 9.0)] * 30 + [(float("nan"), 1.0), (None, 1.0), (0.1, None)]
    df = spark.createDataFrame(points, "predicted double, actual double")
    good = [p for p in points if None not in p and p[0] == p[0]]
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = [(r.boundary, r.value) for r in isotonic.fit(df).orderBy("boundary").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = plain(good)
    assert [v for _, v in found] == sorted(v for _, v in found)
    assert {x for x, _ in found} <= set(expected)
    assert [np.interp(x, *zip(*found, strict=True)) for x in expected] == pytest.approx(list(expected.values()))
    assert isotonic.fit(df.limit(0)).count() == 0


def test_kinds_fall_back_on_all(spark):
    points = [("a", x / 40, float(x % 3)) for x in range(40)] + [("b", x / 5, 1.0) for x in range(5)] + [(None, 0.3, 2.0)] * 3
    got = isotonic.fit(spark.createDataFrame(points, "t string, predicted double, actual double"), kind="t").collect()
    assert {r.kind for r in got} == {"a", None}
    for kind in ("a", None):
        expected = plain([(x, y) for t, x, y in points if kind is None or t == kind])
        knots = sorted((r.boundary, r.value) for r in got if r.kind == kind)
        assert [np.interp(x, *zip(*knots, strict=True)) for x in expected] == pytest.approx(list(expected.values()))


def test_interpolation_by_a_sort(spark):
    rng = np.random.default_rng(1)
    knots = sorted((float(x), float(y)) for x, y in rng.random((300, 2)))
    xs = [*rng.random(400).tolist(), *[x for x, _ in knots[::7]], -1.0, 2.0, None] + [0.5] * 50
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "`a.b` int, predicted double").repartition(5)
    table = spark.createDataFrame(knots, "boundary double, value double")
    got = {r[0]: r.calibrated for r in isotonic.interpolated(rows, table).collect()}
    assert len(got) == len(xs)
    for i, x in enumerate(xs):
        assert got[i] == (None if x is None else pytest.approx(np.interp(x, *zip(*knots, strict=True))))
    assert [r.calibrated for r in isotonic.interpolated(rows.where("predicted = 2.0"), table.limit(0)).collect()] == [2.0]
    assert isotonic.interpolated(rows.limit(0), table).count() == 0
    assert isotonic.fit(rows.select("predicted", F.lit(1.0).alias("actual"))).select("value").distinct().count() == 1


def test_interpolation_takes_time_in_proportion(spark):
    """A frame from each row to the end of its part is folded anew for every row: 150,000 rows in a part took minutes."""
    rows = spark.range(0, 150_000, 1, 1).select(F.col("id"), (F.col("id") / 1000).alias("predicted"))
    table = spark.createDataFrame([(0.0, 0.0), (150.0, 300.0)], "boundary double, value double").coalesce(1)
    frames = isotonic.interpolated(rows, table)
    assert "unboundedfollowing" not in frames._jdf.queryExecution().optimizedPlan().toString().lower()
    got = frames.agg(F.count("*").alias("n"), F.max(F.abs(F.col("calibrated") - 2 * F.col("predicted"))).alias("e")).first()
    assert got.n == 150_000 and got.e < 1e-9
