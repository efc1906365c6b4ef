"""Exact isotonic regression over sorted ranges, and interpolation between any number of knots.

Points of equal predictions are pooled before the shuffle, then sorted by range; each task pools adjacent violators of its range into blocks (sum, weight). Ranges are merged by pairs:
where the last mean of the left one is below the first of the right one nothing changes; otherwise only the left blocks whose mean reaches the right's least, and the right ones
whose mean doesn't pass the left's largest, can be pooled, and these go to a task together. No prediction is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.scratch import discard, written

MOST_BROADCAST = 100_000
_BLOCK = "k string, low double, high double, s double, w double, task int"


def _append(out: list[list[float]], block: tuple[float, float, float, float]) -> None:
    """Adds a block (low, high, sum, weight) behind ascending ones and pools while the means don't ascend."""
    out.append(list(block))
    while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
        _, high, s, w = out.pop()
        out[-1] = [out[-1][0], high, out[-1][2] + s, out[-1][3] + w]


def _table(k: str, blocks: list[list[float]], task: int) -> pa.Table:
    low, high, s, w = (list(c) for c in zip(*blocks, strict=True))
    return pa.table([[k] * len(low), low, high, s, w, pa.array([task] * len(low), pa.int32())], names=["k", "low", "high", "s", "w", "task"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each kind in a task's sorted points (k, x, s, w, task)."""
    now, held, task = None, [], 0
    for batch in batches:
        for k, x, s, w, task in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != now and held:
                yield from _table(now, held, task).to_batches()
                held = []
            now = k
            _append(held, (x, x, s, w))
    if held:
        yield from _table(now, held, task).to_batches()


def fit(points: DataFrame, predicted: str = "predicted", actual: str = "actual", kind: str | None = None, least: int = 20) -> DataFrame:
    """(boundary, value) of the isotonic fit, or (kind, boundary, value) of one for each kind, with that of all points under the null kind.

    A block of equal values has its two ends as boundaries. A kind of fewer than `least` points has no rows, so without enough points the table is empty. Null and
    NaN predictions and null outcomes don't count; points of a null kind count for the fit of all.
    """
    x, y = F.col(predicted).cast("double"), F.col(actual).cast("double")
    base = points.where(x.isNotNull() & ~F.isnan(x) & y.isNotNull())
    rows = base.select(F.lit("").alias("k"), x.alias("x"), y.alias("y"))
    if kind:
        rows = rows.unionByName(base.where(F.col(kind).isNotNull()).select(F.concat(F.lit("v"), F.col(kind).cast("string")).alias("k"), x.alias("x"), y.alias("y")))
    same = written(rows.groupBy("k", "x").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("w")))
    enough = same.groupBy("k").agg(F.sum("w").alias("n")).where(F.col("n") >= least).select("k")
    placed = same.join(enough, "k").repartitionByRange("k", "x").sortWithinPartitions("k", "x").select("k", "x", "s", "w", F.spark_partition_id().alias("task"))
    blocks = written(placed.mapInArrow(_ranges, _BLOCK))
    tasks, level = (blocks.agg(F.max("task")).first()[0] or 0) + 1, 0
    while 1 << level < tasks:
        blocks, last = written(_merged(blocks, level)), blocks
        discard(last)
        level += 1
    knots = blocks.select("k", F.explode(F.array_distinct(F.array("low", "high"))).alias("boundary"), (F.col("s") / F.col("w")).alias("value"))
    if not kind:
        return knots.select("boundary", "value")
    return knots.select(F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).cast(points.schema[kind].dataType).alias("kind"), "boundary", "value")


def _merged(blocks: DataFrame, level: int) -> DataFrame:
    """One round: pairs of neighbouring runs of 2**level ranges become one."""
    mean, pair = F.col("s") / F.col("w"), F.shiftright("task", level + 1)
    right = F.shiftright("task", level).bitwiseAND(F.lit(1)) == 1
    sided = blocks.withColumn("pair", pair).withColumn("right", right).withColumn("mean", mean)
    ends = sided.groupBy("k", "pair").agg(F.max(F.when(~right, mean)).alias("most"), F.min(F.when(right, mean)).alias("least")).where("most >= least")
    joined = sided.join(ends, ["k", "pair"], "left")
    touched = F.col("most").isNotNull() & F.when(F.col("right"), F.col("mean") <= F.col("most")).otherwise(F.col("mean") >= F.col("least"))

    def pool(group: pa.Table) -> pa.Table:
        group = group.sort_by("low")
        found: list[list[float]] = []
        for block in zip(*(group.column(c).to_pylist() for c in ("low", "high", "s", "w")), strict=True):
            _append(found, block)
        return _table(group.column("k")[0].as_py(), found, group.column("task")[0].as_py())

    names = [c.split()[0] for c in _BLOCK.split(", ")]
    again = joined.where(touched).select(*names, "pair").groupBy("k", "pair").applyInArrow(pool, _BLOCK)
    return joined.where(~touched).select(*names).unionByName(again)


def interpolated(rows: DataFrame, knots: DataFrame, column: str = "predicted", kind: str | None = None) -> DataFrame:
    """rows with calibrated: the line between the knots around a prediction, the outer values beyond them, unchanged without knots; any number of knots and rows.

    Rows and knots are sorted together by range; each part of the sort learns the last knot before it and the first behind it from one row a part.
    """
    names = [f"_c{j}" for j in range(len(rows.columns))]
    own = rows.toDF(*names)
    x = F.col(names[rows.columns.index(column)]).cast("double")
    has = knots.select(F.lit("").alias("k") if kind is None else F.coalesce(F.concat(F.lit("v"), F.col("kind").cast("string")), F.lit("")).alias("k"), F.col("boundary").cast("double").alias("x"), F.col("value").cast("double").alias("v"))
    k = F.lit("") if kind is None else F.coalesce(F.concat(F.lit("v"), F.col(names[rows.columns.index(kind)]).cast("string")), F.lit(""))
    kinds = has.select("k", F.lit(True).alias("_has")).distinct()
    meant = own.withColumn("k", k).join(kinds, "k", "left").withColumn("k", F.when(F.col("_has"), F.col("k")).otherwise("")).drop("_has")
    line = meant.select("k", x.alias("x"), F.struct(*names).alias("row"), F.lit(None).cast("double").alias("v")).unionByName(has.where("x IS NOT NULL AND v IS NOT NULL").withColumn("row", F.lit(None).cast(meant.select(F.struct(*names).alias("r")).schema["r"].dataType)))
    placed = written(line.repartitionByRange("k", "x").withColumn("part", F.spark_partition_id()))
    knot = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
    ends = placed.withColumn("knot", knot).groupBy("k", "part").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    over = W.partitionBy("k").orderBy("part")  # a row for each part that holds rows of the kind
    ends = written(ends.select("k", "part", F.last("last", True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("behind")))
    ends = F.broadcast(ends) if ends.count() <= MOST_BROADCAST else ends
    inside = W.partitionBy("k", "part")  # rows of equal predictions see each other; both frames only grow, as one that ends with the part is folded anew for each row
    a = F.coalesce(F.last("knot", True).over(inside.orderBy("x").rangeBetween(W.unboundedPreceding, 0)), F.col("before"))
    b = F.coalesce(F.last("knot", True).over(inside.orderBy(F.desc("x")).rangeBetween(W.unboundedPreceding, 0)), F.col("behind"))
    near = placed.withColumn("knot", knot).join(ends, ["k", "part"]).withColumn("a", a).withColumn("b", b).where("v IS NULL AND row IS NOT NULL")
    on_line = F.col("a.v") + (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x")) * (F.col("b.v") - F.col("a.v"))
    value = F.when(F.col("x").isNull(), None).when(F.col("a").isNull() & F.col("b").isNull(), F.col("x")).when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("b.x") == F.col("a.x")), F.col("a.v")).otherwise(on_line)
    return near.select("row.*", value.alias("calibrated")).toDF(*rows.columns, "calibrated")
