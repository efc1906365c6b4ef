"""Filters, joins, set operations and keyed writes over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: domains of a proposal's fields
STATUSES = ("Draft", "Review", "Last Call", "Final", "Stagnant", "Withdrawn", "Living")
TYPES = ("Standards Track", "Meta", "Informational")
CATEGORIES = ("Core", "Networking", "Interface", "ERC")


def metadata_filter(rows: DataFrame, *, one_of: dict[str, list] | None = None, like_any: dict[str, list[str]] | None = None, contains: dict[str, object] | None = None, equal: dict[str, object] | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
    """AND across fields, OR within one; fields without values don't filter.

    one_of: column in values; like_any: column matches any %value% whatever the case (wildcards in values stay wildcards);
    contains: an array column holds a value; equal; between: (least, most) compared as text, either may be None.
    """
    parts: list[Column] = [F.col(c).isin(list(v)) for c, v in (one_of or {}).items() if v]
    parts += [reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{x}%") for x in v]) for c, v in (like_any or {}).items() if v]
    parts += [F.array_contains(c, v) for c, v in (contains or {}).items()]
    parts += [F.col(c) == v for c, v in (equal or {}).items()]
    for c, (low, high) in (between or {}).items():
        parts += [F.col(c).cast("string") >= low] * (low is not None) + [F.col(c).cast("string") <= high] * (high is not None)
    return rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows


def valid(column: Column, domain: tuple[str, ...]) -> Column:
    return F.coalesce(column.isin(list(domain)), F.lit(False))


def precedence_union(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables; of equal keys the last table's, of several there the largest as JSON."""
    columns = tables[0].columns
    both = reduce(DataFrame.unionByName, [t.withColumn("_p", F.lit(j)) for j, t in enumerate(tables)])
    row = F.struct(*columns)
    return both.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct("_p", F.to_json(row))).alias("_r")).select("_r.*")


def upsert(target: DataFrame, source: DataFrame, key: str, update: list[str], order: str) -> DataFrame:
    """Source rows (the last of each key by order, of equal ones the largest as JSON) insert; on a known key only the update columns change."""
    row = F.struct(*source.columns)
    last = source.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(F.col(order), F.to_json(row))).alias("_r")).select("_r.*")
    s = last.select(F.col(key), F.lit(True).alias("_s"), *[F.col(c).alias(f"_s_{c}") for c in target.columns if c != key])
    t = target.withColumn("_t", F.lit(True))
    both = t.join(s, key, "full_outer")
    new = lambda c: F.when(F.col("_t").isNull() | (F.col("_s").isNotNull() & F.lit(c in update)), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(key, *[new(c) for c in target.columns if c != key])


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return parents.join(ids, parents[key] == ids["_gone"], "left_anti"), children.join(ids, children[foreign] == ids["_gone"], "left_anti")


def drift(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed, modified or unchanged, by content hash."""
    a = old.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("_a"))
    b = new.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return both.select(key, change.alias("change"))


def pending_migrations(defined: DataFrame, applied: DataFrame, version: str = "version") -> DataFrame:
    return defined.join(applied.select(version), version, "left_anti")


def stale(entries: DataFrame, now: str, hours: int, stamp: str) -> DataFrame:
    """Entries at least that old at an injected time."""
    age = F.expr(f"timestampdiff(HOUR, CAST({stamp} AS TIMESTAMP_NTZ), TIMESTAMP_NTZ '{now}')")
    return entries.withColumn("age_hours", age).where(F.col("age_hours") >= hours)


def unseen(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows that aren't known yet."""
    return candidates.join(known.select(key).distinct(), key, "left_anti")


def since(rows: DataFrame, stamp: str, cursor: str) -> tuple[DataFrame, Column]:
    """Rows at or behind a cursor, and the expression of the next cursor."""
    return rows.where(F.col(stamp) >= F.lit(cursor).cast("timestamp_ntz")), F.max(stamp)


def merged_maps(left: F.Column, right: F.Column) -> F.Column:
    """Two maps as one; the right one's values win."""
    kept = F.filter(F.map_entries(left), lambda e: ~F.array_contains(F.map_keys(right), e["key"]))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_from_entries(F.concat(kept, F.map_entries(right))))
