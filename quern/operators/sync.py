"""Keeping sources up to date: per-source state, staleness, a content cache, rate limits and runs over many sources.

State is a table with a row a source; an update is a new version of that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.decisions import folded

STATE = "source string, last_sync string, last_commit string, last_cursor string, docs_synced bigint, errors bigint"


def needs_sync(state: DataFrame, heads: DataFrame) -> DataFrame:
    """(source, needed) of heads (source, commit): never synced, or at another commit; a null commit tells nothing new."""
    both = heads.join(state.select("source", "last_sync", "last_commit"), "source", "left")
    return both.select("source", (F.col("last_sync").isNull() | F.coalesce(~F.col("commit").eqNullSafe(F.col("last_commit")) & F.col("commit").isNotNull(), F.lit(False))).alias("needed"))


def advanced(state: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """state behind results (source, commit, cursor, synced, errors; several rows a source add up, the last commit and cursor by seq stay)."""
    gained = results.groupBy("source").agg(F.max_by("commit", F.when(F.col("commit").isNotNull(), F.col("seq"))).alias("_commit"), F.max_by("cursor", F.when(F.col("cursor").isNotNull(), F.col("seq"))).alias("_cursor"), F.sum("synced").alias("_n"), F.sum("errors").alias("_e"))
    both = state.join(gained, "source", "full")
    seen = F.col("_n").isNotNull()
    return both.select("source", F.when(seen, F.lit(now)).otherwise(F.col("last_sync")).alias("last_sync"), F.coalesce("_commit", "last_commit").alias("last_commit"), F.coalesce("_cursor", "last_cursor").alias("last_cursor"), (F.coalesce("docs_synced", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("docs_synced"), (F.coalesce("errors", F.lit(0)) + F.coalesce("_e", F.lit(0))).alias("errors"))


def since_date(state: DataFrame, papers: DataFrame, source: str, most: int = 50) -> DataFrame:
    """Papers published on or behind the day of a source's last sync (all without one), the newest first, at most most."""
    last = state.where(F.col("source") == source).agg(F.left(F.max("last_sync"), F.lit(10)).alias("_d"))
    return papers.join(F.broadcast(last), F.col("_d").isNull() | (F.left("published", F.lit(10)) >= F.col("_d"))).drop("_d").orderBy(F.desc("published"), "id").limit(most)


def sync_status(results: DataFrame) -> DataFrame:
    """(source, status): an error, up to date (nothing synced but some skipped), or success."""
    status = F.when(F.col("errors") > 0, "error").when((F.col("synced") == 0) & (F.col("skipped") > 0), "already_up_to_date").otherwise("success")
    return results.select("source", status.alias("status"))


def stale_topics(listed: DataFrame, cached: DataFrame) -> DataFrame:
    """Listed topics (topic_id, posts_count, bumped_at) that aren't cached, have more posts, or were bumped behind the cached bump (or last post)."""
    own = cached.select("topic_id", F.col("posts_count").alias("_n"), F.coalesce("bumped_at", "last_posted_at").alias("_b"), F.lit(True).alias("_hit"))
    both = listed.join(own, "topic_id", "left")
    return both.where(F.col("_hit").isNull() | (F.col("posts_count") > F.col("_n")) | F.coalesce(F.col("bumped_at") > F.col("_b"), F.lit(False))).drop("_n", "_b", "_hit")


def reconciled(topics: DataFrame, listed: DataFrame) -> DataFrame:
    """Fetched topics with the newer of their own bump and the listing's; a topic without one keeps none."""
    own = listed.groupBy("topic_id").agg(F.max("bumped_at").alias("_l"))
    return topics.join(own, "topic_id", "left").withColumn("bumped_at", F.when(F.col("bumped_at").isNotNull(), F.greatest("bumped_at", "_l"))).drop("_l")


# -- a content cache: entries by (source, item_id)


def cached(entries: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """entries behind a put of items (source, item_id, content, meta): hash and size of each, the newest of a key."""
    size = F.octet_length("content").cast("bigint")
    new = items.groupBy("source", "item_id").agg(F.max(F.struct("content", "meta")).alias("_i")).select("source", "item_id", F.col("_i.content").alias("content"), F.col("_i.meta").alias("meta"))
    put = new.select("source", "item_id", F.lit(now).alias("fetched_at"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), size.alias("content_bytes"), "meta")
    return entries.join(put.select("source", "item_id"), ["source", "item_id"], "left_anti").unionByName(put)


def stale_items(entries: DataFrame, wanted: DataFrame, now: str, hours: float = 24 * 7) -> DataFrame:
    """wanted (source, item_id) that are missing or were fetched more than hours before."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("fetched_at").cast("timestamp"))) / 3600
    both = wanted.join(entries.select("source", "item_id", "fetched_at"), ["source", "item_id"], "left")
    return both.where(F.col("fetched_at").isNull() | (age > hours)).select("source", "item_id")


def cache_stats(entries: DataFrame) -> DataFrame:
    """Per source: entries, bytes, megabytes and the last fetch."""
    return entries.groupBy("source").agg(F.count("*").alias("entry_count"), F.sum("content_bytes").alias("total_bytes"), F.round(F.sum("content_bytes") / (1024 * 1024), 2).alias("total_mb"), F.max("fetched_at").alias("last_sync"))


def cache_drift(entries: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """(item_id, change) of one source's new contents against the cache."""
    old = entries.where(F.col("source") == source).select("item_id", F.col("content_hash").alias("_a"))
    new = items.where(F.col("source") == source).select("item_id", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return old.join(new, "item_id", "full").select("item_id", change.alias("change"))


def without_source(entries: DataFrame, source: str) -> DataFrame:
    return entries.where(F.col("source") != source)


# -- rate limits


class _Limit:
    def __init__(self):
        self.made, self.window, self.limit, self.left, self.reset, self.refused, self.until = 0, 0.0, None, None, None, 0, 0.0


def _limited(s: _Limit, at: float, status: int, limit: int | None, left: int | None, reset: float | None, retry: float | None, default: int, window: float) -> tuple:
    """Seconds to wait before a request at a time, then what its response tells."""
    if at - s.window >= window:
        s.made, s.window = 0, at
    wait = max(0.0, s.until - at)
    if not wait and s.reset is not None and at < s.reset and s.left is not None and s.left <= 0:
        wait = s.reset - at
    if not wait and s.made >= (s.limit or default):
        wait = max(0.0, window - (at - s.window))
    s.made += 1
    s.limit, s.left = (limit if limit is not None else s.limit), (left if left is not None else s.left)
    if reset is not None:
        s.reset = reset if reset > 1_000_000_000 else at + reset
    if status == 429:
        s.refused += 1
        s.until = at + (retry if retry is not None else min(60.0, 2.0 ** (s.refused - 1)))
    else:
        s.refused, s.until = 0, 0.0
    return wait, s.refused


def rate_limited(requests: DataFrame, key: str = "api", order: str = "at", default: int = 30, window: float = 60.0) -> DataFrame:
    """requests (key, at in seconds, status, limit_header, left_header, reset_header, retry_after) with wait (seconds to wait before it) and refused (429s in a row).

    The wait comes from a backoff that is still on, else from a limit that is used up until its reset, else from the own count in the window.
    """

    def step(s: _Limit, r: dict) -> tuple:
        return _limited(s, r[order], r["status"], r["limit_header"], r["left_header"], r["reset_header"], r["retry_after"], default, window)

    return folded(requests, key, [order], _Limit, step, "wait double, refused int")


def run_sources(sources: dict[str, Callable[[], int]], cycles: int = 1, pause: Callable[[], None] | None = None) -> list[dict]:
    """Runs each source's ingestion in turn for some cycles; an error is recorded and doesn't stop the others."""
    out = []
    for cycle in range(cycles):
        for name, ingest in sources.items():
            try:
                out.append({"cycle": cycle, "source": name, "synced": ingest(), "error": None})
            except Exception as e:  # a source's failure is its own
                out.append({"cycle": cycle, "source": name, "synced": 0, "error": f"{type(e).__name__}: {e}"})
        if pause is not None and cycle + 1 < cycles:
            pause()
    return out


def due(last: Column, now: str, every_hours: Column) -> Column:
    """Whether a source's next run is due."""
    return last.isNull() | ((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))) / 3600 >= every_hours)


def with_backfill(recent: DataFrame, whole: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The rows of an incremental run, then those of the whole listing that neither it nor any earlier run (seen) has; with backfill."""
    done = seen.select(key).unionByName(recent.select(key)).distinct()
    return recent.withColumn("backfill", F.lit(False)).unionByName(whole.join(done, key, "left_anti").withColumn("backfill", F.lit(True)))
