"""Structured Streaming: incremental counts, deduplication, keyed upserts and a stateful breaker over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A file source; files bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def windowed_counts(events: DataFrame, stamp: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window with a watermark; later rows than that are dropped by the stream."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def once(events: DataFrame, key: str, stamp: str, late: str = "2 hours") -> DataFrame:
    return events.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


def breaker(events: DataFrame, key: str = "user_id", limit: int = 3) -> DataFrame:
    """(key, event_id, failures, open) per event: consecutive failures per key, latched open at the limit. The state is two numbers a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, opened = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            run = run + 1 if kind == "error" else 0
            opened = opened or run >= limit
            out.append((k[0], event_id, run, opened))
        state.update((run, opened))
        yield pd.DataFrame(out, columns=[key, "event_id", "failures", "open"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} bigint, event_id bigint, failures bigint, open boolean", "failures bigint, open boolean", "append", "NoTimeout")


def run_upserts(stream: DataFrame, path: str, checkpoint: str, key: str, update: list[str], order: str) -> None:
    """All that is there now, as keyed upserts batch by batch; a batch that is run again gives the same table."""
    from quern.sources.readers import upsert_table

    def write(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, path, batch, key, update, order)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into a memory table (for small results) and returns it."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
