"""Structured Streaming jobs over landed files and item tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from feedloom.operators.features import results
from feedloom.sources.feeds import RESPONSES, classified, documents, outcomes
from feedloom.streaming.keyed import KeyedTable

HEALTH = "feed_id long, events long, error_count long, status string, last_id long"


def responses(spark: SparkSession, path: str, most_files: int = 50) -> DataFrame:
    """Landed responses as a stream, ``most_files`` at a time."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", most_files).parquet(path)


def ingest(source: DataFrame, items_path: str, log_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Parses each micro-batch once, adds items whose key is new, and appends to the fetch log.

    Items are a ``KeyedTable``: state doesn't grow with history and history isn't read, but for files that may hold one of a
    micro-batch's keys.  Each micro-batch has its own folders, which a retry writes anew, so a failure between the writes leaves
    neither repeated nor missing rows.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        docs = documents(classified(batch)).persist()
        try:
            log, items = outcomes(batch, docs=docs)
            KeyedTable(items_path, ("feed_id", "dedupe_key"), buckets).add(items, batch_id)
            log.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        finally:
            docs.unpersist()

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_key(events: DataFrame, keys: list[str], at: str | None = None, within: str | None = None) -> DataFrame:
    """Streaming deduplication.  With an event time ``at`` repeats that come ``within`` this time of the first are dropped, and a key's state with
    it; without, over all history, in state that grows with the keys."""
    if at is None or within is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def health(events: DataFrame) -> DataFrame:
    """Per feed: events seen, length of the current error streak, status, by arbitrary state kept for each key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, streak, status, last = state.get if state.exists else (0, 0, "active", -1)
        rows = pd.concat(list(parts)).sort_values(["fetched_at", "id"])
        for s, i in zip(rows.status, rows.id, strict=True):
            seen, last = seen + 1, int(i)
            streak, status = (streak + 1, "error") if s == "error" else (0, "active")
        state.update((seen, streak, status, last))
        yield pd.DataFrame([(key[0], seen, streak, status, last)], columns=["feed_id", "events", "error_count", "status", "last_id"])

    return events.groupBy("feed_id").applyInPandasWithState(step, HEALTH, "events long, error_count long, status string, last_id long", "update", GroupStateTimeout.NoTimeout)


def windowed_health(events: DataFrame, length: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Events, errors and missing dates by event-time window; rows later than ``late`` don't count.  An extension: digests of a
    stream, by fixed days rather than since the last digest."""
    counted = events.withWatermark("fetched_at", late) if events.isStreaming else events
    return counted.groupBy(F.window("fetched_at", length).alias("w")).agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("missing_published_at_count").alias("missing_dates")
    ).select(F.col("w.start").alias("start"), "events", "errors", "missing_dates")


def features(items: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, version: str, buckets: int = 64) -> StreamingQuery:
    """Feature rows of items without one of the version yet, a folder for each version and micro-batch; results of each micro-batch at
    ``path``-results/version.

    ``work`` gives rows (item_id, status, ...), status ready, skipped or failed; failed ones aren't stored, so their items are tried again
    when they come again.  A repeated micro-batch replaces what it wrote; another version does all items anew.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(f"{path}/algorithm_version={version}", ("item_id",), buckets)
        asked = table.fresh(batch.withColumn("item_id", F.col("id")), batch_id).drop("item_id", "bucket")
        rows = work(asked).persist()
        try:
            table.add(rows.where("status <> 'failed'"), batch_id)
            seen = rows.agg(F.lit(batch_id).cast("long").alias("batch_id"), *results())
            seen.coalesce(1).write.mode("overwrite").parquet(f"{path}-results/algorithm_version={version}/batch={batch_id}")
        finally:
            rows.unpersist()

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
