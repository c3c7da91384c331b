"""Feed lists, fleet counts, the fetch log and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.functions.feeds import alert_flags, alert_section
from feedloom.functions.text import error_text
from feedloom.operators.items import small


def feed_list(feeds: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Feeds by age, with whether credentials are set instead of these; with items also their counts."""
    out = feeds.withColumn("has_auth", F.col("auth_username").isNotNull() & F.col("auth_password").isNotNull()).drop("auth_username", "auth_password")
    if items is not None:
        counts = items.groupBy(F.col("feed_id").alias("id")).agg(F.count("*").alias("item_count"), F.count_if("is_read").alias("read_count"))
        out = out.join(counts, "id", "left").fillna(0, ["item_count", "read_count"])
    return out.orderBy("created_at", "id")


def folder_list(folders: DataFrame) -> DataFrame:
    return folders.orderBy("position", "created_at", "id")


def fetch_log(events: DataFrame, feeds: DataFrame, feed_id: int | None = None, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    rows = events if feed_id is None else events.where(F.col("feed_id") == feed_id)
    named = feeds.select(F.col("id").alias("feed_id"), F.col("title").alias("feed_title"), "feed_url")
    return rows.join(small(named), "feed_id").orderBy(F.desc("fetched_at"), F.desc("id")).limit(limit)


def fleet_counts(feeds: DataFrame) -> DataFrame:
    live = ~F.col("is_paused")
    failing = live & (F.col("status") == "error")
    return feeds.agg(
        F.count("*").alias("total"),
        F.count_if(live).alias("active"),
        F.count_if("is_paused").alias("paused"),
        F.count_if(failing).alias("failing"),
        F.count_if(failing & (F.col("last_error_category") == "network")).alias("failing_network"),
        F.count_if(failing & (F.col("last_error_category") == "parse")).alias("failing_parse"),
    )


def window_counts(events: DataFrame, since: Column) -> DataFrame:
    return events.where(F.col("fetched_at") >= since).agg(
        F.count("*").alias("events"), F.count_distinct("feed_id").alias("feeds"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.sum("missing_published_at_count"), F.lit(0)).alias("missing_dates")
    )


def top_errors(events: DataFrame, since: Column, limit: int = 5) -> DataFrame:
    rows = events.where((F.col("fetched_at") >= since) & (F.col("status") == "error"))
    counts = rows.groupBy(F.col("error_category").alias("category"), error_text(F.col("error_message")).alias("message")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("category"), F.asc_nulls_last("message")).limit(limit)


def longest_failing(feeds: DataFrame, limit: int = 10) -> DataFrame:
    rows = feeds.where(~F.col("is_paused") & (F.col("status") == "error"))
    return rows.orderBy(F.desc("consecutive_error_count"), F.asc_nulls_last("last_error_at"), "id").limit(limit)


def newly_failing(feeds: DataFrame, since: Column, limit: int = 10) -> DataFrame:
    rows = feeds.where(~F.col("is_paused") & (F.col("status") == "error") & (F.col("last_error_at") >= since) & (F.col("consecutive_error_count") <= 3))
    return rows.orderBy(F.desc_nulls_last("last_error_at"), "id").limit(limit)


def recovered(feeds: DataFrame, since: Column, limit: int = 10) -> DataFrame:
    rows = feeds.where((F.col("status") != "error") & (F.col("last_success_at") >= since) & (F.col("last_success_at") > F.col("last_error_at")))
    return rows.orderBy(F.desc("last_success_at"), "id").limit(limit)


def due_feeds(feeds: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    at = F.coalesce("next_fetch_at", now)
    return feeds.where(~F.col("is_paused") & (at <= now)).orderBy(at, "id").limit(limit)


def coverage(items: DataFrame, features: DataFrame, version: str) -> DataFrame:
    """One row: items, ready and skipped features of a version, items still to do, and the share done in percent."""
    done = features.where(F.col("algorithm_version") == version).agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    todo = pending(items, features, version).agg(F.count("*").alias("pending"), F.min("published_at").alias("oldest_pending"))
    out = items.agg(F.count("*").alias("total")).crossJoin(done).crossJoin(todo)  # one row each
    return out.withColumn("percent", F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.round((F.col("ready") + F.col("skipped")) * 100 / F.col("total"), 2)))


def pending(items: DataFrame, features: DataFrame, version: str) -> DataFrame:
    """Items without a feature row of the version."""
    done = features.where(F.col("algorithm_version") == version).select(F.col("item_id").alias("id"))
    return items.join(done, "id", "left_anti")


def backfill(items: DataFrame, features: DataFrame, version: str, limit: int | None = None, newer_than: Column | None = None) -> DataFrame:
    """Pending items, the newest first."""
    rows = pending(items, features, version)
    rows = rows if newer_than is None else rows.where(F.col("created_at") >= newer_than)
    rows = rows.orderBy(F.desc_nulls_last("published_at"), F.desc("created_at"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def work_order(pending_rows: DataFrame, fresh_since: Column, limit: int) -> DataFrame:
    """A batch of pending work: fresh items (priority 100) before history (0), then by age."""
    rows = pending_rows.withColumn("priority", F.when(F.col("created_at") >= fresh_since, 100).otherwise(0))
    return rows.orderBy(F.desc("priority"), "created_at", "id").limit(limit)


def previous_state(events: DataFrame) -> DataFrame:
    """Each event with the status of the feed's one before, and the lengths of the error streaks before and with it."""
    w = W.partitionBy("feed_id").orderBy("fetched_at", "id")
    ok = F.sum(F.when(F.col("status") == "error", 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = events.withColumn("run", ok)
    streak = F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).over(W.partitionBy("feed_id", "run").orderBy("fetched_at", "id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("error_count", streak)
    return rows.withColumns({"previous_status": F.lag("status").over(w), "previous_error_count": F.coalesce(F.lag("error_count").over(w), F.lit(0))}).drop("run")


def latest_batch(batches: DataFrame) -> DataFrame:
    return batches.groupBy("kind").agg(F.max("sent_at").alias("sent_at"))


def digest_due(batches: DataFrame, kind: str, now: Column) -> DataFrame:
    """One row: when the last digest of a kind was sent, from when the next one counts, and whether it is due."""
    last = batches.where(F.col("kind") == kind).agg(F.max("sent_at").alias("last_sent"))
    day = F.expr("interval 24 hours")
    return last.select("last_sent", F.coalesce("last_sent", now - day).alias("since"), (F.col("last_sent").isNull() | (F.col("last_sent") <= now - day)).alias("due"))


def cycle_summary(cycle: DataFrame, *by: str) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    return cycle.groupBy(*by).agg(
        status("success").alias("success"), status("not_modified").alias("not_modified"), status("error").alias("error"),
        F.count_if(F.col("error_category") == "network").alias("network"), F.count_if(F.col("error_category") == "parse").alias("parse"),
        F.coalesce(F.sum("missing_published_at_count"), F.lit(0)).alias("missing_dates"),
    )


def cycle_alerts(cycle: DataFrame, by: str = "cycle_id", most: int = 120) -> DataFrame:
    """Rows that need an alert, by section and then in order, ``most`` a cycle; each with its section's and its cycle's counts."""
    flags = alert_flags(F.col("status"), F.col("previous_status"), F.col("previous_error_count"), F.col("error_count"), F.col("http_status"))
    rows = cycle.withColumn("section", alert_section(flags, F.col("error_category"))).where(F.col("section").isNotNull())
    sizes = rows.groupBy(by, "section").agg(F.count("*").alias("section_count"))
    totals = sizes.groupBy(by).agg(F.sum("section_count").alias("actionable"))
    listed = rows.withColumn("line", F.row_number().over(W.partitionBy(by).orderBy("section", "id"))).where(F.col("line") <= most)
    return listed.join(sizes, [by, "section"]).join(totals, by).withColumn("omitted", F.greatest(F.col("actionable") - most, F.lit(0)))


def daily_digest(feeds: DataFrame, events: DataFrame, since: Column) -> DataFrame:
    """One row with the counts of feeds and of the events since, and the short lists as arrays."""
    listed = lambda df, c, n: df.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", c))), lambda x: x[c]).alias(n))  # noqa: E731  ten rows at most
    place = lambda df, *order: df.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    errors = place(top_errors(events, since), F.desc("n"), F.asc_nulls_last("category"), F.asc_nulls_last("message"))
    out = fleet_counts(feeds).crossJoin(window_counts(events, since))
    out = out.crossJoin(listed(errors, "n", "top_error_counts"))
    out = out.crossJoin(listed(place(longest_failing(feeds), F.desc("consecutive_error_count"), F.asc_nulls_last("last_error_at"), "id"), "id", "longest_failing"))
    out = out.crossJoin(listed(place(newly_failing(feeds, since), F.desc_nulls_last("last_error_at"), "id"), "id", "newly_failing"))
    return out.crossJoin(listed(place(recovered(feeds, since), F.desc("last_success_at"), "id"), "id", "recovered"))


def notification_batch(cycle: DataFrame, kind: str, sent_at: Column) -> DataFrame:
    """One row for each cycle with its outcomes as a JSON array in order; a cycle has as many as a worker's batch of feeds."""
    fields = F.struct("id", "feed_id", "status", "http_status")
    return cycle.groupBy("cycle_id").agg(F.to_json(F.sort_array(F.collect_list(fields))).alias("payload")).select("cycle_id", F.lit(kind).alias("kind"), "payload", sent_at.alias("sent_at"))
