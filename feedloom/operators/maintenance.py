"""Table maintenance: each operator returns a table's new state from its old one and a table of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.functions.feeds import next_interval, retry_delay_ms
from feedloom.functions.text import error_text
from feedloom.functions.vectors import valid


def last_change(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last change of each row."""
    return changes.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def apply_item_state(items: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: (id, is_read, is_starred, seq); null leaves a flag as it is; a flag's time is set and cleared with it."""
    new = last_change(changes).select("id", F.col("is_read").alias("new_read"), F.col("is_starred").alias("new_starred"))
    rows = items.join(new, "id", "left")
    at = lambda flag, old: F.when(F.col(flag).isNull(), F.col(old)).when(F.col(flag), now)
    return rows.withColumns({
        "read_at": at("new_read", "read_at"), "starred_at": at("new_starred", "starred_at"),
        "is_read": F.coalesce("new_read", "is_read"), "is_starred": F.coalesce("new_starred", "is_starred"),
    }).drop("new_read", "new_starred")


def apply_patch(rows: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """patches: (id, seq, and for each column its value and has_<column>); only columns that a patch has change, to null too."""
    new = last_change(patches)
    new = new.select("id", *(F.col(c).alias(f"__{c}") for c in columns), *(f"has_{c}" for c in columns))
    out = rows.join(new, "id", "left")
    return out.withColumns({c: F.when(F.col(f"has_{c}"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(rows.columns)


def apply_feed_patch(feeds: DataFrame, patches: DataFrame) -> DataFrame:
    """A feed's title, folder, pause and credentials; a patch with one of the credentials alone is rejected."""
    both = patches.where((F.col("has_auth_username") == F.col("has_auth_password")) & (F.col("auth_username").isNull() == F.col("auth_password").isNull()))
    return apply_patch(feeds, both, ["title", "folder_id", "is_paused", "auth_username", "auth_password"])


def apply_folder_patch(folders: DataFrame, patches: DataFrame) -> DataFrame:
    return apply_patch(folders, patches, ["title", "position"])


def import_subscriptions(feeds: DataFrame, folders: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new folders, new feeds, counts) of incoming (pos, feed_url, folder_title, site_url, title).

    Titles without a folder get one at the end, in order of first appearance, even if all their feeds are known.  Of feeds
    with one address the first counts; known addresses are passed over.
    """
    titled = incoming.where("folder_title is not null").groupBy("folder_title").agg(F.min("pos").alias("pos"))
    new = titled.join(folders.select(F.col("title").alias("folder_title")), "folder_title", "left_anti")
    base = folders.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("base"))
    # numbered within blocks of places in the list, a block after those before it; only blocks' counts meet in one task
    new = new.withColumn("block", F.floor(F.col("pos") / 65_536))
    counts = new.groupBy("block").agg(F.count("*").alias("held"))
    counts = counts.select("block", (F.sum("held").over(W.orderBy("block")) - F.col("held")).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("pos")) - 1
    made = new.join(counts, "block").crossJoin(base).select(F.concat(F.lit("new-"), F.col("pos").cast("string")).alias("id"), F.col("folder_title").alias("title"), (F.col("base") + place).alias("position"))
    first = incoming.withColumn("__n", F.row_number().over(W.partitionBy("feed_url").orderBy("pos"))).where("__n = 1").drop("__n")
    fresh = first.join(feeds.select("feed_url"), "feed_url", "left_anti")
    every = folders.select(F.col("id").cast("string").alias("folder_id"), F.col("title").alias("folder_title"), "position").union(made.select("id", "title", "position"))
    every = every.groupBy("folder_title").agg(F.min_by("folder_id", "position").alias("folder_id"))
    placed = fresh.join(every, "folder_title", "left").select("pos", "feed_url", "folder_id", "site_url", "title")
    counts = first.agg(F.count("*").alias("n")).crossJoin(placed.agg(F.count("*").alias("created_feeds"))).crossJoin(made.agg(F.count("*").alias("created_folders")))
    return made, placed, counts.select("created_feeds", "created_folders", (F.col("n") - F.col("created_feeds")).alias("skipped_feeds"))


def delete_folders(folders: DataFrame, feeds: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders without those gone; their feeds stay, in no folder."""
    marked = feeds.join(gone.select(F.col("id").alias("folder_id"), F.lit(True).alias("__gone")), "folder_id", "left")
    return folders.join(gone, "id", "left_anti"), marked.withColumn("folder_id", F.when(F.col("__gone").isNull(), F.col("folder_id"))).select(feeds.columns)


def delete_feeds(feeds: DataFrame, gone: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """Feeds and their children (by feed_id) without those gone."""
    ids = gone.select(F.col("id").alias("feed_id"))
    return {"feeds": feeds.join(gone, "id", "left_anti")} | {n: c.join(ids, "feed_id", "left_anti") for n, c in children.items()}


def new_items(items: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch (feed_id, dedupe_key, pos, ...) to add: the first of each key that the table lacks."""
    first = batch.withColumn("__n", F.row_number().over(W.partitionBy("feed_id", "dedupe_key").orderBy("pos"))).where("__n = 1").drop("__n")
    return first.join(items.select("feed_id", "dedupe_key"), ["feed_id", "dedupe_key"], "left_anti")


def upsert_features(features: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for each item: the one generated last, the batch's in ties."""
    rows = features.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    w = W.partitionBy("item_id").orderBy(F.desc("generated_at"), F.desc("__new"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def apply_outcomes(feeds: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Feed state after a fetch each.  outcomes: (feed_id, status, error_category, error_message, etag, last_modified, feed_title,
    site_url, favicon_url, new_item_count, seq).

    A title once set stays; addresses follow the feed; validators outlive errors; success clears the error fields.
    """
    o = last_change(outcomes, "feed_id").select(F.col("feed_id").alias("id"), *(F.col(c).alias(f"o_{c}") for c in ("status", "error_category", "error_message", "etag", "last_modified", "feed_title", "site_url", "favicon_url", "new_item_count")))
    rows = feeds.join(o, "id", "left")
    hit, error = F.col("o_status").isNotNull(), F.col("o_status") == "error"
    streak = F.when(error, F.col("consecutive_error_count") + 1).otherwise(0)
    interval = next_interval(F.col("fetch_interval_minutes"), streak, F.coalesce("o_new_item_count", F.lit(0)), F.col("o_status"))
    new = {
        "title": F.coalesce("title", "o_feed_title"), "site_url": F.coalesce("o_site_url", "site_url"), "favicon_url": F.coalesce("o_favicon_url", "favicon_url"),
        "etag": F.coalesce("o_etag", "etag"), "last_modified": F.coalesce("o_last_modified", "last_modified"),
        "fetch_interval_minutes": interval, "next_fetch_at": now + F.make_dt_interval(F.lit(0), F.lit(0), interval.cast("int")), "last_fetched_at": now,
        "last_success_at": F.when(error, F.col("last_success_at")).otherwise(now), "last_error_at": F.when(error, now).otherwise(F.col("last_error_at")),
        "last_error_category": F.when(error, F.col("o_error_category")), "last_error_message": F.when(error, F.col("o_error_message")),
        "status": F.when(error, "error").otherwise("active"), "consecutive_error_count": streak,
    }
    return rows.select(*(F.when(hit, new[c].cast(feeds.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in feeds.columns))


def validate_features(features: DataFrame, size: int) -> DataFrame:
    """Features with the list of rules that they break: a ready row has a valid vector and no reason, a skipped one the opposite."""
    ready = F.col("status") == "ready"
    rules = {
        "status": ~F.coalesce(F.col("status").isin("ready", "skipped"), F.lit(False)),
        "vector": F.coalesce(ready & ~valid(F.col("embedding"), size), F.lit(False)),
        "skipped_vector": F.coalesce((F.col("status") == "skipped") & F.col("embedding").isNotNull(), F.lit(False)),
        "version": F.col("algorithm_version").isNull() | (F.col("algorithm_version") == ""),
    }
    return features.withColumn("broken", F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items()))))


def retry_now(feeds: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = feeds.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    on = F.col("__hit").isNotNull()
    return hit.withColumns({"is_paused": F.when(on, False).otherwise(F.col("is_paused")), "next_fetch_at": F.when(on, now).otherwise(F.col("next_fetch_at"))}).select(feeds.columns)


def schedule_retries(failures: DataFrame, now: Column) -> DataFrame:
    """failures: (item_id, attempts, error_category, error_message); when each may be tried again."""
    delay = retry_delay_ms(F.col("attempts"))
    return failures.withColumns({"available_at": F.timestamp_millis(F.unix_millis(now) + delay), "error_message": error_text(F.col("error_message"))})


def checked_feeds(incoming: DataFrame, feeds: DataFrame, folders: DataFrame) -> DataFrame:
    """New feeds (feed_url, folder_id, title, auth_username, auth_password) with their errors: address taken, folder unknown, title or
    credentials unfit."""
    taken = feeds.select("feed_url", F.lit(True).alias("__taken")).distinct()
    known = folders.select(F.col("id").alias("folder_id"), F.lit(True).alias("__known"))
    rows = incoming.join(taken, "feed_url", "left").join(known, "folder_id", "left")
    errors = {
        "conflict": F.col("__taken").isNotNull(), "folder": F.col("folder_id").isNotNull() & F.col("__known").isNull(), "title": F.length(F.coalesce("title", F.lit(""))) > 256,
        "auth": F.col("auth_username").isNull() != F.col("auth_password").isNull(),
    }
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(c, n) for n, c in errors.items())))).drop("__taken", "__known")
