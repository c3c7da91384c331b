"""Item queries: filters, search, keyset pages, projections."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.arrow import normal_url
from feedloom.functions.feeds import media, summary_or_description
from feedloom.functions.text import matches_all, simple_tokens
from feedloom.operators.postings import PostingIndex, holding_all, parts_of

#: Feeds joined by broadcast where their plan's size is known to be below this.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if Spark's own estimate proves it small; else as it is, for a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


@dataclass(frozen=True)
class Cursor:
    """Last row of the page before: its date (microseconds, null if it has none) and id."""

    published_us: int | None
    id: int


def filters(feed_id=None, folder_id=None, read: bool | None = None, starred: bool | None = None) -> Column:
    """All given conditions together; those that are None don't enter the plan."""
    found = [c for v, c in ((feed_id, F.col("feed_id") == feed_id), (folder_id, F.col("folder_id") == folder_id), (read, F.col("is_read") == read), (starred, F.col("is_starred") == starred)) if v is not None]
    out = F.lit(True)
    for c in found:
        out = out & c
    return out


def after(cursor: Cursor | None) -> Column:
    """Rows behind the cursor in the order of dates falling, nulls last, then ids falling."""
    if cursor is None:
        return F.lit(True)
    if cursor.published_us is None:
        return F.col("published_at").isNull() & (F.col("id") < cursor.id)
    at = F.timestamp_micros(F.lit(cursor.published_us))
    return (F.col("published_at") < at) | ((F.col("published_at") == at) & (F.col("id") < cursor.id)) | F.col("published_at").isNull()


def newest() -> tuple[Column, Column]:
    return F.desc_nulls_last("published_at"), F.desc("id")


def with_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    return items.join(small(feeds.select(F.col("id").alias("feed_id"), "folder_id", F.col("title").alias("feed_title"))), "feed_id")


def own_text() -> list[Column]:
    return [F.col("title"), F.col("summary_text"), F.regexp_replace(F.col("content_html"), "<[^>]*>", " "), F.col("author")]


def search(items: DataFrame, query: str) -> DataFrame:
    """Items all of whose query tokens are in their own text, or all in their feed's title; each once."""
    q = F.lit(query)
    own = matches_all(q, *own_text())
    return items.where(own | matches_all(q, F.col("feed_title")))


def search_union(items: DataFrame, query: str) -> DataFrame:
    """The same as a distinct union of the two kinds of hits, for indexes that serve either."""
    q = F.lit(query)
    own = matches_all(q, *own_text())
    return items.where(own).union(items.where(matches_all(q, F.col("feed_title")))).dropDuplicates(["id"])


def search_index(items: DataFrame) -> PostingIndex:
    """An index of the items' own words, for ``search_indexed``; ``save`` it once and add new items as further runs."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in own_text()))
    return PostingIndex.of(items.select(F.col("id").alias("item_id"), F.explode(F.array_distinct(simple_tokens(text))).alias("token"), F.lit(1.0).alias("weight")), parts=parts_of(items, F.col("title"), F.col("summary_text"), F.col("content_html"), F.col("author")))


def search_indexed(items: DataFrame, feeds: DataFrame, index: PostingIndex, query: str) -> DataFrame:
    """The items of ``search`` by the index of their words and the titles of their feeds; no item's text is read."""
    spark = items.sparkSession
    asked = spark.range(1).select(F.col("id").alias("query_id"), simple_tokens(F.lit(query)).alias("tokens"))
    own = holding_all(index, asked).select(F.col("item_id").alias("id"))
    titled = feeds.where(matches_all(F.lit(query), F.col("title"))).select(F.col("id").alias("feed_id"))
    by_feed = items.select("id", "feed_id").join(titled, "feed_id", "left_semi").select("id")
    return items.join(own.union(by_feed).distinct(), "id", "left_semi")


def page(items: DataFrame, feeds: DataFrame, query: str | None = None, cursor: Cursor | None = None, limit: int = 100, **conditions) -> DataFrame:
    """A page of ``limit`` items and one more, which tells that another page follows.

    The order is total, so consecutive pages make up the whole list.  Items that have ``raw_extension_data`` come with media and the
    summary that it may supply, worked out for the page's rows alone.  A query of blanks is an error.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    if query is not None and not query.strip():
        raise ValueError("a query needs text")
    rows = with_feeds(items, feeds).where(filters(**conditions))
    rows = search(rows, query) if query is not None else rows
    rows = rows.where(after(cursor)).orderBy(*newest()).limit(limit + 1)
    return projected(rows).orderBy(*newest()) if "raw_extension_data" in rows.columns else rows


def projected(items: DataFrame, raw: str = "raw_extension_data") -> DataFrame:
    """Items with media and the summary that extension data may supply."""
    found = items.withColumns({"media": media(F.col(raw), F.col("url")), "summary_text": summary_or_description(F.col("summary_text"), F.col(raw))})
    m = F.col("media")
    return found.withColumn("media", m.withField("enclosure_url", normal_url(m["enclosure_url"])).withField("image_url", normal_url(m["image_url"])))
