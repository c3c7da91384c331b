"""Subscription lists: OPML documents to rows, and rows in the order of an export."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from feedloom.functions.arrow import normal_url
from feedloom.functions.text import normalized
from feedloom.operators.items import small


@udtf(returnType="pos int, feed_url string, folder_title string, site_url string, title string")
class OpmlOutlines:
    """The feeds of one document in order, each with the title of the nearest outline above it that isn't a feed."""

    def eval(self, doc: str):
        try:
            body = ET.fromstring(doc or "").find("body")
        except ET.ParseError:
            return
        name = lambda e: (e.get("title") or "").strip() or (e.get("text") or "").strip() or None
        stack, pos = [(e, None) for e in reversed(body if body is not None else [])], 0
        while stack:
            e, folder = stack.pop()
            url = (e.get("xmlUrl") or "").strip()
            if e.tag == "outline" and url:
                yield pos, url, folder, e.get("htmlUrl"), name(e)
                pos += 1
            elif e.tag == "outline":
                folder = name(e) or folder
            stack += [(c, folder) for c in reversed(e)]


def subscriptions(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, feed_url, folder_title, site_url, title) of documents (doc_id, body); of one address the first counts."""
    spark = documents.sparkSession
    spark.udtf.register("opml_outlines", OpmlOutlines)
    rows = spark.sql("select d.doc_id, o.* from {docs} d, lateral opml_outlines(d.body) o", docs=documents)
    rows = rows.withColumns({"feed_url": normal_url(F.col("feed_url")), "site_url": normal_url(F.col("site_url")), "title": normalized(F.col("title"))}).where("feed_url is not null")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "feed_url").orderBy("pos"))).where("n = 1").drop("n")


def export_rows(feeds: DataFrame, folders: DataFrame) -> DataFrame:
    """(place, folder_title, feed_url, site_url, text, is_paused): feeds with their place in the order of folders, a struct that
    sorts as the list does, so that no row has to be numbered."""
    own = folders.select(F.col("id").alias("folder_id"), F.col("title").alias("folder_title"), "position", F.col("created_at").alias("folder_created"))
    place = F.struct("position", "folder_created", "created_at", "id")  # nulls sort first
    rows = feeds.join(small(own), "folder_id", "left").withColumn("place", place)
    return rows.select("place", "folder_title", "feed_url", "site_url", F.coalesce("title", "feed_url").alias("text"), "is_paused")


def export_outline(feeds: DataFrame, folders: DataFrame) -> DataFrame:
    """Export rows by folder title in order of first appearance, those in no folder last; folders of one title are one.
    ``group_first`` is the id of the first feed of the title."""
    rows = export_rows(feeds, folders)
    first = rows.where("folder_title is not null").groupBy("folder_title").agg(F.min("place").alias("group"))
    out = rows.join(first, "folder_title", "left").orderBy(F.asc_nulls_last("group"), "place")
    return out.withColumn("group_first", F.col("group.id")).drop("group")
