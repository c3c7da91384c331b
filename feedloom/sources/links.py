"""Links of pages, feed discovery and list files."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.functions.text import normalized
from feedloom.functions.urls import content_type, is_http

MAX_BYTES = 5 * 1024 * 1024
# Media types of feeds.
FEED_TYPES = "application/atom+xml application/feed+json application/json application/rdf+xml application/rss+xml application/xml text/xml".split()
LINKS = "page_id long, pos int, tag string, rel string, type string, href string, title string"


class Links(HTMLParser):
    def __init__(self, page: str):
        super().__init__()
        self.base, self.page, self.found = None, page, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "base" and self.base is None and a.get("href"):
            self.base = a["href"]
        elif tag in ("link", "a") and a.get("href"):
            self.found.append((tag, a.get("rel"), a.get("type"), a["href"].strip(), a.get("title")))

    handle_startendtag = handle_starttag

    def resolved(self, href: str) -> str | None:
        try:
            return urljoin(urljoin(self.page, self.base or ""), href)
        except ValueError:
            return None


def page_links(pages: DataFrame) -> DataFrame:
    """Every ``link`` and ``a`` with an address, resolved against the page and its base, in document order."""

    def read(batches):
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.page_id, batch.url, batch.html, strict=True):
                parser = Links(url or "")
                parser.feed(html or "")
                parser.close()
                rows += [(page, n, tag, rel, kind, parser.resolved(href), title) for n, (tag, rel, kind, href, title) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "tag", "rel", "type", "href", "title"])

    return pages.select("page_id", "url", "html").mapInPandas(read, LINKS)


def sized(pages: DataFrame, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Pages with an error for those too long or without a web address."""
    return pages.withColumn("error", F.when(F.octet_length("html") > most_bytes, "too_large").when(~is_http(F.col("url")), "bad_url"))


def discover(pages: DataFrame) -> DataFrame:
    """(page_id, pos, feed_url, title, type): feeds that pages name, each address once in document order."""
    fit = sized(pages).where("error is null")
    rels = F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+")
    links = page_links(fit).where((F.col("tag") == "link") & F.array_contains(rels, "alternate") & content_type(F.col("type")).isin(*FEED_TYPES) & is_http(F.col("href")))
    first = links.withColumn("n", F.row_number().over(W.partitionBy("page_id", "href").orderBy("pos"))).where("n = 1")
    return first.select("page_id", "pos", F.col("href").alias("feed_url"), normalized(F.col("title")).alias("title"), content_type(F.col("type")).alias("type"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a list file: a line each, blank lines and those that start with # passed over."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def bulk_add(urls: DataFrame, pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row of counts: listed pages, feeds added (the first of each page, if new), pages that gave none."""
    w = W.partitionBy("page_id").orderBy("pos")
    first = discover(pages).withColumn("n", F.row_number().over(w)).where("n = 1").select("page_id", "feed_url")
    listed = urls.join(pages.select("page_id", "url"), "url", "left").join(first, "page_id", "left").join(feeds.select("feed_url", F.lit(True).alias("known")), "feed_url", "left")
    return listed.agg(F.count("*").alias("processed"), F.count_if(F.col("feed_url").isNotNull() & F.col("known").isNull()).alias("added"), F.count_if(F.col("feed_url").isNull()).alias("failed"))
