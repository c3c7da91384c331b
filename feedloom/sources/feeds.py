"""Landed feed responses to items: RSS 2.0, RSS 1.0 (RDF) and Atom, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.arrow import favicon_url, first_url
from feedloom.functions.feeds import dedupe_key, extensions, published_at, text_of
from feedloom.functions.text import normalized

RESPONSES = "feed_id string, http_status int, etag string, last_modified string, body string, error string, fetched_at timestamp, duration_ms int"

CHANNEL = "title:string,link:array<string>,image:struct<url:string>,item:array<variant>"
SCHEMAS = {
    "rss": f"channel struct<{CHANNEL}>",
    "RDF": f"channel struct<{CHANNEL}>, item array<variant>",
    "feed": "title string, icon string, logo string, link array<struct<`@_href`:string,`@_rel`:string>>, entry array<variant>",
}
#: Options of the XML reader; names of attributes and of an element's own text are as stored extension data has them.
READ = {"ignoreNamespace": "false", "attributePrefix": "@_", "valueTag": "#text"}
#: A private character in front of each value keeps the reader from taking it for a number, truth value or date.
MARK = chr(0x10FFFD)


def classified(responses: DataFrame) -> DataFrame:
    """Responses with their outcome: not_modified (no body), error with its category, or success."""
    ok = F.col("http_status").between(200, 299)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("http_status") == 304, "not_modified").when(F.coalesce(ok, F.lit(False)), "success").otherwise("error")
    return responses.withColumn("status", status).withColumns({"body": F.when(F.col("status") == "success", F.col("body")), "error_category": F.when(F.col("status") == "error", "network")})


def kind_of(body: Column) -> Column:
    """Local name of the document's first element."""
    return F.regexp_extract(F.regexp_extract(body, r"<(?![?!])([\w:.-]+)", 1), r"([^:]+)$", 1)


def kept_references(body: Column) -> Column:
    """Body with character references outside CDATA kept as they are written."""
    parts = F.regexp_extract_all(body, F.lit(r"(<!\[CDATA\[[\s\S]*?\]\]>|(?:(?!<!\[CDATA\[)[\s\S])+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<![CDATA["), p).otherwise(F.replace(p, F.lit("&"), F.lit("&amp;")))), "")


def marked(body: Column) -> Column:
    """Body without its declaration, values marked as texts: what follows a tag or an attribute's equals sign."""
    bare = F.regexp_replace(body, r"^\s*<\?xml[^>]*\?>", "")
    values = F.regexp_replace(bare, r"([\w:.-]\s*=\s*[\"'])(?=\s*[-+.\dtTfFnNiI])", f"$1{MARK}")
    return F.regexp_replace(values, r"(<!\[CDATA\[|>)(\s*)(?=[^\s<\]])", f"$1$2{MARK}")


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(""))


def alternates(links: Column, href: str, rel: str) -> Column:
    """Addresses of the links that may be the page itself, in order."""
    fit = F.filter(links, lambda x: x[href].isNotNull() & F.coalesce(normalized(x[rel]).isNull() | (normalized(x[rel]) == "alternate"), F.lit(True)))
    return F.transform(fit, lambda x: x[href])


def links_of(entry: Column) -> Column:
    """Link elements of an Atom entry, one or several, as structs."""
    many = F.try_variant_get(entry, "$.link", "array<variant>")
    one = F.try_variant_get(entry, "$.link", "variant")
    listed = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))
    part = lambda v, k: unmarked(F.try_variant_get(v, f"$['@_{k}']", "string")).alias(k)
    return F.transform(listed, lambda v: F.struct(part(v, "href"), part(v, "rel")))


def documents(responses: DataFrame, strict: bool = False) -> DataFrame:
    """(feed_id, feed_title, site_url, icon_url, items) of classified responses of status success; items is null where a document is empty,
    malformed or of another kind.  ``feed_rows`` and ``item_rows`` derive their rows from this; persist it to parse once for both.

    Items are read as variants, so elements of any name are kept.  With ``strict`` the items of RSS 1.0 are read inside the channel
    only, where standard documents have none.
    """
    docs = responses.where("status = 'success'").select("feed_id", "body").withColumn("kind", kind_of(F.col("body")))
    own = marked(kept_references(F.col("body")))
    read = lambda k: F.when(F.col("kind") == k, F.from_xml(own, SCHEMAS[k], READ))
    docs = docs.select("feed_id", "kind", read("rss").alias("rss"), read("RDF").alias("rdf"), read("feed").alias("atom"))
    first = lambda *c: F.coalesce(*(normalized(x) for x in c))

    def rss_items(items: Column) -> Column:
        t = lambda x, *n: [unmarked(text_of(x, k)) for k in n]
        return F.transform(items, lambda x: F.struct(
            first(*t(x, "guid")).alias("guid"), first(*t(x, "title")).alias("title"), F.array(*t(x, "link")).alias("urls"), first(*t(x, "dc:creator", "author", "itunes:author")).alias("author"),
            first(*t(x, "description", "summary")).alias("summary_text"), first(*t(x, "content:encoded", "description")).alias("content_html"),
            published_at(*t(x, "pubDate", "published", "updated", "dc:date")).alias("published_at"), unmarked(extensions(x)).alias("raw"),
        ))

    def atom_items(items: Column) -> Column:
        t = lambda x, *n: [unmarked(text_of(x, k)) for k in n]
        return F.transform(items, lambda x: F.struct(
            first(*t(x, "id")).alias("guid"), first(*t(x, "title")).alias("title"), alternates(links_of(x), "href", "rel").alias("urls"), first(F.coalesce(unmarked(text_of(x, "author", "name")), *t(x, "itunes:author"))).alias("author"),
            first(*t(x, "summary")).alias("summary_text"), first(*t(x, "content", "summary")).alias("content_html"),
            published_at(*t(x, "published", "updated", "created")).alias("published_at"), unmarked(extensions(x)).alias("raw"),
        ))

    none = F.array().cast("array<variant>")
    rdf = F.coalesce(F.col("rdf.channel.item"), none) if strict else F.coalesce(F.col("rdf.item"), F.col("rdf.channel.item"))
    rss = F.coalesce(F.col("rss.channel.item"), F.when(F.col("rss.channel").isNotNull(), none))
    atom = F.coalesce(F.col("atom.entry"), F.when(F.col("atom").isNotNull() & F.col("atom.title").isNotNull(), none))
    rows = F.when(F.col("kind") == "feed", atom_items(atom)).otherwise(rss_items(F.coalesce(rss, rdf)))
    site = F.when(F.col("kind") == "feed", alternates(F.col("atom.link"), "@_href", "@_rel")).otherwise(F.array(F.coalesce(F.get("rss.channel.link", F.lit(0)), F.get("rdf.channel.link", F.lit(0)))))
    icons = F.array(F.col("rss.channel.image.url"), F.col("rdf.channel.image.url"), F.col("atom.icon"), F.col("atom.logo"))
    clean = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull()), unmarked)
    return docs.select(
        "feed_id", first(*(unmarked(F.col(c)) for c in ("rss.channel.title", "rdf.channel.title", "atom.title"))).alias("feed_title"),
        first_url(clean(site)).alias("site_url"), first_url(clean(icons)).alias("icon_url"), rows.alias("items"),
    )


def feed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """(feed_id, status, error_category, feed_title, site_url, favicon_url, new_item_count, missing_published_at_count) of parsed documents;
    those that could not be read have status error and category parse.  ``more`` are further columns, made from the documents' own."""
    bad = F.col("items").isNull()
    missing = F.size(F.filter("items", lambda x: x["published_at"].isNull()))
    return docs.select(
        "feed_id", F.when(bad, "error").otherwise("success").alias("status"), F.when(bad, "parse").alias("error_category"), F.when(~bad, F.col("feed_title")).alias("feed_title"), F.when(~bad, F.col("site_url")).alias("site_url"),
        F.when(~bad, F.coalesce("icon_url", favicon_url(F.col("site_url")))).alias("favicon_url"), F.when(bad, 0).otherwise(F.size("items")).alias("new_item_count"), F.when(bad, 0).otherwise(missing).alias("missing_published_at_count"), *more,
    )


def item_rows(docs: DataFrame) -> DataFrame:
    """One row for each item of parsed documents, with its place in the document, dedupe key and extension data."""
    items = docs.select("feed_id", F.posexplode("items").alias("pos", "x")).select("feed_id", "pos", "x.*").withColumn("url", first_url(F.filter("urls", lambda u: u.isNotNull()))).drop("urls")
    key = dedupe_key(F.col("feed_id"), F.col("guid"), F.col("url"), F.col("title"), F.col("published_at"))
    return items.withColumnRenamed("raw", "raw_extension_data").withColumn("dedupe_key", key)


def parse_feeds(responses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(feeds, items) of classified responses of status success."""
    docs = documents(responses, strict)
    return feed_rows(docs), item_rows(docs)


def outcomes(responses: DataFrame, strict: bool = False, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one outcome for each response, items): what fetched documents say, and the others' own status.  ``docs`` are these responses' ``documents``,
    if the caller has them already."""
    known = classified(responses)
    docs = documents(known, strict) if docs is None else docs
    feeds, items = feed_rows(docs), item_rows(docs)
    rest = known.where("status <> 'success'").select("feed_id", "status", "error_category", *(F.lit(None).cast("string").alias(c) for c in ("feed_title", "site_url", "favicon_url")), F.lit(0).alias("new_item_count"), F.lit(0).alias("missing_published_at_count"))
    meta = responses.select("feed_id", F.col("http_status"), "etag", "last_modified", F.col("error").alias("error_message"), "fetched_at", "duration_ms")
    return feeds.union(rest).join(meta, "feed_id"), items
