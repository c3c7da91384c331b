"""Golden values of feed documents, schedules, alerts, text features, media and pages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import arrow, feeds, text, urls, vectors, weburl
from feedloom.operators import items as I
from feedloom.operators import maintenance as M
from feedloom.operators import statistics as S
from feedloom.operators.features import embedded, hashed_embedder, prepared
from feedloom.sources import feeds as SF
from feedloom.sources import links as SL
from feedloom.sources.opml import subscriptions
from feedloom.sources.tables import NOW_US

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="c" xmlns:dc="d"><channel><title>Harbour notes</title><link>https://harbour.test</link>
<item><title>Tides &amp; ropes</title><link>https://harbour.test/log/ropes</link><guid isPermaLink="false">hn:0042</guid><dc:creator>Mira</dc:creator><author>Desk</author><pubDate>Tue, 03 Mar 2026 07:20:00 GMT</pubDate>
<content:encoded><![CDATA[<div>Knots &amp; bends</div>]]></content:encoded><description>On rope</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Orchard diary</title><link rel="self" href="https://orchard.test/d.atom"/><link href="https://orchard.test"/>
<entry><title>Grafting</title><id>urn:orchard:7</id><author><name>Tove</name></author><link rel="alternate" href="https://orchard.test/d/7"/><updated>2026-03-03T07:20:00Z</updated><content>Cut low</content></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d"><channel><title>Quarry list</title><link>https://quarry.test</link></channel><item><title>Slate</title><link>https://quarry.test/slate</link><dc:date>2026-03-03T07:20:00Z</dc:date></item></rdf:RDF>"""
AT = datetime(2026, 3, 3, 7, 20)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def landed(spark, *bodies):
    return spark.createDataFrame([(str(k), 200, None, None, b, None, AT, 5) for k, b in enumerate(bodies)], SF.RESPONSES)


def test_feed_documents(spark):
    bad = ["", "<html><body>no feed</body></html>", "<rss><channel><title>cut", "<rss version='2.0'><channel><title>Empty</title></channel></rss>", "<rss><channel><title>x</title><item><title>undated</title></item></channel></rss>"]
    f, items = SF.parse_feeds(SF.classified(landed(spark, RSS, ATOM, RDF, *bad)))
    rows = {r.feed_id: r for r in f.collect()}
    assert [(rows[k].status, rows[k].error_category) for k in "345"] == [("error", "parse")] * 3
    assert [(rows[k].status, rows[k].new_item_count, rows[k].missing_published_at_count) for k in "01267"] == [("success", 1, 0)] * 3 + [("success", 0, 0), ("success", 1, 1)]
    assert (rows["0"].feed_title, rows["0"].site_url, rows["0"].favicon_url) == ("Harbour notes", "https://harbour.test/", "https://harbour.test/favicon.ico")
    assert rows["1"].site_url == "https://orchard.test/"
    one = {r.feed_id: r for r in items.collect()}
    r = one["0"]
    assert (r.guid, r.title, r.author, r.summary_text, r.content_html, r.published_at) == ("hn:0042", "Tides &amp; ropes", "Mira", "On rope", "<div>Knots &amp; bends</div>", AT)
    assert (one["1"].guid, one["1"].url, one["1"].author, one["1"].content_html, one["1"].published_at) == ("urn:orchard:7", "https://orchard.test/d/7", "Tove", "Cut low", AT)
    assert one["2"].published_at == AT and one["7"].published_at is None
    assert SF.parse_feeds(SF.classified(landed(spark, RDF)), strict=True)[1].count() == 0


def test_response_classes(spark):
    rows = [("a", 304, None, None, "x", None, AT, 1), ("b", 500, None, None, "x", None, AT, 1), ("c", None, None, None, None, "timeout", AT, 1), ("d", 200, "e", "l", RSS, None, AT, 1)]
    log, items = SF.outcomes(spark.createDataFrame(rows, SF.RESPONSES))
    got = {r.feed_id: (r.status, r.error_category, r.http_status) for r in log.collect()}
    assert got == {"a": ("not_modified", None, 304), "b": ("error", "network", 500), "c": ("error", "network", None), "d": ("success", None, 200)}
    assert items.count() == 1


def test_schedule_activity_and_retries(spark):
    cases = [(60, 1, 0, "error", 120), (120, 0, 0, "not_modified", 150), (240, 0, 3, "success", 180), (60, 0, 10, "success", 60), (60, 3, 0, "error", 150), (80, 4, 0, "error", 200), (1400, 9, 0, "error", 1440)]
    df = spark.createDataFrame(cases, "cur long, errors long, new long, status string, want long")
    assert df.where(feeds.next_interval(F.col("cur"), F.col("errors"), F.col("new"), F.col("status")) != F.col("want")).count() == 0
    assert [value(spark, feeds.activity(F.lit(360), F.lit(n))) for n in (0, 1)] == ["inactive", "active"]
    assert [value(spark, feeds.retry_delay_ms(F.lit(n))) for n in (1, 2, 10, 20)] == [60_000, 120_000, 30_720_000, 86_400_000]


def test_fetch_transitions(spark):
    kind = "id long, title string, site_url string, favicon_url string, status string, etag string, last_modified string, fetch_interval_minutes int, next_fetch_at timestamp, last_fetched_at timestamp, last_success_at timestamp, last_error_at timestamp, last_error_category string, last_error_message string, consecutive_error_count int"
    old = [(k, t, "s", None, "active", "tag", None, c, None, None, None, None, "network", "m", e) for k, t, c, e in ((1, None, 120, 0), (2, "kept", 60, 2), (3, "x", 60, 4), (4, "y", 60, 0))]
    o = "feed_id long, status string, error_category string, error_message string, etag string, last_modified string, feed_title string, site_url string, favicon_url string, new_item_count int, seq int"
    new = [(1, "success", None, None, "new", None, "Title", "s2", None, 2, 1), (2, "error", "parse", "bad", None, None, "other", None, None, 0, 1), (3, "not_modified", None, None, None, None, None, None, None, 0, 1)]
    got = {r.id: r for r in M.apply_outcomes(spark.createDataFrame(old, kind), spark.createDataFrame(new, o), F.timestamp_micros(F.lit(NOW_US))).collect()}
    assert (got[1].fetch_interval_minutes, got[1].title, got[1].etag, got[1].site_url, got[1].last_error_category) == (90, "Title", "new", "s2", None)
    assert (got[2].fetch_interval_minutes, got[2].consecutive_error_count, got[2].title, got[2].etag, got[2].status) == (150, 3, "kept", "tag", "error")
    assert (got[3].fetch_interval_minutes, got[3].status, got[3].consecutive_error_count, got[3].last_error_message) == (90, "active", 0, None)
    assert got[4].last_fetched_at is None and got[4].last_error_message == "m"


def test_text_features(spark):
    html = "<section><style>b{}</style><h2>Bread oven</h2><svg><text>icon</text></svg><p>Flour &amp; salt.</p><script>run()</script></section>"
    assert arrow.visible_text(html) == "Bread oven Flour & salt."
    rows = [(1, "Lighthouse lens repair", "<p>Lighthouse lens repair</p>", "<p>Lighthouse lens repair</p><p>Brass rings hold every prism.</p>"), (2, "Старий маяк Fresnel", None, None), (3, "Oh", None, "Oh"), (4, None, None, None)]
    got = {r.id: r for r in prepared(spark.createDataFrame(rows, "id long, title string, summary_text string, content string")).collect()}
    assert got[1].model_text == "query: Lighthouse lens repair\n\nBrass rings hold every prism."
    assert got[1].lexical_terms == ["lighthouse", "lens", "repair"]
    assert (got[2].lexical_terms, got[2].skip_reason) == (["старий", "маяк", "fresnel"], None)
    assert got[3].skip_reason == got[4].skip_reason == "insufficient_text"
    assert value(spark, text.tokens(F.lit("Try f# or g++ on qt.io, r7._ -y-"))) == ["try", "f#", "or", "g++", "on", "qt.io", "r7", "y"]
    assert value(spark, text.utf16_length(F.lit("a\U0001f389"))) == 3
    assert value(spark, text.near_duplicate_titles(F.lit("Red kite over mill"), F.lit("red KITE over, mill!")))
    assert not value(spark, text.near_duplicate_titles(F.lit("red kite"), F.lit("red kite")))


def test_urls(spark):
    cases = {"https://Mill.Test:443": "https://mill.test/", "http://k.l/m#n": "http://k.l/m#n", "not one": None, "": None, "mailto:p@q": "mailto:p@q", "http://": None}
    assert {k: weburl.href(k) for k in cases} == cases
    assert value(spark, arrow.canonical_url(F.lit(" HTTPS://Mill.Test/W//?v=2#g "))) == "https://mill.test/W?v=2"
    assert value(spark, arrow.canonical_url(F.lit("Plain Words "))) == "plain words"
    assert value(spark, urls.content_type(F.lit(" Application/RSS+xml; charset=x"))) == "application/rss+xml"
    for url, want in (("https://youtu.be/kq-77_zz", "kq-77_zz"), ("https://www.youtube.com/watch?v=mnopq88", "mnopq88"), ("https://m.youtube.com/shorts/rstuv99?x", "rstuv99"), ("https://youtube.com/watch?v=a b", None), ("https://films.test/watch?v=mnopq88", None)):
        assert value(spark, urls.youtube_id(F.lit(url))) == want


def test_media(spark):
    video = '{"yt:videoId":"clip_907","media:group":{"media:thumbnail":[{"@_url":"https://img.test/c.jpg"}],"yt:duration":{"@_seconds":"310"},"media:description":"A boat trip"},"enclosure":{"@_url":"https://snd.test/a.mp3","@_type":"audio/mpeg"}}'
    sound = '{"itunes:duration":"02:04:09","enclosure":{"@_url":"https://snd.test/a.mp3","@_type":"audio/mpeg"}}'
    rows = spark.createDataFrame([(1, video, None), (2, sound, " "), (3, None, "own"), (4, '{"enclosure":{"@_url":"https://snd.test/a.mp3","@_type":"audio/ogg"}}', None)], "id long, raw_extension_data string, summary_text string").withColumn("url", F.lit("https://x.example/"))
    got = {r.id: (r.media, r.summary_text) for r in I.projected(rows).collect()}
    m, summary = got[1]
    assert (m.kind, m.duration_seconds, m.player_url, m.enclosure_url, m.mime_type, m.image_url, summary) == ("youtube", 310.0, "https://www.youtube-nocookie.com/embed/clip_907", None, None, "https://img.test/c.jpg", "A boat trip")
    assert (got[2][0].kind, got[2][0].duration_seconds, got[2][1]) == ("podcast", 7449.0, None)
    assert (got[3][0].kind, got[3][1]) == (None, "own")
    assert got[4][0].kind == "audio"
    assert value(spark, feeds.duration_seconds(F.lit("1:2:3:4"))) is None and value(spark, feeds.duration_seconds(F.lit("1:x"))) is None
    assert value(spark, feeds.extension_data(F.lit('{"dc:x":"1","plain":"2","enclosure":{"a":1}}'))) == {"dc:x": "1", "enclosure": '{"a":1}'}


def test_alerts(spark):
    rows = [(1, k, "error", None, "success", 0, 1, 500 if k % 2 else 401) for k in range(150)] + [(2, 200, "success", None, "error", 7, 0, 200), (2, 201, "error", "parse", "error", 2, 3, 500), (2, 202, "error", "parse", "error", 3, 4, 500)]
    df = spark.createDataFrame(rows, "cycle_id long, id long, status string, error_category string, previous_status string, previous_error_count long, error_count long, http_status int")
    got = S.cycle_alerts(df).collect()
    first = [r for r in got if r.cycle_id == 1]
    assert (len(first), {r.omitted for r in first}, {r.section for r in first}) == (120, {30}, {2, 5})
    assert [(feeds.SECTIONS[r.section - 1], r.id) for r in sorted((r for r in got if r.cycle_id == 2), key=lambda r: r.line)] == [("recovered", 200), ("persistent_error/threshold", 201)]


def test_pages_make_up_the_list(spark, sf):
    from feedloom.sources.tables import view

    items, own = view(spark, sf, "items").where("id % 20 = 0"), view(spark, sf, "feeds")
    seen, cursor = [], None
    while True:
        rows = I.page(items, own, cursor=cursor, limit=30).select("id", F.unix_micros("published_at").alias("at")).collect()
        seen += [r.id for r in rows[:30]]
        if len(rows) <= 30:
            break
        cursor = I.Cursor(rows[29].at, rows[29].id)
    assert seen == [r.id for r in I.with_feeds(items, own).orderBy(*I.newest()).select("id").collect()]
    with pytest.raises(ValueError):
        I.page(items, own, limit=101)
    with pytest.raises(ValueError):
        I.page(items, own, query="  ")


def test_subscriptions_and_import(spark):
    doc = """<opml><body><outline xmlUrl="https://p.test/atom" text="P"/><outline title="Crafts"><outline text="Wood"><outline title="Q" xmlUrl="https://q.test/rss" htmlUrl="https://q.test"/></outline>
        <outline text="R" xmlUrl="https://r.test/rss"/></outline><outline xmlUrl="https://q.test/rss"/></body></opml>"""
    rows = subscriptions(spark.createDataFrame([(1, doc), (2, "<broken"), (3, None)], "doc_id long, body string"))
    got = [(r.feed_url, r.folder_title, r.title) for r in rows.orderBy("pos").collect()]
    assert got == [("https://p.test/atom", None, "P"), ("https://q.test/rss", "Wood", "Q"), ("https://r.test/rss", "Crafts", "R")]
    known = spark.createDataFrame([(1, "https://p.test/atom")], "id long, feed_url string")
    folders = spark.createDataFrame([(1, "Crafts", 4)], "id long, title string, position long")
    made, placed, counts = M.import_subscriptions(known, folders, rows)
    assert [(r.title, r.position) for r in made.collect()] == [("Wood", 5)]
    assert counts.first().asDict() == {"created_feeds": 2, "created_folders": 1, "skipped_feeds": 1}
    assert {r.feed_url: r.folder_id for r in placed.collect()}["https://r.test/rss"] == "1"


def test_discovery(spark, tmp_path):
    page = """<html><head><title>Mill</title><link rel="icon" type="image/png" href="i.png"><base href="/wheel/"><link type="application/atom+xml; q=1" rel="home ALTERNATE" href="grain.atom">
        <link rel="alternate" title=" Flour prices " type="application/rss+xml" href="/prices.rss"><link rel="alternate" type="application/pdf" href="/p.pdf"><link rel="author" type="application/rss+xml" href="/a.rss">
        <link rel="alternate" type="application/rss+xml" href="/prices.rss"></head></html>"""
    pages = spark.createDataFrame([(1, "https://mill.test/q", page), (2, "ftp://mill.test", page), (3, "https://weir.test", None)], "page_id long, url string, html string")
    assert [(r.feed_url, r.title) for r in SL.discover(pages).orderBy("pos").collect()] == [("https://mill.test/wheel/grain.atom", None), ("https://mill.test/prices.rss", "Flour prices")]
    (tmp_path / "urls.txt").write_text("https://weir.test\n   \n# later\n https://mill.test/q \n")
    listed = SL.url_list(spark, str(tmp_path / "urls.txt"))
    assert SL.bulk_add(listed, pages, spark.createDataFrame([], "id long, feed_url string")).first().asDict() == {"processed": 2, "added": 1, "failed": 1}


def test_embedding_batches_fail_alone(spark):
    def odd(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no model")
        return hashed_embedder(8)(texts)

    rows = spark.createDataFrame([(k, "bad" if k == 5 else "fine words") for k in range(12)], "id long, model_text string").coalesce(1)
    got = embedded(rows, odd, 8, batch_size=4).collect()
    assert {r.id for r in got if r.error} == {4, 5, 6, 7}
    assert value(spark, vectors.valid(F.array(F.lit(1.0), F.lit(float("nan"))), 2)) is False


def test_entries_are_parsed_once(spark, sf):
    from feedloom.plans import registry, textual  # noqa: F401

    plan = registry.QUERIES["ingested_entries"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_bodies_are_read_once(spark, sf):
    from feedloom.plans import registry, textual  # noqa: F401

    plan = registry.QUERIES["embeddings_of_articles"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("noscript") <= 6, plan.count("noscript")


@pytest.mark.parametrize("name", ["streamed_features", "streamed_items"])
def test_streams_are_landed_by_all_tasks(spark, sf, name, monkeypatch):
    """What a stream reads is written by the tasks that have it, not by two of them."""
    from pyspark.sql.classic.dataframe import DataFrame

    from feedloom.plans import registry, textual  # noqa: F401

    asked = []
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n, f=DataFrame.coalesce: asked.append(n) or f(self, n))
    registry.QUERIES[name](spark, sf)
    assert 2 not in asked
