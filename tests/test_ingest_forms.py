"""Feed documents with unlisted extensions, odd links and dates of every form."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import feeds as FF
from feedloom.operators import items as I
from feedloom.sources import feeds as SF

KIND = SF.RESPONSES
AT = datetime(2026, 1, 2)


def items_of(spark, *bodies):
    rows = spark.createDataFrame([(str(k), 200, None, None, b, None, AT, 1) for k, b in enumerate(bodies)], KIND)
    feeds, items = SF.parse_feeds(SF.classified(rows))
    return feeds.orderBy("feed_id").collect(), items.orderBy("feed_id", "pos").collect()


PLAIN = """<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:media="m" xmlns:itunes="i" xmlns:x="x"><channel><title>42</title><link>HTTPS://Pod.test</link><image><url>https://pod.test/i.png</url></image>
<item><title>007</title><guid isPermaLink="false">0042</guid><link>not an address</link><itunes:episode>007</itunes:episode><itunes:explicit>true</itunes:explicit><x:empty/><x:when>2026-01-02</x:when><x:at>2026-01-02T03:04:05Z</x:at>
<media:group><media:thumbnail url="https://pod.test/a.jpg" width="1.50"/><media:thumbnail url="https://pod.test/b.jpg"/><media:description> Told &amp; retold </media:description><media:content url="c" duration="1e3"/></media:group>
<enclosure url="https://pod.test/1.mp3" length="0012" type="audio/mpeg"/><enclosure url="https://pod.test/2.mp3" length="5" type="audio/mpeg"/>
<x:mixed a="1">own<b>bold</b></x:mixed><x:tag>one</x:tag><x:tag>two</x:tag><x:tag k="v">three</x:tag><x:code><![CDATA[ 12 <i> & ]]></x:code><plain>dropped</plain><pubDate>Fri, 24 Apr 2026 10:00:00 EST</pubDate></item>
<item rdf:about="here" xmlns:rdf="r"><title>One</title><title>Two</title><link>https://pod.test/x?a=1&amp;b=2</link></item></channel></rss>"""


def test_extensions_of_any_name(spark):
    (feed,), (one, two) = items_of(spark, PLAIN)
    assert (feed.feed_title, feed.site_url, feed.favicon_url) == ("42", "https://pod.test/", "https://pod.test/i.png")
    assert (one.title, one.guid, one.url) == ("007", "0042", None)
    assert one.published_at == datetime(2026, 4, 24, 15)
    assert json.loads(one.raw_extension_data) == {
        "itunes:episode": "007", "itunes:explicit": "true", "x:empty": "", "x:when": "2026-01-02", "x:at": "2026-01-02T03:04:05Z",
        "media:group": {"media:thumbnail": [{"@_url": "https://pod.test/a.jpg", "@_width": "1.50"}, {"@_url": "https://pod.test/b.jpg"}], "media:description": "Told &amp; retold", "media:content": {"@_url": "c", "@_duration": "1e3"}},
        "enclosure": [{"@_url": "https://pod.test/1.mp3", "@_length": "0012", "@_type": "audio/mpeg"}, {"@_url": "https://pod.test/2.mp3", "@_length": "5", "@_type": "audio/mpeg"}],
        "x:mixed": {"#text": "own", "@_a": "1", "b": "bold"}, "x:tag": ["one", "two", {"#text": "three", "@_k": "v"}], "x:code": "12 <i> &",
    }
    assert two.title is None  # a list has no text
    assert json.loads(two.raw_extension_data) == {"@_rdf:about": "here", "@_xmlns:rdf": "r"}
    assert two.url == "https://pod.test/x?a=1&amp;b=2"


def test_media_and_summary_from_stored_extensions(spark):
    rows = SF.parse_feeds(SF.classified(spark.createDataFrame([("0", 200, None, None, PLAIN, None, AT, 1)], KIND)))[1]
    got = I.projected(rows).where("pos = 0").first()
    assert got.summary_text == "Told &amp; retold"


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="y"><title>Clips</title><icon>/relative.ico</icon><logo>https://clips.test/l.png</logo><link rel="self" href="https://clips.test/self"/><link rel="" href="https://clips.test"/>
<entry><id>1</id><title type="html">A</title><link href="::bad"/><link rel="enclosure" href="https://clips.test/e"/><link rel=" alternate " href="https://clips.test/ok"/><updated>2026-04-24T10:00:00.5+02:00</updated><author><name>N</name></author><yt:videoId>00123456</yt:videoId></entry>
<entry><id>2</id><title>B</title><link href="https://clips.test/only"/><published>never</published><updated>24 Apr 26</updated></entry><entry><id>3</id><title>C</title><link rel="related" href="https://clips.test/r"/></entry></feed>"""


def test_links_of_atom(spark):
    (feed,), rows = items_of(spark, ATOM)
    assert (feed.site_url, feed.favicon_url) == ("https://clips.test/", "https://clips.test/l.png")
    assert [r.url for r in rows] == ["https://clips.test/ok", "https://clips.test/only", None]
    assert rows[0].published_at == datetime(2026, 4, 24, 8, 0, 0, 500_000) and rows[1].published_at == datetime(2026, 4, 24)
    assert json.loads(rows[0].raw_extension_data) == {"yt:videoId": "00123456"}
    assert (rows[0].author, rows[0].title) == ("N", "A")


def at(*parts):
    return datetime(*parts, tzinfo=UTC)


DATES = {
    "Fri, 24 Apr 2026 10:00:00 GMT": at(2026, 4, 24, 10),
    "Fri, 24 Apr 2026 10:00:00 EST": at(2026, 4, 24, 15),
    "Fri, 24 Apr 2026 10:00:00 PDT": at(2026, 4, 24, 17),
    "24 Apr 2026 10:00 +0530": at(2026, 4, 24, 4, 30),
    "24 Apr 2026 10:00:07 -03:00": at(2026, 4, 24, 13, 0, 7),
    "24 Apr 2026 10:00:00 GMT+0200": at(2026, 4, 24, 8),
    "Friday, 24 April 2026 10:00:00 UT (summer)": at(2026, 4, 24, 10),
    "24 Apr 26": at(2026, 4, 24),
    "24 Apr 99 10:00:00 Z": at(1999, 4, 24, 10),
    "24-Apr-2026 23:59:59 GMT": at(2026, 4, 24, 23, 59, 59),
    "24 Apr 2026": at(2026, 4, 24),
    "April 24, 2026": at(2026, 4, 24),
    "Apr 24 2026 10:00:00": at(2026, 4, 24, 10),
    "Fri Apr 24, 2026 3:04 PM": at(2026, 4, 24, 15, 4),
    "4/24/2026 12:30 am": at(2026, 4, 24, 0, 30),
    "2026/04/24 10:00:00": at(2026, 4, 24, 10),
    "2026-04-24": at(2026, 4, 24),
    "2026-04-24T10:00:00Z": at(2026, 4, 24, 10),
    "2026-04-24T10:00:00.25+0200": at(2026, 4, 24, 8, 0, 0, 250_000),
    "2026-04-24 10:00": at(2026, 4, 24, 10),
    " 2026-04-24T10:00:00-05:00\n": at(2026, 4, 24, 15),
}
NOT_DATES = ["", "never", "24 Foo 2026", "32 Apr 2026", "24 Apr 2026 25:00:00", "2026-13-01", "24 Apr 2026 10:00:00 XYZ", "tomorrow at 5", "24 Apr", "Apr 2026 24", "13:00"]


def test_dates_of_every_form(spark):
    rows = spark.createDataFrame([(t,) for t in [*DATES, *NOT_DATES]], "t string").select("t", F.unix_micros(FF.published_at(F.col("t"))).alias("us"))
    got = {r.t: r.us for r in rows.collect()}
    assert got == {t: round(v.timestamp() * 1e6) for t, v in DATES.items()} | dict.fromkeys(NOT_DATES)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_do_not_follow_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        us = spark.range(1).select(*(F.unix_micros(FF.published_at(F.lit(t))) for t in ("24 Apr 2026", "2026-04-24 10:00", "2026-04-24"))).first()
        assert list(us) == [round(DATES[t].timestamp() * 1e6) for t in ("24 Apr 2026", "2026-04-24 10:00", "2026-04-24")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
