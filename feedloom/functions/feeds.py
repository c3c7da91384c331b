"""Feed records: keys, dates, extension data, media, fetch schedule and alert flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import normalized
from feedloom.functions.urls import youtube_id

LEAST_MINUTES, MOST_MINUTES = 60, 1440
PERSISTENT_COUNTS = (3, 10, 25)
SECTIONS = ("recovered", "new_error/auth", "new_error/parse", "new_error/network", "new_error/other", "persistent_error/threshold")


def dedupe_key(feed: Column, guid: Column, url: Column, title: Column, published: Column) -> Column:
    """SHA-256 of the guid, or of address, title and date where there is none."""
    iso = F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.when(guid.isNotNull(), F.concat(F.lit("guid:"), feed.cast("string"), F.lit(":"), guid)).otherwise(F.concat_ws(":", F.lit("fallback"), blank(feed), blank(url), blank(title), blank(iso))), 256)


#: Names of time zones in mail dates, with their minutes from Greenwich, and the months' first letters.
ZONES = {"": 0, "z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

CLOCK = r"(?:[\s,T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([ap]m)?)?"
ZONE = r"\s*(?:(?:gmt|utc?)?([+-])(\d{2}):?(\d{2})|(z|[a-z]{2,3}))?(?:\s*\([^)]*\))?"
#: Day first with the month's name, month's name first, and figures with the month or the year first.
BY_DAY = rf"^(\d{{1,2}})[\s.-]+([a-z]{{3,9}})\.?,?[\s-]+(\d{{4}}|\d{{2}}){CLOCK}{ZONE}$"
BY_MONTH = rf"^([a-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){CLOCK}{ZONE}$"
BY_FIGURES = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){CLOCK}{ZONE}$"
BY_YEAR = rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){CLOCK}{ZONE}$"
ISO = r"^\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[Zz]|[+-]\d{2}:?\d{2})?)?$"


def written_date(v: Column) -> Column:
    """The moment that a date means as feeds write it: mail dates with or without weekday, seconds, time and zone, with years of two figures (50 to 99
    are of the last century); month first; figures; ISO 8601.  What names no zone is in UTC; null for what isn't a date."""
    text = F.lower(F.regexp_replace(F.trim(v), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+", ""))
    rest = "|".join(f"${k}" for k in range(4, 12))

    def moment(f: Column) -> Column:
        day, month, year = 1, 2, 3
        part = lambda k: F.nullif(F.get(f, k - 1), F.lit(""))
        whole = lambda k: part(k).try_cast("int")
        letters = F.position(F.left(part(month), F.lit(3)), F.lit(MONTHS))
        m = F.coalesce(whole(month), F.when((F.length(part(month)) >= 3) & (letters % 3 == 1), (letters + 2) / 3).cast("int"))
        y = F.when(F.length(part(year)) == 2, whole(year) + F.when(whole(year) < 50, 2000).otherwise(1900)).otherwise(whole(year))
        half, hour = part(7), F.coalesce(whole(4), F.lit(0))
        hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        at = F.try_make_timestamp(y, m, whole(day), hour, F.coalesce(whole(5), F.lit(0)), F.coalesce(whole(6), F.lit(0)).cast("decimal(16,6)"), F.lit("UTC"))
        named = F.element_at(F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair)), F.coalesce(part(11), F.lit("")))
        away = F.when(part(8).isNull(), named).otherwise((whole(9) * 60 + whole(10)) * F.when(part(8) == "-", -1).otherwise(1))
        return F.timestamp_micros(F.unix_micros(at) - away.cast("long") * 60_000_000)

    def iso(t: Column) -> Column:
        full = F.regexp_replace(F.regexp_replace(F.upper(t), r"(:\d{2}(?:\.\d+)?\s*[+-]\d{2})(\d{2})$", "$1:$2"), r"^(.{10}[T ]\d{2}:\d{2})(?![:\d])", "$1:00")
        return F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).when(full.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), full).otherwise(F.concat(full, F.lit("Z"))).try_cast("timestamp")

    def meaning(t: Column) -> Column:
        parts = F.when(t.rlike(BY_DAY), F.regexp_replace(t, BY_DAY, f"$1|$2|$3|{rest}"))
        for pattern, places in ((BY_MONTH, "$2|$1|$3"), (BY_FIGURES, "$2|$1|$3"), (BY_YEAR, "$3|$2|$1")):
            parts = parts.when(t.rlike(pattern), F.regexp_replace(t, pattern, f"{places}|{rest}"))
        return F.when(t.rlike("(?i)" + ISO), iso(t)).otherwise(once(F.split(parts, r"\|"), moment))

    return once(text, meaning)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def published_at(*candidates: Column) -> Column:
    """The first candidate that is a date."""
    return F.get(F.filter(F.transform(F.array(*candidates), written_date), lambda d: d.isNotNull()), 0)


def extension_data(raw: Column) -> Column:
    """Of a JSON object: the members whose names have a prefix, and the enclosure, as a map of JSON texts."""
    return F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, v: k.contains(":") | (k == "enclosure"))


def extensions(item: Column) -> Column:
    """The same members of a variant, as the JSON text of an object; empty elements are empty texts."""
    own = F.to_json(F.map_filter(item.cast("map<string,variant>"), lambda k, v: k.contains(":") | (k == "enclosure")))
    return F.regexp_replace(own, r'(?<!\\)":null(?=[,}])', '":""')


def text_of(item: Column, *path: str) -> Column:
    """Text of a variant's member: a string, or an object's own text; null for lists and what has none."""
    value = F.try_variant_get(item, "$" + "".join(f"['{n}']" for n in path), "variant")
    return once(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$['#text']", "string")))


def read_text(data: Column, name: str, *within: str) -> Column:
    """Text of a member that is a string or an object with its text, trimmed; null if blank."""
    value = F.get_json_object(data, "$" + "".join(f"['{n}']" for n in (name, *within)))
    return normalized(F.coalesce(F.get_json_object(value, "$['#text']"), F.get_json_object(value, "$['__cdata']"), F.when(~value.rlike(r"^\s*[\[{]"), value)))


def duration_seconds(v: Column) -> Column:
    """Seconds of ``s``, ``m:s`` or ``h:m:s``; null for what isn't."""
    parts = F.transform(F.split(v, ":"), lambda x: F.when(F.trim(x) == "", F.lit(0.0)).otherwise(x.try_cast("double")))
    fit = (F.size(parts) <= 3) & F.forall(parts, lambda x: x.isNotNull())
    return F.when((v != "") & fit, F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x))


def http_url(v: Column) -> Column:
    return F.when(v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+$"), v)


def media(raw: Column, url: Column) -> Column:
    """Struct of kind, player_url, enclosure_url, mime_type, image_url and duration_seconds; nulls for plain items."""
    video = F.coalesce(read_text(raw, "yt:videoId"), youtube_id(url))
    enclosure = http_url(F.coalesce(read_text(raw, "enclosure", "@_url"), read_text(raw, "enclosure", "url")))
    mime = F.coalesce(read_text(raw, "enclosure", "@_type"), read_text(raw, "enclosure", "type"))
    thumb = lambda *p: F.coalesce(*(http_url(read_text(raw, *p, *q)) for q in (("@_url",), ("url",), ())))
    first = lambda *p: http_url(F.get_json_object(raw, "$" + "".join(f"['{n}']" for n in p) + "[0]['@_url']"))
    image = F.coalesce(thumb("media:group", "media:thumbnail"), first("media:group", "media:thumbnail"), thumb("media:thumbnail"), first("media:thumbnail"), http_url(read_text(raw, "itunes:image", "@_href")))
    seconds = F.coalesce(*(duration_seconds(read_text(raw, *p)) for p in (("itunes:duration",), ("media:group", "yt:duration", "@_seconds"), ("media:group", "yt:duration"))))
    is_video, is_audio = video.isNotNull(), enclosure.isNotNull() & F.coalesce(mime.startswith("audio/"), F.lit(False))
    podcast = F.get_json_object(raw, "$['itunes:duration']").isNotNull() | F.get_json_object(raw, "$['itunes:image']").isNotNull()
    sound = ~is_video & is_audio
    return F.struct(
        F.when(is_video, "youtube").when(is_audio & podcast, "podcast").when(is_audio, "audio").alias("kind"),
        F.when(is_video, F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), video)).alias("player_url"),
        F.when(sound, enclosure).alias("enclosure_url"),
        F.when(sound, mime).alias("mime_type"),
        F.when(is_video | is_audio, image).alias("image_url"),
        F.when(is_video | is_audio, seconds).alias("duration_seconds"),
    )


def summary_or_description(summary: Column, raw: Column) -> Column:
    return F.coalesce(normalized(summary), read_text(raw, "media:group", "media:description"), read_text(raw, "media:description"))


def next_interval(current: Column, errors: Column, new_items: Column, status: Column) -> Column:
    """Minutes to the next fetch: longer after errors and empty fetches, shorter after new items, within bounds."""
    cur = F.greatest(current, F.lit(LEAST_MINUTES))
    after = (
        F.when(status == "error", F.ceil(cur * F.when(errors >= 3, 2.5).otherwise(2.0)))
        .when((status == "not_modified") | (new_items == 0), cur + 30)
        .otherwise(F.greatest(F.lit(LEAST_MINUTES), F.floor(cur * 0.75)))
    )
    return F.least(F.greatest(after, F.lit(LEAST_MINUTES)), F.lit(MOST_MINUTES)).cast("long")


def activity(interval: Column, new_items: Column) -> Column:
    return F.when((new_items > 0) | (interval < 360), "active").otherwise("inactive")


def retry_delay_ms(attempts: Column) -> Column:
    return F.least(60000 * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(16))), F.lit(86400000.0)).cast("long")


def error_category(is_parse: Column) -> Column:
    return F.when(F.coalesce(is_parse, F.lit(False)), "parse").otherwise("network")


def alert_flags(status: Column, previous: Column, previous_count: Column, count: Column, http_status: Column) -> dict[str, Column]:
    no = F.lit(False)
    error = status == "error"
    new = error & (F.coalesce(previous != "error", F.lit(True)) | (F.coalesce(previous_count, F.lit(0)) == 0))
    return {
        "recovered": F.coalesce((previous == "error") & ~error, no),
        "new_error": F.coalesce(new, no),
        "persistent": F.coalesce(error & ~new & F.coalesce(count, F.lit(0)).isin(*PERSISTENT_COUNTS), no),
        "auth": F.coalesce(http_status.isin(401, 403), no),
    }


def alert_section(flags: dict[str, Column], category: Column) -> Column:
    """Place in SECTIONS, from 1; null for what needs no alert."""
    return (
        F.when(flags["recovered"], 1)
        .when(flags["new_error"] & flags["auth"], 2)
        .when(flags["new_error"] & (category == "parse"), 3)
        .when(flags["new_error"] & (category == "network"), 4)
        .when(flags["new_error"], 5)
        .when(flags["persistent"], 6)
    )
