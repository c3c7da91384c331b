"""URLs and media types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_http(v: Column) -> Column:
    return F.coalesce(v.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def content_type(v: Column) -> Column:
    """Media type without parameters, in lower case."""
    return F.lower(F.trim(F.split_part(v, F.lit(";"), F.lit(1))))


def youtube_id(url: Column) -> Column:
    """Video id of a YouTube address; null for others and for ids of odd signs."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    fit = lambda v: F.when(v.rlike(r"^[A-Za-z0-9_-]{6,}$"), v)
    short = fit(F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^?#]*)", 1))
    query = fit(F.regexp_extract(url, r"[?&]v=([^&#]*)", 1))
    path = fit(F.regexp_extract(url, r"^[^?#]*/(?:embed|shorts)/([^/?#]+)", 1))
    return F.when(host == "youtu.be", short).when((host == "youtube.com") | host.endswith(".youtube.com"), F.coalesce(query, path))
