"""Arrow UDFs for what has no built-in function: Unicode normal forms, HTML with entities, WHATWG-like URLs."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.functions import weburl

# Elements without visible text, and elements that separate words.
SKIPPED = frozenset("canvas noscript script style svg template".split())
SEPARATING = frozenset("article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class VisibleText(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in SKIPPED
        if tag in SEPARATING:
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag in SEPARATING:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        if tag in SEPARATING:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    parser = VisibleText()
    parser.feed(html or "")
    parser.close()
    return clean("".join(parser.parts))


def clean(text: str | None) -> str:
    return " ".join(re.sub(r"[\x00-\x1f\x7f]", " ", unicodedata.normalize("NFKC", text or "")).split())


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(visible_text)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(clean)


@F.pandas_udf(StringType())
def normal_url(url: pd.Series) -> pd.Series:
    """Addresses as the URL standard writes them; null for what isn't one."""
    return url.map(weburl.href, na_action="ignore")


@F.pandas_udf(StringType())
def first_url(urls: pd.Series) -> pd.Series:
    """The first of a list of texts that is an address, as the URL standard writes it."""
    return urls.map(lambda v: next((u for u in map(weburl.href, v) if u is not None), None), na_action="ignore")


@F.pandas_udf(StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    """Addresses for comparison; see ``weburl.canonical``."""
    return url.map(weburl.canonical, na_action="ignore")


@F.pandas_udf(StringType())
def favicon_url(url: pd.Series) -> pd.Series:
    return url.map(weburl.favicon, na_action="ignore")
