"""Text cleaning, tokens and search features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHM_VERSION = "similarity-v1"
MODEL_PREFIX = "query: "
MAX_BODY = 32_000
MAX_TERMS = 16
# Stop words of search terms, in English, Russian and Ukrainian.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "и в во не на с со а но по из за для что це та й у до від із з про як"
).split()
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}_+#.-]*"


def normalized(v: Column) -> Column:
    """Without surrounding white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(v, r"^\s+|\s+$", ""), F.lit(""))


def collapsed(v: Column) -> Column:
    """Control characters and runs of white space become one space; ends trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"[\x00-\x20\x{7F}\x{A0}]+", " "))


def tag_free(html: Column) -> Column:
    """Visible text by regular expressions alone: no entity is decoded.  ``arrow.html_to_text`` is the full reader."""
    unread = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|svg|noscript|template|canvas)\b[^>]*>.*?</\1\s*>", " ")
    return collapsed(F.regexp_replace(unread, r"(?s)<!--.*?-->|<[^>]*>", " "))


def tokens(v: Column) -> Column:
    """Lower-case tokens of letters and digits, inner ``_+#.-`` kept, edge ``._-`` stripped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(v, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", "")), lambda t: t != "")


def search_terms(title: Column, summary: Column) -> Column:
    """Distinct tokens of the title, then of the summary, without stop words and single letters; MAX_TERMS at most."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    fit = F.filter(F.array_distinct(F.concat(tokens(title), tokens(summary))), lambda t: ~F.array_contains(stop, t) & ((F.length(t) > 1) | t.rlike(r"\d")))
    return F.slice(fit, 1, MAX_TERMS)


def without_prefix(body: Column, segment: Column) -> Column:
    """Body without a leading copy of the segment, whatever its case, and the punctuation that follows it."""

    def cut(x: Column) -> Column:
        b, s = x["body"], x["segment"]
        rest = F.trim(F.regexp_replace(F.substring(b, F.length(s) + 1, F.length(b)), r"^[\s:;,.!?\-|–—]+", ""))
        return F.when((b != "") & (s != "") & F.lower(b).startswith(F.lower(s)), rest).otherwise(b)

    # bound to a variable, so that a filter that is pushed down doesn't work out the body anew wherever it is named
    return F.get(F.transform(F.array(F.struct(body.alias("body"), segment.alias("segment"))), cut), F.lit(0))


def segments(*parts: Column) -> Column:
    """Non-empty parts in order, without those that repeat an earlier one in any case."""

    def add(seen: Column, part: Column) -> Column:
        return F.when((part == "") | F.exists(seen, lambda s: F.lower(s) == F.lower(part)), seen).otherwise(F.concat(seen, F.array(part)))

    return F.aggregate(F.array(*parts), F.array().cast("array<string>"), add)


def input_hash(plain: Column, version: str = ALGORITHM_VERSION) -> Column:
    return F.sha2(F.concat(F.lit(version), F.char(F.lit(0)), plain), 256)


def utf16_length(v: Column) -> Column:
    return (F.bit_length(F.encode(v, "UTF-16BE")) / 16).cast("int")


def skip_reason(plain: Column, least: int = 3) -> Column:
    return F.when(F.size(tokens(plain)) < least, F.lit("insufficient_text"))


def matches_all(query: Column, *fields: Column) -> Column:
    """Whether every token of the query is a token of the fields; a query without tokens matches nothing."""
    wanted = simple_tokens(query)
    own = simple_tokens(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields)))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, own)) == 0)


def simple_tokens(v: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(v, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def near_duplicate_titles(a: Column, b: Column, least: float = 0.85) -> Column:
    """Whether the token sets of two titles, three tokens each at least, have this Jaccard similarity."""
    x, y = F.array_distinct(simple_tokens(a)), F.array_distinct(simple_tokens(b))
    return (F.size(x) >= 3) & (F.size(y) >= 3) & (F.size(F.array_intersect(x, y)) >= least * F.size(F.array_union(x, y)))


def error_text(v: Column) -> Column:
    return F.left(F.nullif(v, F.lit("")), F.lit(2000))
