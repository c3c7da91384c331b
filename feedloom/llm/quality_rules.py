"""Quality rules: counts from the text itself, and a hashed n-gram log-likelihood ratio.

DataFrame functions only.  The ratio compares two multinomials over hashed word unigrams and bigrams: one of documents
trusted as a target, one of the whole raw corpus.  A document's verdict is the mean log ratio of its n-grams against
a fixed threshold, in integers, so it doesn't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import WORD_SPACE, put, ready

MICRO = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def grams(h: Column, bits: int) -> Column:
    """Buckets, 0 to 2 ** bits - 1, of all words and pairs of neighbouring words, from the words' hashes."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    both = F.concat(h, F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))
    return F.transform(both, lambda x: x.bitwiseAND((1 << bits) - 1).cast("int"))


def hashes(own: Column) -> Column:
    return F.transform(own, lambda w: F.xxhash64(w))


def repeated(own: Column, h: Column) -> Column:
    """Number of words in three-word windows that occur twice or more; each word counts once.

    If all hashes of windows differ no window repeats.  Else windows are sorted with their places; those equal to a neighbour
    repeat.  The places, in order, then cover three words each, less what the one before covers.
    """
    n = F.size(own)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", own[i], own[i + 1], own[i + 2]).alias("w"), i.alias("i")))

    def cover(ordered: Column) -> Column:
        places = F.transform(F.filter(ordered, lambda x, k: (x["w"] == F.get(ordered, k - 1)["w"]) | (x["w"] == F.get(ordered, k + 1)["w"])), lambda x: x["i"])
        return F.aggregate(
            F.sort_array(places), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum"), i.alias("last")), lambda a: a["sum"]
        )

    heavy = let(F.sort_array(windows), cover)
    plain = F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2])))) == n - 2
    return F.when(n < 4, F.lit(0).cast("long")).when(plain, F.lit(0).cast("long")).otherwise(heavy)


def base_counts(text: Column, own: Column, h: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(own).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(WORD_SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated(own, h),
    }


def ratio_weights(docs: DataFrame, trusted: DataFrame, text: str, key: str, bits: int, prior: float) -> DataFrame:
    """One row with an array of 2 ** bits log ratios in millionths.

    The raw multinomial counts all documents.  ``prior`` pseudo-counts a bucket, dealt as the raw corpus is, pull the
    target towards it, so that a bucket with little evidence has a ratio near 0.
    """
    size = 1 << bits
    flags = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(trusted.select(F.col(key).alias("k")).withColumn("flag", F.lit(1)).hint("shuffle_hash"), "k", "left")
    own = flags.select(F.coalesce("flag", F.lit(0)).alias("flag"), hashes(words(F.col("t"))).alias("h"))
    found = own.select("flag", F.explode(grams(F.col("h"), bits)).alias("b"))
    counts = put(found.groupBy("b").agg(F.count("*").alias("raw"), F.sum("flag").alias("target")), "gram-counts")  # 2 ** bits rows
    whole = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t"))
    share = F.col("raw") / F.col("r")
    ratio = F.log((F.col("target") + prior * size * share) / ((F.col("t") + prior * size) * share))
    seen = counts.crossJoin(F.broadcast(whole)).select("b", F.round(ratio * MICRO).cast("long").alias("w"))
    full = docs.sparkSession.range(0, size, 1, 1).select(F.col("id").cast("int").alias("b")).join(seen, "b", "left").select("b", F.coalesce("w", F.lit(0)).alias("w"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 16, prior: float = 8.0, threshold: float = -0.06) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr_micro) for each row.

    The target is all documents labelled of quality 1, found by a shuffled join, the same at every size, since labels may be as many as documents; only
    2 ** bits weights go to all tasks.  Every n-gram of every document counts in the raw multinomial.
    A document is kept if it passes the base rules and its mean log ratio is ``threshold`` or more.
    Null text has no words and fails.  Without labels all ratios are 0.  Repeated rows and null keys stay rows.
    Very long texts and texts of very many lines are judged whole.  An empty table gives an empty result.  Other columns may have any
    names and aren't returned.
    """
    docs = ready(docs)
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    weights = ratio_weights(docs, trusted, text, key, bits, prior)
    own = docs.select(F.col(key), F.col(text).alias("text"), words(F.col(text)).alias("own")).withColumn("h", hashes(F.col("own")))
    base = own.select(key, *(c.alias(n) for n, c in base_counts(F.col("text"), F.col("own"), F.col("h")).items()), grams(F.col("h"), bits).alias("grams"), weights.scalar().alias("weights"))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, b: a + F.get("weights", b))
    n_grams = F.greatest(F.size("grams"), F.lit(1))
    scored = base.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"), total.alias("total"), n_grams.alias("n_grams"))
    passed = F.col("total") >= F.lit(round(threshold * MICRO)).cast("long") * F.col("n_grams")
    return scored.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passed).alias("kept"), F.floor(F.col("total") / F.col("n_grams")).alias("llr_micro"))
