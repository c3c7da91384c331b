"""Related items for any set of sources: vector and term candidates, fusion, diversity, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.functions.arrow import canonical_url, nfkc
from feedloom.functions.text import near_duplicate_titles, search_terms, simple_tokens, tokens
from feedloom.functions.vectors import dot, fused, qualifies, recency
from feedloom.operators import neighbours as N
from feedloom.operators import terms

CANDIDATES = 150
WEIGHTS = {"title": 1.0, "summary_text": 0.4, "content": 0.1}


def source_status(sources: DataFrame, features: DataFrame, version: str, enabled: bool = True) -> DataFrame:
    """(source_id, status) of sources that exist: unavailable, pending or ready."""
    known = features.select(F.col("item_id").alias("source_id"), F.col("status").alias("state"), "algorithm_version", "embedding")
    status = (
        F.when(~F.lit(enabled) | F.coalesce(F.col("state") == "skipped", F.lit(False)), "unavailable")
        .when(F.col("state").isNull() | (F.col("state") != "ready") | (F.col("algorithm_version") != version) | F.col("embedding").isNull(), "pending")
        .otherwise("ready")
    )
    return sources.select("source_id").join(known, "source_id", "left").select("source_id", status.alias("status"))


def active(features: DataFrame, version: str) -> DataFrame:
    return features.where((F.col("status") == "ready") & (F.col("algorithm_version") == version) & F.col("embedding").isNotNull())


def pool_of(features: DataFrame, version: str) -> DataFrame:
    """(item_id, embedding) of items that can be found; vectors all of zeros are near nothing."""
    return active(features, version).select("item_id", "embedding").where(dot(F.col("embedding"), F.col("embedding")) > 0)


def asked_of(sources: DataFrame, pool: DataFrame) -> DataFrame:
    """(source_id, embedding) of the sources that have a vector, once each."""
    return sources.select(F.col("source_id").alias("item_id")).distinct().join(pool, "item_id").withColumnRenamed("item_id", "source_id")


def semantic_candidates(sources: DataFrame, features: DataFrame, version: str, least: float = 0.80, limit: int = CANDIDATES, piece: int = N.PIECE) -> DataFrame:
    """(source_id, item_id, distance, place): the nearest items of each source by cosine, at ``least`` similarity or more, from all pairs.

    Any number of sources may ask: they and the vectors meet by a shuffle, in pieces of ``piece`` vectors.  The cutoff comes before the
    limit, which it can't change.
    """
    pool = pool_of(features, version)
    return N.exact(asked_of(sources, pool), pool, least, limit, piece)


def semantic_candidates_indexed(sources: DataFrame, features: DataFrame, version: str, least: float = 0.80, limit: int = CANDIDATES, probe: int | None = None, index: N.Index | None = None) -> DataFrame:
    """The same through an inverted file of product-quantised vectors, re-ranked exactly; finds most but not all of them.

    ``index`` is one of ``neighbours.index_of`` or of ``Index.load``, made here if none is given.  ``probe`` lists are asked for each source, by default a tenth of
    all and at least eight.
    """
    pool = pool_of(features, version)
    index = index or N.index_of(pool)
    asked = asked_of(sources, pool)
    found = N.candidates(index, asked, least, 2 * limit, probe or max(8, len(index.quantiser.centroids) // 10))
    return N.reranked(found, asked, pool, least, limit)


def occurrences(items: DataFrame) -> DataFrame:
    """(item_id, token, weight): a row for each place of a token, weighed by the field it stands in."""

    def weighed(name: str, weight: float) -> Column:
        return F.transform(tokens(F.col(name)), lambda t: F.struct(t.alias("token"), F.lit(weight).alias("weight")))

    return items.select(F.col("id").alias("item_id"), F.explode(F.concat(*(weighed(*field) for field in WEIGHTS.items()))).alias("x")).select("item_id", "x.*")


def postings(items: DataFrame) -> DataFrame:
    """(item_id, token, weight): each token's occurrences, weighed by the field they stand in."""
    return occurrences(items).groupBy("item_id", "token").agg(F.round(F.sum("weight"), 6).alias("weight"))


def source_terms(sources: DataFrame, items: DataFrame) -> DataFrame:
    """(source_id, token): what each source searches by, MAX_TERMS tokens at most."""
    own = items.withColumnRenamed("id", "source_id")
    return sources.join(own, "source_id").select("source_id", F.explode(search_terms(F.col("title"), F.col("summary_text"))).alias("token"))


def lexical_candidates(sources: DataFrame, items: DataFrame, limit: int = CANDIDATES, pool: DataFrame | None = None, piece: int = terms.PIECE) -> DataFrame:
    """(source_id, item_id, rank, place): items that have any of a source's terms, by the sum S of their weights as S / (S + 1).

    Texts of ``pool`` (items if not given) are dealt to pieces of about ``piece`` characters and all searches go to each piece, so no list of
    all hits is made.  For many searches of one pool store its index and use ``postings.ranked``.
    """
    own = items.withColumnRenamed("id", "source_id")
    asked = sources.select("source_id").distinct().join(own, "source_id").select("source_id", F.array_join(search_terms(F.col("title"), F.col("summary_text")), " ").alias("words"))
    return terms.ranked(asked, items if pool is None else pool, {c: tokens(F.col(c)) for c in WEIGHTS}, WEIGHTS, limit, piece)


def fuse(semantic: DataFrame, lexical: DataFrame, items: DataFrame, now, strong: float = 0.86, weak: float = 0.80, by_terms: float = 0.05) -> DataFrame:
    """Both lists merged by item, qualified and scored; wide columns are joined only here."""
    a = semantic.select("source_id", "item_id", (1 - F.col("distance")).alias("similarity"), F.col("place").alias("semantic_place"))
    b = lexical.select("source_id", "item_id", F.col("rank").alias("lexical_rank"), F.col("place").alias("lexical_place"))
    both = a.join(b, ["source_id", "item_id"], "full").where(qualifies(F.col("similarity"), F.col("lexical_rank"), strong, weak, by_terms))
    wide = items.select(F.col("id").alias("item_id"), "feed_id", "title", "url", "published_at")
    own = items.select(F.col("id").alias("source_id"), F.col("feed_id").alias("source_feed"), F.col("title").alias("source_title"), F.col("url").alias("source_url"))
    rows = both.join(wide, "item_id").join(own, "source_id")
    score = fused(F.col("semantic_place"), F.col("lexical_place"), F.col("feed_id") == F.col("source_feed"), recency(F.col("published_at"), now))
    return rows.withColumn("score", F.round(score, 12))


def diversify(ranked: DataFrame, limit: int = 5, per_feed: int = 2) -> DataFrame:
    """(source_id, selected): of each source's candidates by score, greedily those that repeat no address, no title and no feed
    more than ``per_feed`` times, ``limit`` and one more at most.

    A source has 2 * CANDIDATES rows at most, so its array is bounded; what is passed over takes no place of its feed.
    """
    ranked = ranked.withColumns({"title": nfkc(F.col("title")), "source_title": nfkc(F.col("source_title")), "url": canonical_url(F.col("url")), "source_url": canonical_url(F.col("source_url"))})
    row = F.struct((-F.col("score")).alias("by"), (-F.coalesce(F.unix_micros("published_at"), F.lit(-(1 << 62)))).alias("then"), (-F.col("item_id")).alias("last"), "item_id", "feed_id", "title", "url", "score")
    listed = ranked.groupBy("source_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first("source_title").alias("source_title"), F.first("source_url").alias("source_url"))
    kind = "array<struct<item_id:bigint,feed_id:string,title:string,url:string,score:double>>"

    def take(chosen, x):
        repeat = (
            (F.size(chosen) > limit)
            | (F.size(F.filter(chosen, lambda c: c["feed_id"] == x["feed_id"].cast("string"))) >= per_feed)
            | F.coalesce(x["url"] == F.col("source_url"), F.lit(False))
            | F.exists(chosen, lambda c: F.coalesce(c["url"] == x["url"], F.lit(False)))
            | F.coalesce(near_duplicate_titles(x["title"], F.col("source_title")), F.lit(False))
            | F.exists(chosen, lambda c: F.coalesce(near_duplicate_titles(c["title"], x["title"]), F.lit(False)))
        )
        one = F.struct(x["item_id"].cast("long").alias("item_id"), x["feed_id"].cast("string").alias("feed_id"), x["title"].alias("title"), x["url"].alias("url"), x["score"].alias("score"))
        return F.when(repeat, chosen).otherwise(F.concat(chosen, F.array(one)))

    return listed.select("source_id", F.aggregate("rows", F.array().cast(kind), take).alias("selected"))


def similar_items(sources: DataFrame, items: DataFrame, features: DataFrame, now, version: str, limit: int = 5, strategy: str = "hybrid", strong: float = 0.86, weak: float = 0.80) -> DataFrame:
    """(source_id, status, count, has_more, items) for each source that exists.

    ``strategy`` is hybrid, semantic or lexical.  Only ready sources are searched.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit must be from 1 to 20")
    status = source_status(sources, features, version)
    ready = status.where("status = 'ready'").select("source_id")
    none = F.lit(False)
    semantic = semantic_candidates(ready, features, version, weak)
    live = active(features, version).select(F.col("item_id").alias("id"))
    lexical = lexical_candidates(ready, items, pool=items.join(live, "id", "left_semi"))
    semantic = semantic.where(none) if strategy == "lexical" else semantic
    lexical = lexical.where(none) if strategy == "semantic" else lexical
    chosen = diversify(fuse(semantic, lexical, items, now, strong, weak), limit)
    out = status.join(chosen, "source_id", "left").withColumn("selected", F.coalesce("selected", F.array().cast(chosen.schema["selected"].dataType)))
    return out.select("source_id", "status", F.least(F.size("selected"), F.lit(limit)).alias("count"), (F.size("selected") > limit).alias("has_more"), F.slice("selected", 1, limit).alias("items"))


def relevance(results: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """One row of means over sources, from all judgments (source_id, item_id, gain), the rest counting as gain 0; all sources of
    judged are asked.  See ``relevance_of``."""
    log2 = lambda c: F.log2(c + 1)
    ideal = judged.where("gain > 0").withColumn("place", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("gain"), "item_id"))).where(F.col("place") <= k)
    ideal = ideal.groupBy("source_id").agg(F.sum(F.col("gain") / log2(F.col("place"))).alias("best"))
    asked = judged.select("source_id").distinct().join(ideal, "source_id", "left").fillna(0, ["best"])
    got = results.where(F.col("place") <= k).join(judged, ["source_id", "item_id"], "left").fillna(0, ["gain"])
    return relevance_of(asked, got, k)


def best_gain(relevant: Column, k: int = 5) -> Column:
    """Ideal discounted gain of a source that has so many relevant items, all of gain 1."""
    return F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= relevant), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))


def relevance_of(asked: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """One row of means over the sources of asked (source_id, best): precision, nDCG, share of sources with results and with useful ones,
    share of irrelevant results; and if results have ``feed_id`` and ``title`` the share of results that repeat a title of their list,
    and of different feeds in a list.

    results: (source_id, item_id, place, gain).  Only the first k of a source count, so a source costs k rows, however many items
    are relevant to it; ``best`` is its ideal discounted gain.
    """
    more = {"feed_id", "title"} <= set(results.columns)
    figures = [F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("dcg"), F.count_if(F.col("gain") > 0).alias("good"), F.count("*").alias("n")]
    if more:
        figures += [F.count_distinct("feed_id").alias("feeds"), F.count_distinct(F.lower(F.trim(F.coalesce("title", F.lit(""))))).alias("titles")]
    got = results.where(F.col("place") <= k).groupBy("source_id").agg(*figures)
    rows = asked.join(got, "source_id", "left").fillna(0)
    of_all = lambda c: F.round(F.coalesce(F.sum(c) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), 6)
    out = [
        F.round(F.avg(F.col("good") / k), 6).alias("precision"),
        F.round(F.avg(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0)), 6).alias("ndcg"),
        F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("covered"),
        F.round(F.avg((F.col("good") > 0).cast("double")), 6).alias("useful"),
        of_all(F.col("n") - F.col("good")).alias("irrelevant"),
    ]
    return rows.agg(*out, *([of_all(F.col("n") - F.col("titles")).alias("repeated"), of_all(F.col("feeds")).alias("diversity")] if more else []))


def title_sets(items: DataFrame) -> DataFrame:
    """(id, own): the token set of each title of three tokens or more, sorted."""
    own = F.sort_array(F.array_distinct(simple_tokens(nfkc(F.col("title")))))
    # rows of a generator, so that a filter that is pushed down doesn't work out the set anew
    return items.select("id", F.explode_outer(F.array(own)).alias("own")).where(F.size("own") >= 3)


def title_classes(items: DataFrame) -> DataFrame:
    """(id, own, least, members): the token set of each title of three tokens or more, the least id of the items that have the same set, and
    how many these are.  Counts are summed before they are shuffled, so a title of many items costs each task one row."""
    sets = title_sets(items)
    return sets.join(sets.groupBy("own").agg(F.min("id").alias("least"), F.count("*").alias("members")), "own").select("id", "own", "least", "members")


def numbered(tokens_: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """(token, often, number): each token of (least, token) once, how often it is there and a number that no other has: its hash's bucket and its place in it."""
    often = tokens_.groupBy("token").agg(F.count("least").alias("often")).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("token"))
    return often.select("token", "often", (F.shiftleft("bucket", 32) + place).alias("number"))


def near_title_links(items: DataFrame, percent: int = 85) -> DataFrame:
    """(id, other, same), id < other: items of (id, title) whose titles' token sets have this Jaccard similarity.

    Items of one token set are a class, named by its least id.  Each other member has one row to that id (same); each pair of
    classes that reach the similarity has one row between their least ids.  So all links follow, and a title that many
    items have costs a row for each item, not for each pair.

    Pairs of different sets are found by their rarest tokens: two sets of sizes m and n that reach the similarity share one of the
    first n - ceil(percent * n / 100) + 1 tokens of each, tokens ordered by how many sets have them.  A pair is looked at where its first
    common token stands, at places p and q: at most 1 + min(m - p, n - q) tokens are common then, which rules most pairs out before
    their sets are compared.
    """
    sets = title_sets(items)
    classes = sets.groupBy("own").agg(F.min("id").alias("least"))
    same = sets.join(classes, "own").where("id > least").select(F.col("least").alias("id"), F.col("id").alias("other"), F.lit(True).alias("same"))
    tokens_ = classes.select("least", F.explode("own").alias("token"))
    ranked = tokens_.join(numbered(tokens_), "token").groupBy("least").agg(F.sort_array(F.collect_list(F.struct("often", "number")))["number"].alias("own"))
    n = F.size("own")
    # a set within another of one token more is the closest case; asked here, so that classes are worked out once for all uses
    ranked = ranked.where(n * (100 - percent) >= percent)
    first = ranked.select("least", "own", n.alias("n"), F.posexplode(F.slice("own", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)).alias("p", "token"))
    a, b = (first.select("token", F.col("least").alias(i), F.col("own").alias(w), F.col("n").alias(k), (F.col("n") - F.col("p") - 1).alias(r)) for i, w, k, r in (("id", "x", "m", "left"), ("other", "y", "k", "rest")))
    # of sizes m and k, s common tokens reach the similarity if s * (100 + percent) >= (m + k) * percent
    reaches = lambda s: s * (100 + percent) >= (F.col("m") + F.col("k")) * percent
    possible = (F.least("m", "k") * 100 >= F.greatest("m", "k") * percent) & reaches(1 + F.least("left", "rest"))
    # bound to a variable, so that sets are compared once
    close = F.exists(F.array(F.array_intersect("x", "y")), lambda s: reaches(F.size(s)) & (s[0] == F.col("token")))
    pairs = a.join(b, "token").where((F.col("id") < F.col("other")) & possible & close).select("id", "other")
    return same.union(pairs.select("id", "other", F.lit(False)))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    hit = exact.join(found.select("source_id", "item_id").distinct(), ["source_id", "item_id"], "left_semi").agg(F.count("*").alias("hits"))
    return exact.agg(F.count("*").alias("exact")).crossJoin(hit).select("exact", "hits", F.when(F.col("exact") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("exact")).alias("recall"))
