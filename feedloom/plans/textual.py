"""Text features, related items, ingest and links: queries over articles, features and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import feeds as FF
from feedloom.functions import text as T
from feedloom.functions import urls as U
from feedloom.functions.arrow import canonical_url, favicon_url, normal_url
from feedloom.functions.vectors import recency
from feedloom.operators import features as FE
from feedloom.operators import neighbours as N
from feedloom.operators import postings as P
from feedloom.operators import similar as R
from feedloom.operators import statistics as S
from feedloom.plans.registry import VERSION, Tables, now, query, scratch
from feedloom.sources import feeds as SF
from feedloom.sources import links as SL
from feedloom.sources.opml import subscriptions
from feedloom.streaming import jobs

#: Cosines of the test vectors stay far below those of real models, so queries over them take lower bounds.
WEAK, STRONG = 0.25, 0.35


def tok(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_+#.-]*'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: t <> '')"


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"select id, len({tok('content')}) n, md5(array_to_string({tok('content')}, ' ')) digest from articles")
def article_tokens(t: Tables):
    """X21"""
    own = T.tokens(F.col("content"))
    return t.articles.select("id", F.size(own).alias("n"), F.md5(F.array_join(own, " ")).alias("digest"))


@query(f"""with k as (select id, unnest(list_concat({tok('title')}, {tok('summary_text')})) token, generate_subscripts(list_concat({tok('title')}, {tok('summary_text')}), 1) pos from articles),
    f as (select id, token, min(pos) pos from k where not list_contains({STOP}, token) and (length(token) > 1 or regexp_matches(token, '[0-9]')) group by 1, 2),
    r as (select *, row_number() over (partition by id order by pos) n from f)
    select a.id, coalesce(string_agg(token, ' ' order by n) filter (where n <= 16), '') terms from articles a left join r on a.id = r.id group by 1""")
def search_terms(t: Tables):
    """X22"""
    return t.articles.select("id", F.array_join(T.search_terms(F.col("title"), F.col("summary_text")), " ").alias("terms"))


@query(f"""with p as (select id, trim(regexp_replace(coalesce(title, ''), '[\\x00-\\x20\\x7F]+', ' ', 'g')) a, trim(regexp_replace(coalesce(summary_text, ''), '[\\x00-\\x20\\x7F]+', ' ', 'g')) b from articles),
    s as (select id, case when a = '' then b when b = '' or lower(a) = lower(b) then a else concat(a, chr(10), chr(10), b) end plain from p)
    select id, sha256(concat('similarity-v1', chr(0), plain)) input_hash, length(plain) plain_text_length, case when len({tok('plain')}) < 3 then 'insufficient_text' end skip_reason from s""")
def short_features(t: Tables):
    """X19 X20 X23 X24, of title and summary"""
    both = t.articles.select("id", T.collapsed(F.col("title")).alias("a"), T.collapsed(F.col("summary_text")).alias("b"))
    plain = both.select("id", F.array_join(T.segments(F.col("a"), F.col("b")), "\n\n").alias("plain"))
    return plain.select("id", T.input_hash(F.col("plain")).alias("input_hash"), T.utf16_length(F.col("plain")).alias("plain_text_length"), T.skip_reason(F.col("plain")).alias("skip_reason"))


@query()
def full_features(t: Tables):
    """X15 X16 X17 X18 UD2, with the Arrow readers"""
    return FE.prepared(t.articles).select("id", "input_hash", "plain_text_length", F.array_join("lexical_terms", " ").alias("terms"), "skip_reason")


@query()
def embeddings_of_articles(t: Tables):
    """UD1 ST4: hashed stand-in model, in batches"""
    rows = FE.embedded(FE.prepared(t.articles, exact=False).where("skip_reason is null"), FE.hashed_embedder(), 64)
    return rows.select("id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), "error")


LEX = f"""with w as (select id item_id, token, round(sum(weight), 6) weight from (select id, unnest({tok('title')}) token, 1.0 weight from articles union all select id, unnest({tok('summary_text')}), 0.4 from articles
    union all select id, unnest({tok('content')}), 0.1 from articles) group by 1, 2)"""


@query(LEX + " select item_id, count(*) tokens, round(sum(weight), 3) weight from w group by 1")
def posting_totals(t: Tables):
    """R4"""
    return R.postings(t.articles).groupBy("item_id").agg(F.count("*").alias("tokens"), F.round(F.sum("weight"), 3).alias("weight"))


LEXICAL = LEX + f""", k as (select id source_id, unnest(list_concat({tok('title')}, {tok('summary_text')})) token, generate_subscripts(list_concat({tok('title')}, {tok('summary_text')}), 1) pos from articles where id % 100 = 0),
    f as (select source_id, token, min(pos) pos from k where not list_contains({STOP}, token) and (length(token) > 1 or regexp_matches(token, '[0-9]')) group by 1, 2),
    q as (select * from (select *, row_number() over (partition by source_id order by pos) n from f) where n <= 16),
    h as (select source_id, item_id, sum(weight) s from q join w on q.token = w.token where source_id <> item_id group by 1, 2),
    r as (select source_id, item_id, round(s / (s + 1), 9) rank, published_at from h join articles a on a.id = h.item_id)
    select source_id, item_id, round(rank, 6) rank, place from (select *, row_number() over (partition by source_id order by rank desc, published_at desc nulls last, item_id desc) place from r) where place <= 150"""


@query(LEXICAL)
def lexical_candidates(t: Tables):
    """R5 J10 T6 W3, for the stated sources against all articles"""
    sources = t.articles.where("id % 100 = 0").select(F.col("id").alias("source_id"))
    return R.lexical_candidates(sources, t.articles).withColumn("rank", F.round("rank", 6))


@query(LEXICAL)
def lexical_indexed(t: Tables):
    """The same through a stored index, read by the sources' tokens; cells of segments and searches meet in tasks"""
    at = scratch(t.spark)

    def keep(df):
        df.write.parquet(f"{at}/terms")
        return t.spark.read.parquet(f"{at}/terms")

    index = P.PostingIndex.of(R.occurrences(t.articles), parts=P.parts_of(t.articles, *map(F.col, R.WEIGHTS))).save(f"{at}/postings")
    terms = R.source_terms(t.articles.where("id % 100 = 0").select(F.col("id").alias("source_id")), t.articles)
    rows = P.ranked(index, terms, t.articles.select(F.col("id").alias("item_id"), "published_at"), R.CANDIDATES, keep)
    return rows.withColumn("rank", F.round("rank", 6))


PAIRS = """with a as (select item_id, embedding v from features where status = 'ready' and algorithm_version = 'similarity-v1'),
    d as (select s.item_id source_id, a.item_id, 1 - list_cosine_similarity(s.v::double[], a.v::double[]) distance from a join a s on s.item_id % 10 = 0 and s.item_id <> a.item_id),
    n as (select *, row_number() over (partition by source_id order by distance, item_id) place from d where distance <= 0.75)"""


@query(PAIRS + " select source_id, item_id, round(distance, 6) distance, place from n where place <= 150")
def semantic_candidates(t: Tables):
    """R2 J9 T5 X38 F8"""
    sources = t.features.where("item_id % 10 = 0").select(F.col("item_id").alias("source_id"))
    return R.semantic_candidates(sources, t.features, VERSION, least=WEAK).withColumn("distance", F.round("distance", 6))


@query(PAIRS + """, s as (select count(*) n from a where item_id % 10 = 0), b as (select count(*) n from a)
    select (select count(*) from n where place <= 150) exact, s.n * b.n pairs, true recalled, true sparing from s, b""")
def semantic_recall(t: Tables):
    """Whether the inverted file finds nine tenths of the exact neighbours and scores a tenth of all pairs at most; ``index_work`` has the figures"""
    return index_figures(t).select("exact", "pairs", (F.col("hits") >= 0.9 * F.col("exact")).alias("recalled"), (F.col("scored") <= 0.1 * F.col("pairs")).alias("sparing"))


def index_figures(t: Tables):
    """Exact neighbours of the stated sources, how many the index finds, all pairs, those whose code is looked at, and those scored exactly.

    The test vectors are spread evenly over the sphere, so their lists prune little: nine of ten are asked.
    """
    pool = R.pool_of(t.features, VERSION)
    asked = pool.where("item_id % 10 = 0").withColumnRenamed("item_id", "source_id")
    index = N.index_of(pool)
    probe = -(-9 * len(index.quantiser.centroids) // 10)
    found = N.candidates(index, asked, WEAK, 2 * R.CANDIDATES, probe).withColumn("found", F.lit(True))
    near = N.reranked(found, asked, pool, WEAK, R.CANDIDATES)
    figures = R.recall(R.semantic_candidates(asked.select("source_id"), t.features, VERSION, least=WEAK), near)
    return figures.crossJoin(N.work(index, asked, probe)).crossJoin(found.agg(F.count("*").alias("scored")))


@query()
def index_work(t: Tables):
    """The shares behind ``semantic_recall``"""
    share = lambda c: F.round(F.col(c) / F.greatest("pairs", F.lit(1)), 4).alias(c)
    return index_figures(t).select("exact", "hits", F.round("recall", 4).alias("recall"), "pairs", share("scanned"), share("scored"))


@query("""select a.id source_id, case when f.status = 'skipped' then 'unavailable' when f.status is null or f.algorithm_version <> 'similarity-v1' or f.embedding is null then 'pending' else 'ready' end status
    from articles a left join features f on a.id = f.item_id""")
def source_status(t: Tables):
    """R1"""
    return R.source_status(t.articles.select(F.col("id").alias("source_id")), t.features, VERSION)


@query(PAIRS + """ select source_id, item_id, round((0.7 / (60 + place)) * case when x.feed_id = y.feed_id then 0.9 else 1.0 end * case when x.published_at is null then 1.0 else 1 + 0.05 / (1 + greatest((epoch_us($now) - epoch_us(x.published_at)) / 86400000000.0, 0) / 30) end, 8) score
    from n join articles x on x.id = n.item_id join articles y on y.id = n.source_id where place <= 150 and 1 - distance >= 0.35""")
def fused_semantic(t: Tables):
    """R6 R9 X26 X27 X28 J7 J8, semantic list alone"""
    sources = t.features.where("item_id % 10 = 0").select(F.col("item_id").alias("source_id"))
    near = R.semantic_candidates(sources, t.features, VERSION, least=WEAK)
    none = near.select("source_id", "item_id", F.lit(0.0).alias("rank"), "place").where("false")
    return R.fuse(near, none, t.articles, now(), STRONG, WEAK).select("source_id", "item_id", F.round("score", 8).alias("score"))


@query(PAIRS.replace("% 10 = 0", "% 100 = 0") + ", " + LEX[5:] + f""", k as (select id source_id, unnest(list_concat({tok('title')}, {tok('summary_text')})) token, generate_subscripts(list_concat({tok('title')}, {tok('summary_text')}), 1) pos from articles where id % 100 = 0),
    f as (select source_id, token, min(pos) pos from k where not list_contains({STOP}, token) and (length(token) > 1 or regexp_matches(token, '[0-9]')) group by 1, 2),
    q as (select * from (select *, row_number() over (partition by source_id order by pos) n from f) where n <= 16),
    h as (select source_id, item_id, sum(weight) s from q join w on q.token = w.token where source_id <> item_id group by 1, 2),
    r as (select source_id, item_id, round(s / (s + 1), 9) rank, published_at from h join articles a on a.id = h.item_id),
    l as (select * from (select *, row_number() over (partition by source_id order by rank desc, published_at desc nulls last, item_id desc) place from r) where place <= 150),
    m as (select coalesce(n.source_id, l.source_id) source_id, coalesce(n.item_id, l.item_id) item_id, 1 - distance similarity, n.place sp, l.rank, l.place lp from (select * from n where place <= 150) n full join l on n.source_id = l.source_id and n.item_id = l.item_id),
    o as (select m.*, (coalesce(0.7 / (60 + sp), 0) + coalesce(0.3 / (60 + lp), 0)) * case when x.feed_id = y.feed_id then 0.9 else 1.0 end * case when x.published_at is null then 1.0 else 1 + 0.05 / (1 + greatest((epoch_us($now) - epoch_us(x.published_at)) / 86400000000.0, 0) / 30) end score
        from m join articles x on x.id = m.item_id join articles y on y.id = m.source_id where coalesce(similarity >= 0.35, false) or coalesce(similarity >= 0.25 and rank is not null, false) or (similarity is null and rank >= 0.05))
    select source_id, item_id, sp semantic_place, lp lexical_place, round(score, 8) score from o""")
def fused_hybrid(t: Tables):
    """Both lists"""
    sources = t.features.where("item_id % 100 = 0").select(F.col("item_id").alias("source_id"))
    near = R.semantic_candidates(sources, t.features, VERSION, least=WEAK)
    asked = t.articles.where("id % 100 = 0").select(F.col("id").alias("source_id"))
    rows = R.fuse(near, R.lexical_candidates(asked, t.articles), t.articles, now(), STRONG, WEAK)
    return rows.select("source_id", "item_id", "semantic_place", "lexical_place", F.round("score", 8).alias("score"))


def title_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+'))"


def alike(x: str, y: str) -> str:
    return f"(len({x}) >= 3 and len({y}) >= 3 and len(list_intersect({x}, {y})) >= 0.85 * len(list_distinct(list_concat({x}, {y}))))"


@query("with recursive a" + PAIRS.replace("% 10 = 0", "% 100 = 0")[6:] + ", live as (select * from articles where id in (select item_id from a)), " + LEX[5:].replace("from articles", "from live") + f""", k as (select id source_id, unnest(list_concat({tok('title')}, {tok('summary_text')})) token, generate_subscripts(list_concat({tok('title')}, {tok('summary_text')}), 1) pos from live where id % 100 = 0),
    f as (select source_id, token, min(pos) pos from k where not list_contains({STOP}, token) and (length(token) > 1 or regexp_matches(token, '[0-9]')) group by 1, 2),
    q as (select * from (select *, row_number() over (partition by source_id order by pos) n from f) where n <= 16),
    h as (select source_id, item_id, sum(weight) s from q join w on q.token = w.token where source_id <> item_id group by 1, 2),
    r as (select source_id, item_id, round(s / (s + 1), 9) rank, published_at from h join articles a on a.id = h.item_id),
    l as (select * from (select *, row_number() over (partition by source_id order by rank desc, published_at desc nulls last, item_id desc) place from r) where place <= 150),
    m as (select coalesce(n.source_id, l.source_id) source_id, coalesce(n.item_id, l.item_id) item_id, 1 - distance similarity, n.place sp, l.rank, l.place lp from (select * from n where place <= 150) n full join l on n.source_id = l.source_id and n.item_id = l.item_id),
    o as (select m.source_id, m.item_id, x.feed_id, x.published_at, {title_set('x.title')} words, {title_set('y.title')} source_words, concat(x.lang, '/', cast(x.id % 400 as varchar)) address, concat(y.lang, '/', cast(y.id % 400 as varchar)) source_address,
        round((coalesce(0.7 / (60 + sp), 0) + coalesce(0.3 / (60 + lp), 0)) * case when x.feed_id = y.feed_id then 0.9 else 1.0 end * case when x.published_at is null then 1.0 else 1 + 0.05 / (1 + greatest((epoch_us($now) - epoch_us(x.published_at)) / 86400000000.0, 0) / 30) end, 12) score
        from m join articles x on x.id = m.item_id join articles y on y.id = m.source_id where coalesce(similarity >= 0.35, false) or coalesce(similarity >= 0.25 and rank is not null, false) or (similarity is null and rank >= 0.05)),
    p as (select *, row_number() over (partition by source_id order by score desc, published_at desc nulls last, item_id desc) turn from o),
    fit as (select * from p where address <> source_address and not {alike('words', 'source_words')}),
    g as (select id source_id, 0::bigint turn, [{{'item_id': 0::bigint, 'feed_id': '', 'address': '', 'words': ['']}}][2:] chosen from live where id % 100 = 0
        union all select g.source_id, p.turn, case when fit.item_id is null or len(chosen) > 5 or len(list_filter(chosen, lambda c: c.feed_id = fit.feed_id)) >= 2 or len(list_filter(chosen, lambda c: c.address = fit.address or {alike('c.words', 'fit.words')})) > 0 then chosen
            else list_append(chosen, {{'item_id': fit.item_id, 'feed_id': fit.feed_id, 'address': fit.address, 'words': fit.words}}) end
            from g join p on p.source_id = g.source_id and p.turn = g.turn + 1 left join fit on fit.source_id = p.source_id and fit.turn = p.turn),
    e as (select source_id, arg_max(chosen, turn) chosen from g group by 1),
    s as (select a.id source_id, case when f.status = 'skipped' then 'unavailable' when f.status is null or f.algorithm_version <> 'similarity-v1' or f.embedding is null then 'pending' else 'ready' end status from articles a left join features f on a.id = f.item_id where a.id % 100 = 0)
    select s.source_id, s.status, least(coalesce(len(chosen), 0), 5) count, coalesce(len(chosen), 0) > 5 has_more, coalesce(array_to_string(list_transform(chosen[:5], lambda c: cast(c.item_id as varchar)), ','), '') items from s left join e using (source_id)""")
def similar_items(t: Tables):
    """Hybrid ranking of the stated sources, chosen greedily; the oracle takes each source's ranking turn by turn"""
    sources = t.articles.where("id % 100 = 0").select(F.col("id").alias("source_id"))
    rows = R.similar_items(sources, t.articles, t.features, now(), VERSION, 5, "hybrid", STRONG, WEAK)
    return rows.select("source_id", "status", "count", "has_more", F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("items"))


@query(PAIRS + """, one as (select item_id source_id, label from features where item_id % 10 = 0 and status = 'ready' and algorithm_version = 'similarity-v1'),
    c as (select label, count(*) - 1 others from features group by 1),
    b as (select source_id, coalesce((select sum(1 / log2(i + 1)) from range(1, 6) r(i) where i <= others), 0) best from one join c using (label)),
    r as (select n.source_id, place, case when o.label = f.label then 1 else 0 end gain, a.feed_id, lower(trim(coalesce(a.title, ''))) title from n join one o on n.source_id = o.source_id join features f on f.item_id = n.item_id join articles a on a.id = n.item_id where place <= 5),
    g as (select source_id, sum(gain / log2(place + 1)) dcg, sum(gain) good, count(*) n, count(distinct feed_id) feeds, count(distinct title) titles from r group by 1)
    select round(avg(coalesce(good, 0) / 5.0), 6) precision_at_5, round(avg(case when best > 0 then coalesce(dcg, 0) / best else 0 end), 6) ndcg, round(avg(case when n > 0 then 1.0 else 0.0 end), 6) covered, round(avg(case when good > 0 then 1.0 else 0.0 end), 6) useful,
    round(sum(n - good) / sum(n), 6) irrelevant, round(sum(n - titles) / sum(n), 6) repeated, round(sum(feeds) / sum(n), 6) diversity from b left join g using (source_id)""")
def relevance(t: Tables):
    """The vectors' classes as judgments; a source's relevant items are counted by class, never listed"""
    one = t.features.select(F.col("item_id").alias("source_id"), F.col("label").alias("own"), "status", "algorithm_version").where("source_id % 10 = 0 and status = 'ready' and algorithm_version = 'similarity-v1'")
    classes = t.features.groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("others"))
    near = R.semantic_candidates(one.select("source_id"), t.features, VERSION, least=WEAK).where("place <= 5")
    labelled = near.join(one.select("source_id", "own"), "source_id").join(t.features.select("item_id", "label"), "item_id").join(t.articles.select(F.col("id").alias("item_id"), "feed_id", "title"), "item_id")
    asked = one.join(classes, "own").select("source_id", R.best_gain(F.col("others")).alias("best"))
    return R.relevance_of(asked, labelled.withColumn("gain", (F.col("own") == F.col("label")).cast("int"))).withColumnRenamed("precision", "precision_at_5")


@query("""select id, concat('https://news.example.com/', lang, '/', cast(id % 400 as varchar)) canonical, 'https://news.example.com/favicon.ico' favicon from articles""")
def article_urls(t: Tables):
    """X3 X4"""
    return t.articles.select("id", canonical_url(F.col("url")).alias("canonical"), favicon_url(F.col("url")).alias("favicon"))


@query("""select id, sha256(case when id % 2 = 0 then concat('guid:', feed_id, ':', 'g', cast(id as varchar)) else concat('fallback:', feed_id, ':', url, ':', coalesce(title, ''), ':', coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z'), '')) end) dedupe_key from articles""")
def dedupe_keys(t: Tables):
    """X5"""
    guid = F.when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id").cast("string")))
    return t.articles.select("id", FF.dedupe_key(F.col("feed_id"), guid, F.col("url"), F.col("title"), F.col("published_at")).alias("dedupe_key"))


@query("""select id, epoch_us(published_at) rfc, epoch_us(published_at) iso, epoch_us(published_at) eastern, epoch_us(published_at) short, epoch_us(date_trunc('day', published_at)) dated, epoch_us(date_trunc('day', published_at)) named,
    epoch_us(date_trunc('minute', published_at)) figures, epoch_us(published_at) shifted from articles""")
def parsed_dates(t: Tables):
    """Dates written in each form and read again"""
    at = F.col("published_at")
    west = lambda h: at - F.make_dt_interval(hours=F.lit(h))
    forms = {
        "rfc": F.concat(F.lit("Mon, "), F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        "eastern": F.concat(F.date_format(west(5), "d MMM yyyy HH:mm:ss"), F.lit(" EST")),
        "short": F.concat(F.lit("Tue, "), F.date_format(west(7), "dd MMM yy HH:mm:ss"), F.lit(" PDT")),
        "dated": F.date_format(at, "d MMM yyyy"),
        "named": F.date_format(at, "MMMM d, yyyy"),
        "figures": F.date_format(at, "M/d/yyyy h:mm a"),
        "shifted": F.concat(F.date_format(west(-2), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200")),
    }
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.articles.select("id", *(FF.published_at(v).alias(k) for k, v in forms.items()), FF.published_at(F.lit("never"), iso).alias("iso"))


#: An item for each document, with elements that no list of names foresees, a number with zeros in front, repeated enclosures, two links of
#: which the first is no address, and a date in Eastern time.
ODD_ITEM = """concat('<rss><channel><title>t</title><item><guid>00', cast(doc_id as string), '</guid><itunes:episode>00', cast(doc_id % 10 as string), '</itunes:episode><media:group><media:thumbnail url="https://i.example/', cast(doc_id as string), '.jpg"/><media:description>told ', lang, '</media:description></media:group>',
    '<odd:', lang, ' k="1.50">true</odd:', lang, '><enclosure url="a"/>', case when doc_id % 3 = 0 then '<enclosure url="b"/>' else '' end, '<pubDate>2 Mar 2026 19:00:00 EST</pubDate></item></channel></rss>')"""
ODD_ENTRY = """concat('<feed><title>t</title><entry><id>1</id><title>e</title><link href="', case when doc_id % 2 = 0 then 'no address' else '/relative' end, '"/><link rel="" href="HTTPS://E.example:443/a/../', cast(doc_id as string), '"/></entry></feed>')"""


def landed(t: Tables, body):
    none = F.lit(None).cast("string")
    return t.table("documents").select(F.col("doc_id").alias("feed_id"), F.lit(200).alias("http_status"), none.alias("etag"), none.alias("last_modified"), body.alias("body"), none.alias("error"), now().alias("fetched_at"), F.lit(1).alias("duration_ms"))


@query("""select doc_id feed_id, concat('00', cast(doc_id as varchar)) guid, concat('00', cast(doc_id % 10 as varchar)) episode, concat('https://i.example/', cast(doc_id as varchar), '.jpg') image, concat('told ', lang) summary, '1.50' k, 'true' own,
    case when doc_id % 3 = 0 then 2 else 0 end enclosures, 1772496000000000 published_at from documents""")
def ingested_extensions(t: Tables):
    """What items of unlisted names keep, read from the stored extension data"""
    rows = SF.item_rows(SF.documents(SF.classified(landed(t, F.expr(ODD_ITEM))))).join(t.table("documents").select(F.col("doc_id").alias("feed_id"), "lang"), "feed_id")
    raw = F.col("raw_extension_data")
    odd = F.get(F.map_values(F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, v: k.startswith("odd:"))), 0)
    group = lambda *p: FF.read_text(raw, "media:group", *p)
    return rows.select(
        "feed_id", "guid", FF.read_text(raw, "itunes:episode").alias("episode"), group("media:thumbnail", "@_url").alias("image"), FF.summary_or_description(F.col("summary_text"), raw).alias("summary"),
        F.get_json_object(odd, "$['@_k']").alias("k"), F.get_json_object(odd, "$['#text']").alias("own"), F.coalesce(F.json_array_length(F.get_json_object(raw, "$['enclosure']")), F.lit(0)).alias("enclosures"), "published_at",
    )


@query("select doc_id feed_id, concat('https://e.example/', cast(doc_id as varchar)) url from documents")
def ingested_links(t: Tables):
    """The first link that is an address, as the URL standard writes it"""
    return SF.item_rows(SF.documents(SF.classified(landed(t, F.expr(ODD_ENTRY))))).select("feed_id", "url")


@query("""select id, concat('https://a.example:8443/Dir', cast(id % 7 as varchar), '/x%20', cast(id as varchar), '?q=%C3%A9') href, concat('https://a.example:8443/Dir', cast(id % 7 as varchar), '/x%20', cast(id as varchar)) canonical,
    'https://a.example:8443/favicon.ico' favicon, id % 2 = 0 plain from articles""")
def hard_urls(t: Tables):
    """Dot segments, spaces, ports, other letters"""
    k = F.col("id")
    raw = F.concat(F.lit("  HTTPS://A.Example:08443/y/../Dir"), (k % 7).cast("string"), F.lit("/./x "), k.cast("string"))
    port = F.concat(F.lit("http://1.1:8"), F.when(k % 2 == 0, F.lit("0")).otherwise(F.lit("00000")))
    return t.articles.select("id", normal_url(F.concat(raw, F.lit("?q=é"))).alias("href"), canonical_url(F.concat(raw, F.lit("//#f"))).alias("canonical"), favicon_url(F.concat(raw, F.lit("?z"))).alias("favicon"), (normal_url(port).isNotNull()).alias("plain"))


@query("""select id, case when id % 3 = 0 then 'youtube' when id % 3 = 1 then 'podcast' end kind, case when id % 3 = 0 then concat('https://www.youtube-nocookie.com/embed/video_', cast(id as varchar)) end player_url,
    case when id % 3 < 2 then cast(id % 60 * 60 + 5 as double) end duration, case when id % 3 = 1 then 'audio/mpeg' end mime from articles""")
def article_media(t: Tables):
    """X9 X10 X11 X7 X8 X12"""
    k = F.col("id")
    clock = F.concat((k % 60).cast("string"), F.lit(":05"))
    raw = F.when(k % 3 == 1, F.to_json(F.create_map(F.lit("itunes:duration"), clock)))
    sound = F.concat(F.lit('{"itunes:duration":"'), clock, F.lit('","enclosure":{"@_url":"https://a.example/x.mp3","@_type":"audio/mpeg"}}'))
    video = F.concat(F.lit('{"itunes:duration":"'), clock, F.lit('"}'))
    raw = F.when(k % 3 == 1, sound).when(k % 3 == 0, video)
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?x=1&v=video_"), k.cast("string"))).otherwise(F.col("url"))
    m = FF.media(raw, url)
    return t.articles.select("id", m["kind"].alias("kind"), m["player_url"].alias("player_url"), m["duration_seconds"].alias("duration"), m["mime_type"].alias("mime"))


@query("select id, round(case when published_at is null then 1.0 else 1 + 0.05 / (1 + greatest((epoch_us($now) - epoch_us(published_at)) / 86400000000.0, 0) / 30) end, 9) factor from articles")
def recency_factors(t: Tables):
    """X26"""
    return t.articles.select("id", F.round(recency(F.col("published_at"), now()), 9).alias("factor"))


@query("select page_id, case when octet_length(encode(html)) > 2500 then 'too_large' when page_id % 7 = 0 then 'bad_url' end error from pages")
def page_sizes(t: Tables):
    """With a bound that some pages pass, and some addresses that aren't of the web"""
    pages = t.table("pages").withColumn("url", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp://"), "url")).otherwise(F.col("url")))
    return SL.sized(pages, 2500).select("page_id", "error")


#: Pages that name feeds: a third one, a third the same one twice and another kind of link, a third none.
NAMING = """concat('<head><link rel="stylesheet" href="/s.css">', case when page_id % 3 < 2 then concat('<link rel="alternate feed" type="application/atom+xml; charset=x" title=" Feed of ', cast(page_id as string), ' " href="/feeds/', cast(page_id % 40 as string), '.xml">') else '' end,
    case when page_id % 3 = 1 then concat('<link rel="ALTERNATE" type="application/rss+xml" href="/feeds/', cast(page_id % 40 as string), '.xml"><link rel="alternate" type="text/html" href="/m">') else '' end, '</head>', html)"""
SITE = "regexp_extract(url, '^https?://[^/]+', 0)"


@query(f"select page_id, concat({SITE}, '/feeds/', cast(page_id % 40 as varchar), '.xml') feed_url, concat('Feed of ', cast(page_id as varchar)) title, 'application/atom+xml' as type from pages where page_id % 3 < 2")
def discovered_feeds(t: Tables):
    """S7, over the whole pages with feed links put in front"""
    return SL.discover(t.table("pages").withColumn("html", F.expr(NAMING))).select("page_id", "feed_url", "title", "type")


@query(f"""with p as (select page_id, url, case when page_id % 3 < 2 then concat({SITE}, '/feeds/', cast(page_id % 40 as varchar), '.xml') end feed_url from pages)
    select count(*) processed, count(*) filter (where feed_url is not null and page_id % 40 >= 10) added, count(*) filter (where feed_url is null) failed from p""")
def bulk_added(t: Tables):
    """All pages as a list of addresses, a quarter of their feeds known already"""
    pages = t.table("pages").withColumn("html", F.expr(NAMING))
    known = SL.discover(pages).where("page_id % 40 < 10").select("feed_url").distinct()
    listed = pages.select("url").distinct()
    return SL.bulk_add(listed, pages, known)


@query("""select s_suppkey doc_id, 0 pos, concat('https://s', cast(s_suppkey as varchar), '.example.org/feed') feed_url, concat('Shelf ', cast(s_suppkey % 6 as varchar)) folder_title, s_name title from supplier
    union all select s_suppkey, 2, concat('https://all', cast(s_suppkey % 3 as varchar), '.example.org/'), null, null from supplier""")
def imported_outlines(t: Tables):
    """An outline document for each supplier, with an address twice, nested folders and a feed in none"""
    k = F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("https://S"), k, F.lit(".example.org/feed"))
    body = F.concat(F.lit('<opml><body><outline text="Room"><outline text="Shelf '), (F.col("s_suppkey") % 6).cast("string"), F.lit('"><outline text=" '), F.col("s_name"), F.lit(' " xmlUrl="'), own, F.lit('"/></outline></outline><outline xmlUrl="'), own, F.lit('"/><outline xmlUrl="https://all'), (F.col("s_suppkey") % 3).cast("string"), F.lit('.example.org"/></body></opml>'))
    return subscriptions(t.table("supplier").select(F.col("s_suppkey").alias("doc_id"), body.alias("body"))).select("doc_id", "pos", "feed_url", "folder_title", "title")


@query("""select id, nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') title, case when id % 3 = 0 then 'application/rss+xml' else 'text/html' end media, coalesce(case when id % 4 = 0 then concat('item ', cast(id as varchar)) end, case when id % 4 = 1 then 'told' end) summary,
    concat('https://shop.example.com/Order/', cast(id % 5000 as varchar), '/#top') url from items""")
def normal_values(t: Tables):
    """Texts and addresses as they are stored"""
    k = F.col("id")
    kind = F.when(k % 3 == 0, " Application/RSS+XML; charset=utf-8").otherwise("TEXT/html ")
    summary = F.when(k % 4 == 0, F.concat(F.lit(" item "), k.cast("string"), F.lit("\n"))).when(k % 4 == 2, "  ")
    raw = F.when(k % 4 == 1, '{"media:description":" told "}')
    return t.items.select("id", T.normalized(F.concat(F.lit(" \t"), "title", F.lit("\n"))).alias("title"), U.content_type(kind).alias("media"), FF.summary_or_description(T.normalized(summary), raw).alias("summary"), normal_url(F.col("url")).alias("url"))


@query("select page_id, cast(count(*) as bigint) links from (select page_id, unnest(regexp_extract_all(html, '<a href=')) from pages) group by 1")
def page_link_counts(t: Tables):
    """S7"""
    return SL.page_links(t.table("pages")).where("tag = 'a'").groupBy("page_id").agg(F.count("*").alias("links"))


@query("""with l as (select doc_id, unnest(string_split(regexp_replace(text, '[<>&]', '', 'g'), chr(10))) line from documents)
    select doc_id feed_id, count(*) filter (where trim(line, ' ' || chr(9) || chr(13)) <> '') items, count(*) missing from l group by 1""")
def ingested_documents(t: Tables):
    """S2 S3 S4 ST1: each document as a landed feed of its lines"""
    lines = F.transform(F.split(F.regexp_replace("text", "[<>&]", ""), "\n"), lambda x: F.concat(F.lit("<item><title>"), x, F.lit("</title></item>")))
    body = F.concat(F.lit("<rss version='2.0'><channel><title>t</title>"), F.array_join(lines, ""), F.lit("</channel></rss>"))
    titled = F.size(F.filter("items", lambda x: x["title"].isNotNull()))
    feeds = SF.feed_rows(SF.documents(SF.classified(landed(t, body))), F.when(F.col("items").isNull(), 0).otherwise(titled).alias("titled"))
    return feeds.select("feed_id", F.col("titled").alias("items"), F.col("missing_published_at_count").alias("missing"))


@query("""with l as (select doc_id, unnest(string_split(regexp_replace(text, '[<>&]', '', 'g'), chr(10))) line from documents)
    select doc_id feed_id, case when doc_id % 2 = 0 then 'Atom' else 'RDF' end feed_title, count(*) n, count(*) filter (where trim(line, ' ' || chr(9) || chr(13)) <> '') titled, count(*) dated from l group by 1, 2""")
def ingested_entries(t: Tables):
    """Each document as a landed Atom or RDF feed of its lines"""
    atom = F.col("doc_id") % 2 == 0
    lines = F.split(F.regexp_replace("text", "[<>&]", ""), "\n")
    entries = F.when(atom, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<entry><title>"), x, F.lit("</title><updated>2024-03-05T06:07:08Z</updated></entry>"))), ""))
    items = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<item><title>"), x, F.lit("</title><dc:date>2024-03-05T06:07:08Z</dc:date></item>"))), "")
    body = F.coalesce(F.concat(F.lit("<feed><title>Atom</title>"), entries, F.lit("</feed>")), F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>RDF</title></channel>'), items, F.lit("</rdf:RDF>")))
    of = lambda name: F.size(F.filter("items", lambda x: x[name].isNotNull())).alias(f"{name}s")
    feeds = SF.feed_rows(SF.documents(SF.classified(landed(t, body))), F.size("items").alias("n"), of("title"), of("published_at")).where("n > 0")
    return feeds.select("feed_id", "feed_title", "n", F.col("titles").alias("titled"), F.col("published_ats").alias("dated"))


@query("""select doc_id feed_id, case when doc_id % 5 = 0 then 'error' when doc_id % 5 = 1 then 'not_modified' when doc_id % 5 = 2 then 'error' else 'success' end status, case when doc_id % 5 = 0 then 'network' when doc_id % 5 = 2 then 'parse' end error_category,
    case when doc_id % 5 = 0 then 503 when doc_id % 5 = 1 then 304 else 200 end http_status, case when doc_id % 5 > 2 then 1 else 0 end new_item_count, 0 missing_published_at_count, case when doc_id % 5 = 0 then 'down' end error_message from documents""")
def logged_fetches(t: Tables):
    """The log row of each landed response: failed, unchanged, unreadable or read"""
    k = F.col("feed_id")
    rows = landed(t, F.expr(ODD_ITEM)).withColumns({"http_status": F.when(k % 5 == 0, 503).when(k % 5 == 1, 304).otherwise(200), "error": F.when(k % 5 == 0, "down"), "body": F.when(k % 5 == 2, "<rss><channel>").otherwise(F.col("body"))})
    return SF.outcomes(rows)[0].select("feed_id", "status", "error_category", "http_status", "new_item_count", "missing_published_at_count", "error_message")


@query(f"""with p as (select id, trim(regexp_replace(coalesce(title, ''), '[\\x00-\\x20\\x7F]+', ' ', 'g')) plain from articles)
    select id item_id, case when len({tok('plain')}) < 3 then 'skipped' else 'ready' end status, sha256(concat('similarity-v1', chr(0), plain)) input_hash from p""")
def streamed_features(t: Tables):
    """ST4 S15 M7 A11: features of the articles' titles through the stream, each item once though half of them come twice"""
    folder, none = scratch(t.spark), F.lit(None).cast("string")
    items = t.articles.select("id", "title", none.alias("summary_text"), none.alias("content"))
    for part in (items.where("id % 2 = 0"), items):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 200).parquet(f"{folder}/in")
        jobs.features(stream, lambda df: FE.feature_rows(df, FE.hashed_embedder(16), 16, VERSION, 64, exact=False), f"{folder}/features", f"{folder}/checkpoint", VERSION, 8).awaitTermination()
    return t.spark.read.parquet(f"{folder}/features/algorithm_version={VERSION}").select("item_id", "status", "input_hash")


@query("""select doc_id feed_id, concat('00', cast(doc_id as varchar)) guid from documents""")
def streamed_items(t: Tables):
    """ST1 ST2 M6: every document's feed lands twice; the stream of ingest adds its item once"""
    folder = scratch(t.spark)
    rows = landed(t, F.expr(ODD_ITEM)).withColumns({"feed_id": F.col("feed_id").cast("string"), "http_status": F.col("http_status").cast("int"), "duration_ms": F.col("duration_ms").cast("int")})
    for part in (rows.where("cast(feed_id as long) % 3 > 0"), rows):
        part.write.mode("append").parquet(f"{folder}/in")
        jobs.ingest(jobs.responses(t.spark, f"{folder}/in", 200), f"{folder}/items", f"{folder}/log", f"{folder}/checkpoint", 8).awaitTermination()
    return t.spark.read.parquet(f"{folder}/items").select(F.col("feed_id").cast("long").alias("feed_id"), "guid")


@query("""with s as (select id, list_sort(list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'))) own from articles)
    select id, min(id) over (partition by own) least, count(*) over (partition by own) members from s where len(own) >= 3""")
def near_titles(t: Tables):
    """X25, titles of one token set: each article with its class, never a class's pairs; every other title is in full-width letters"""
    plain, wide = "".join(map(chr, range(33, 127))), "".join(map(chr, range(0xFF01, 0xFF5F)))
    titles = t.articles.withColumn("title", F.when(F.col("id") % 2 == 0, F.translate("title", plain, wide)).otherwise(F.col("title")))
    return R.title_classes(titles).select("id", "least", "members")


@query("""with s as (select id, list_sort(list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'))) own from articles), c as (select own, min(id) least from s where len(own) >= 3 group by 1)
    select least id, id other, true same from s join c using (own) where id > least
    union all select x.least, y.least, false from c x join c y on x.least < y.least and len(list_intersect(x.own, y.own)) * 20 >= (len(x.own) + len(y.own) - len(list_intersect(x.own, y.own))) * 17""")
def near_title_links(t: Tables):
    """X25, whole: also among articles of different titles"""
    return R.near_title_links(t.articles)
