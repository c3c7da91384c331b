"""Lists, pages, counts, digests and maintenance: queries whose oracles are plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.feeds import activity, alert_flags, duration_seconds, error_category, next_interval, retry_delay_ms
from feedloom.functions.vectors import valid
from feedloom.operators import items as I
from feedloom.operators import maintenance as M
from feedloom.operators import statistics as S
from feedloom.operators.features import results
from feedloom.operators.stored import BucketedTable
from feedloom.plans.registry import VERSION, Tables, now, query, scratch, since
from feedloom.sources.opml import export_outline
from feedloom.streaming.schedule import feed_schedule

DAY = 86_400_000_000


@query("""select f.id, f.folder_id, f.title, f.status, f.is_paused, f.auth_username is not null and f.auth_password is not null has_auth, epoch_us(f.created_at) created_at,
    coalesce(c.n, 0) item_count, coalesce(c.r, 0) read_count from feeds f left join (select feed_id, count(*) n, count(*) filter (where is_read) r from items group by 1) c on f.id = c.feed_id""")
def feed_statistics(t: Tables):
    """S1 A1 J2 T4 F6"""
    return S.feed_list(t.feeds, t.items).select("id", "folder_id", "title", "status", "is_paused", "has_auth", "created_at", "item_count", "read_count")


@query("select id, title, position, epoch_us(created_at) created_at from folders order by position, folders.created_at, id")
def folder_list(t: Tables):
    """T4"""
    return S.folder_list(t.folders)


#: Extension data for items: an episode, a clip with a description, or none.
RAW = """case when id % 3 = 0 then concat('{"itunes:duration":"', cast(id % 60 as string), ':05","enclosure":{"@_url":"HTTPS://A.example/', cast(id as string), '.mp3","@_type":"audio/mpeg"}}')
    when id % 3 = 1 then concat('{"yt:videoId":"clip_', cast(id as string), '","media:group":{"media:description":" told ', cast(id as string), ' "}}') end"""


@query("""select i.id, i.feed_id, i.title, f.title feed_title, epoch_us(i.published_at) published_at, i.is_read, i.is_starred, case when i.id % 3 = 1 then concat('told ', cast(i.id as varchar)) end summary_text,
    case when i.id % 3 = 0 then 'podcast' when i.id % 3 = 1 then 'youtube' end kind, case when i.id % 3 = 1 then concat('https://www.youtube-nocookie.com/embed/clip_', cast(i.id as varchar)) end player_url,
    case when i.id % 3 = 0 then concat('https://a.example/', cast(i.id as varchar), '.mp3') end enclosure_url, case when i.id % 3 = 0 then cast(i.id % 60 * 60 + 5 as double) end duration from items i join feeds f on i.feed_id = f.id
    where f.folder_id = 7 and not i.is_read and i.is_starred order by i.published_at desc nulls last, i.id desc limit 101""")
def item_page(t: Tables):
    """The page's rows with media and summaries from extension data"""
    rows = I.page(t.items.withColumn("raw_extension_data", F.expr(RAW)), t.feeds, folder_id=7, read=False, starred=True)
    m = F.col("media")
    return rows.select("id", "feed_id", "title", "feed_title", "published_at", "is_read", "is_starred", "summary_text", m["kind"].alias("kind"), m["player_url"].alias("player_url"), m["enclosure_url"].alias("enclosure_url"), m["duration_seconds"].alias("duration"))


@query("""select i.id, epoch_us(i.published_at) published_at from items i join feeds f on i.feed_id = f.id where i.published_at < make_timestamp(1704067200000000)
    or (i.published_at = make_timestamp(1704067200000000) and i.id < 5000) or i.published_at is null order by i.published_at desc nulls last, i.id desc limit 51""")
def item_page_after(t: Tables):
    """F4 T1"""
    return I.page(t.items, t.feeds, cursor=I.Cursor(1704067200000000, 5000), limit=50).select("id", "published_at")


SEARCH = """with w as (select i.*, f.title feed_title from items i join feeds f on i.feed_id = f.id),
    k as (select *, regexp_extract_all(lower(concat_ws(' ', coalesce(title,''), coalesce(summary_text,''), regexp_replace(coalesce(content_html,''), '<[^>]*>', ' ', 'g'), coalesce(author,''))), '[\\p{L}\\p{N}]+') own,
    regexp_extract_all(lower(coalesce(feed_title,'')), '[\\p{L}\\p{N}]+') feed from w)
    select id, feed_id, epoch_us(published_at) published_at from k where (list_contains(own, 'urgent') and list_contains(own, '77')) or (list_contains(feed, 'urgent') and list_contains(feed, '77'))"""


@query(SEARCH)
def item_search(t: Tables):
    """F2 F3 U1 in one pass"""
    return I.search(I.with_feeds(t.items, t.feeds), "Urgent 77").select("id", "feed_id", "published_at")


@query(SEARCH)
def item_search_union(t: Tables):
    """U1 as a distinct union"""
    return I.search_union(I.with_feeds(t.items, t.feeds), "Urgent 77").select("id", "feed_id", "published_at")


@query(SEARCH)
def item_search_indexed(t: Tables):
    """F2 F3 U1 by a stored index: words' id lists are intersected, feeds' titles give the rest"""
    index = I.search_index(t.items).save(f"{scratch(t.spark)}/words")
    return I.search_indexed(t.items.join(t.feeds.select(F.col("id").alias("feed_id")), "feed_id", "left_semi"), t.feeds, index, "Urgent 77").select("id", "feed_id", "published_at")


@query("""select id, epoch_us(next_fetch_at) next_fetch_at from feeds where not is_paused and coalesce(next_fetch_at, $now) <= $now order by coalesce(feeds.next_fetch_at, $now), id limit 50""")
def due_feeds(t: Tables):
    """F5 T2"""
    return S.due_feeds(t.feeds, now()).select("id", "next_fetch_at")


@query("""select e.id, e.feed_id, e.status, e.error_category, e.http_status, epoch_us(e.fetched_at) fetched_at, f.title feed_title, f.feed_url from fetch_events e join feeds f on e.feed_id = f.id
    order by e.fetched_at desc, e.id desc limit 100""")
def fetch_log(t: Tables):
    """J3 T3"""
    return S.fetch_log(t.fetch_events, t.feeds, limit=100).select("id", "feed_id", "status", "error_category", "http_status", "fetched_at", "feed_title", "feed_url")


@query("""select e.id, epoch_us(e.fetched_at) fetched_at from fetch_events e join feeds f on e.feed_id = f.id where e.feed_id = 42 order by e.fetched_at desc, e.id desc limit 20""")
def fetch_log_of_feed(t: Tables):
    """F10"""
    return S.fetch_log(t.fetch_events, t.feeds, feed_id=42).select("id", "fetched_at")


FLEET = """count(*) total, count(*) filter (where not is_paused) active, count(*) filter (where is_paused) paused, count(*) filter (where not is_paused and status = 'error') failing,
    count(*) filter (where not is_paused and status = 'error' and last_error_category = 'network') failing_network, count(*) filter (where not is_paused and status = 'error' and last_error_category = 'parse') failing_parse"""


@query(f"select {FLEET} from feeds")
def fleet_counts(t: Tables):
    """A2"""
    return S.fleet_counts(t.feeds)


@query("""select count(*) events, count(distinct feed_id) feeds, count(*) filter (where status = 'error') errors, cast(coalesce(sum(missing_published_at_count), 0) as bigint) missing_dates
    from fetch_events where fetched_at >= $since""")
def window_counts(t: Tables):
    """A3 F9"""
    return S.window_counts(t.fetch_events, since())


@query("""select error_category category, nullif(error_message, '') message, count(*) n from fetch_events where fetched_at >= make_timestamp(0) and status = 'error' group by 1, 2
    order by n desc, category nulls last, message nulls last limit 5""")
def top_errors(t: Tables):
    """A4 X39"""
    return S.top_errors(t.fetch_events, F.timestamp_micros(F.lit(0)))


@query("""select id, consecutive_error_count, epoch_us(last_error_at) last_error_at from feeds where not is_paused and status = 'error' order by consecutive_error_count desc, feeds.last_error_at nulls last, id limit 10""")
def longest_failing(t: Tables):
    """T8"""
    return S.longest_failing(t.feeds).select("id", "consecutive_error_count", "last_error_at")


@query("""select id, epoch_us(last_error_at) last_error_at from feeds where not is_paused and status = 'error' and last_error_at >= $since and consecutive_error_count <= 3 order by feeds.last_error_at desc nulls last, id limit 10""")
def newly_failing(t: Tables):
    """T9"""
    return S.newly_failing(t.feeds, since()).select("id", "last_error_at")


@query("""select id, epoch_us(last_success_at) last_success_at from feeds where status <> 'error' and last_success_at >= $since and last_success_at > last_error_at order by feeds.last_success_at desc, id limit 10""")
def recovered_feeds(t: Tables):
    """T10"""
    return S.recovered(t.feeds, since()).select("id", "last_success_at")


COVER = """with d as (select item_id from features where algorithm_version = 'similarity-v1'), p as (select * from articles where id not in (select item_id from d))"""


@query(COVER + """, c as (select (select count(*) from articles) total, (select count(*) from features where algorithm_version = 'similarity-v1' and status = 'ready') ready,
    (select count(*) from features where algorithm_version = 'similarity-v1' and status = 'skipped') skipped, (select count(*) from p) pending, (select epoch_us(min(published_at)) from p) oldest_pending)
    select *, round((ready + skipped) * 100.0 / total, 2) percent from c""")
def coverage_status(t: Tables):
    """A5 A6 J5"""
    return S.coverage(t.articles, t.features, VERSION)


@query(COVER + " select id, epoch_us(published_at) published_at from p order by p.published_at desc nulls last, id desc limit 200")
def backfill_order(t: Tables):
    """J6 T11 ST5"""
    return S.backfill(t.articles.withColumn("created_at", F.col("published_at")), t.features, VERSION, limit=200).select("id", "published_at")


@query("""select id, case when created_at >= make_timestamp(1695000000000000) then 100 else 0 end priority from items order by 2 desc, created_at, id limit 64""")
def work_order(t: Tables):
    """T12"""
    return S.work_order(t.items, F.timestamp_micros(F.lit(1695000000000000)), 64).select("id", "priority")


STATE = """with r as (select *, sum(case when status = 'error' then 0 else 1 end) over (partition by feed_id order by fetched_at, id rows unbounded preceding) run from fetch_events),
    s as (select *, sum(case when status = 'error' then 1 else 0 end) over (partition by feed_id, run order by fetched_at, id rows unbounded preceding) error_count from r),
    q as (select *, lag(status) over (partition by feed_id order by fetched_at, id) previous_status, coalesce(lag(error_count) over (partition by feed_id order by fetched_at, id), 0) previous_error_count from s)"""


@query(STATE + " select id, feed_id, status, previous_status, cast(previous_error_count as bigint) previous_error_count, cast(error_count as bigint) error_count from q")
def previous_state(t: Tables):
    """W4 W1"""
    return S.previous_state(t.fetch_events).select("id", "feed_id", "status", "previous_status", "previous_error_count", "error_count")


ALERTS = STATE + """, g as (select *, case when previous_status = 'error' and status <> 'error' then 1
    when status = 'error' and (coalesce(previous_status <> 'error', true) or previous_error_count = 0) then case when http_status in (401, 403) then 2 when error_category = 'parse' then 3 when error_category = 'network' then 4 else 5 end
    when status = 'error' and error_count in (3, 10, 25) then 6 end section from q),
    l as (select *, row_number() over (partition by cycle_id order by section, id) line, count(*) over (partition by cycle_id, section) section_count, count(*) over (partition by cycle_id) actionable from g where section is not null)"""


@query(ALERTS + " select cycle_id, section, line, id, section_count, actionable, greatest(actionable - 120, 0) omitted from l where line <= 120")
def cycle_alerts(t: Tables):
    """G1 X33 X34 A12"""
    return S.cycle_alerts(S.previous_state(t.fetch_events)).select("cycle_id", "section", "line", "id", "section_count", F.col("actionable").cast("long").alias("actionable"), F.col("omitted").cast("long").alias("omitted"))


@query("""select cycle_id, count(*) filter (where status = 'success') success, count(*) filter (where status = 'not_modified') not_modified, count(*) filter (where status = 'error') error,
    count(*) filter (where error_category = 'network') network, count(*) filter (where error_category = 'parse') parse, cast(coalesce(sum(missing_published_at_count), 0) as bigint) missing_dates from fetch_events group by 1""")
def cycle_summary(t: Tables):
    """A7 A8 A11"""
    return S.cycle_summary(t.fetch_events, "cycle_id")


@query(f"""with a as (select {FLEET} from feeds), b as (select count(*) events, count(distinct feed_id) feeds, count(*) filter (where status = 'error') errors, cast(coalesce(sum(missing_published_at_count), 0) as bigint) missing_dates from fetch_events where fetched_at >= $since),
    x as (select string_agg(cast(id as varchar), ',' order by consecutive_error_count desc, last_error_at nulls last, id) v from (select * from feeds where not is_paused and status = 'error' order by consecutive_error_count desc, last_error_at nulls last, id limit 10)),
    y as (select string_agg(cast(id as varchar), ',' order by last_success_at desc, id) v from (select * from feeds where status <> 'error' and last_success_at >= $since and last_success_at > last_error_at order by last_success_at desc, id limit 10)),
    z as (select string_agg(cast(id as varchar), ',' order by last_error_at desc nulls last, id) v from (select * from feeds where not is_paused and status = 'error' and last_error_at >= $since and consecutive_error_count <= 3 order by last_error_at desc nulls last, id limit 10)),
    e as (select error_category c, nullif(error_message, '') m, count(*) n from fetch_events where fetched_at >= $since and status = 'error' group by 1, 2 order by n desc, c nulls last, m nulls last limit 5),
    u as (select string_agg(cast(n as varchar), ',' order by n desc, c nulls last, m nulls last) v from e)
    select a.*, b.*, x.v longest, y.v recovered, coalesce(z.v, '') newly, coalesce(u.v, '') top_errors from a, b, x, y, z, u""")
def daily_digest(t: Tables):
    """G2"""
    d = S.daily_digest(t.feeds, t.fetch_events, since())
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return d.withColumns({"longest": joined("longest_failing"), "recovered": joined("recovered"), "newly": joined("newly_failing"), "top_errors": joined("top_error_counts")}).drop("longest_failing", "newly_failing", "top_error_counts")


@query("""with b as (select cycle_id % 3 kind, max(fetched_at) sent_at from fetch_events where cycle_id % 3 = 1 group by 1)
    select epoch_us(max(sent_at)) last_sent, epoch_us(coalesce(max(sent_at), $now - interval 24 hour)) since, max(sent_at) is null or max(sent_at) <= $now - interval 24 hour due from b""")
def digest_due(t: Tables):
    """G3 W5"""
    kinds = t.fetch_events.select((F.col("cycle_id") % 3).cast("string").alias("kind"), F.col("fetched_at").alias("sent_at"))
    return S.digest_due(S.latest_batch(kinds), "1", now())


@query("""select cycle_id, 'cycle' kind, count(*) n, min(id) least from fetch_events group by 1""")
def notification_batches(t: Tables):
    """The payload's members are counted again from its JSON; a cycle has 500 events however large the table is"""
    rows = S.notification_batch(t.fetch_events, "cycle", now())
    member = F.from_json("payload", "array<struct<id:long,status:string>>")
    return rows.select("cycle_id", "kind", F.size(member).cast("long").alias("n"), F.array_min(F.transform(member, lambda x: x["id"])).alias("least"))


@query("""select f.id, f.folder_id, d.title folder_title, coalesce(f.title, f.feed_url) text from feeds f left join folders d on f.folder_id = d.id""")
def export_list(t: Tables):
    """S11 J4"""
    from feedloom.sources.opml import export_rows

    own = export_rows(t.feeds, t.folders).select("feed_url", "folder_title", "text")
    return t.feeds.select("id", "folder_id", "feed_url").join(own, "feed_url").select("id", "folder_id", "folder_title", "text")


@query("""with r as (select f.*, d.title folder_title, row_number() over (order by d.position nulls first, d.created_at nulls first, f.created_at, f.id) pos from feeds f left join folders d on f.folder_id = d.id)
    select id, case when folder_title is not null then first_value(id) over (partition by folder_title order by pos) end group_first, folder_title, feed_url, is_paused from r""")
def export_outline_rows(t: Tables):
    """S10"""
    return export_outline(t.feeds, t.folders).select(F.col("place.id").alias("id"), "group_first", "folder_title", "feed_url", "is_paused")


STATES = """with c as (select custkey, seq, r, s from (select o_orderkey custkey, o_orderkey % 7 seq, case when o_orderkey % 2 = 0 then true when o_orderkey % 4 = 1 then false end r, case when o_orderkey % 3 = 0 then false end s from orders where o_orderkey % 5 = 0))
    select i.id, coalesce(c.r, i.is_read) is_read, epoch_us(case when c.r is null then i.read_at when c.r then $now end) read_at, coalesce(c.s, i.is_starred) is_starred, epoch_us(case when c.s is null then i.starred_at when c.s then $now end) starred_at
    from items i left join c on i.id = c.custkey"""


@query(STATES)
def item_state_changes(t: Tables):
    """M1 J11"""
    return M.apply_item_state(t.items, state_changes(t), now()).select("id", "is_read", "read_at", "is_starred", "starred_at")


def state_changes(t: Tables):
    k = F.col("id")
    return t.items.where(k % 5 == 0).select("id", (k % 7).alias("seq"), F.when(k % 2 == 0, True).when(k % 4 == 1, False).alias("is_read"), F.when(k % 3 == 0, False).alias("is_starred"))


@query(STATES)
def item_state_stored(t: Tables):
    """The same on a stored table, of which a change rewrites the buckets that it touches"""
    table = BucketedTable(t.spark, f"{scratch(t.spark)}/items", "id", 32).write(t.items.select("id", "is_read", "read_at", "is_starred", "starred_at"))
    table.change(state_changes(t), lambda rows, new: M.apply_item_state(rows, new, now()))
    return table.rows("id", "is_read", "read_at", "is_starred", "starred_at")


@query("""select id, case when id % 4 = 0 and id % 3 = 0 then null when id % 4 = 0 then concat('renamed ', cast(id as varchar)) else title end title, case when id % 4 = 0 and id % 8 = 0 then null else folder_id end folder_id,
    case when id % 4 = 0 then true else is_paused end is_paused, auth_username, auth_password from feeds""")
def feed_patches(t: Tables):
    """M2"""
    k, no = F.col("id"), F.lit(False)
    patch = t.feeds.where(k % 4 == 0).select(
        "id", F.lit(1).alias("seq"), F.when(k % 3 != 0, F.concat(F.lit("renamed "), k.cast("string"))).alias("title"), F.lit(True).alias("has_title"), F.lit(None).cast("long").alias("folder_id"), (k % 8 == 0).alias("has_folder_id"),
        F.lit(True).alias("is_paused"), F.lit(True).alias("has_is_paused"), F.lit(None).cast("string").alias("auth_username"), no.alias("has_auth_username"), F.lit(None).cast("string").alias("auth_password"), no.alias("has_auth_password"),
    )
    return M.apply_feed_patch(t.feeds, patch).select("id", "title", "folder_id", "is_paused", "auth_username", "auth_password")


@query("""select id, case when id % 2 = 0 then concat('folder ', cast(id as varchar)) else title end title, position from folders""")
def folder_patches(t: Tables):
    """M3"""
    k = F.col("id")
    patch = t.folders.where(k % 2 == 0).select("id", F.lit(1).alias("seq"), F.concat(F.lit("folder "), k.cast("string")).alias("title"), F.lit(True).alias("has_title"), F.lit(0).cast("long").alias("position"), F.lit(False).alias("has_position"))
    return M.apply_folder_patch(t.folders, patch).select("id", "title", "position")


#: Addresses of an import: those of known feeds and, twice over or more, of unknown ones.
INCOMING_URL = "case when s_suppkey % 2 = 0 then concat('https://site', cast(s_suppkey * 3 as string), '.example.com/feed.xml') else concat('https://other', cast(s_suppkey % 50 as string), '.example.org/feed') end"


@query("""with i as (select s_suppkey pos, case when s_suppkey % 2 = 0 then concat('https://site', cast(s_suppkey * 3 as varchar), '.example.com/feed.xml') else concat('https://other', cast(s_suppkey % 50 as varchar), '.example.org/feed') end feed_url, case when s_suppkey % 4 <> 0 then concat('import ', cast(s_suppkey % 6 as varchar)) end folder_title from supplier),
    f as (select folder_title, min(pos) pos from i where folder_title is not null group by 1), n as (select i.* from (select *, row_number() over (partition by feed_url order by pos) k from i) i where k = 1 and feed_url not in (select feed_url from feeds))
    select n.pos, n.feed_url, case when f.pos is not null then concat('new-', cast(f.pos as varchar)) end folder_id from n left join f on n.folder_title = f.folder_title""")
def subscription_import(t: Tables):
    """M4 J12 W2 A10"""
    k = F.col("s_suppkey")
    incoming = t.table("supplier").select(k.alias("pos"), F.expr(INCOMING_URL).alias("feed_url"), F.when(k % 4 != 0, F.concat(F.lit("import "), (k % 6).cast("string"))).alias("folder_title"), F.lit(None).cast("string").alias("site_url"), F.lit(None).cast("string").alias("title"))
    return M.import_subscriptions(t.feeds, t.folders, incoming)[1].select("pos", "feed_url", "folder_id")


@query("""with i as (select s_suppkey pos, case when s_suppkey % 2 = 0 then concat('https://site', cast(s_suppkey * 3 as varchar), '.example.com/feed.xml') else concat('https://other', cast(s_suppkey % 50 as varchar), '.example.org/feed') end feed_url, concat('import ', cast(s_suppkey % 6 as varchar)) folder_title from supplier)
    select count(distinct feed_url) filter (where feed_url not in (select feed_url from feeds)) created_feeds, count(distinct folder_title) created_folders, count(distinct feed_url) filter (where feed_url in (select feed_url from feeds)) skipped_feeds from i""")
def subscription_import_counts(t: Tables):
    """A9"""
    k = F.col("s_suppkey")
    incoming = t.table("supplier").select(k.alias("pos"), F.expr(INCOMING_URL).alias("feed_url"), F.concat(F.lit("import "), (k % 6).cast("string")).alias("folder_title"), F.lit(None).cast("string").alias("site_url"), F.lit(None).cast("string").alias("title"))
    return M.import_subscriptions(t.feeds, t.folders, incoming)[2]


@query("select id, case when folder_id % 3 <> 0 then folder_id end folder_id from feeds")
def deleted_folders(t: Tables):
    """M5: feeds of deleted folders stay, in none"""
    return M.delete_folders(t.folders, t.feeds, t.folders.where("id % 3 = 0").select("id"))[1].select("id", "folder_id")


@query("select id, feed_id from items where feed_id % 6 <> 0")
def deleted_feeds(t: Tables):
    """M5: items go with their feeds"""
    return M.delete_feeds(t.feeds, t.feeds.where("id % 6 = 0").select("id"), items=t.items, events=t.fetch_events)["items"].select("id", "feed_id")


@query("""with k as (select feed_id, id % 40 dedupe_key, min(id) pos from items group by 1, 2), o as (select distinct feed_id, id % 40 dedupe_key from items where id % 3 = 0) select k.* from k where not exists (select 1 from o where o.feed_id = k.feed_id and o.dedupe_key = k.dedupe_key)""")
def inserted_items(t: Tables):
    """M6"""
    batch = t.items.select("feed_id", (F.col("id") % 40).alias("dedupe_key"), F.col("id").alias("pos"))
    return M.new_items(batch.where("pos % 3 = 0"), batch).select("feed_id", "dedupe_key", "pos")


@query("select item_id, status, case when item_id % 4 = 0 then 2 else 1 end generated_at from features")
def upserted_features(t: Tables):
    """M7 S15"""
    rows = t.features.select("item_id", "status", F.lit(1).cast("long").alias("generated_at"))
    return M.upsert_features(rows, rows.where("item_id % 4 = 0").withColumn("generated_at", F.lit(2).cast("long")))


OUTCOMES = """with o as (select id, case when id % 3 = 0 then 'error' when id % 3 = 1 then 'not_modified' else 'success' end os, id % 4 n from feeds where id % 2 = 0),
    j as (select f.*, o.os, o.n, case when o.os = 'error' then f.consecutive_error_count + 1 else 0 end streak, greatest(f.fetch_interval_minutes, 60) cur from feeds f left join o on f.id = o.id),
    v as (select *, cast(least(greatest(case when os = 'error' then ceil(cur * case when streak >= 3 then 2.5 else 2.0 end) when os = 'not_modified' or n = 0 then cur + 30 else greatest(60, floor(cur * 0.75)) end, 60), 1440) as bigint) nxt from j)"""


@query(OUTCOMES + """ select id, case when os is null then status when os = 'error' then 'error' else 'active' end status, case when os is null then consecutive_error_count else streak end consecutive_error_count,
    case when os is null then fetch_interval_minutes else nxt end fetch_interval_minutes, epoch_us(case when os is null then next_fetch_at else $now + to_minutes(nxt) end) next_fetch_at, case when os is not null then coalesce(title, 'from feed') else title end title,
    case when os = 'success' then 'new' else etag end etag, case when os is null then last_error_category when os = 'error' then 'network' end last_error_category from v""")
def fetch_outcomes(t: Tables):
    """M8 X29"""
    return M.apply_outcomes(t.feeds, outcomes_of(t), now()).select("id", "status", "consecutive_error_count", "fetch_interval_minutes", "next_fetch_at", "title", "etag", "last_error_category")


def outcomes_of(t: Tables):
    k = F.col("id")
    none = F.lit(None).cast("string")
    return t.feeds.where(k % 2 == 0).select(k.alias("feed_id"), F.when(k % 3 == 0, "error").when(k % 3 == 1, "not_modified").otherwise("success").alias("status"), F.when(k % 3 == 0, "network").alias("error_category"), none.alias("error_message"), F.when(k % 3 == 2, "new").alias("etag"), none.alias("last_modified"), F.lit("from feed").alias("feed_title"), none.alias("site_url"), none.alias("favicon_url"), (k % 4).alias("new_item_count"), F.lit(1).alias("seq"))


@query(OUTCOMES + """ select id, case when os = 'error' then 'error' else 'active' end status, cast(streak as bigint) consecutive_error_count, nxt fetch_interval_minutes, epoch_us($now + to_minutes(nxt)) next_fetch_at, coalesce(title, 'from feed') title,
    case when os = 'success' then 'new' else etag end etag, case when os = 'error' then 'network' end last_error_category from v where os is not null""")
def streamed_outcomes(t: Tables):
    """ST3 M8: the same outcomes through the stream of feed states, that starts from the feeds' table"""
    folder = scratch(t.spark)
    later = now() + F.make_dt_interval(F.lit(2))
    o = outcomes_of(t).withColumn("fetched_at", now())
    none = {c: F.lit(None).cast(o.schema[c].dataType) for c in o.columns}
    mark = t.spark.range(1).select(*(c.alias(k) for k, c in (none | {"feed_id": F.lit(-1).cast("long"), "status": F.lit("not_modified"), "fetched_at": later}).items()))
    o.unionByName(mark).write.parquet(f"{folder}/in")
    stream = feed_schedule(t.spark.readStream.schema(t.spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in"), t.feeds, "1 hour")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{folder}/out").where("kind = 'state' and feed_id >= 0")
    return rows.select(F.col("feed_id").alias("id"), "status", "consecutive_error_count", "fetch_interval_minutes", "next_fetch_at", "title", "etag", "last_error_category")


@query("""select count(*) claimed, count(*) filter (where status = 'ready' and item_id % 6 >= 2) ready, count(*) filter (where status = 'skipped') skipped, count(*) filter (where status = 'ready' and item_id % 6 < 2) failed from features""")
def feature_results(t: Tables):
    """What became of a batch's items; some vectors are cut short or hold no number"""
    k = F.col("item_id")
    odd = F.when(k % 6 == 0, F.slice("embedding", 1, 63)).when(k % 6 == 1, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("embedding"))
    status = F.when(F.col("status") == "skipped", "skipped").when(~valid(odd, 64), "failed").otherwise("ready")
    return t.features.select(status.alias("status")).agg(*results())


@query("""select item_id, status, status = 'ready' and item_id % 6 < 2 vector, status = 'skipped' skipped_vector, item_id % 10 = 0 version from features""")
def feature_rules(t: Tables):
    """Some vectors cut short or with a member that is no number, some versions missing"""
    k = F.col("item_id")
    odd = F.when(k % 6 == 0, F.slice("embedding", 1, 63)).when(k % 6 == 1, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("embedding"))
    rows = M.validate_features(t.features.withColumns({"embedding": odd, "algorithm_version": F.when(k % 10 != 0, F.col("algorithm_version"))}), 64)
    return rows.select("item_id", "status", *(F.array_contains("broken", n).alias(n) for n in ("vector", "skipped_vector", "version")))


@query("select id, case when id % 5 = 0 then false else is_paused end is_paused, epoch_us(case when id % 5 = 0 then $now else next_fetch_at end) next_fetch_at from feeds")
def retried_feeds(t: Tables):
    """M10"""
    return M.retry_now(t.feeds, t.feeds.where("id % 5 = 0"), now()).select("id", "is_paused", "next_fetch_at")


@query("""select id item_id, cast(least(60000 * pow(2, least(greatest(consecutive_error_count - 1, 0), 16)), 86400000) as bigint) delay, epoch_us($now) + 1000 * cast(least(60000 * pow(2, least(greatest(consecutive_error_count - 1, 0), 16)), 86400000) as bigint) available_at
    from feeds where status = 'error'""")
def retry_schedule(t: Tables):
    """M11 X31"""
    rows = t.feeds.where("status = 'error'").select(F.col("id").alias("item_id"), F.col("consecutive_error_count").alias("attempts"), F.col("last_error_category").alias("error_category"), F.col("last_error_message").alias("error_message"))
    return M.schedule_retries(rows, now()).select("item_id", retry_delay_ms(F.col("attempts")).alias("delay"), "available_at")


@query("""select s_suppkey pos, concat_ws(',', case when s_suppkey * 3 <= (select max(id) from feeds) and s_suppkey % 2 = 0 then 'conflict' end, case when s_suppkey % 30 >= 25 then 'folder' end) errors from supplier""")
def import_checks(t: Tables):
    """M12 F11"""
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://site"), F.when(k % 2 == 0, k * 3).otherwise(-k).cast("string"), F.lit(".example.com/feed.xml"))
    none = F.lit(None).cast("string")
    rows = t.table("supplier").select(k.alias("pos"), url.alias("feed_url"), (k % 30).alias("folder_id"), none.alias("title"), none.alias("auth_username"), none.alias("auth_password"))
    return M.checked_feeds(rows, t.feeds, t.folders).select("pos", F.array_join("errors", ",").alias("errors"))


@query("""select id, case when fetch_interval_minutes < 360 or id % 3 > 0 then 'active' else 'inactive' end activity, case when id % 2 = 0 then 'parse' else 'network' end category,
    cast(id % 90 * 3600 + id % 60 * 60 + id % 50 as double) duration from feeds""")
def feed_scalars(t: Tables):
    """X30 X32 X11"""
    k = F.col("id")
    clock = F.concat_ws(":", (k % 90).cast("string"), (k % 60).cast("string"), (k % 50).cast("string"))
    return t.feeds.select("id", activity(F.col("fetch_interval_minutes"), k % 3).alias("activity"), error_category(k % 2 == 0).alias("category"), duration_seconds(clock).alias("duration"))


@query(STATE + """ select id, coalesce(previous_status, '') = 'error' and status <> 'error' recovered, status = 'error' and (coalesce(previous_status <> 'error', true) or previous_error_count = 0) new_error, http_status in (401, 403) auth from q""")
def alert_flag_rows(t: Tables):
    """X33"""
    rows = S.previous_state(t.fetch_events)
    flags = alert_flags(F.col("status"), F.col("previous_status"), F.col("previous_error_count"), F.col("error_count"), F.col("http_status"))
    return rows.select("id", *(flags[n].alias(n) for n in ("recovered", "new_error", "auth")))


@query("""select epoch_us(date_trunc('day', fetched_at)) start, count(*) events, count(*) filter (where status = 'error') errors, cast(sum(missing_published_at_count) as bigint) missing_dates from fetch_events group by 1""")
def daily_windows(t: Tables):
    """ST6 in batch"""
    from feedloom.streaming.jobs import windowed_health

    return windowed_health(t.fetch_events)


@query("""select id, cast(least(greatest(case when status = 'error' then ceil(greatest(fetch_interval_minutes, 60) * case when consecutive_error_count >= 3 then 2.5 else 2.0 end) when id % 4 = 0 then greatest(fetch_interval_minutes, 60) + 30
    else greatest(60, floor(greatest(fetch_interval_minutes, 60) * 0.75)) end, 60), 1440) as bigint) next_minutes from feeds""")
def next_intervals(t: Tables):
    """X29"""
    return t.feeds.select("id", next_interval(F.col("fetch_interval_minutes"), F.col("consecutive_error_count"), F.col("id") % 4, F.when(F.col("status") == "error", "error").otherwise("success")).alias("next_minutes"))
