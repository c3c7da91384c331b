"""The feed domain's tables, as views over the TPC-H-like test tables.

Each view is one SELECT in the common part of Spark SQL and DuckDB; ``ts(x)`` stands for a timestamp of x microseconds.
So queries and their oracles read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The moment that queries take as now, and a day before it.
NOW_US = 1705320000000000
SINCE_US = NOW_US - 86_400_000_000

VIEWS = {
    "folders": """select cast(n_nationkey as bigint) id, n_name title, cast(n_regionkey as bigint) position,
        ts((1704067200 + cast(n_nationkey as bigint) * 3600) * 1000000) created_at from nation""",
    "feeds": """select c_custkey id, case when c_custkey % 10 = 0 then null else cast(c_nationkey as bigint) end folder_id,
        case when c_custkey % 9 = 0 then null else c_name end title, concat('https://Site', cast(c_custkey as string), '.example.com/Home/') site_url,
        concat('https://site', cast(c_custkey as string), '.example.com/feed.xml') feed_url, cast(null as string) favicon_url,
        case when c_custkey % 5 = 0 then 'error' else 'active' end status, c_acctbal < 0 is_paused,
        concat('etag-', cast(c_custkey as string)) etag, cast(null as string) last_modified, 60 + (c_custkey % 24) * 60 fetch_interval_minutes,
        case when c_custkey % 7 = 0 then null else ts(1705319000000000 + (c_custkey % 100) * 30000000) end next_fetch_at,
        ts(1705233000000000 + (c_custkey % 500) * 60000000) last_fetched_at, ts(1705225000000000 + (c_custkey % 700) * 120000000) last_success_at,
        case when c_custkey % 3 = 0 then ts(1705220000000000 + (c_custkey % 900) * 100000000) end last_error_at,
        case when c_custkey % 5 <> 0 then null when c_custkey % 10 = 0 then 'parse' else 'network' end last_error_category,
        case when c_custkey % 5 = 0 then concat('failed ', cast(c_custkey % 4 as string)) end last_error_message,
        case when c_custkey % 5 = 0 then c_custkey % 12 else 0 end consecutive_error_count,
        case when c_custkey % 11 = 0 then 'reader' end auth_username, case when c_custkey % 22 = 0 then 'secret' end auth_password,
        ts((1690000000 + (c_custkey * 7919) % 10000000) * 1000000) created_at from customer""",
    "items": """select o_orderkey id, o_custkey feed_id, concat(o_orderpriority, ' number ', cast(o_orderkey % 1000 as string)) title,
        concat('https://Shop.Example.com/Order/', cast(o_orderkey % 5000 as string), '/#top') url,
        case when o_orderkey % 3 = 0 then null else concat('author ', o_orderstatus) end author, cast(null as string) summary_text,
        concat('<p>Order <b>', o_orderstatus, '</b> of ', cast(o_custkey as string), '</p>') content_html,
        case when o_orderkey % 50 = 0 then null else cast(o_orderdate as timestamp) end published_at, o_orderstatus = 'F' is_read,
        case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) end read_at, o_orderpriority = '1-URGENT' is_starred,
        case when o_orderpriority = '1-URGENT' then cast(o_orderdate as timestamp) end starred_at,
        ts((1690000000 + (o_orderkey * 104729) % 10000000) * 1000000) created_at from orders""",
    "fetch_events": """select event_id id, user_id feed_id, case when event_type = 'error' then 'error' when event_type = 'view' then 'not_modified' else 'success' end status,
        case when event_type <> 'error' then null when event_id % 3 = 0 then null when event_id % 3 = 1 then 'parse' else 'network' end error_category,
        case when event_type <> 'error' then null when event_id % 7 = 0 then '' else concat('message ', cast(event_id % 6 as string)) end error_message,
        case when event_type = 'error' then 400 + event_id % 5 when event_type = 'view' then 304 else 200 end http_status,
        case when event_type = 'click' then event_id % 4 else 0 end missing_published_at_count, cast(ts as timestamp) fetched_at,
        cast(abs(value) as bigint) duration_ms, cast(floor(event_id / 500) as bigint) cycle_id from events""",
    "articles": """select doc_id id, source feed_id, lang, split_part(text, chr(10), 1) title, split_part(text, chr(10), 2) summary_text, text content,
        case when doc_id % 20 = 0 then null else ts((1690000000 + (doc_id * 15485863) % 15000000) * 1000000) end published_at,
        concat('https://News.example.com/', lang, '/', cast(doc_id % 400 as string), '/') url from documents""",
    "features": """select d.doc_id item_id, case when d.doc_id % 13 = 0 then 'skipped' else 'ready' end status,
        case when d.doc_id % 17 = 0 then 'similarity-v0' else 'similarity-v1' end algorithm_version, e.embedding, cast(e.label as bigint) label
        from documents d join embeddings e on d.doc_id = e.vec_id""",
}


def sql_of(name: str, engine: str) -> str:
    """A view's SELECT for 'spark' or 'duckdb'."""
    sql = re.sub(r"\bts\(", "timestamp_micros(" if engine == "spark" else "make_timestamp(", VIEWS[name])
    return sql if engine == "spark" else sql.replace("as string)", "as varchar)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table; unused columns are pruned down to the Parquet scan."""
    sql = sql_of(name, "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"(?:from|join)\s+(\w+)", sql))}
    for t in tables:
        sql = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put in front as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b(from|join)\s+{n}\b", sql)]
    head = ", ".join(f"{n} as ({sql_of(n, 'duckdb')})" for n in used)
    body = sql.strip()
    if not used:
        return body
    own = re.match(r"with( recursive)? ", body, re.I)
    return f"with{own[1] or ''} {head}, {body[own.end():]}" if own else f"with {head} {body}"
