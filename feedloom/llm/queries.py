"""The numbered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from feedloom.llm.byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from feedloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.fingerprint_log import log_dedup

    return log_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.weak_quality import weak_quality

    return weak_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.periodic_runs import listing, periodic_runs, with_cycles

    rows = periodic_runs(with_cycles(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", digest(listing(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.minhash import minhash_groups

    return minhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedloom.llm.prefix_trie import prefix_trie, shared_beginnings

    return prefix_trie(*shared_beginnings(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_suffix_dedup, op3_toxicity, op4_quality_rules, op5_byte_bpe, op6_token_counts, op7_decontaminate, op8_html_extract, op9_fingerprint_log, op10_weak_quality, op11_periodic_runs, op12_minhash, op13_prefix_trie)}


#: All strings of 50 bytes by MD5 of their hexadecimal digits, and the bytes between the removed runs.
SUFFIX_SQL = r"""with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
    w as (select doc_id, i, md5(substr(x, 2 * i + 1, 100)) g from (select doc_id, x, unnest(range(0, length(x) // 2 - 49)) i from d)),
    m as (select g, min(doc_id) least from w group by 1 having count(*) > 1),
    r as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) fresh from w join m using (g) where doc_id > least),
    s as (select doc_id, min(i) a, max(i) + 50 b from (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) run from r) group by doc_id, run),
    p as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) a, a b from s union all select d.doc_id, coalesce(max(s.b), 0), max(length(x) // 2) from d left join s on s.doc_id = d.doc_id group by 1),
    k as (select doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' order by a) kept from p join d using (doc_id) group by 1),
    t as (select doc_id, sum(b - a) n, count(*) runs from s group by 1)
    select d.doc_id, length(x) // 2 n_bytes, cast(coalesce(t.n, 0) as bigint) n_removed, coalesce(t.runs, 0) n_spans, sha256(unhex(kept)) kept_sha256 from d join k using (doc_id) left join t using (doc_id)"""
#: All windows of 35 words by MD5, those that stand twice, and the words that none of them covers.
LOG_SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
    x as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) g from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d)),
    r as (select g from x group by 1 having count(*) > 1),
    c as (select distinct doc_id, unnest(range(i, i + 35)) i from x semi join r using (g)),
    k as (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from d),
    o as (select doc_id, count(*) n, string_agg(word, ' ' order by i) kept from k anti join c using (doc_id, i) group by 1)
    select d.doc_id, len(w) n_words, len(w) - coalesce(o.n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join o using (doc_id)"""
#: Links of all pairs that share a shingle, and what each document reaches along them.
MINHASH_SQL = r"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) shingle from d),
    n as (select doc_id, count(*) n from s group by 1),
    p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
    l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
    r as (select doc_id node, doc_id reached from d union select l.y, r.reached from r join l on l.x = r.node)
    select d.doc_id, coalesce(n.n, 0) n_shingles, least_reached component_id, d.doc_id = least_reached kept from d left join n using (doc_id) join (select node, min(reached) least_reached from r group by 1) g on g.node = d.doc_id"""
#: CRC-32 of a decimal number, a bit at a time.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast({} as varchar), ''), lambda c: ascii(c)::bigint)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: case when t & 1 = 1 then xor(t >> 1, 3988292384::bigint) else t >> 1 end)), 4294967295::bigint)"
#: Every prefix of every rebuilt conversation as a list of turns; totals of all nodes below each.
TRIE_SQL = r"""with o as (select conv_id c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) own from conversations where conv_id is not null group by 1),
    h as (select *, """ + CRC_SQL.format("c") + r""" % 4 h from o),
    r as (select h.c, list_concat(coalesce(lead.own, [])[1:h], h.own[h + 1:]) turns from h left join o lead on lead.c = h.c - h.c % 20),
    p as (select c, turns, unnest(range(0, len(turns) + 1)) depth from r),
    n as (select turns[1:depth] node, depth, min(c) conv_id, count(*) n_convs, sha256(coalesce(string_agg(case when len(turns) = depth then cast(c as varchar) end, ',' order by c), '')) ends_sha256 from p group by 1, 2),
    k as (select node[1:depth - 1] parent, count(*) n_children from n where depth > 0 group by 1),
    m as (select n.*, coalesce(n_children, 0) n_children, (n_convs - 1) * coalesce(len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')), 0) own from n left join k on k.parent = n.node),
    t as (select node[1:d] node, sum(own) saved_tokens, count(*) filter (where n_children = 0) n_leaves from (select *, unnest(range(0, depth + 1)) d from m) group by 1)
    select m.conv_id, m.depth, u.conv_id parent_conv_id, m.n_convs, m.n_children, t.n_leaves, cast(t.saved_tokens as bigint) saved_tokens, m.ends_sha256 from m join t on t.node = m.node left join n u on m.depth > 0 and u.node = m.node[1:m.depth - 1]"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's queries for the operators that SQL can express within reason on whole tables."""
    return {"op2_suffix_dedup": SUFFIX_SQL, "op9_fingerprint_log": LOG_SQL, "op12_minhash": MINHASH_SQL, "op13_prefix_trie": TRIE_SQL}
