"""Related items by hand, and streams against their batch forms."""

from datetime import datetime

from pyspark.sql import functions as F

from feedloom.operators import similar as R
from feedloom.operators import statistics as S
from feedloom.sources.feeds import RESPONSES
from feedloom.sources.tables import view
from feedloom.streaming import jobs


def test_diversity_is_greedy(spark):
    kind = "source_id long, item_id long, feed_id string, title string, url string, published_at timestamp, score double, source_title string, source_url string"
    rows = [(0, 1, "a", "something else one", "https://X.example/src#f", None, 0.9), (0, 2, "a", "first good article here", "https://x.example/2", None, 0.8), (0, 3, "b", "another article of note", "https://x.example/2/", None, 0.7), (0, 4, "a", "second good thing seen", "https://x.example/4", None, 0.6), (0, 5, "a", "third good thing again", "https://x.example/5", None, 0.5), (0, 6, "b", "First good ARTICLE here", "https://x.example/6", None, 0.4), (0, 7, "b", "late but new entry", "https://x.example/7", None, 0.3)]
    df = spark.createDataFrame([(*r, "the source title itself", "https://x.example/src") for r in rows], kind)
    assert [x.item_id for x in R.diversify(df).first().selected] == [2, 4, 7]


def test_states_and_strategies(spark):
    v = lambda *x: [float(y) for y in x] + [0.0] * (4 - len(x))
    items = spark.createDataFrame([(k, f"f{k}", f"alpha beta title number {k} {'x' * k}", "", "body", f"https://x.example/{k}", None) for k in range(1, 6)], "id long, feed_id string, title string, summary_text string, content string, url string, published_at timestamp")
    feats = spark.createDataFrame([(1, "ready", "v1", v(1)), (2, "ready", "v1", v(1, 0.05)), (3, "skipped", "v1", None), (4, "ready", "v0", v(1))], "item_id long, status string, algorithm_version string, embedding array<double>")
    ask = items.select(F.col("id").alias("source_id"))
    got = {r.source_id: r for r in R.similar_items(ask, items, feats, F.current_timestamp(), "v1", strategy="semantic").collect()}
    assert {k: (r.status, r["count"]) for k, r in got.items()} == {1: ("ready", 1), 2: ("ready", 1), 3: ("unavailable", 0), 4: ("pending", 0), 5: ("pending", 0)}
    assert got[1]["items"][0].item_id == 2
    by_terms = {r.source_id: r["count"] for r in R.similar_items(ask, items, feats, F.current_timestamp(), "v1", strategy="lexical").collect()}
    assert by_terms == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert R.similar_items(ask.where("source_id = 99"), items, feats, F.current_timestamp(), "v1").count() == 0


def test_pieces_give_the_same(spark, sf):
    f = view(spark, sf, "features")
    ask = f.where("item_id % 7 = 0").select(F.col("item_id").alias("source_id"))
    whole, parts = (R.semantic_candidates(ask, f, "similarity-v1", 0.2, 20, piece) for piece in (1 << 16, 100))
    assert {tuple(r[:2]) for r in whole.collect()} == {tuple(r[:2]) for r in parts.collect()}
    assert R.semantic_candidates(ask.where("false"), f, "similarity-v1").count() == 0


def test_ingest_stream_equals_batch(spark, tmp_path):
    body = lambda n: f"<rss><channel><title>t</title>{''.join(f'<item><guid>g{k}</guid><title>i{k}</title></item>' for k in range(n))}</channel></rss>"
    for part in (3, 5):
        spark.createDataFrame([("f1", 200, None, None, body(part), None, datetime(2026, 1, part), 1), ("f2", 304, None, None, None, None, datetime(2026, 1, part), 1)], RESPONSES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    items, log = str(tmp_path / "items"), str(tmp_path / "log")
    q = jobs.ingest(jobs.responses(spark, str(tmp_path / "in"), most_files=1), items, log, str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(items).select("feed_id", "guid").count() == spark.read.parquet(items).select("feed_id", "guid").distinct().count() == 5
    assert spark.read.parquet(log).count() == 4


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_health_and_windows_equal_batch(spark, sf, tmp_path):
    events = view(spark, sf, "fetch_events").where("feed_id < 12")
    events.repartition(1).sortWithinPartitions("fetched_at").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = {r.feed_id: (r.error_count, r.last_id) for r in run(jobs.health(stream), "update", "health").collect()}
    last = S.previous_state(events).collect()
    want = {}
    for r in sorted(last, key=lambda r: (r.fetched_at, r.id)):
        want[r.feed_id] = (r.error_count, r.id)
    assert got == want
    windows = run(jobs.windowed_health(stream), "complete", "windows")
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, jobs.windowed_health(events).collect()))
    keys = run(jobs.first_of_key(stream.select("feed_id", "status"), ["feed_id", "status"]), "append", "keys")
    assert keys.count() == events.select("feed_id", "status").distinct().count()


def test_feature_stream_by_version(spark, sf, tmp_path):
    """Each item once for each version, repeated batches change nothing, failed items are tried again, and results are counted."""
    from feedloom.operators.features import feature_rows, hashed_embedder, prepared

    articles = view(spark, sf, "articles").where("id < 20").select("id", "title", "summary_text", "content")
    short = articles.where("id < 2").withColumns({"id": F.col("id") + 100, "title": F.lit("hm"), "summary_text": F.lit(None).cast("string"), "content": F.lit("hm")})
    articles.union(short).coalesce(1).write.parquet(str(tmp_path / "a"))
    path = str(tmp_path / "f")
    fine = hashed_embedder(8)

    def broken(texts):
        raise RuntimeError("no model")

    def run(version, embedder, check):
        stream = spark.readStream.schema(articles.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
        jobs.features(stream, lambda df: feature_rows(df, embedder, 8, version), path, str(tmp_path / check), version, buckets=4).awaitTermination()

    def stored(version):
        return sorted(r.item_id for r in spark.read.parquet(f"{path}/algorithm_version={version}").collect())

    def counted(version):
        return [tuple(r) for r in spark.read.parquet(f"{path}-results/algorithm_version={version}").orderBy("batch_id").select("claimed", "ready", "skipped", "failed").collect()]

    every = sorted(r.id for r in articles.union(short).collect())
    brief = sorted(r.id for r in prepared(articles.union(short)).where("skip_reason is not null").collect())
    n, k = len(every), len(brief)
    assert {100, 101} <= set(brief)
    run("v1", broken, "c1")
    assert stored("v1") == brief and counted("v1") == [(n, 0, k, n - k)]
    articles.coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))  # the same items come again
    run("v1", fine, "c1")
    assert stored("v1") == every and counted("v1")[1] == (n - k, n - k, 0, 0)
    run("v2", fine, "c2")  # a new version does old items
    assert stored("v2") == every and counted("v2") == [(n, n - k, k, 0), (0, 0, 0, 0)]
    run("v2", fine, "c3")  # batches repeated, as after a failure before the checkpoint
    assert stored("v2") == every


def test_keyed_table_reads_few_files(spark, tmp_path):
    """A batch that repeats an old one's keys and adds new ones, after 2 and after 20 batches: as many files are read."""
    from feedloom.streaming.keyed import KeyedTable

    table = KeyedTable(str(tmp_path / "t"), ("k",), 4)
    rows = lambda b: spark.range(b * 100, b * 100 + 100).select(F.col("id").alias("k"), F.lit(b).alias("b"))
    asked = []
    for b in range(20):
        table.add(rows(b), b)
        if b in (1, 19):
            asked.append(len(table.files_asked(table.hashed(rows(1).union(rows(500))), 99)))
    assert asked == [4, 4]
    table.add(rows(3).union(rows(600)), 20)
    table.add(rows(3).union(rows(600)), 20)  # replayed
    kept = table.rows(spark, rows(0).schema)
    assert kept.count() == kept.select("k").distinct().count() == 2100
    assert kept.where("batch = 20").count() == 100
    rows(700).write.parquet(str(tmp_path / "t" / "batch=77" / "bucket=0"))  # a batch that failed before its filters
    assert table.rows(spark, rows(0).schema).count() == 2100 and table.fresh(rows(700), 78).count() == 100


def test_deduplication_within_a_time(spark, tmp_path):
    def run(rows):
        for r in rows:
            spark.createDataFrame([r], "k string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "e"))
        got = jobs.first_of_key(stream, ["k"], "at", "1 day")
        got.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.k, r["at"].day) for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert run([("a", datetime(2026, 1, 1)), ("a", datetime(2026, 1, 1)), ("b", datetime(2026, 1, 2))]) == [("a", 1), ("b", 2)]
    run([("z", datetime(2026, 1, 9))])  # the state of a and b goes
    assert run([("a", datetime(2026, 1, 10)), ("z", datetime(2026, 1, 9))]) == [("a", 1), ("a", 10), ("b", 2), ("z", 9)]


def test_near_title_links(spark):
    """Links between different titles, against every pair of titles."""
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    rows = [(1, None), (2, "One two"), (3, "one TWO three"), (4, "Three, two, one!"), (5, "one two three four five six"), (6, "one two three four five six seven")]
    for k in range(10, 150):
        own = rng.sample(words, rng.randint(3, 24))
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*rng.sample(own, len(own) - rng.randint(0, 2)), *rng.sample(words, rng.randint(0, 2))]))]
    sets = {i: frozenset((t or "").lower().replace(",", "").replace("!", "").split()) for i, t in rows}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    big = {i for s, i in least.items() if len(s) >= 3}
    want = {(least[s], i, True) for i, s in sets.items() if len(s) >= 3 and least[s] != i}
    want |= {(a, b, False) for a in big for b in big if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in R.near_title_links(spark.createDataFrame(rows, "id long, title string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert (3, 4, True) in want and (5, 6, False) in want and len([w for w in want if not w[2]]) > 20


def test_title_pairs_are_compared_once(spark):
    """Tokens have numbers of their own whatever their hashes, and a pair's sets meet once, where their first common token stands."""
    rows = spark.createDataFrame([(k, f"w{k % 40}") for k in range(100)], "least long, token string")
    for buckets in (1, 7, 1 << 20):
        got = R.numbered(rows, buckets).collect()
        assert len({r.number for r in got}) == len({r.token for r in got}) == 40 and {r.often for r in got} == {2, 3}
    titles = spark.range(12).select("id", F.concat(F.lit("a b c d e f g h i j k l m n x"), F.col("id")).alias("title"))
    links = R.near_title_links(titles)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    assert links.count() == links.distinct().count() == 66
