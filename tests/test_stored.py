"""Changes of stored tables against the operators on whole tables, and what they rewrite."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.operators import maintenance as M
from feedloom.operators.stored import BucketedTable
from feedloom.sources.tables import view

def now():
    return F.timestamp_micros(F.lit(1_705_320_000_000_000))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).glob("bucket=*/*.parquet")}


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.fixture
def items(spark, sf, tmp_path):
    return BucketedTable(spark, str(tmp_path / "items"), "id", 16).write(view(spark, sf, "items"))


def test_a_change_rewrites_its_buckets(spark, sf, items):
    whole = view(spark, sf, "items")
    one = items.placed(whole).where("bucket = 3").limit(5).select("id", F.lit(True).alias("is_read"), F.lit(None).cast("boolean").alias("is_starred"), F.lit(1).alias("seq"))
    one = spark.createDataFrame(one.collect(), one.schema)
    before = files(items.path)
    assert items.change(one, lambda old, new: M.apply_item_state(old, new, now())) == [3]
    after = files(items.path)
    assert {p for p in before if "bucket=3/" not in p} == {p for p in after if "bucket=3/" not in p}
    assert all(before[p] == after[p] for p in before if "bucket=3/" not in p)
    assert not {p for p in before if "bucket=3/" in p} & set(after)
    same(items.rows(), M.apply_item_state(whole, one, now()))


def test_new_items_and_outcomes(spark, sf, tmp_path):
    kind = "id long, feed_id long, dedupe_key string, pos int"
    old = spark.createDataFrame([(k, k % 5, f"k{k}", 0) for k in range(50)], kind)
    batch = spark.createDataFrame([(100 + k, k % 5, f"k{k + 45}", k) for k in range(10)] + [(200, 0, "k50", 99)], kind)
    table = BucketedTable(spark, str(tmp_path / "i"), "dedupe_key", 8).write(old)
    table.change(batch, lambda rows, new: rows.unionByName(M.new_items(rows, new)))
    same(table.rows(), old.unionByName(M.new_items(old, batch)))

    feeds = view(spark, sf, "feeds")
    stored = BucketedTable(spark, str(tmp_path / "f"), "id", 16).write(feeds)
    o = feeds.where("id % 10 = 0").select(F.col("id").alias("feed_id"), F.lit("error").alias("status"), F.lit("parse").alias("error_category"), *(F.lit(None).cast("string").alias(c) for c in ("error_message", "etag", "last_modified", "feed_title", "site_url", "favicon_url")), F.lit(0).alias("new_item_count"), F.lit(1).alias("seq"))
    o = spark.createDataFrame(o.collect(), o.schema)
    stored.change(o, lambda rows, new: M.apply_outcomes(rows, new, now()), "feed_id")
    same(stored.rows(), M.apply_outcomes(feeds, o, now()))


def test_upserts_deletions_and_empty_buckets(spark, tmp_path):
    kind = "item_id long, v string, generated_at timestamp"
    old = spark.createDataFrame([(k, "old", datetime(2026, 1, 1)) for k in range(6)], kind)
    table = BucketedTable(spark, str(tmp_path / "t"), "item_id", 64).write(old)
    new = spark.createDataFrame([(k, "new", datetime(2026, 1, 2)) for k in (5, 9)], kind)
    table.change(new, M.upsert_features)
    same(table.rows(), M.upsert_features(old, new))
    gone = spark.createDataFrame([(k,) for k in (0, 1, 9)], "item_id long")
    drop = lambda rows, ids: rows.join(ids, "item_id", "left_anti")
    table.change(gone, drop)  # most of these are alone in their bucket
    assert sorted(r.item_id for r in table.rows().collect()) == [2, 3, 4, 5]
    table.change(gone.limit(1).select(F.lit(1).cast("long").alias("item_id"), F.lit("back").alias("v"), F.lit(datetime(2026, 1, 3)).alias("generated_at")), M.upsert_features)
    assert sorted(r.item_id for r in table.rows("item_id").collect()) == [1, 2, 3, 4, 5]
    assert table.change(gone.where("false"), drop) == []


def test_a_failed_change_leaves_the_table(spark, items):
    before, rows = files(items.path), items.rows().count()
    bad = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(Exception):
        items.change(bad, lambda old, new: old.withColumn("title", F.raise_error(F.lit("lost")).cast("string")))
    assert files(items.path) == before and items.rows().count() == rows
