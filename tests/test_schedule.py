"""The stream of feed states against the batch operator applied outcome by outcome, across a restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedloom.operators import maintenance as M
from feedloom.streaming.schedule import NAMES, feed_schedule

FEED = "id long, title string, site_url string, favicon_url string, status string, etag string, last_modified string, fetch_interval_minutes int, next_fetch_at timestamp, last_fetched_at timestamp, last_success_at timestamp, last_error_at timestamp, last_error_category string, last_error_message string, consecutive_error_count int"
OUT = "feed_id long, seq long, status string, error_category string, error_message string, etag string, last_modified string, feed_title string, site_url string, favicon_url string, new_item_count long, fetched_at timestamp"
T0 = datetime(2026, 1, 1)


def test_states_and_due_feeds(spark, tmp_path):
    rng = random.Random(5)
    feeds = [(k, None if k % 2 else f"own {k}", None, None, "active", None, None, 60 + 30 * k, T0 + timedelta(minutes=5) if k == 4 else None, None, None, None, None, None, k % 3) for k in range(1, 5)]
    outcomes = []
    for n in range(5):
        for k in (1, 2, 3):
            status = rng.choice(["error", "error", "success", "not_modified"])
            bad = status == "error"
            outcomes.append((k, n, status, "network" if bad else None, f"m{n}" if bad else None, f"e{n}" if status == "success" else None, None, f"t{n}", None if n % 2 else f"https://s{n}.example/", None, rng.randrange(3), T0 + timedelta(minutes=60 * n + k)))
    rng.shuffle(outcomes)
    parts = [outcomes[:6], outcomes[6:12], [*outcomes[12:]]]
    frame = spark.createDataFrame(feeds, FEED)

    def add(rows):
        spark.createDataFrame(rows, OUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(OUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = feed_schedule(stream, frame, "2 days")
        got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    add(parts[0])
    add(parts[1])
    run()
    add(parts[2])
    add([(99, 0, "not_modified", None, None, None, None, None, None, None, 0, T0 + timedelta(days=9))])  # moves time on
    run()  # from the checkpoint
    rows = spark.read.parquet(str(tmp_path / "out")).where("feed_id < 99").collect()
    states = {(r.feed_id, r["at"]): tuple(r[n] for n in NAMES) for r in rows if r.kind == "state"}
    assert len(states) == len([r for r in rows if r.kind == "state"]) == 15

    want = frame
    for n in range(5):
        for k in (1, 2, 3):
            one = [o for o in outcomes if o[0] == k and o[1] == n]
            want = spark.createDataFrame(M.apply_outcomes(want, spark.createDataFrame(one, OUT), F.lit(one[0][-1])).collect(), FEED)
            r = want.where(F.col("id") == k).first()
            assert states[k, one[0][-1]] == tuple(r[c] for c in NAMES)

    due = sorted((r.feed_id, r["at"]) for r in rows if r.kind == "due")
    times = {k: sorted(o[-1] for o in outcomes if o[0] == k) for k in (1, 2, 3)}
    expected = [(4, T0 + timedelta(minutes=5))]
    for (k, at), state in states.items():
        nxt = state[NAMES.index("next_fetch_at")]
        later = [t for t in times[k] if t > at]
        if not later or nxt < later[0]:
            expected.append((k, nxt))
    assert due == sorted(expected)


def test_calls_of_the_state_store_follow_groups():
    import pandas as pd

    from feedloom.streaming.schedule import GROUP, NAMES, OUTCOMES, FeedSchedule

    calls = []

    class Stored(list):
        def get(self):
            calls.append("get")
            return iter(list(self))

        def appendList(self, rows):  # noqa: N802
            calls.append("append")
            self.extend(rows)

        def put(self, rows):
            calls.append("put")
            self[:] = rows

        def clear(self):
            calls.append("clear")
            self[:] = []

    class Handle:
        def getListState(self, name, schema):  # noqa: N802
            return Stored()

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

    class Watermark:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return round((T0 + timedelta(hours=1)).timestamp() * 1000) + 10**8

    p, key = FeedSchedule(), (0,)
    p.init(Handle())
    feeds = [{"feed_id": k, **dict.fromkeys(NAMES), "consecutive_error_count": None if k % 2 else k, "status": "active"} for k in range(GROUP)]
    p.handleInitialState(key, pd.DataFrame(feeds), None)
    rows = pd.DataFrame([{"feed_id": k, **dict.fromkeys(OUTCOMES), "status": "error", "fetched_at": T0 + timedelta(minutes=k % 50)} for k in range(GROUP)])
    list(p.handleInputRows(key, iter([rows]), None))
    out = pd.concat(list(p.handleExpiredTimer(key, Watermark(), None)))
    assert (out.kind == "state").sum() == GROUP
    assert out[out.kind == "state"].set_index("feed_id").consecutive_error_count.to_dict() == {k: 1 if k % 2 else k + 1 for k in range(GROUP)}
    assert len(calls) < 12, calls
