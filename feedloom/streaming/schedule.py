"""Feed state with its schedule as a stream: outcomes in, states and due feeds out, by event-time timers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from feedloom.functions.feeds import LEAST_MINUTES, MOST_MINUTES

TEXTS = ("title", "site_url", "favicon_url", "etag", "last_modified", "last_error_category", "last_error_message", "status")
TIMES = ("next_fetch_at", "last_fetched_at", "last_success_at", "last_error_at")
STATE = "title string, site_url string, favicon_url string, etag string, last_modified string, last_error_category string, last_error_message string, status string, fetch_interval_minutes long, consecutive_error_count long, next_fetch_at timestamp, last_fetched_at timestamp, last_success_at timestamp, last_error_at timestamp"
OUTCOME = "seq long, status string, error_category string, error_message string, etag string, last_modified string, feed_title string, site_url string, favicon_url string, new_item_count long, fetched_at timestamp"
OUT = f"feed_id long, kind string, at timestamp, {STATE}"
NAMES = [c.split()[0] for c in STATE.split(", ")]
OUTCOMES = [c.split()[0] for c in OUTCOME.split(", ")]
LONGS = {c.split()[0] for c in f"feed_id long, {STATE}, {OUTCOME}".split(", ") if c.endswith(" long")}
#: Feed ids of a group: each call to the state store costs some milliseconds, so it is made for so many feeds at once.
GROUP = 256


def plain(values: dict) -> dict:
    """Values without pandas' own nulls, and whole numbers that it made floats for them."""
    found = {k: None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else v for k, v in values.items()}
    return {k: int(v) if k in LONGS and v is not None else v for k, v in found.items()}


def transition(feed: dict, o: dict) -> dict:
    """A feed's state after an outcome: the rules of ``maintenance.apply_outcomes``, at the outcome's own time."""
    now, error, count = o["fetched_at"], o["status"] == "error", o["new_item_count"] or 0
    streak = (feed["consecutive_error_count"] or 0) + 1 if error else 0
    cur = max(feed["fetch_interval_minutes"] or LEAST_MINUTES, LEAST_MINUTES)
    if error:
        after = math.ceil(cur * (2.5 if streak >= 3 else 2.0))
    elif o["status"] == "not_modified" or count == 0:
        after = cur + 30
    else:
        after = max(LEAST_MINUTES, math.floor(cur * 0.75))
    interval = min(max(after, LEAST_MINUTES), MOST_MINUTES)
    first = lambda *v: next((x for x in v if x is not None), None)
    return feed | {
        "title": first(feed["title"], o["feed_title"]), "site_url": first(o["site_url"], feed["site_url"]), "favicon_url": first(o["favicon_url"], feed["favicon_url"]),
        "etag": first(o["etag"], feed["etag"]), "last_modified": first(o["last_modified"], feed["last_modified"]), "fetch_interval_minutes": interval, "next_fetch_at": now + timedelta(minutes=interval),
        "last_fetched_at": now, "last_success_at": feed["last_success_at"] if error else now, "last_error_at": now if error else feed["last_error_at"],
        "last_error_category": o["error_category"] if error else None, "last_error_message": o["error_message"] if error else None, "status": "error" if error else "active", "consecutive_error_count": streak,
    }


def ms(at) -> int:
    return round(pd.Timestamp(at).tz_localize(None).timestamp() * 1000)


class FeedSchedule(StatefulProcessor):
    """Keeps the states of a group of feeds and the outcomes that still wait for earlier ones.

    Outcomes wait until the watermark has passed them and are then applied by time, so files may come in any order within the stream's
    lateness.  Each applied outcome gives a row of kind ``state``; unless another outcome comes before the feed's next fetch, that time
    gives a row of kind ``due``.  A group has a timer for the first of the times that it waits for.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feeds = handle.getListState("feeds", f"feed_id long, {STATE}, announced boolean")
        self.waiting = handle.getListState("waiting", f"feed_id long, {OUTCOME}")

    def wake(self, times: list) -> None:
        if times:
            self.handle.registerTimer(min(times))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        rows = [plain(r) for r in initialState[["feed_id", *NAMES]].to_dict("records")]
        self.feeds.appendList([(r["feed_id"], *(r[n] for n in NAMES), False) for r in rows])
        self.wake([ms(r["next_fetch_at"]) for r in rows if r["next_fetch_at"] is not None])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = [plain(r) for r in frame[["feed_id", *OUTCOMES]].to_dict("records")]
            self.waiting.appendList([(r["feed_id"], *(r[c] for c in OUTCOMES)) for r in new])
            self.wake([ms(r["fetched_at"]) for r in new])
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        feeds = {f["feed_id"]: f for f in (plain(dict(zip(["feed_id", *NAMES, "announced"], r, strict=True))) for r in self.feeds.get())}
        held = [plain(dict(zip(["feed_id", *OUTCOMES], r, strict=True))) for r in self.waiting.get()]

        def announce(k: int, before: int) -> None:
            feed = feeds[k]
            if feed["next_fetch_at"] is not None and not feed["announced"] and ms(feed["next_fetch_at"]) < before:
                feed["announced"] = True
                out.append((k, "due", feed["next_fetch_at"], dict(feed)))

        # nothing earlier than the watermark can still come, so all up to it is applied in its order
        ripe, rest = [], []
        for o in held:
            (ripe if ms(o["fetched_at"]) <= now else rest).append(o)
        for o in sorted(ripe, key=lambda r: (r["fetched_at"], r["seq"])):
            k = o["feed_id"]
            if k not in feeds:
                feeds[k] = dict.fromkeys(NAMES) | {"feed_id": k, "fetch_interval_minutes": LEAST_MINUTES, "consecutive_error_count": 0, "status": "active", "announced": False}
            announce(k, ms(o["fetched_at"]))
            feeds[k] = transition(feeds[k], o) | {"announced": False}
            out.append((k, "state", o["fetched_at"], dict(feeds[k])))
        for k in feeds:
            announce(k, now + 1)
        if out:
            self.feeds.put([(k, *(f[n] for n in (*NAMES, "announced"))) for k, f in feeds.items()])
        if ripe:
            self.waiting.clear()
            if rest:
                self.waiting.put([(o["feed_id"], *(o[c] for c in OUTCOMES)) for o in rest])
        self.wake([ms(f["next_fetch_at"]) for f in feeds.values() if f["next_fetch_at"] is not None and not f["announced"]] + [ms(o["fetched_at"]) for o in rest])
        if out:
            frame = pd.DataFrame([(k, kind, when, *(f[n] for n in NAMES)) for k, kind, when, f in out], columns=["feed_id", "kind", "at", *NAMES])
            for c in ("at", *TIMES):
                frame[c] = pd.to_datetime(frame[c])
            yield frame

    def close(self) -> None:
        pass


def feed_schedule(outcomes: DataFrame, feeds: DataFrame, late: str = "1 hour") -> DataFrame:
    """(feed_id, kind, at, and the feed's state) of a stream of outcomes (feed_id, seq, status, ..., fetched_at) and the feeds as they are at first.

    A row of kind ``state`` for each outcome, in the order of their times, and one of kind ``due`` when a feed's next fetch comes
    before another outcome.  Outcomes later than ``late`` behind the newest don't count.  State is kept for groups of GROUP feed ids, in
    RocksDB: an outcome is added to those that wait, and a group's states are read and written when the watermark passes one of its times.
    """
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    group = F.floor(F.col("feed_id") / GROUP).cast("long").alias("feed_group")
    first = feeds.select(F.col("id").alias("feed_id"), *(F.col(n).cast("long" if n in ("fetch_interval_minutes", "consecutive_error_count") else "timestamp" if n in TIMES else "string").alias(n) for n in NAMES))
    stream = outcomes.select("feed_id", *(F.col(c).cast("long" if c in ("seq", "new_item_count") else outcomes.schema[c].dataType).alias(c) for c in OUTCOMES)).withWatermark("fetched_at", late)
    grouped = lambda df: df.select("*", group).groupBy("feed_group")
    return grouped(stream).transformWithStateInPandas(FeedSchedule(), OUT, "Append", "EventTime", initialState=grouped(first))
