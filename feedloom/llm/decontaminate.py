"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from feedloom.llm.common import blocks, put, ready
from feedloom.llm.anchors import group_starts
from feedloom.llm.vector_text import joined, prefix, spans, window, word_hashes

#: Tokens are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text; other ASCII signs separate them.
FOLD = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 10 if b == 10 else 32 for b in range(256)], np.uint8)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit values of the tokens of all texts, place of each text's first token, and the end)."""
    data, at = joined([t and t.lower() for t in texts])
    data = FOLD[data]
    starts, ends = spans(data)
    return word_hashes(data, starts, ends), np.searchsorted(starts, at)


def seeds(values: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of each window of ``width`` tokens within one text."""
    if len(values) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(len(values) - width + 1)
    text = np.searchsorted(at, first, "right") - 1
    first, text = (x[first + width <= at[text + 1]] for x in (first, text))
    return window(prefix(values), first, first + width), text, first


def common(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(length, start in a, start in b) of matches of ``size`` or more unmarked tokens that extend to neither side."""
    found = []
    if min(len(a), len(b)) < size:
        return found
    whole = []
    for x, free in ((a, free_a), (b, free_b)):
        taken = np.append(0, (~free).cumsum())
        first = np.flatnonzero(taken[size:] == taken[:-size])
        whole.append((window(prefix(x), first, first + size), first))
    (ha, pa_), (hb, pb) = whole
    order = np.argsort(ha, kind="stable")
    ha, pa_ = ha[order], pa_[order]
    lo, hi = np.searchsorted(ha, hb, "left"), np.searchsorted(ha, hb, "right")
    for k in np.flatnonzero(hi > lo).tolist():
        for p in pa_[lo[k] : hi[k]].tolist():
            t, n = int(pb[k]), size
            if p and t and free_a[p - 1] and free_b[t - 1] and a[p - 1] == b[t - 1]:
                continue  # part of a longer match, found at its start
            if (a[p : p + n] != b[t : t + n]).any():
                continue
            while p + n < len(a) and t + n < len(b) and free_a[p + n] and free_b[t + n] and a[p + n] == b[t + n]:
                n += 1
            found.append((n, p, t))
    return found


def tiled(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Number of tokens of a that greedy string tiling marks in b: longest matches first, none overlapping.

    The search length falls from a's own to ``least`` by halves.  What a mark leaves of a match found at that length goes back among
    the others if it is as long, so matches are taken in the order of what is left of them, as by definition.
    """
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    size = max(least, len(a))
    while True:
        queue = [(-n, p, t) for n, p, t in common(a, b, free_a, free_b, size)]
        heapify(queue)
        while queue:
            n, p, t = heappop(queue)
            free = free_a[p : p - n] & free_b[t : t - n]
            if free.all():
                free_a[p : p - n] = free_b[t : t - n] = False
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).view(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= size:
                    heappush(queue, (s - e, p + s, t + s))
        if size == least:
            return int((~free_a).sum())
        size = max(least, size // 2)


@dataclass
class Items:
    """Benchmark items with an index of their seeds."""

    ids: list[int]
    values: np.ndarray
    at: np.ndarray
    width: int

    def __post_init__(self):
        h, item, place = seeds(self.values, self.at, self.width)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def matches(self, texts: list[str | None], coverage: float) -> list[list[tuple[int, int, int]]]:
        """For each text (item id, marked tokens, tokens) of the items of which tiling covers ``coverage`` or more."""
        values, at = tokens(texts)
        h, text, _ = seeds(values, at, self.width)
        may = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.h, h[may], "left"), np.searchsorted(self.h, h[may], "right")
        near: dict[tuple[int, int], set[int]] = {}
        for k in np.flatnonzero(hi > lo).tolist():
            for i, p in zip(self.item[lo[k] : hi[k]].tolist(), self.place[lo[k] : hi[k]].tolist(), strict=True):
                near.setdefault((int(text[may[k]]), i), set()).add(p)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (t, i), places in near.items():
            a, b = self.values[self.at[i] : self.at[i + 1]], values[at[t] : at[t + 1]]
            reach = len({p + k for p in places for k in range(self.width)})
            if reach >= coverage * len(a) and (n := tiled(a, b, self.width)) >= coverage * len(a):
                out[t].append((self.ids[i], n, len(a)))
        return [sorted(m) for m in out]


def rare_seeds(item_seeds: DataFrame, hits: DataFrame, width: int, coverage: float) -> DataFrame:
    """(other, seed): of each item (other, seed, times, n) the rarest seeds of which a text has some if it can cover so much of the item.

    A place of a seed covers ``width`` tokens at most, so a text needs ``coverage`` * n / width of the item's places, and has one of any set
    that lacks fewer.  The commonest seeds among hits (id, seed), such as a phrase of many texts, are those left out.
    """
    often = hits.groupBy("seed").agg(F.count("*").alias("often"))
    w = W.partitionBy("other")
    known = item_seeds.join(often, "seed").withColumn("rarer", F.sum("times").over(w.orderBy("often", "seed")) - F.col("times"))
    places = F.col("n") - (width - 1)
    unseen = places - F.sum("times").over(w)  # of seeds that no text has: the rarest of all
    before, need = F.col("rarer") + F.col("unseen"), F.ceil(coverage * F.col("n") / width)
    return known.withColumn("unseen", unseen).where(before <= places - need).select("other", "seed")


def matched(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", width: int = 5, coverage: float = 0.5, most_bytes: int = 16 << 20) -> DataFrame:
    """All columns of docs, with ``matches``: an array of (item_id, n_marked, n_tokens), empty if there are none.

    An item is matched where greedy string tiling, with tiles of ``width`` tokens or more, covers ``coverage`` of its
    tokens by text of the document, in whatever order.  Items of fewer than ``width`` tokens are never matched.
    If the items' texts have ``most_bytes`` in all at most, tasks get all items and documents aren't shuffled; else
    the rarer seeds of each item are joined by a shuffle, and only pairs that share one are tiled, equal texts (by SHA-256) once.  Very
    long texts are whole; empty tables give no matches.  Null
    texts and items have no tokens; repeated items with one id count once each for the best; repeated rows and null keys stay.
    Ids of items are of any type.  A column of docs that is named matches is replaced; others may have any names.
    """
    docs = ready(docs).drop("matches")
    spark, id_type = docs.sparkSession, items.schema[item_key].dataType
    items = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), F.col("text").alias("item")).distinct()
    pairs_type = f"array<struct<item_id:{id_type.simpleString()},n_marked:int,n_tokens:int>>"
    kind = StructType([*docs.schema.fields]).add("matches", DataType.fromDDL(pairs_type))
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("n_marked", pa.int32()), ("n_tokens", pa.int32())]))
    names = ("item_id", "n_marked", "n_tokens")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0))).first()[0]

    def best(found: list[tuple[int, int, int]]) -> list[dict]:
        top: dict[int, tuple[int, int, int]] = {}
        for m in found:
            if m[0] not in top or m[1] * top[m[0]][2] > top[m[0]][1] * m[2]:
                top[m[0]] = m
        return [dict(zip(names, m, strict=True)) for m in sorted(top.values())]

    if size <= most_bytes:
        got = items.orderBy("item_id", "item").toArrow()
        values, at = tokens(got.column("item").to_pylist())
        sent = spark.sparkContext.broadcast((got.column("item_id").to_pylist(), values, at))

        def run(batches):
            index = Items(*sent.value, width)
            for whole in batches:
                for batch in blocks(whole, text, 4_000_000):
                    found = [best(m) for m in index.matches(batch.column(text).to_pylist(), coverage)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, "matches"])

        return docs.mapInArrow(run, kind)

    def seed_rows(batches):
        """(id, seed, times, n): how often a text has each seed, and its number of tokens."""
        for batch in (b for whole in batches for b in blocks(whole, "t", 4_000_000)):
            values, at = tokens(batch.column("t").to_pylist())
            h, own, _ = seeds(values, at, width)
            order = np.lexsort((h, own))
            new = np.flatnonzero(group_starts(own[order], h[order]))
            lead = order[new]
            times = np.diff(np.append(new, len(order)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own[lead])), pa.array(h[lead].view(np.int64)), pa.array(times.astype(np.int32)), pa.array(np.diff(at)[own[lead]].astype(np.int32))], ["id", "seed", "times", "n"])

    def tile_rows(batches):
        for batch in (b for whole in batches for b in blocks(whole, "t", 4_000_000)):
            places, marked, sizes = [], [], []
            for k, (item, t) in enumerate(zip(batch.column("item").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                values, at = tokens([item, t])
                a, b = values[: at[1]], values[at[1] :]
                n = tiled(a, b, width) if len(a) >= width else 0
                if len(a) >= width and n >= coverage * len(a):
                    places.append(k)
                    marked.append(n)
                    sizes.append(len(a))
            own = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("item_id").take(own), pa.array(marked, pa.int32()), pa.array(sizes, pa.int32())], ["id", "item_id", "n_marked", "n_tokens"])

    # equal texts have equal matches
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(text, 256)).alias("id"))
    texts = rows.where("id is not null").groupBy("id").agg(F.first(F.col("row").getField(text)).alias("t"))
    item_rows = items.withColumn("id", F.unhex(F.sha2("item", 256)))
    seed_type = "id binary, seed long, times int, n int"
    item_seeds = item_rows.select("id", F.col("item").alias("t")).distinct().mapInArrow(seed_rows, seed_type).withColumnRenamed("id", "other")
    hits = put(texts.mapInArrow(seed_rows, seed_type).select("id", "seed").join(item_seeds.select("seed").distinct(), "seed", "left_semi"), "decontaminate-seeds")
    shared = hits.join(rare_seeds(item_seeds, hits, width, coverage), "seed").select("id", "other").distinct()
    pairs = shared.join(item_rows.withColumnRenamed("id", "other"), "other").join(texts, "id").select("id", "item_id", "item", "t")
    found = pairs.mapInArrow(tile_rows, f"id binary, item_id {id_type.simpleString()}, n_marked int, n_tokens int")
    share = F.col("n_marked") / F.col("n_tokens")
    found = found.groupBy("id", "item_id").agg(F.max(F.struct(share, "n_marked", "n_tokens")).alias("m")).select("id", F.struct("item_id", "m.n_marked", "m.n_tokens").alias("m"))
    found = found.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("found"))  # one of each item at most
    return rows.join(found, "id", "left").select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.coalesce("found", F.array().cast(pairs_type)).alias("matches"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, item_id, n_marked, n_tokens, coverage): one row for each document and item matched in it."""
    rows = matched(docs, items, **options).select(key, F.explode("matches").alias("m"))
    return rows.select(key, "m.item_id", "m.n_marked", "m.n_tokens", (F.col("m.n_marked") / F.col("m.n_tokens")).alias("coverage"))
