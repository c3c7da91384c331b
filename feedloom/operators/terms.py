"""Term search without a stored index: items and searches meet in pieces of bounded text, and each piece keeps its own best items.

A search's hits are never rows: a piece sums its items' weights in an array, so what is shuffled is each item's distinct tokens once,
and ``limit`` items of each search and piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of the texts of a piece.
PIECE = 1 << 27
#: Weights are summed as whole millionths, so sums don't depend on their order.
UNIT = 1_000_000
#: Bytes of an Arrow batch: tokens of texts may be many.
BATCH = 16 << 20
UNDATED = -(1 << 62)
BEST = "source_id long, item_ids array<long>, ranks array<long>, times array<long>"
Best = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def rank_of(s: Column) -> Column:
    """S / (S + 1) to nine places, of S in millionths."""
    return F.floor(s / (s + UNIT) * 1e9 + 0.5) / 1e9


def summed(weights: list[float]):
    """Takes (id, at, t0, t1, ...), the tokens of each field; gives (id, at, words, weights): distinct tokens with the sum of their weights."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lists = [batch.column(f"t{k}") for k in range(len(weights))]
            words = pa.concat_arrays([c.flatten() for c in lists])
            if not len(words):
                continue
            rows = np.concatenate([np.repeat(np.arange(n), c.value_lengths().to_numpy()) for c in lists])
            micro = np.repeat([round(w * UNIT) for w in weights], [len(c.flatten()) for c in lists])
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            keys, at = np.unique(rows * size + coded.indices.to_numpy(), return_inverse=True)
            total = np.bincount(at, micro).astype(np.int64)
            cuts = np.searchsorted(keys // size, np.arange(n + 1))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), coded.dictionary.take(pa.array(keys % size))), " ")
            held = pa.array([total[s:e].tobytes() for s, e in zip(cuts, cuts[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), joined, held], ["id", "at", "words", "weights"]).filter(pa.array(np.diff(cuts) > 0))

    return run


def foremost(ids: np.ndarray, total: np.ndarray, times: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ranks in whole billionths, times) of the ``limit`` best items by the sum of their weights in millionths."""
    rank = np.floor(total / (total + UNIT) * 1e9 + 0.5).astype(np.int64)
    if len(ids) > limit:
        keep = rank >= np.partition(rank, len(rank) - limit)[len(rank) - limit]
        ids, rank, times = ids[keep], rank[keep], times[keep]
    order = np.lexsort((-ids, -times, -rank))[:limit]
    return ids[order], rank[order], times[order]


def best_rows(found: list[Best]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), *(pa.array([r[k] for r in found], pa.list_(pa.int64())) for k in (1, 2, 3))], ["source_id", "item_ids", "ranks", "times"])


class Piece:
    """The postings of a piece's items, by token."""

    def __init__(self, parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts)
        own = whole.column("id").to_numpy()
        self.ids, first, item = np.unique(own, return_index=True, return_inverse=True)
        self.times = whole.column("at").to_numpy()[first]
        lists = [pc.split_pattern(c, " ") for c in whole.column("words").chunks]
        lengths = np.concatenate([c.value_lengths().to_numpy() for c in lists])
        coded = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        self.tokens = coded.dictionary
        self.starts = np.searchsorted(codes[order], np.arange(len(self.tokens) + 1))
        self.items = np.repeat(item, lengths)[order].astype(np.int32)
        self.weights = np.frombuffer(b"".join(whole.column("weights").to_pylist()), np.int64)[order]

    def best(self, sources: pa.RecordBatch, limit: int) -> pa.RecordBatch:
        asked = pc.split_pattern(sources.column("words"), " ")
        codes = pc.fill_null(pc.index_in(asked.flatten(), self.tokens), -1).to_numpy()
        cuts = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())])
        out: list[Best] = []
        for source, s, e in zip(sources.column("id").to_pylist(), cuts, cuts[1:], strict=False):
            spans = [slice(self.starts[c], self.starts[c + 1]) for c in codes[s:e] if c >= 0]
            if not spans:
                continue
            # sums of whole numbers below 2**53 are exact
            total = np.bincount(np.concatenate([self.items[x] for x in spans]), np.concatenate([self.weights[x] for x in spans]), len(self.ids))
            hit = np.flatnonzero((total > 0) & (self.ids != source))
            if len(hit):
                out.append((source, *foremost(self.ids[hit], total[hit], self.times[hit], limit)))
        return best_rows(out)


def met(limit: int):
    """Takes rows (cell, kind, id, at, words, weights), those of a cell together and its items (kind 0) before searches (kind 1)."""

    def run(batches):
        cell, held, piece = None, [], None
        for batch in batches:
            cells, kinds = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            if not len(cells):
                continue
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(s, e - s)
                if cells[s] != cell:
                    cell, held, piece = cells[s], [], None
                if kinds[s] == 0:
                    held.append(part)
                    continue
                if held:
                    piece, held = Piece(held), []
                if piece is not None:
                    yield piece.best(part, limit)

    return run


def ranked(searches: DataFrame, items: DataFrame, fields: dict[str, Column], weights: dict[str, float], limit: int, piece: int = PIECE) -> DataFrame:
    """(source_id, item_id, rank, place): for each of searches (source_id, words, joined by a space) the ``limit`` best of items (id, published_at),
    by the sum S of the weights of the words' places as S / (S + 1), then the newest, then the greatest id.  A source is not its own hit.

    ``fields`` are the tokens of each field of an item.  Exact: every place counts.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    chars = items.agg(F.sum(sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in fields), F.lit(0)).cast("long"))).first()[0] or 0
    pieces = max(1, -(-chars // piece))
    at = F.coalesce(F.unix_micros("published_at"), F.lit(UNDATED))
    tokens = items.select("id", at.alias("at"), *(c.alias(f"t{k}") for k, c in enumerate(fields.values())))
    own = tokens.mapInArrow(summed([weights[c] for c in fields]), "id long, at long, words string, weights binary")
    stored = own.select(F.pmod(F.xxhash64("id"), F.lit(pieces)).alias("cell"), F.lit(0).alias("kind"), "id", "at", "words", "weights")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long")))
    asked = searches.where("words <> ''").select(every.alias("cell"), F.lit(1).alias("kind"), F.col("source_id").alias("id"), "words")
    both = stored.unionByName(asked, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell", "kind")
    return placed(both.mapInArrow(met(limit), BEST), limit)


def placed(best: DataFrame, limit: int) -> DataFrame:
    """(source_id, item_id, rank, place): the ``limit`` best of the lists that pieces found."""
    rows = best.repartition("source_id").select("source_id", F.explode(F.arrays_zip("item_ids", "ranks", "times")).alias("x"))
    place = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("x.ranks"), F.desc("x.times"), F.desc("x.item_ids")))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("source_id", F.col("x.item_ids").alias("item_id"), (F.col("x.ranks") / 1e9).alias("rank"), "place")
