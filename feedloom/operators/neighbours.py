"""Nearest vectors: exact search in cells, and an inverted file of product-quantised vectors that is probed and re-ranked exactly.

Both bring a group of sources and a part of the stored vectors together in one task by a shuffle.  The vectors pass by the sources, of which
each keeps its nearest, so a source costs a bounded number of rows however many vectors are near it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts that the stored vectors are dealt to at most, of so many vectors at least.  Each part gives a source its nearest, so parts don't grow in number.
PARTS, PIECE = 4, 1 << 12
#: Sources of a group.
GROUP = 1 << 12
#: Hits that a task holds before it keeps each source's nearest.
HITS = 1 << 21
#: Products of one step in a task: 64 MB.
STEP = 1 << 23
NEAR = "source_id long, item_id long, distance double"


def rows_of(column: pa.ListArray) -> np.ndarray:
    """Vectors of a column, none of them null, as rows of a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


class Nearest:
    """Of a group of sources the ``limit`` nearest of all stored vectors that pass by, at distance ``most`` at most, ties by item."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, most: float, limit: int):
        self.ids, self.own, self.limit = ids, own, limit
        self.bound = np.full(len(ids), most)
        self.hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.pending = 0

    def meet(self, who: np.ndarray, items: np.ndarray, vectors: np.ndarray) -> None:
        """Stored vectors pass by the sources at the places ``who``."""
        step = max(1, STEP // max(1, len(who)))
        for at in range(0, len(items), step):
            own = items[at : at + step]
            near = 1 - self.own[who] @ vectors[at : at + step].T
            i, j = np.nonzero((near <= self.bound[who, None]) & (self.ids[who, None] != own))
            self.hits.append((who[i], own[j], near[i, j]))
            self.pending += len(i)
            if self.pending > HITS:
                self.keep()

    def keep(self) -> None:
        """Leaves each source its nearest; what is farther than the last of them can't come in."""
        i, item, near = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        order = np.lexsort((item, near, i))
        i, item, near = i[order], item[order], near[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        last = place == self.limit - 1
        self.bound[i[last]] = near[last]
        kept = place < self.limit
        self.hits, self.pending = [(i[kept], item[kept], near[kept])], 0

    def found(self) -> pa.RecordBatch:
        self.keep()
        i, item, near = self.hits[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(item), pa.array(near)], ["source_id", "item_id", "distance"])


def met(pass_by: Callable[[Nearest, pa.RecordBatch], None], most: float, limit: int):
    """Takes rows (cell, kind, id, ...) with those of a cell together, sources (kind 0) before stored ones; ``pass_by`` brings these to the sources."""

    def run(batches):
        cell, held, group = None, [], None
        for batch in batches:
            cells, kinds = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            if not len(cells):
                continue
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(s, e - s)
                if cells[s] != cell:
                    if group is not None:
                        yield group.found()
                    cell, held, group = cells[s], [], None
                if kinds[s] == 0:
                    held.append(part)
                    continue
                if held:
                    own = pa.Table.from_batches(held)
                    group, held = Nearest(own.column("id").to_numpy(), unit(rows_of(own.column("vector").combine_chunks())), most, limit), []
                if group is not None:  # else nobody asks here
                    pass_by(group, part)
        if group is not None:
            yield group.found()

    return run


def first_of_each(near: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("source_id").orderBy("distance", "item_id")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def dealt(stored: DataFrame, sources: DataFrame, piece: int, *order: str) -> DataFrame:
    """Rows (cell, kind, id, ...) of stored (id, ...) and sources (source_id, embedding), those of a cell together and its sources first.

    A cell is a part of the stored rows and a group of sources: each stored row goes to every group, each source to every part.
    """
    parts, groups = max(1, min(PARTS, -(-stored.count() // piece))), max(1, -(-sources.count() // GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    rows = stored.select("*", of("id", parts).alias("part"), every(groups).alias("group")).withColumn("kind", F.lit(1))
    asked = sources.select(F.col("source_id").alias("id"), F.col("embedding").alias("vector"), of("source_id", groups).alias("group"), every(parts).alias("part")).withColumn("kind", F.lit(0))
    both = asked.unionByName(rows, allowMissingColumns=True).withColumn("cell", F.col("part") * groups + F.col("group")).drop("part", "group")
    return both.repartition("cell").sortWithinPartitions("cell", "kind", *order)


def exact(sources: DataFrame, pool: DataFrame, least: float, limit: int, piece: int = PIECE) -> DataFrame:
    """(source_id, item_id, distance, place): of each source (source_id, embedding) the nearest items of pool (item_id, embedding) by cosine, at
    ``least`` similarity or more; all pairs are looked at.

    The pool is dealt to ``PARTS`` parts of ``piece`` vectors or more, each of which gives a source its ``limit`` best.
    """

    def pass_by(group: Nearest, part: pa.RecordBatch) -> None:
        group.meet(np.arange(len(group.ids)), part.column("id").to_numpy(), unit(rows_of(part.column("vector"))))

    stored = pool.select(F.col("item_id").alias("id"), F.col("embedding").alias("vector"))
    return first_of_each(dealt(stored, sources, piece).mapInArrow(met(pass_by, 1 - least, limit), NEAR), limit)


def centres(v: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, rounds: int = 12) -> np.ndarray:
    """k means of rows by Lloyd's steps; spherical ones have unit length and meet rows by the largest product."""
    c = v[rng.choice(len(v), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(v, c, spherical)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if spherical:
            c = unit(c)
    return c


def nearest_centre(v: np.ndarray, c: np.ndarray, spherical: bool) -> np.ndarray:
    cost = -(v @ c.T) if spherical else (c * c).sum(1) - 2 * v @ c.T
    return cost.argmin(1)


@dataclass(frozen=True)
class Quantiser:
    """A list for each centre of the sphere; within it a vector's rest after its centre is coded by the nearest word of a book for each
    two dimensions (of four, the order by codes blurs among many vectors: 0.58 of the best 150 of 44,553 are among the first 165, of two 0.98 among 300).  ``error`` is the root mean square of a coded product's error."""

    centroids: np.ndarray
    books: np.ndarray
    error: float

    @classmethod
    def fitted(cls, vectors: np.ndarray, lists: int, seed: int = 1) -> Quantiser:
        rng, v = np.random.default_rng(seed), unit(vectors)
        size = v.shape[1]
        parts = next(m for m in range(max(1, size // 2), 0, -1) if size % m == 0)
        c = centres(v, min(lists, len(v)), rng, True)
        rest = v - c[nearest_centre(v, c, True)]
        books = np.stack([centres(p, min(256, len(p)), rng, False) for p in np.split(rest, parts, axis=1)])
        made = cls(c, books, 0.0)
        lost = v - made.decoded(*made.coded(v))
        return cls(c, books, float(np.sqrt((lost**2).sum(1).mean() / size)))

    def coded(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of each unit vector."""
        own = nearest_centre(v, self.centroids, True)
        rest = v - self.centroids[own]
        return own, np.column_stack([nearest_centre(p, b, False) for p, b in zip(np.split(rest, len(self.books), axis=1), self.books, strict=True)]).astype(np.uint8)

    def decoded(self, own: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centroids[own] + np.hstack([b[code[:, k]] for k, b in enumerate(self.books)])

    def probes(self, v: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` lists nearest to each unit vector."""
        near = -(v @ self.centroids.T)
        count = min(count, near.shape[1])
        return np.argpartition(near, count - 1, axis=1)[:, :count]


@dataclass(frozen=True)
class Index:
    """An inverted file: a fitted quantiser and rows (list, item_id, code)."""

    quantiser: Quantiser
    rows: DataFrame

    def save(self, path: str) -> None:
        """Rows in a folder for each list, so that a search reads the lists it probes; the quantiser as one row beside them."""
        q = self.quantiser
        self.rows.repartition("list").sortWithinPartitions("list", "item_id").write.partitionBy("list").parquet(f"{path}/rows")
        one = [(q.centroids.ravel().tolist(), q.centroids.shape[1], q.books.ravel().tolist(), *q.books.shape, q.error)]
        self.rows.sparkSession.createDataFrame(one, "centroids array<double>, size int, books array<double>, parts int, words int, width int, error double").coalesce(1).write.parquet(f"{path}/quantiser")

    def add(self, pool: DataFrame, path: str) -> None:
        """Further items (item_id, embedding) to the folder of a saved index, coded by the same quantiser."""
        coded_rows(self.quantiser, pool).repartition("list").sortWithinPartitions("list", "item_id").write.mode("append").partitionBy("list").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        r = spark.read.parquet(f"{path}/quantiser").first()
        q = Quantiser(np.array(r.centroids).reshape(-1, r["size"]), np.array(r.books).reshape(r.parts, r.words, r.width), r.error)
        return cls(q, spark.read.parquet(f"{path}/rows"))


def coded_rows(q: Quantiser, pool: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, code = q.coded(unit(rows_of(batch.column("embedding"))))
                yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("item_id"), pa.array([c.tobytes() for c in code], pa.binary())], ["list", "item_id", "code"])

    return pool.select("item_id", "embedding").mapInArrow(run, "list long, item_id long, code binary")


def index_of(pool: DataFrame, lists: int | None = None, sample: int = 20_000, seed: int = 1) -> Index:
    """The index of pool (item_id, embedding), vectors of one size and not all zeros.

    The quantiser is fitted on ``sample`` vectors at most, those of the least hash of their ids; all vectors are coded.  ``lists``
    is by default half the square root of the sample.  An empty pool gives an index of one list that holds nothing.
    """
    found = pool.select("item_id", "embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(sample).select("embedding").toArrow()
    v = rows_of(found.column("embedding").combine_chunks()) if found.num_rows else np.ones((1, 1))
    q = Quantiser.fitted(v, lists or max(1, round(len(v) ** 0.5 / 2)), seed)
    return Index(q, coded_rows(q, pool))


def probed(q: Quantiser, sources: DataFrame, probe: int) -> DataFrame:
    """(list, source_id, embedding): each source once for each list that it asks."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = q.probes(unit(rows_of(batch.column("embedding"))), probe)
                at = pa.array(np.repeat(np.arange(len(own)), own.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), batch.column("source_id").take(at), batch.column("embedding").take(at)], ["list", "source_id", "embedding"])

    return sources.select("source_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "list long, source_id long, embedding array<double>")


def candidates(index: Index, sources: DataFrame, least: float, rerank: int, probe: int, piece: int = PIECE, slack: float = 2.0) -> DataFrame:
    """(source_id, item_id, distance): by their codes the ``rerank`` nearest items of each source in the ``probe`` lists that are nearest to it, down
    to ``slack`` errors below the least similarity.

    The codes are dealt to ``PARTS`` parts of ``piece`` or more, each of which gives a source its nearest, from all of its lists together.
    """
    q = index.quantiser

    def pass_by(group: Nearest, part: pa.RecordBatch) -> None:
        if not hasattr(group, "asks"):
            group.asks = np.zeros((len(group.ids), len(q.centroids)), bool)
            np.put_along_axis(group.asks, q.probes(group.own, probe), True, axis=1)
        lists, items = part.column("list").to_numpy(), part.column("id").to_numpy()
        vectors = q.decoded(lists, np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(lists), -1))
        cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            who = np.flatnonzero(group.asks[:, lists[s]])
            if len(who):
                group.meet(who, items[s:e], vectors[s:e])

    stored = index.rows.select(F.col("item_id").alias("id"), F.col("list").cast("long").alias("list"), "code")
    near = dealt(stored, sources, piece, "list").mapInArrow(met(pass_by, 1 - least + slack * q.error, rerank), NEAR)
    return first_of_each(near, rerank).select("source_id", "item_id", "distance")


def reranked(found: DataFrame, sources: DataFrame, pool: DataFrame, least: float, limit: int) -> DataFrame:
    """(source_id, item_id, distance, place): candidates by their exact distance."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (unit(rows_of(batch.column(c))) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("item_id"), pa.array(1 - (a * b).sum(1))], ["source_id", "item_id", "distance"])

    rows = found.select("source_id", "item_id").join(pool.select("item_id", F.col("embedding").alias("y")), "item_id").join(sources.select("source_id", F.col("embedding").alias("x")), "source_id")
    near = rows.select("source_id", "item_id", "x", "y").mapInArrow(run, NEAR).where(F.col("distance") <= 1 - least)
    return first_of_each(near, limit)


def work(index: Index, sources: DataFrame, probe: int) -> DataFrame:
    """One row (pairs, scanned): pairs of sources and stored items, and those whose code a search looks at."""
    sizes = index.rows.groupBy(F.col("list").cast("long").alias("list")).agg(F.count("*").alias("n"))
    asked = probed(index.quantiser, sources, probe).groupBy("list").agg(F.count("*").alias("asked"))
    both = sizes.join(asked, "list", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col("n") * F.col("asked")), F.lit(0)).alias("scanned"))
    return both.crossJoin(sources.agg(F.count("*").alias("sources"))).select((F.col("items") * F.col("sources")).alias("pairs"), "scanned")
