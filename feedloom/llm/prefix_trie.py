"""Prefix trie of conversations, its subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.llm.common import put, ready

#: Units below the shards' bound of turns are whole subtrees; the bound is a share of all turns, but never below this.
LEAST_UNIT = 1024
TOTALS = ("n_children", "n_leaves", "saved_tokens")
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, words long, a long, b long"


class MessageQueue:
    """A priority queue of messages (level, key, totals), those of one level and key summed, that spills sorted runs.

    Levels are taken from the highest down, and keys within a level upwards.  Over ``limit`` waiting messages are sorted and written
    to a nameless file of the task in Spark's own local folders, as Spark's sorts do; nothing else reads it and
    it goes with the task.
    """

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.fresh, self.size = limit, [], 0
        self.runs: list[list] = []  # file or None, rows left, sorted rows in memory

    def push(self, level: int, keys: np.ndarray, totals: np.ndarray) -> None:
        self.fresh.append(np.column_stack([np.full(len(keys), -level), keys, totals]))
        self.size += len(keys)
        if self.size > self.limit:
            self.settle()
            self.spill()

    @staticmethod
    def summed(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
        return np.column_stack([rows[first, :2], np.add.reduceat(rows[:, 2:], first)])

    def settle(self) -> None:
        """Waiting messages as a sorted run in memory."""
        if self.size:
            self.runs.append([None, 0, self.summed(np.concatenate(self.fresh))])
        self.fresh, self.size = [], 0

    def spill(self) -> None:
        """All runs in memory as one run on disk."""
        held = [r for r in self.runs if r[0] is None]
        rows = self.summed(np.concatenate([r[2] for r in held]))
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        rows.tofile(file)
        file.seek(0)
        self.runs = [r for r in self.runs if r[0] is not None] + [[file, len(rows), rows[:0]]]

    def take(self, level: int, key: int) -> np.ndarray:
        """All messages up to this level and key, as rows (-level, key, totals)."""
        self.settle()
        out = []
        for run in self.runs:
            while True:
                file, left, rows = run
                n = int(np.searchsorted(rows[:, 0], -level, "left"))
                end = int(np.searchsorted(rows[:, 0], -level, "right"))
                n += int(np.searchsorted(rows[n:end, 1], key, "right"))
                out.append(rows[:n])
                run[2] = rows[n:]
                if n < len(rows) or not left:
                    break
                part = np.fromfile(file, np.int64, 5 * min(left, 1 << 16)).reshape(-1, 5)
                run[1], run[2] = left - len(part), part
        self.runs = [r for r in self.runs if len(r[2]) or r[1]]
        rows = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        return self.summed(rows) if len(rows) else rows


LAST = np.iinfo(np.int64).max


def time_forward(limit: int = 1 << 20):
    """Takes nodes in reverse level order, each level by conv_id, with the totals that came to them from outside; gives the nodes with
    all totals, and for parents that aren't among them one summed message each (n_convs is null)."""
    names = [c.split()[0] for c in NODE.split(", ")]

    def unclaimed(rows: np.ndarray) -> pa.RecordBatch:
        n, none = len(rows), pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(-rows[:, 0]), pa.array(rows[:, 1]), none, none, none, none, none, *(pa.array(rows[:, 2 + k]) for k in range(3))], [*names, *TOTALS]) if n else None

    def run(batches):
        queue = MessageQueue(limit)
        for batch in batches:
            depth = np.asarray(batch.column("depth"))
            cuts = [0, *(np.flatnonzero(depth[1:] != depth[:-1]) + 1).tolist(), len(depth)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                part, level = batch.slice(s, e - s), int(depth[s])
                keys, n, words = (part.column(c).to_numpy() for c in ("conv_id", "n_convs", "words"))
                came = queue.take(level, int(keys[-1]))
                at = np.searchsorted(keys, came[:, 1])
                own = (came[:, 0] == -level) & (keys[np.minimum(at, len(keys) - 1)] == came[:, 1])
                totals = np.column_stack([part.column(c).to_numpy() for c in TOTALS])
                totals[at[own]] += came[own, 2:]
                if (lost := unclaimed(came[~own])) is not None:
                    yield lost
                totals[:, 1] = np.where(totals[:, 0] == 0, 1, totals[:, 1])
                totals[:, 2] += (n - 1) * words
                up = part.column("parent_conv_id").is_valid().to_numpy(zero_copy_only=False)
                if up.any():
                    to = part.column("parent_conv_id").drop_null().to_numpy()
                    queue.push(level - 1, to, np.column_stack([np.ones(len(to), np.int64), totals[up, 1:]]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(totals[:, k]) for k in range(3))], [*names, *TOTALS])
        if (lost := unclaimed(queue.take(-1, LAST))) is not None:
            yield lost

    return run


def chained(rows: DataFrame) -> DataFrame:
    """(conv, depth, len, words, a, b, pa, pb) of turns (conv, depth, len, role, text) that stand by conv and depth: 128 bits of SHA-256
    over the turns so far name a node (a, b) and its parent (pa, pb); the root is (0, 0)."""

    def run(batches):
        conv, digest = None, bytes(16)
        for batch in batches:
            out, words = [], []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
                role, text = role.encode(), text.encode()
                parent = digest if c == conv else bytes(16)
                conv, digest = c, hashlib.sha256(parent + len(role).to_bytes(8) + role + text).digest()[:16]
                out.append(digest + parent)
                words.append(len(text.split()))
            ids = np.frombuffer(b"".join(out), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("conv", "depth", "len")), pa.array(words, pa.int64()), *(pa.array(ids[:, k].copy()) for k in range(4))], ["conv", "depth", "len", "words", "a", "b", "pa", "pb"])

    return rows.mapInArrow(run, "conv long, depth long, len long, words long, a long, b long, pa long, pb long")


def id_pieces(batches):
    """Of rows (a, b, conv) in order: strings of up to 4,096 numbers joined by commas, each of one node."""
    for batch in batches:
        a, b, c = (np.asarray(batch.column(k)) for k in ("a", "b", "conv"))
        cuts = {0, len(a), *range(0, len(a), 4096), *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()}
        at = sorted(cuts)
        ids = list(map(str, c.tolist()))
        if len(at) > 1:
            at_ = at[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(a[at_]), pa.array(b[at_]), pa.array(c[at_]), pa.array([",".join(ids[s:e]) for s, e in zip(at, at[1:], strict=False)])], ["a", "b", "first", "piece"])


def hashed_pieces(batches):
    """Of rows (a, b, first, piece) in order: SHA-256 of each node's pieces joined by commas."""
    node, state = None, None
    for batch in batches:
        out = []
        for a, b, piece in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "piece")), strict=True):
            if (a, b) == node:
                state.update(b",")
            else:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            state.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "sha"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["a", "b", "sha"])


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie of
    conversations; convs (conv) has their whole numbers, each once, and turns (conv, at, role, text) what they say.

    A node is a sequence of first turns (role, text) and is named by its least member and its depth; the root has depth 0 and no
    parent.  ends_sha256 is of the members that end there, in order.  Ties of ``at`` go by role and text; null roles and texts count as
    empty.  Conversations without turns are members of the root.  No conversations give no nodes.  Extra columns are ignored.

    Nodes are counted by the digests of their turns, so copies and common beginnings are summed before they are
    shuffled.  A node below which no more turns stand than a share of all is light; a light node whose parent isn't is the root of a
    unit, and units are dealt to shards.  Each shard takes its nodes in reverse level order and passes totals to parents
    through a spilling priority queue; what goes to parents outside is summed and passed on in the same way through the
    nodes that aren't light: at most four for each partition and level.  A node's ids are sorted and joined in
    pieces in many tasks; only the pieces of a node meet, since SHA-256 must read them in a row.
    """
    spark = turns.sparkSession
    w = W.partitionBy("conv")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = turns.select(F.col("conv").cast("long"), "at", blank("role"), blank("text"))
    rows = rows.select("conv", F.row_number().over(w.orderBy("at", "role", "text")).cast("long").alias("depth"), F.count("*").over(w).alias("len"), "role", "text")
    paths = put(chained(ready(rows.sortWithinPartitions("conv", "depth"))), "trie-paths")
    known = convs.select(F.col("conv").cast("long").alias("conv"))
    count, least = known.agg(F.count("*"), F.min("conv")).first()
    deep = put(paths.groupBy("a", "b", "pa", "pb", "depth", "words").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight")), "trie-nodes")
    total = deep.where("depth = 1").agg(F.sum("weight")).first()[0] or 0
    bound = max(LEAST_UNIT, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    own = deep.select("depth", "conv_id", "n_convs", "words", "a", "b", "pa", "pb", "weight")
    over = deep.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    first = own.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    placed = own.where("depth > 1").join(over, ["pa", "pb"]).select(*own.columns, "parent_conv_id").union(first)
    heavy = F.col("weight") > bound
    flags = deep.where(heavy).select("a", "b", F.lit(True).alias("heavy"))
    tops = paths.select("conv", "depth", "a", "b").join(flags, ["a", "b"], "left").where("heavy is null").groupBy("conv").agg(F.min(F.struct("depth", "a", "b")).alias("top"))
    tops = tops.select(F.col("conv").alias("conv_id"), F.xxhash64("top.a", "top.b").alias("unit"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    schema = NODE + "".join(f", {c} long" for c in TOTALS)
    zero = [F.lit(0).cast("long").alias(c) for c in TOTALS]
    dealt = placed.where(~heavy).join(tops, "conv_id").select("unit", *columns, *zero).repartition("unit").sortWithinPartitions(F.desc("depth"), "conv_id")
    below = put(dealt.drop("unit").mapInArrow(time_forward(limit), schema), "trie-shards")

    root = spark.createDataFrame([(0, least, None, count, 0, 0, 0)] if count else [], NODE)
    upper = placed.where(heavy).select(*columns).union(root)
    came = below.where("n_convs is null").groupBy("depth", "conv_id").agg(*(F.sum(c).alias(c) for c in TOTALS))
    upper = upper.join(came, ["depth", "conv_id"], "left").select(*columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in TOTALS))
    upper = upper.repartition(1).sortWithinPartitions(F.desc("depth"), "conv_id").mapInArrow(time_forward(limit), schema)

    silent = known.join(paths.where("depth = 1").select("conv"), "conv", "left_anti").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv")
    ends = paths.where("depth = len").select("a", "b", "conv").union(silent)
    pieces = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(id_pieces, "a long, b long, first long, piece string")
    shas = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed_pieces, "a long, b long, sha string")
    out = below.where("n_convs is not null").union(upper).join(shas, ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def shared_beginnings(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) for ``prefix_trie`` from conversations (conv_id, turn, role, text): conversation c takes its first h turns from the first
    conversation of its group of ``group`` numbers, if there is one, and goes on with its own turns after its first h; h is the
    CRC-32 of its decimal number modulo ``most`` + 1.

    Turns are ordered by number, null first, then by role and text.  Rows without conv_id belong to no conversation.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    convs = rows.select("conv").distinct()
    own = rows.withColumn("at", place).where(F.col("at") >= taken).select("conv", "at", "role", "text")
    heads = rows.where(F.col("conv") % group == 0).withColumn("at", place).where(F.col("at") < most).withColumnRenamed("conv", "head")
    shared = convs.withColumn("head", F.col("conv") - F.col("conv") % group).join(heads, "head").where(F.col("at") < taken)
    return own.union(shared.select("conv", "at", "role", "text")), convs
