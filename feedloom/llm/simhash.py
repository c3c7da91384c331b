"""SimHash near-duplicates through an inverted index on byte positions with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, components, put

#: The 14 blocks of the Steiner system S(3, 4, 8), the four-element sets of positions 0 to 7 whose
#: exclusive or is 0.  Any three positions lie in one of them, and the complement of a block is a block.  So two
#: fingerprints that differ in three bytes at most agree in all four bytes of some block.
BLOCKS = [b for b in combinations(range(8), 4) if not b[0] ^ b[1] ^ b[2] ^ b[3]]
BITS = 3
#: At most three bits differ, so at least this many of the eight positional bytes are the same.
LEAST_SHARED = 8 - BITS


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of the text, A-Z lower-cased; of all words where there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum() - 1
    starts = np.append(0, ends[: n - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint of each list of hashes: the bits that over half of them have; 0 of an empty list."""
    out = np.zeros(len(hashes), np.uint64)
    for k, h in enumerate(hashes):
        if len(h):
            count = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):  # 4 MB of bits at a time
                part = h[at : at + (1 << 16)]
                count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * count > len(h)).view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, name, fp) for each row of docs, longs but for the key: a hash of its text, which tells it from others of its key, and its fingerprint; null
    and wordless texts get 0."""

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text", 4_000_000)):
            fps = majority([shingle_hashes(t, width, seed) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("name"), pa.array(fps.view(np.int64))], ["k", "name", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("name"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, name long, fp long")


def near_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints that share an index key: places of pairs that share enough bytes and differ in few bits."""
    lists = [], []
    step = max(1, (1 << 20) // max(1, len(fps)))
    for at in range(0, len(fps), step):
        diff = fps[at : at + step, None] ^ fps[None, :]
        shared = (diff.view(np.uint8).reshape(*diff.shape, 8) == 0).sum(2)  # the tally of positional bytes
        i, j = np.nonzero(shared >= LEAST_SHARED)
        ok = np.bitwise_count(diff[i, j]) <= BITS
        i, j = i[ok] + at, j[ok]
        lists[0].append(i[i < j])
        lists[1].append(j[i < j])
    return np.concatenate(lists[0]), np.concatenate(lists[1])


def probed_pairs(fps: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many fingerprints that can differ in the bits of ``free`` only, by looking up each change."""
    fps = np.sort(fps)
    bits = [1 << b for b in range(64) if free >> b & 1]
    lists = [], []
    for n in range(1, BITS + 1):
        for change in combinations(bits, n):
            to = fps ^ np.uint64(sum(change))
            at = np.searchsorted(fps, to)
            hit = np.flatnonzero((at < len(fps)) & (fps[np.minimum(at, len(fps) - 1)] == to) & (to > fps))
            lists[0].append(hit)
            lists[1].append(at[hit])
    return np.concatenate(lists[0]), np.concatenate(lists[1])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes, so that a group gives a link for each node, not each pair."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_of_runs(spread: int, last: bool):
    """Takes rows (key, fp) with equal keys together; gives links (a, b), or rows of runs over ``spread`` as (key, a)."""

    def finish(key: int, parts: list[np.ndarray]):
        fps = np.unique(np.concatenate(parts))
        if len(fps) < 2:
            return None
        if last and len(fps) > spread:
            same = np.bitwise_or.reduce(fps ^ fps[0])
            i, j = probed_pairs(fps, int(same))
        else:
            i, j = near_pairs(fps)
        root = forest(len(fps), i, j)
        odd = np.flatnonzero(root != np.arange(len(fps)))
        return np.full(len(odd), -1), fps[odd].view(np.int64), fps[root[odd]].view(np.int64)

    def run(batches):
        key, parts, size = None, [], 0
        for batch in batches:
            keys, fps = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
            out = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if keys[s] != key:
                    if size > 1 and (last or size <= spread) and (got := finish(key, parts)):
                        out.append(got)
                    key, parts, size = keys[s], [], 0
                size += e - s
                if last or size <= spread:
                    parts.append(fps[s:e])
                else:  # dealt anew by a further byte, without being gathered here
                    rest = np.concatenate([*parts, fps[s:e]])
                    parts = []
                    out.append((np.full(len(rest), key), rest.view(np.int64), np.zeros(len(rest), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "a", "b"])
        if size > 1 and (last or size <= spread) and (got := finish(key, parts)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["key", "a", "b"])

    return run


def byte(column: F.Column, position: int) -> F.Column:
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(255)


def fingerprint_links(fps: DataFrame, spread: int = 4096) -> DataFrame:
    """Links (a, b) that connect just the distinct fingerprints within BITS bits of each other, by chains.

    Each of the 14 postings of a fingerprint is keyed by four positional bytes.  Members of a posting list are
    compared in the task that holds it.  A list of over ``spread`` members is dealt anew by each of the other four
    bytes, one of which a pair must share; what is then still that long is searched bit change by bit change, in time
    proportional to its length.
    """
    slots = [
        (F.lit(k << 32) + sum((F.shiftleft(byte(F.col("fp"), p), 8 * n) for n, p in enumerate(b)), F.lit(0).cast("long"))).alias("key") for k, b in enumerate(BLOCKS)
    ]
    postings = fps.select("fp", F.explode(F.array(*slots)).alias("key")).select("key", "fp")
    dealt = postings.repartition("key").sortWithinPartitions("key")
    found = put(dealt.mapInArrow(links_of_runs(spread, False), "key long, a long, b long"), "links")
    rest = F.array(*(F.array(*(byte(F.col("fp"), p) + F.lit(n << 8) for n, p in enumerate(sorted({*range(8)} - {*b})))) for b in BLOCKS))
    hot = found.where("key >= 0").select("key", F.col("a").alias("fp")).select("fp", F.col("key"), F.explode(F.get(rest, F.shiftright("key", 32).cast("int"))).alias("sub"))
    hot = hot.select((F.col("key") * F.lit(1024) + F.col("sub")).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return found.where("key < 0").select("a", "b").union(hot.mapInArrow(links_of_runs(spread, True), "key long, a long, b long").select("a", "b"))


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component_id, text_hash) for each row of docs.

    Fingerprints of ``width``-word shingles link at BITS or fewer differing bits; component_id is the least key that a
    chain of links reaches.  Equal fingerprints are one node, so groups of copies cost one row.  Null and wordless
    texts have fingerprint 0, linked as any other.  A null key keeps its row and never names a component; where all
    keys of a group are null component_id is null.  Repeated rows stay; rows of one key with different texts are different documents,
    told apart by text_hash (``xxhash64`` of the text).  Very long texts are read whole, 4 MB of bits at a time.  An empty table gives an
    empty result; extra columns of any name are ignored.
    """
    own = put(fingerprints(docs, text, key, width, seed), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("k").alias("least"))
    groups = components(fingerprint_links(nodes.select("fp")))
    rooted = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = put(rooted, "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("name").alias("text_hash"))
