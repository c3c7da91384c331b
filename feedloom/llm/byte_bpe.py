"""Byte-level BPE: encoding with a rank queue under a hierarchical bitmap, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks

NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bitmap:
    """Set of small integers in three levels of 64-bit words; the least member takes three find-first-set steps."""

    def __init__(self, size: int):
        self.levels = [[0] * (-(-size // 64**k) or 1) for k in (1, 2, 3)]

    def add(self, x: int) -> None:
        for level in self.levels:
            level[x >> 6] |= 1 << (x & 63)
            x >>= 6

    def discard(self, x: int) -> None:
        for level in self.levels:
            level[x >> 6] &= ~(1 << (x & 63))
            if level[x >> 6]:
                break
            x >>= 6

    def first(self) -> int:
        """The least member, or -1.  The top level has a single word up to 64 ** 3 members."""
        x = next((i for i, word in enumerate(self.levels[2]) if word), -1)
        for level in reversed(self.levels):
            if x < 0:
                return -1
            word = level[x]
            x = x << 6 | ((word & -word).bit_length() - 1)
        return x


class ByteBPE:
    """Encoder and decoder for one table of ranks.

    ``encode`` takes many pre-tokens at once.  Their bytes are nodes of one linked list that breaks between
    pre-tokens.  A bucket for each merge rank holds the nodes at which a pair of that rank started when it was
    filed; the bitmap gives the lowest rank with a bucket.  Its nodes are checked against the pair that starts there
    now (stale entries are skipped), merged from left to right, and the pairs that arise are filed in turn.

    All nodes of a rank are merged at once, since a merge makes pairs of higher ranks as a rule.  For the ranks whose token can form a pair
    of a lower rank (``falling``) a bucket is taken in stretches from the left, and in each pre-token the merges end with
    the first one that makes a lower pair; what is left of the stretch is filed again.  A stretch shrinks where that
    happens and grows where it doesn't, so the work stays near the number of merges, however long a pre-token is.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NONE << 20)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)
        # Ranks whose token can form a pair of a lower rank; that pair is due before other pairs of the same rank.
        self.falling = {part for key, rank in pairs.items() for part in (key >> 32, key & 0xFFFFFFFF) if rank < part and self.tokens[part][1:]}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word); words mustn't be empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.int64), size
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        ends = size.cumsum()
        starts = ends - size
        word = np.repeat(np.arange(len(words)), size)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1], prv[starts] = n, -1
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        open_ = (whole < 0)[word]
        alive = np.ones(n, bool)
        rank = np.full(n + 1, NONE)  # of the pair that starts at a node; the last is a place to write to for no node
        first = np.flatnonzero(open_ & (nxt < n))
        rank[first] = self.rank_of(sym[first], sym[nxt[first]])
        buckets: dict[int, list[np.ndarray]] = {}
        later: dict[int, tuple[np.ndarray, int]] = {}  # of a falling rank: nodes in order, and how many of them are done
        stretch: dict[int, int] = {}
        queue = Bitmap(self.size)

        def file(nodes: np.ndarray) -> None:
            r = rank[nodes]
            nodes, r = nodes[r < NONE], r[r < NONE]
            if not len(nodes):
                return
            order = np.argsort(r, kind="stable")
            nodes, r = nodes[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, part in zip(r[np.append(0, cuts)].tolist(), np.split(nodes, cuts) if len(cuts) else [nodes], strict=True):
                if key in buckets:
                    buckets[key].append(part)
                else:
                    buckets[key] = [part]
                    queue.add(key)

        def taken(r: int) -> np.ndarray:
            """The next stretch of a falling rank's nodes in order; the others stay filed."""
            rest, done = later.pop(r, (np.zeros(0, np.int64), 0))
            fresh = np.unique(np.concatenate(buckets.pop(r))) if r in buckets else rest[:0]
            if len(fresh) > len(rest) - done or len(fresh) > 1 << 13:
                rest, done, fresh = np.union1d(rest[done:], fresh), 0, rest[:0]
            own = rest[done : done + stretch.setdefault(r, 1 << 13)]
            done += len(own)
            if done < len(rest):
                over = np.searchsorted(fresh, own[-1])
                if over < len(fresh):
                    buckets[r] = [fresh[over:]]
                later[r], fresh = (rest, done), fresh[:over]
                queue.add(r)
            return np.union1d(own, fresh) if len(fresh) else own

        def first_merges(r: int, at: np.ndarray) -> np.ndarray:
            """Of the nodes of a falling rank those up to the first in each pre-token that makes a lower pair."""
            right = nxt[nxt[at]]
            left = np.where(prv[at] >= 0, sym[prv[at]], -1)
            joins = np.append(False, (nxt[nxt[at[:-1]]] == at[1:]))  # its left neighbour is merged just before
            left[joins] = r
            lower = (self.rank_of(np.maximum(left, 0), np.full(len(at), r)) < r) & (left >= 0)
            lower |= (self.rank_of(np.full(len(at), r), sym[np.minimum(right, n - 1)]) < r) & (right < n)
            if not lower.any():
                stretch[r] = min(2 * stretch[r], 1 << 16)
                return at
            start = np.flatnonzero(np.append(True, word[at[1:]] != word[at[:-1]]))
            seen = lower.cumsum() - lower  # lower pairs before each node, less those of other pre-tokens
            ok = seen == np.repeat(seen[start], np.diff(np.append(start, len(at))))
            if not ok.all():
                buckets.setdefault(r, []).append(at[~ok])
                queue.add(r)
                if 2 * ok.sum() < len(at):
                    stretch[r] = max(stretch[r] // 4, 64)
            return at[ok]

        file(first)
        while (r := queue.first()) >= 0:
            queue.discard(r)
            falls = r in self.falling
            at = taken(r) if falls else np.concatenate(buckets.pop(r))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if not falls:
                at = np.unique(at) if len(at) > 1 else at
            if len(at) > 1:  # of pairs that overlap, as in a run of one letter, every other one counts
                linked = np.append(False, nxt[at[:-1]] == at[1:])
                if linked.any():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0]
            if falls:
                at = first_merges(r, at)
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            alive[gone] = False
            rank[gone] = NONE
            nxt[at] = after
            inner = after < n
            prv[after[inner]] = at[inner]
            before = prv[at]
            again = np.concatenate([at, before[before >= 0]])
            again = np.unique(again) if len(again) > 1 else again
            to = nxt[again]
            has = to < n
            rank[again[~has]] = NONE
            again, to = again[has], to[has]
            if len(again):
                rank[again] = self.rank_of(sym[again], sym[to])
                file(again)
        keep = alive.copy()
        done = ~open_
        keep[done] = False
        keep[starts[whole >= 0]] = True
        sym[starts[whole >= 0]] = whole[whole >= 0]
        return sym[keep], np.add.reduceat(keep, starts, dtype=np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = False, cache: int = 300_000) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for each row of docs; with ``ids`` the token ids as well.

    Texts are cut into pre-tokens by ``pattern``; each distinct pre-token of a batch is encoded once and kept for the
    task while the store has less than ``cache`` of them.  The digests are of the decimal ids joined by commas and of
    the bytes that decoding these ids gives.  Null text counts as empty: no tokens, digests of nothing.
    Rows are independent, so repeated keys and null keys stay as they are; other columns aren't returned.  An empty table gives an
    empty result.
    """

    def run(batches):
        import regex

        bpe, find = ByteBPE(read_ranks(ranks)), regex.compile(pattern).findall

        class Codes(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                fresh.append(word)
                return n

        codes, fresh, said, back, count, id_lists = Codes(), [], [], [], [], []
        for batch in (b for whole in batches for b in blocks(whole, "text", 8_000_000)):
            if len(codes) > cache:
                codes, said, back, count, id_lists = Codes(), [], [], [], []
            texts = [np.fromiter(map(codes.__getitem__, find(t or "")), np.int32) for t in batch.column("text").to_pylist()]
            flat, sizes = bpe.encode([w.encode() for w in fresh])
            fresh.clear()
            flat, at = flat.tolist(), 0
            for n in sizes.tolist():
                own = flat[at : at + n]
                at += n
                said.append(",".join(map(str, own)).encode())
                back.append(bpe.decode(own))
                count.append(n)
                if ids:
                    id_lists.append(own)
            numbers = np.array(count, np.int64)
            out = {"doc": batch.column("doc"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if ids else {})
            for words in texts:
                own = words.tolist()
                out["n_tokens"].append(int(numbers[words].sum()))
                out["ids_sha256"].append(hashlib.sha256(b",".join(map(said.__getitem__, own))).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join(map(back.__getitem__, own))).hexdigest())
                if ids:
                    out["ids"].append([i for w in own for i in id_lists[w]])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) if k == "n_tokens" else pa.array(v, pa.list_(pa.int32())) if k == "ids" else v if k == "doc" else pa.array(v, pa.string()) for k, v in out.items()], list(out))

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
    return out.withColumnRenamed("doc", key)
