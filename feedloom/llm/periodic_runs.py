"""Periodic runs of words, found in a Re-Pair grammar: each nonterminal's boundary is searched once for all its places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import WORD_SPACE, blocks, ready
from feedloom.llm.vector_text import joined, mix, pair_names, prefix, spans, window, word_hashes, word_ids

#: Words of the shortest run.
LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


class Grammar:
    """Re-Pair over symbols in stretches; ``last`` marks the last symbol of each.

    In a round every pair that occurs twice is ranked by its count; an occurrence is replaced unless one that overlaps it ranks higher, so
    all of the most frequent pair's are, and others that don't touch.  A pair that occurs once will never occur
    twice later, so it ends a stretch.  Rule r makes symbol terminals + r of two symbols; ``place`` is one of its places.
    """

    def __init__(self, ids: np.ndarray, last: np.ndarray):
        self.terminals = int(ids.max()) + 1 if len(ids) else 0
        self.final = ids.copy()  # by place: the symbol that starts there in the end, or -1
        sym, pos, tied = ids.copy(), np.arange(len(ids)), ~last
        known = made = left = right = place = np.zeros(0, np.int64)
        size = np.ones(self.terminals, np.int64)
        while True:
            at = np.flatnonzero(tied)
            if not len(at):
                break
            pairs, which, count = np.unique(sym[at] << 32 | sym[at + 1], return_inverse=True, return_counts=True)
            twice = count[which] > 1
            tied[at[~twice]] = False
            at, which = at[twice], which[twice]
            if not len(at):
                break
            order = np.empty(len(pairs), np.int64)
            order[np.lexsort((mix(pairs.view(np.uint64)), count))] = np.arange(len(pairs))
            rank = np.full(len(sym), -1)
            rank[at] = order[which]
            before, after, here = np.append(-1, rank[:-1]), np.append(rank[1:], -1), np.arange(len(sym))
            since = np.maximum.accumulate(np.where(rank != before, here, 0))  # aaaa is replaced from its start on
            i = np.flatnonzero((rank >= 0) & ((here - since) % 2 == 0) & (after <= rank) & ((here != since) | (before < rank)))
            keys, first, of = np.unique(sym[i] << 32 | sym[i + 1], return_index=True, return_inverse=True)
            slot = np.searchsorted(known, keys)
            new = np.ones(len(keys), bool)
            if len(known):
                new = known[np.minimum(slot, len(known) - 1)] != keys
            named = np.empty(len(keys), np.int64)
            named[~new] = made[slot[~new]]
            named[new] = len(size) + np.arange(new.sum())
            a, b = keys[new] >> 32, keys[new] & 0xFFFFFFFF
            left, right, place, size = np.append(left, a), np.append(right, b), np.append(place, pos[i[first[new]]]), np.append(size, size[a] + size[b])
            known, made = np.insert(known, slot[new], keys[new]), np.insert(made, slot[new], named[new])
            sym[i] = named[of]
            self.final[pos[i]], self.final[pos[i + 1]] = sym[i], -1
            tied[i] = tied[i + 1]
            keep = tied | np.append(False, tied[:-1])
            keep[i + 1] = False
            sym, pos, tied = sym[keep], pos[keep], tied[keep]
        self.left, self.right, self.place, self.size = left, right, place, size

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (rule, place) where a wanted rule is derived."""
        within = lambda of, s: np.where(s >= self.terminals, of[np.maximum(s - self.terminals, 0)], False)
        useful = wanted.copy()
        while len(useful):
            more = wanted | within(useful, self.left) | within(useful, self.right)
            if (more == useful).all():
                break
            useful = more
        at = np.flatnonzero(self.final >= self.terminals)
        rule, out = self.final[at] - self.terminals, []
        while len(rule):
            at, rule = at[useful[rule]], rule[useful[rule]]
            out.append((rule[wanted[rule]], at[wanted[rule]]))
            a, b = self.left[rule], self.right[rule]
            both, where = np.concatenate([a, b]), np.concatenate([at, at + self.size[a]])
            at, rule = where[both >= self.terminals], both[both >= self.terminals] - self.terminals
        return (np.concatenate([r for r, _ in out]), np.concatenate([p for _, p in out])) if out else (np.zeros(0, np.int64),) * 2


def halves(starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, middle, end) of all inner nodes of balanced binary trees over the pieces of each group."""
    out = []
    while len(starts):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        a = np.flatnonzero((place % 2 == 0) & np.append(group[1:] == group[:-1], False))
        if not len(a):
            break
        out.append((starts[a], starts[a + 1], ends[a + 1]))
        ends[a] = ends[a + 1]
        keep = place % 2 == 0
        starts, ends, group = starts[keep], ends[keep], group[keep]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Extensions:
    """How far the ids at two places agree, by names of all strings of 1, 4, 16 and so on ids, equal just for equal strings."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.levels, names, width = [], ids, 1
        while True:
            self.levels.append((width, np.append(names, np.full(len(ids) + 1 - len(names), -1)).astype(np.int32)))
            if 4 * width > longest:
                break
            names = pair_names(names[:-width], names[width:])
            names = pair_names(names[: -2 * width], names[2 * width :])
            width *= 4

    def ahead(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        done = np.zeros(len(x), np.int64)
        for width, names in reversed(self.levels):
            for _ in range(3):
                done += width * ((done + width <= most) & (names[x + done] == names[y + done]))
        return done

    def back(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        done = np.zeros(len(x), np.int64)
        for width, names in reversed(self.levels):
            for _ in range(3):
                done += width * ((done + width <= most) & (names[np.maximum(x - done - width, 0)] == names[np.maximum(y - done - width, 0)]))
        return done


def crossing(start: np.ndarray, middle: np.ndarray, end: np.ndarray, ids: np.ndarray, reach: Extensions, least: int) -> tuple[np.ndarray, ...]:
    """(cut, from, to, period) of the runs within each [start, end) that cross its middle.

    Such a run holds the period's words before or after the middle.  For each period the words there are compared with those one period
    on; they must agree for max(period, least - period) words in all, so for three on one side at least, which is looked
    up first for all periods.
    """
    x = mix(ids.astype(np.uint64))
    triple = np.zeros(len(ids) + 7, np.uint64)
    triple[3 : len(ids) + 1] = x[:-2] + x[1:-1] * np.uint64(3) + x[2:] * np.uint64(5)
    triple[:3], triple[len(ids) + 1 :] = np.arange(1, 4), np.arange(4, 10)  # equal to no other
    out = [np.zeros(0, np.int64)] * 4
    after, before = (np.minimum(side, (end - start) // 2) for side in (end - middle, middle - start))
    work = (after + before).cumsum()
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 21), "right")))
        found = []
        for room, sign in ((after[at:to], 1), (before[at:to], -1)):
            cut = np.repeat(np.arange(at, to), room)
            q = np.arange(1, len(cut) + 1) - np.repeat(room.cumsum() - room, room)
            m = middle[cut]
            t = m + sign * q
            near = np.flatnonzero((triple[t + 3] == triple[m + 3]) | (triple[t] == triple[m]))
            found.append((cut[near], np.minimum(m[near], t[near]), np.maximum(m[near], t[near])))
        cut, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
        on, off = reach.ahead(low, high, end[cut] - high), reach.back(low, high, low - start[cut])
        q = high - low
        ok = (on + off >= np.maximum(q, least - q)) & (low - off < middle[cut]) & (high + on > middle[cut])
        cut, i, j, q = cut[ok], (low - off)[ok], (high + on)[ok], q[ok]
        order = np.lexsort((q, j, i, cut))
        cut, i, j, q = cut[order], i[order], j[order], q[order]
        first = np.append(True, (cut[1:] != cut[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(cut) else np.zeros(0, bool)
        out = [np.append(a, b[first]) for a, b in zip(out, (cut, i, j, q), strict=True)]  # of several periods of the same words the least
        at = to
    return tuple(out)


def maximal_runs(ids: np.ndarray, last: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, period) of the maximal runs of at least ``least`` and two periods' ids, by from, then period; ``last`` marks the last id of each
    stretch, which no run leaves."""
    none = (np.zeros(0, np.int64),) * 3
    if len(ids) < least:
        return none
    edges = np.append(-1, np.flatnonzero(last))
    grammar = Grammar(ids, last)
    # names tell stretches apart: the id after a stretch's last one is a new one, so no comparison passes it
    shift = np.append(0, last.cumsum()[:-1])
    spaced = np.full(len(ids) + len(edges) - 1, -1)
    place = np.arange(len(ids)) + shift
    spaced[place] = ids
    gaps = np.flatnonzero(spaced < 0)
    spaced[gaps] = grammar.terminals + np.arange(len(gaps))
    reach = Extensions(spaced, int(np.diff(edges).max()))

    rules = grammar.place, grammar.place + grammar.size[grammar.left], grammar.place + grammar.size[grammar.terminals :]
    at = np.flatnonzero(grammar.final >= 0)
    top = halves(at.copy(), at + grammar.size[grammar.final[at]], shift[at])
    found = []
    for k, (s, m, e) in enumerate((rules, top)):
        large = np.flatnonzero(e - s >= least)
        off = shift[s[large]]
        cut, i, j, q = crossing(s[large] + off, m[large] + off, e[large] + off, spaced, reach, least)
        i, j, cut = i - off[cut], j - off[cut], large[cut]
        if k == 0 and len(cut):
            wanted = np.zeros(len(grammar.left), bool)
            wanted[cut] = True
            rule, where = grammar.places(wanted)
            lo, hi = np.searchsorted(cut, rule, "left"), np.searchsorted(cut, rule, "right")
            n = hi - lo
            pick = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(lo, n)
            move = np.repeat(where - grammar.place[rule], n)
            i, j, q = i[pick] + move, j[pick] + move, q[pick]
        found.append((i, j, q))
    i, j, q = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(i):
        return none
    order = np.lexsort((-j, i, q))
    i, j, q = i[order], j[order], q[order]
    # what a longer interval of the same period holds is a part of that run
    far = np.maximum.accumulate(j + q * (len(ids) + 1))
    whole = np.append(True, j[1:] + q[1:] * (len(ids) + 1) > far[:-1])
    i, j, q = i[whole], j[whole], q[whole]
    order = np.lexsort((q, i))
    return i[order], j[order], q[order]


def in_repeats(hashes: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Which words stand in a string of least // 2 words that their text has twice; all words of a run do."""
    width = least // 2
    out = np.zeros(len(hashes) + 1, np.int64)
    n = len(hashes) - width + 1
    if n < 2:
        return out[:-1] > 0
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    keys = window(prefix(hashes), at, at + width) ^ mix(owner[at].astype(np.uint64))
    bits = np.uint64(max(16, int(len(keys)).bit_length() + 2))
    slot = (keys >> (np.uint64(64) - bits)).astype(np.int64)
    shared = np.flatnonzero(np.bincount(slot, minlength=1)[slot] > 1)
    _, which, count = np.unique(keys[shared], return_inverse=True, return_counts=True)
    twice = at[shared[count[which] > 1]]
    np.add.at(out, twice, 1)
    np.add.at(out, twice + width, -1)
    return out[:-1].cumsum() > 0


def runs_of_texts(raw: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of each run of words, by text, start and period."""
    data, at = joined(raw)
    starts, ends = spans(data)
    owner = np.searchsorted(at, starts, "right") - 1
    held = np.flatnonzero(in_repeats(word_hashes(data, starts, ends), owner, least))
    empty = (np.zeros(0, np.int64),) * 4
    if len(held) < least:
        return empty
    last = np.append((np.diff(held) > 1) | (np.diff(owner[held]) > 0), True)
    size = np.diff(np.append(-1, np.flatnonzero(last)))
    keep = np.repeat(size >= least, size)
    held, last = held[keep], last[keep]
    if not len(held):
        return empty
    ids = np.unique(word_ids(data, starts, ends)[held], return_inverse=True)[1].astype(np.int64)
    i, j, q = maximal_runs(ids, last, least)
    text = owner[held[i]]
    begin = np.searchsorted(owner, text)
    return text, held[i] - begin, j - i, q


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(key, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed) for each row of docs.

    A run is a stretch of consecutive words, at least ``least`` and twice its smallest period long, that no neighbouring word extends
    with that period; ``runs`` lists all by start, then period, counted in words.  The longest (the first of equals, then of
    the smaller period) is given by itself, four nulls where there is none.  ``collapsed`` are the words, joined by a space,
    without those that some run contains after its first period.  Null, empty and wordless texts have no runs and
    collapse to an empty text.  Rows of any key, null and repeated ones too, stay; an empty table gives an empty result; extra
    columns are ignored.  Working memory follows the longest text: some 100 bytes for each of its words that can be in a run.

    Only words of strings of least // 2 words that their text has twice can be in runs; the rest ends a stretch.  A block's
    stretches share one grammar, so what is copied is searched once.
    """

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text", 4_000_000)):
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            owner, start, length, period = runs_of_texts([b" ".join(w) for w in words], least)
            count = np.bincount(owner, minlength=len(words))
            bounds = np.append(0, count.cumsum())
            best = np.lexsort((period, start, -length, owner))[bounds[:-1][count > 0]]
            longest = np.full(len(words), -1)
            longest[count > 0] = best
            drop = np.zeros(n.sum() + 1, np.int64)
            first = n.cumsum() - n
            np.add.at(drop, first[owner] + start + period, 1)
            np.add.at(drop, first[owner] + start + length, -1)
            drop = drop[:-1].cumsum() > 0
            collapsed = [b" ".join(w) if not c else b" ".join([x for x, d in zip(w, drop[f : f + len(w)].tolist(), strict=True) if not d]) for w, c, f in zip(words, count.tolist(), first.tolist(), strict=True)]
            of = lambda v: pa.array(np.append(v, 0)[longest], mask=longest < 0)
            items = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(n), pa.array(count), of(start), of(length), of(period), of(1000 * length // np.maximum(period, 1)), listed, pa.array([c.decode() for c in collapsed], pa.string())],
                ["k", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs {RUNS}, collapsed string"
    return ready(docs).select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("k", key)


def listing(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")


def with_cycles(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, the texts of a tenth of them made periodic.

    With h the CRC-32 of the decimal key and g = floor(h / 10), a text of n > 0 words whose h ends in 0 keeps its first a = g mod n
    words and then goes on with words a to a + p - 1 over and over, p = 1 + floor((n - a) / (3 + g mod 8)).  Other texts, and those of a
    null key, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"([^{WORD_SPACE[1:-1]}]+)"), F.lit(1))
    g, n = F.floor(h / 10), F.size(words)
    chosen = docs.withColumn(text, F.when((h % 10 == 0) & (n > 0), F.transform(F.array(F.struct(words.alias("w"), (g % n).cast("int").alias("a"), (g % 8).cast("int").alias("c"))), cycled)[0]).otherwise(F.col(text)))
    return chosen


def cycled(x: Column) -> Column:
    n, a = F.size(x["w"]), x["a"]
    p = F.lit(1) + F.floor((n - a) / (x["c"] + 3)).cast("int")
    return F.array_join(F.concat(F.slice(x["w"], F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(x["w"], a + i % p))), " ")
