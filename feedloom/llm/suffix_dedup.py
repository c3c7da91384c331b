"""Removal of repeated byte strings with per-shard suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.llm.anchors import Anchors, group_starts
from feedloom.llm.common import blocks, drop, list_of, lists, named_rows, put, ready
from feedloom.llm.vector_text import VALUES, joined, prefix, window

K = 16
PIECE = 16  # shards of one hash whose strings are merged in one task
BOUNDS = 31  # bits of a span's length beside its first place


def in_order(high: np.ndarray, high_bits: int, low: np.ndarray | None = None, low_bits: int = 0) -> np.ndarray:
    """Order of numbers below 2 ** high_bits, or of pairs of these and numbers below 2 ** low_bits."""
    index = len(high).bit_length()
    if high_bits + low_bits + index <= 64:  # one sort of whole numbers, faster than an indirect one
        both = high.astype(np.uint64) << np.uint64(low_bits + index) | np.arange(len(high), dtype=np.uint64)
        if low is not None:
            both |= low.astype(np.uint64) << np.uint64(index)
        both.sort()
        return (both & np.uint64((1 << index) - 1)).astype(np.int64)
    return np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of data in order, by Larsson and Sadakane's refinement.

    Suffixes are first sorted by five bytes; each round then sorts those still in groups by the group of the suffix
    that starts as much further on as is sorted already, which doubles the sorted length.  Groups are numbered by
    their last place, and groups of one are left alone.
    """
    n = len(data)
    padded = np.append(data, np.zeros(5, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key << np.uint64(8) | padded[k : k + n]
    order = in_order(key, 40)
    group = np.empty(n + 1, np.int64)  # 0 past the end; others from 1
    group[n] = 0

    def number(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Group numbers of the suffixes in ``places`` of the order, where ``new`` marks the start of a group."""
        starts = np.flatnonzero(new)
        last = np.append(starts[1:], len(places)) - 1
        return (places[last] + 1)[new.cumsum() - 1]

    new = group_starts(key[order])
    group[order] = number(np.arange(n), new)
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    open_ = np.flatnonzero((sizes > 1)[new.cumsum() - 1])
    done = 5
    while len(open_):
        at = order[open_]
        own, next_ = group[at], group[np.minimum(at + done, n)]
        by = in_order(own, n.bit_length(), next_, n.bit_length())
        at, own, next_ = at[by], own[by], next_[by]
        order[open_] = at
        new = group_starts(own, next_)
        group[at] = number(open_, new)
        sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_ = open_[(sizes > 1)[new.cumsum() - 1]]
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = 8192) -> np.ndarray:
    """Length of the common prefix, ``most`` at most, of each suffix in the order with the one before it.

    Kasai's recurrence, along the text: the length for the next suffix is one less at least, since the order is by
    whole suffixes.  The text is cut into ``lanes`` stretches, all of which take a step at a time.
    """
    n = len(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.append(-1, order[:-1])[rank]  # the suffix before each, by place in the text
    padded = np.append(data, np.zeros(most + 1, np.uint8))
    stretch = -(-n // lanes) or 1
    at = np.arange(0, n, stretch)
    have = np.zeros(len(at), np.int64)
    out = np.zeros(n, np.int64)
    for _ in range(stretch):
        live = at < n
        at, have = at[live], have[live]
        other = before[at]
        have = np.where(other < 0, 0, np.maximum(have - 1, 0))
        grow = np.flatnonzero(other >= 0)
        while len(grow):
            a, b, h = at[grow], other[grow], have[grow]
            more = (h < most) & (np.maximum(a, b) + h < n) & (padded[a + h] == padded[b + h])
            grow = grow[more]
            have[grow] += 1
        out[rank[at]] = have
        at = at + 1
    return out


def windows_of(data: np.ndarray, at: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard of texts data[at[t]:at[t + 1]], each of a document: (text, offset, string, least document of the string) of
    each window, in the order of strings."""
    order = suffix_array(data)
    same = common_prefixes(data, order, width) >= width
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(data)) - at[text]
    whole = (offset + width <= size[text])[order]  # a window must end within its text
    # a run of neighbours is one string as long as common prefixes last; windows that leave their text don't end a run
    string = (~same).cumsum()[whole]
    start = order[whole]
    text, offset = text[start], offset[start]
    new = group_starts(string)
    string = new.cumsum() - 1
    least = np.minimum.reduceat(docs[text], np.flatnonzero(new)) if len(text) else docs[text]
    return text, offset, string, least[string]


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k) for each k below count[i]."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(count.cumsum() - count, count)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the pieces of data one after another, and where each begins (and the end)."""
    at = np.append(0, sizes.cumsum())
    i, k = spread(sizes)
    return data[starts[i] + k], at


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


ANCHORS = "part string, block long, bucket int, start int, h array<long>, n array<int>, docs array<long>, names array<long>, counts array<int>, hash array<int>, windows array<int>"


def anchor_rows(width: int, buckets: int):
    """Anchors of blocks of documents in two parts.

    ``hashes``: for each block and bucket of hashes a row of the distinct hashes there and how often the block has each, so a hash
    has one entry a block, however many anchors have it.  ``places``: for each block its documents, the number of anchors of each, and of
    all anchors in order the number of their hash within the block and the number of windows they serve.
    """

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = {"part": pa.string(), "block": pa.int64(), "bucket": pa.int32(), "start": pa.int32(), "h": longs, "n": ints, "docs": longs, "names": longs, "counts": ints, "hash": ints, "windows": ints}

        def rows(n_rows: int, **columns):
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n_rows, k) for c, k in kinds.items()], list(kinds))

        for batch in (b for whole in batches for b in blocks(whole, "text", 2_000_000)):
            data, at = joined(batch.column("text").to_pylist())
            found = Anchors(VALUES[data], at[:-1], at[1:] - 1, width, min(K, width))
            if not len(found.first):
                continue
            block += 1
            order = np.argsort(found.hash)
            h = found.hash[order]
            new = group_starts(h)
            number = np.empty(len(h), np.int32)
            number[order] = new.cumsum() - 1
            times = np.diff(np.append(np.flatnonzero(new), len(h))).astype(np.int32)
            h = h[new]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cuts = np.flatnonzero(group_starts(bucket))
            bounds, n = np.append(cuts, len(h)), len(cuts)
            yield rows(n, part=pa.array(["hashes"] * n), block=pa.array(np.full(n, block)), bucket=pa.array(bucket[cuts]), start=pa.array(cuts.astype(np.int32)), h=list_of(h.view(np.int64), bounds), n=list_of(times, bounds))
            owners = np.flatnonzero(group_starts(found.owner))
            of = found.owner[owners]
            one = lambda v: list_of(v, np.array([0, len(v)]))
            yield rows(
                1, part=pa.array(["places"]), block=pa.array([block]), docs=one(np.asarray(batch.column("doc"))[of]), names=one(np.asarray(batch.column("name"))[of]),
                counts=one(np.diff(np.append(owners, len(number))).astype(np.int32)), hash=one(number), windows=one(found.windows.astype(np.int32)),
            )

    return run


def repeated_hashes(batches):
    """Takes rows of distinct hashes with those of a bucket together; gives for each block which of its hashes (their places, ``at``)
    have two or more anchors anywhere, and how many."""

    def settle(rows: list[tuple]):
        blocks_, starts, hs, ns = zip(*rows, strict=True)
        size = np.fromiter(map(len, hs), np.int64, len(hs))
        row, k = spread(size)
        h, n, at = np.concatenate(hs), np.concatenate(ns).astype(np.int64), np.array(starts)[row] + k
        order = np.argsort(h, kind="stable")
        new = group_starts(h[order])
        total = np.empty(len(h), np.int64)
        total[order] = np.add.reduceat(n[order], np.flatnonzero(new))[new.cumsum() - 1]
        keep = total > 1
        row, bounds = row[keep], np.append(0, np.bincount(row[keep], minlength=len(rows)).cumsum())
        some = np.flatnonzero(np.diff(bounds))
        bounds = np.append(bounds[some], len(row))
        return pa.RecordBatch.from_arrays([pa.array(np.array(blocks_)[some]), list_of(at[keep].astype(np.int32), bounds), list_of(h[keep], bounds), list_of(np.minimum(total[keep], (1 << 31) - 1).astype(np.int32), bounds)], ["block", "at", "h", "n"])

    def run():
        bucket, rows = None, []
        for batch in batches:
            for b, block, start, h, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "start")), lists(batch.column("h")), lists(batch.column("n")), strict=True):
                if b != bucket and rows:
                    yield settle(rows)
                    rows = []
                bucket = b
                rows.append((block, start, h, n))
        if rows:
            yield settle(rows)

    return run()


def mark_rows(hot: int):
    """(doc, name, h, parts, first, windows) of each document: its anchors whose hash is repeated, from blocks joined with those hashes.
    A hash with over ``hot`` anchors is to be dealt to ``parts`` shards."""

    def run(batches):
        for batch in batches:
            for at, h, n, docs, names, counts, number, windows in zip(*(lists(batch.column(c)) for c in ("at", "h", "n", "docs", "names", "counts", "hash", "windows")), strict=True):
                owner, _ = spread(counts)
                before = windows.cumsum() - windows
                first = before - before[np.append(0, counts.cumsum()[:-1])][owner]
                place = np.full(number.max() + 1, -1)
                place[at] = np.arange(len(at))
                own = np.flatnonzero(place[number] >= 0)
                place, owner = place[number[own]], owner[own]
                cuts = np.flatnonzero(group_starts(owner))
                bounds = np.append(cuts, len(own))
                parts = np.where(n > hot, -(-n // hot), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[owner[cuts]]), pa.array(names[owner[cuts]]), list_of(h[place], bounds), list_of(parts[place], bounds), list_of(first[own].astype(np.int32), bounds), list_of(windows[own], bounds)],
                    ["doc", "name", "h", "parts", "first", "windows"],
                )

    return run


def cut_contexts(width: int):
    """(h, parts, doc, name, context, firsts) from documents with their marks: all bytes that an anchor's windows cover, once
    for each document, and where it has them."""

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text", 2_000_000)):
            data, at = joined(batch.column("text").to_pylist())
            marks = [lists(batch.column(c)) for c in ("h", "parts", "first", "windows")]
            if not batch.num_rows:
                continue
            owner = np.repeat(np.arange(batch.num_rows), [len(x) for x in marks[0]])
            h, parts, first, windows = map(np.concatenate, marks)
            own = binaries(*gathered(data, at[owner] + first, windows.astype(np.int64) + (width - 1))).dictionary_encode()
            code = np.asarray(own.indices).astype(np.int64)
            order = np.lexsort((first, code, owner))
            new = np.flatnonzero(group_starts(owner[order], code[order]))
            lead = order[new]
            doc, name = (np.asarray(batch.column(c))[owner[lead]] for c in ("doc", "name"))
            firsts = list_of(first[order].astype(np.int32), np.append(new, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(h[lead]), pa.array(parts[lead]), pa.array(doc), pa.array(name), own.dictionary.take(pa.array(code[lead])), firsts], ["h", "parts", "doc", "name", "context", "firsts"])

    return run


SPANS = "docs array<long>, names array<long>, spans array<long>"
SETTLED = f"{SPANS}, h long, piece int, strings binary, times array<int>, starts array<int>"


def span_row(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """One row of arrays of documents, their names and spans, from columns (doc, name, first window, windows)."""
    doc, name, first, windows = (np.concatenate(c) for c in zip(*parts, strict=True))
    whole = np.array([0, len(doc)])
    return [list_of(doc, whole), list_of(name, whole), list_of(first.astype(np.int64) << BOUNDS | windows, whole)]


def dealt(contexts: DataFrame) -> DataFrame:
    """Contexts with those of one shard (h, salt) together: all of a hash, or where it has ``parts`` those of documents of one part."""
    salt = F.when(F.col("parts") > 0, 1 + F.pmod(F.xxhash64("doc", "name"), "parts")).otherwise(0).cast("int")
    return contexts.withColumn("salt", salt).repartition("h", "salt").sortWithinPartitions("h", "salt")


def shard_spans(width: int, size: int):
    """Takes contexts with those of one h and salt together; gives repeated windows as spans, a row of arrays a shard, and sorted runs of strings.

    Shards of about ``size`` bytes hold whole groups of one h and salt.  Equal contexts, compared by their bytes, are one text of the suffix array,
    of the least document that has it; the array then gives each window's least document.  Where an h is dealt
    to several shards, the least document of a string is still to be compared with theirs: those strings go out in the order of the
    suffix array, as one run, or for over PIECE parts as several runs by a hash of the string.
    """

    def settle(rows: pa.Table):
        rows = rows.combine_chunks()
        column = lambda c: np.asarray(rows.column(c).chunk(0) if rows.column(c).num_chunks else rows.column(c))
        doc, name, parts, h = map(column, ("doc", "name", "parts", "h"))
        firsts = rows.column("firsts").chunk(0)
        start, first = np.asarray(firsts.offsets), np.asarray(firsts.values)
        coded = rows.column("context").chunk(0).dictionary_encode()
        code, texts = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        own = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(own, code, doc)
        text, offset, string, least = windows_of(data, at, own, width)
        # rows of a later document than the text's least: all windows
        late = np.flatnonzero(doc > own[code])
        i, k = spread(start[late + 1] - start[late])
        found = [(doc[late[i]], name[late[i]], first[start[late[i]] + k], np.diff(at)[code[late[i]]] - (width - 1))]
        # rows of the least document: the windows that a lesser one has, in runs
        rows_by = np.flatnonzero(doc == own[code])
        rows_by = rows_by[np.argsort(code[rows_by], kind="stable")]
        row_at = np.searchsorted(code[rows_by], np.arange(len(texts) + 1))

        def rows_of(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(index into t, row, first) of all places where the least document of a text has it."""
            i, k = spread(row_at[t + 1] - row_at[t])
            r = rows_by[row_at[t[i]] + k]
            j, k = spread(start[r + 1] - start[r])
            return i[j], r[j], first[start[r[j]] + k]

        hit = np.sort((text << 32 | offset)[least < own[text]])
        cut = np.flatnonzero(np.append(True, np.diff(hit) != 1))[: len(hit)]
        i, r, place = rows_of(hit[cut] >> 32)
        found.append((doc[r], name[r], place + (hit[cut] & 0xFFFFFFFF)[i], np.diff(np.append(cut, len(hit)))[i]))
        if len(i) or len(late):
            yield dict(zip(("docs", "names", "spans"), span_row(found), strict=True))
        # strings of dealt hashes that no lesser document of this shard has
        dealt = np.zeros(len(texts), np.int64)
        dealt[code], h_of = parts, np.zeros(len(texts), np.int64)
        h_of[code] = h
        lead = np.flatnonzero((least == own[text]) & (dealt[text] > 0))
        if not len(lead):
            return
        i, r, place = rows_of(text[lead])
        w = lead[i]
        place, bytes_at = place + offset[w], at[text[w]] + offset[w]
        sums = prefix(VALUES[data])
        pieces = -(-dealt[text[w]] // PIECE)
        piece = (window(sums, bytes_at, bytes_at + width) % pieces.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((place, name[r], string[w], piece, h_of[text[w]]))
        w, r, place, piece, bytes_at = w[order], r[order], place[order], piece[order], bytes_at[order]
        entry = np.flatnonzero(group_starts(string[w], name[r]))
        times = np.diff(np.append(entry, len(w)))
        runs = np.flatnonzero(group_starts(h_of[text[w[entry]]], piece[entry]))
        bounds = np.append(runs, len(entry))
        bytes_, _ = gathered(data, bytes_at[entry], np.full(len(entry), width))
        lead_r = r[entry]
        yield {
            "docs": list_of(doc[lead_r], bounds), "names": list_of(name[lead_r], bounds), "h": pa.array(h_of[text[w[entry[runs]]]]), "piece": pa.array(piece[entry[runs]].astype(np.int32)),
            "strings": binaries(bytes_, bounds * width), "times": list_of(times.astype(np.int32), bounds), "starts": list_of(place.astype(np.int32), np.append(entry, len(w))[bounds]),
        }

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = {"docs": longs, "names": longs, "spans": longs, "h": pa.int64(), "piece": pa.int32(), "strings": pa.binary(), "times": ints, "starts": ints}

    def out(rows: list[pa.RecordBatch]):
        for columns in settle(pa.Table.from_batches(rows)):
            n = len(columns["docs"])
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

    def run(batches):
        held, held_bytes, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, salt = np.asarray(batch.column("h")), np.asarray(batch.column("salt"))
            new = group_starts(h, salt)
            new[0] = (h[0], salt[0]) != last
            last = h[-1], salt[-1]
            ends = np.flatnonzero(new)  # a shard may end before these rows
            context = batch.column("context")
            upto = np.frombuffer(context.buffers()[1], np.int32, len(context) + 1, context.offset * 4).astype(np.int64)
            begin = 0
            while True:
                k = np.searchsorted(upto[ends], upto[begin] + size - held_bytes)
                if k == len(ends):
                    break
                if ends[k] > begin:
                    held.append(batch.slice(begin, ends[k] - begin))
                if held:
                    yield from out(held)
                held, held_bytes, begin = [], 0, ends[k]
                ends = ends[k + 1 :]
            held.append(batch.slice(begin))
            held_bytes += int(upto[-1] - upto[begin])
        if held:
            yield from out(held)

    return run


def merged(width: int):
    """Takes the sorted runs of an h's shards, those of one piece together; gives the spans of strings that a lesser document of another shard has.

    Each run is merged into those before it by binary search; a second search gives its strings' least documents.
    """

    def settle(runs: list[tuple]):
        known, least = np.zeros(0, f"S{width + 1}"), np.zeros(0, np.int64)
        strings = []
        for data, docs, *_ in runs:
            # a last byte that isn't zero, since numpy's strings lose zeros at their end
            own = np.append(np.frombuffer(data, np.uint8).reshape(-1, width), np.ones((len(docs), 1), np.uint8), axis=1).view(f"S{width + 1}")[:, 0]
            strings.append(own)
            at = np.searchsorted(known, own)
            hit = known[np.minimum(at, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
            np.minimum.at(least, at[hit], docs[hit])
            fresh = np.flatnonzero(~hit)
            fresh = fresh[np.append(True, own[fresh[1:]] != own[fresh[:-1]])[: len(fresh)]]  # a string of several rows of one key comes once
            known, least = np.insert(known, at[fresh], own[fresh]), np.insert(least, at[fresh], docs[fresh])
        found = []
        for own, (_, docs, names, times, starts) in zip(strings, runs, strict=True):
            repeat = np.repeat(least[np.searchsorted(known, own)] < docs, times)
            doc, name, first = np.repeat(docs, times)[repeat], np.repeat(names, times)[repeat], starts[repeat].astype(np.int64)
            order = np.lexsort((first, name, doc))
            doc, name, first = doc[order], name[order], first[order]
            cut = np.flatnonzero(group_starts(doc, name, first - np.arange(len(first))))  # runs of windows
            found.append((doc[cut], name[cut], first[cut], np.diff(np.append(cut, len(first)))))
        if any(len(f[0]) for f in found):
            yield pa.RecordBatch.from_arrays(span_row(found), ["docs", "names", "spans"])

    def run(batches):
        group, runs = None, []
        for batch in batches:
            for h, piece, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "piece", "strings")), *(lists(batch.column(c)) for c in ("docs", "names", "times", "starts")), strict=True):
                if (h, piece) != group and runs:
                    yield from settle(runs)
                    runs = []
                group = h, piece
                runs.append(row)
        if runs:
            yield from settle(runs)

    return run


#: Buckets of hashes for each shuffle partition; a task sorts one bucket at a time, so its memory is a small part of what it reads.
BUCKETS = 12


def repeated_spans(docs: DataFrame, width: int, shard: int, hot: int) -> DataFrame:
    """(doc, name, spans): for each document of (doc, name, text) with repeats, where they start and how many windows, in bytes."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = put(docs.mapInArrow(anchor_rows(width, buckets), ANCHORS), "anchors", parts="part")
    hashes = anchors.where("part = 'hashes'").select("bucket", "block", "start", "h", "n").repartition("bucket").sortWithinPartitions("bucket")
    known = put(hashes.mapInArrow(repeated_hashes, "block long, at array<int>, h array<long>, n array<int>"), "hashes")
    drop(anchors, "part=hashes")
    of_block = known.groupBy("block").agg(F.collect_list(F.struct("at", "h", "n")).alias("r")).select("block", *(F.flatten(f"r.{c}").alias(c) for c in ("at", "h", "n")))
    places = anchors.where("part = 'places'").select("block", "docs", "names", "counts", "hash", "windows")
    marks = places.join(of_block.hint("shuffle_hash"), "block").drop("block").mapInArrow(mark_rows(hot), "doc long, name long, h array<long>, parts array<int>, first array<int>, windows array<int>")
    # rows that repeat a document have the same marks
    marks = put(marks.groupBy("doc", "name").agg(F.first(F.struct("h", "parts", "first", "windows")).alias("m")).select("doc", "name", "m.*"), "marks")
    drop(anchors, "part=places")
    drop(known)
    contexts = docs.join(marks.hint("shuffle_hash"), ["doc", "name"]).mapInArrow(cut_contexts(width), "h long, parts int, doc long, name long, context binary, firsts array<int>")
    contexts = put(contexts, "contexts")
    drop(marks)
    settled = put(dealt(contexts).mapInArrow(shard_spans(width, shard), SETTLED), "spans")
    drop(contexts)
    runs = settled.where("strings is not null").select("h", "piece", "strings", "docs", "names", "times", "starts").repartition("h", "piece").sortWithinPartitions("h", "piece")
    found = settled.where("strings is null").select("docs", "names", "spans").union(runs.mapInArrow(merged(width), SPANS))
    spans = found.select(F.explode(F.arrays_zip("docs", "names", "spans")).alias("s")).select(F.col("s.docs").alias("doc"), F.col("s.names").alias("name"), F.col("s.spans").alias("span"))
    return spans.groupBy("doc", "name").agg(F.collect_list("span").alias("spans"))


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 50, shard: int = 2 << 20, hot: int = 2000, as_text: bool = False) -> DataFrame:
    """All columns of docs with kept (binary: the bytes that stay, or with ``as_text`` a string without characters cut in part), n_bytes, n_removed and n_spans (of removed bytes).

    A byte goes if a ``width``-byte string that covers it also starts in a document with a lesser key.  Strings are judged
    on the input and never cross documents.

    Anchors chosen by content first tell which places may repeat: those whose anchor's hash stands elsewhere too.  All
    their contexts go to shards, each of ``shard`` bytes or so, by their anchor; the shards' suffix arrays and common prefixes
    compare the bytes and give each window's least document.  A hash only deals; it removes nothing.  An anchor with over
    ``hot`` places has several shards, whose sorted strings are merged by binary search.

    Null text counts as empty and has kept empty.  Keys are of any type that sorts.  A null key is neither less nor greater than others: nothing is removed
    from it or on account of it.  Rows that repeat both key and text are one document to others and have the same result; rows of
    one key with different texts are documents of equal rank: each has its own spans, and neither loses a byte to the
    other.  Columns of docs named like the new ones are replaced.  An empty table gives an empty result.
    """
    if width < 1:
        raise ValueError("width must be 1 or more")
    docs = ready(docs).drop("kept", "n_bytes", "n_removed", "n_spans")
    rows = named_rows(docs, key, text)
    slim = rows.select("doc", "name", F.col("row").getField(text).alias("text")).where("doc is not null and name is not null")
    spans = repeated_spans(slim, width, shard, hot)

    def cut(batches):
        for batch in batches:
            for part in blocks(pa.RecordBatch.from_arrays([*batch.column("row").flatten(), batch.column("spans")], [*docs_names, "\0spans"]), text, 4_000_000):
                kept, figures = [], []
                for t, own in zip(part.column(text).to_pylist(), lists(part.column("\0spans")), strict=True):
                    raw = (t or "").encode()
                    own = np.sort(own)
                    first = own >> BOUNDS
                    last = np.maximum.accumulate(first + (own & ((1 << BOUNDS) - 1)) + (width - 1))
                    new = np.flatnonzero(np.append(True, first[1:] > last[:-1])[: len(own)])
                    starts, ends = first[new].tolist(), last[np.append(new[1:], len(own)) - 1].tolist() if len(own) else []
                    kept.append(b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)))
                    figures.append((len(raw), len(raw) - len(kept[-1]), len(starts)))
                out = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out, *(pa.array(x, pa.int64()) for x in zip(*figures, strict=True))], [*docs_names, "kept", "n_bytes", "n_removed", "n_spans"])

    docs_names = docs.columns
    kind = StructType([*docs.schema.fields]).add("kept", "string" if as_text else "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return rows.join(spans.hint("shuffle_hash"), ["doc", "name"], "left").select("row", "spans").mapInArrow(cut, kind)
