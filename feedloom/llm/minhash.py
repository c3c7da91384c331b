"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning over signature batches, exact verification."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, components, drop, put, ready
from feedloom.llm.simhash import forest
from feedloom.llm.vector_text import gram_names, joined, mix, prefix, spans, window, word_hashes, word_ids

#: Bands of signature values.  Sets of similarity 0.8 agree in some band but for one time in 20 million.
BANDS, ROWS = 32, 4
#: Signature values compared before each decision.
BATCH = 16
#: Shingles that a cell's members have in all, about.
SHINGLES = 1 << 20


def members(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that ``joined`` put together: words of each text, and of each text's distinct shingles its text, a number that is
    equal just for equal shingles of these texts, and its first word's place among all words."""
    starts, ends = spans(data)
    owner = np.searchsorted(at, starts, "right") - 1
    words = np.bincount(owner, minlength=len(at) - 1)
    names = gram_names(word_ids(data, starts, ends), width)
    first = np.flatnonzero(owner[: len(names)] == owner[len(owner) - len(names) :]) if len(names) else np.zeros(0, np.int64)
    _, at_first = np.unique(owner[first] << 32 | names[first], return_index=True)
    first = first[at_first]
    return words, owner[first], names[first], first


def coefficients(values: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(97).integers(0, 1 << 32, (2, values), np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def signatures(hashes: np.ndarray, bounds: np.ndarray, values: int) -> np.ndarray:
    """(sets, values) minima of hashes[bounds[i]:bounds[i + 1]] under each hash function; sets are not empty."""
    out = np.empty((len(bounds) - 1, values), np.uint32)
    for k, (a, b) in enumerate(zip(*coefficients(values), strict=True)):
        out[:, k] = np.minimum.reduceat(hashes * a + b, bounds[:-1])
    return out


def sketches(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(k, n, digest, words, signature) of each row: the size of its set, and for sets that can be near others a digest of the word
    sequence, the words joined by a space, and the signature.  Where there are fewer words than ``width`` only the digest is given,
    and without words nothing."""
    values = BANDS * ROWS

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text", 4_000_000)):
            raw = [b" ".join((t or "").encode().lower().split()) for t in batch.column("text").to_pylist()]
            data, at = joined(raw)
            words, owner, _, first = members(data, at, width)
            starts, ends = spans(data)
            sums = prefix(word_hashes(data, starts, ends))
            x = (window(sums, first, first + width) >> np.uint64(32)).astype(np.uint32)
            n = np.bincount(owner, minlength=len(raw))
            large = np.flatnonzero(n)
            signed = signatures(x, np.append(0, n[large].cumsum()), values) if len(large) else np.zeros((0, values), np.uint32)
            sig: list[bytes | None] = [None] * len(raw)
            for k, s in zip(large.tolist(), signed, strict=True):
                sig[k] = s.tobytes()
            size = np.where(words >= width, n, np.minimum(words, 1))
            digest = [hashlib.sha256(r).digest()[:16] if r else None for r in raw]
            kept = [r if s is not None else None for r, s in zip(raw, sig, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(size), pa.array(digest, pa.binary()), pa.array(kept, pa.binary()), pa.array(sig, pa.binary())], ["k", "n", "digest", "words", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, n long, digest binary, words binary, signature binary")


def matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a column, none of them null, as rows of a matrix."""
    size = 4 * BANDS * ROWS
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8, len(column) * size, start).view(np.uint32).reshape(-1, BANDS * ROWS)


def postings(classes: DataFrame) -> DataFrame:
    """(bucket, c): a bucket for each band of each class's signature."""

    def run(batches):
        for batch in batches:
            sig = matrix(batch.column("signature")).astype(np.uint64).reshape(-1, BANDS, ROWS)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
            for r in range(ROWS):
                keys = mix((keys << np.uint64(32)) + keys + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("c")), BANDS))], ["bucket", "c"])

    return classes.select("c", "signature").mapInArrow(run, "bucket long, c long")


def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest matches among n values that leave more than ``miss`` of the posterior to similarities of ``percent`` or more.

    From a uniform prior m matches of n make the posterior a beta distribution, whose upper tail is a binomial sum.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total > miss:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Which pairs of rows a[i], b[j] survive all batches; those dropped at one aren't compared further."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for at in range(0, a.shape[1], BATCH):
        cols = slice(at, at + BATCH)
        matches[alive] += (a[i[alive], cols] == b[j[alive], cols]).sum(1)
        alive = alive[matches[alive] >= least_matches(at + BATCH, percent, miss)]
    return alive


def pruned(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""

    def run(batches):
        for batch in batches:
            a, b = matrix(batch.column("sa")), matrix(batch.column("sb"))
            at = np.arange(len(a))
            kept = pa.array(plausible(a, b, at, at, percent, miss))
            yield batch.select(["a", "b"]).take(kept)

    own = classes.select("c", "n", "signature")
    both = pairs.join(own.toDF("b", "nb", "sb"), "b").join(own.toDF("a", "na", "sa"), "a")
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return both.where(fit).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def class_words(asked: DataFrame, classes: DataFrame, sketched: DataFrame) -> DataFrame:
    """(c, words) of the classes of asked (c), once each."""
    wanted = classes.join(asked, "c", "left_semi").select("c", "digest")
    return put(sketched.where("words is not null").select("digest", "words").join(wanted, "digest").dropDuplicates(["c"]).select("c", "words"), "minhash-words")


def verified(pairs: DataFrame, classes: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have the similarity; words are compared, not hashes."""

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, "wa", 2_000_000)):
            n = batch.num_rows
            data, at = joined(batch.column("wa").to_pylist() + batch.column("wb").to_pylist())
            _, owner, names, _ = members(data, at, width)
            size = np.bincount(owner, minlength=2 * n)
            both = np.sort(owner % n << 32 | names)
            shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=n)
            kept = 100 * shared >= percent * (size[:n] + size[n:] - shared)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    texts = class_words(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct(), classes, sketched)
    found = put(pairs.join(texts.toDF("b", "wb"), "b").join(texts.toDF("a", "wa"), "a").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long"), "minhash-links")
    drop(texts)
    return found


def shared_shingles(i: np.ndarray, j: np.ndarray, names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i[k] and j[k], names[bounds[x]:bounds[x + 1]] being set x."""
    out = np.empty(len(i), np.int64)
    size = np.diff(bounds)
    work = (size[i] + size[j]).cumsum()
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 21), "right")))
        both = np.concatenate([i[at:to], j[at:to]])
        pair = np.repeat(np.tile(np.arange(to - at), 2), size[both])
        place = np.arange(len(pair)) - np.repeat(size[both].cumsum() - size[both], size[both]) + np.repeat(bounds[both], size[both])
        keys = np.sort(pair << 32 | names[place])
        out[at:to] = np.bincount(keys[1:][keys[1:] == keys[:-1]] >> 32, minlength=to - at)
        at = to
    return out


def cell_links(width: int, percent: int, miss: float):
    """Takes rows (cell, c, part, n, signature, words) with equal cells together; gives links (a, b) that join the parts which some of a cell's
    pairs join, a part at most once.

    The pairs of different parts that survive their signatures are verified on their words, those of most matches first, until they
    are all in one part or known not to be linked.
    """

    def finish(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        c, part, n = (t.column(k).to_numpy() for k in ("c", "part", "n"))
        if (part == part[0]).all():
            return None
        order = np.argsort(c, kind="stable")
        order = order[np.append(True, np.diff(c[order]) > 0)]
        c, part, n, t = c[order], part[order], n[order], t.take(pa.array(order)).combine_chunks()
        sig = matrix(t.column("signature").chunk(0))
        parts, label = np.unique(part, return_inverse=True)
        found, step = [], max(1, (1 << 22) // len(c))
        for at in range(0, len(c), step):
            near = np.triu(label[at : at + step, None] != label[None, :], at + 1)
            near &= np.minimum(n[at : at + step, None], n[None, :]) * 100 >= np.maximum(n[at : at + step, None], n[None, :]) * percent
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 18):
                a, b = i[k : k + (1 << 18)] + at, j[k : k + (1 << 18)]
                kept = plausible(sig, sig, a, b, percent, miss)
                found.append((a[kept].astype(np.int32), b[kept].astype(np.int32)))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 2
        if not len(i):
            return None
        matches = np.concatenate([(sig[i[k : k + 65536]] == sig[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536)])
        order = np.argsort(-matches, kind="stable")
        i, j = i[order], j[order]
        data, at = joined(t.column("words").to_pylist())
        _, owner, names, _ = members(data, at, width)
        bounds = np.searchsorted(owner, np.arange(len(c) + 1))
        out, wave, root = [], len(c), np.arange(len(parts))
        while len(i):
            a, b = i[:wave].astype(np.int64), j[:wave].astype(np.int64)
            shared = shared_shingles(a, b, names, bounds)
            linked = 100 * shared >= percent * (n[a] + n[b] - shared)
            new = forest(len(parts), root[label[a[linked]]], root[label[b[linked]]])
            gone = np.flatnonzero(new != np.arange(len(parts)))
            out.append(np.column_stack([parts[gone], parts[new[gone]]]))
            root = new[root]
            i, j, wave = i[wave:], j[wave:], wave if len(gone) else 2 * wave
            alive = root[label[i]] != root[label[j]]
            i, j = i[alive], j[alive]
        pairs = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]) if len(pairs) else None

    def run(batches):
        cell, rows = None, []
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            if not len(cells):
                continue
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if rows and cells[s] != cell:
                    if (got := finish(rows)) is not None:
                        yield got
                    rows = []
                cell = cells[s]
                rows.append(batch.slice(s, e - s))
        if rows and (got := finish(rows)) is not None:
            yield got

    return run


def open_links(classes: DataFrame, sketched: DataFrame, parts: DataFrame, spread: int, width: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between parts (c, part) of classes that share a bucket and have the similarity, some for all that there are.

    A bucket with members of several parts is dealt to cells of ``spread`` members or so, and of a bounded number of shingles: its
    largest part's members go to a cell each and the others to all cells, or, where the others alone are too many, each
    two chunks of members meet in a cell.  So no task holds a bucket's members in one group, no two of them fail to meet, and
    pairs are compared where their members are and never listed.  Of buckets with the same members one is enough.
    """
    held = postings(classes).join(parts, "c")
    sizes = F.sum("n").alias("n"), F.count("*").alias("many")
    counts = put(held.groupBy("bucket", "part").agg(*sizes, F.bit_xor(F.xxhash64("c")).alias("who"), F.sum(F.shiftright(F.xxhash64("c", F.lit(1)), 20)).alias("sum")), "minhash-buckets")
    stats = counts.groupBy("bucket").agg(F.sum("many").alias("all"), F.sum("n").alias("n_all"), F.max(F.struct("many", "n", "part")).alias("most"), F.count("*").alias("parts"), F.bit_xor("who").alias("who"), F.sum("sum").alias("sum")).where("parts > 1")
    stats = stats.groupBy("all", "n_all", "who", "sum").agg(F.min("bucket").alias("bucket"), F.min_by("most", "bucket").alias("most"))
    fit = (F.col("all") - F.col("most.many") <= spread) & (F.col("n_all") - F.col("most.n") <= SHINGLES)
    chunks = F.greatest(F.ceil(F.col("all") / spread), F.ceil(F.col("n_all") / SHINGLES)).cast("int")
    stats = stats.select("bucket", F.col("most.part").alias("main"), fit.alias("few"), chunks.alias("chunks"))
    rows = held.join(stats, "bucket").withColumn("own", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    cells = F.when(F.col("few") & (F.col("part") == F.col("main")), F.array("own")).when(F.col("few"), every).otherwise(F.transform(every, lambda k: F.least("own", k) * F.col("chunks") + F.greatest("own", k)))
    dealt = put(rows.select("c", "part", "n", "bucket", F.explode(cells).alias("k")).select(F.xxhash64("bucket", "k").alias("cell"), "c", "part", "n"), "minhash-cells")
    texts = class_words(dealt.select("c").distinct(), classes, sketched)
    full = dealt.join(texts.join(classes.select("c", "signature"), "c"), "c").select("cell", "c", "part", "n", "signature", "words")
    links = put(full.repartition("cell").sortWithinPartitions("cell").mapInArrow(cell_links(width, percent, miss), "a long, b long").distinct(), "minhash-links")
    drop(texts)
    return links


def minhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, percent: int = 80, miss: float = 1e-7, spread: int = 1024) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs.

    A row's set holds the distinct ``width``-word shingles of its text, A-Z lower-cased; of fewer words the whole sequence.  Rows whose
    sets have a Jaccard similarity of ``percent`` hundredths or more are linked; component_id is the least key that a chain of links
    reaches, and kept tells whether it is the row's own.

    Rows of one word sequence are a class.  Classes of a bucket are first compared with its least class; what these links
    leave in different components meets in ``open_links``.  Each pair is dropped once its signature leaves a chance of at most
    ``miss`` that it reaches the similarity, and survivors are verified on their words.  So a group of near copies costs a row
    for each member and bucket, and each link joins verified sets; a link is lost only where no band agrees (5e-8 at the
    least similarity) or at the chosen miss probability, and then only if no chain of others replaces it.

    Null, empty and wordless texts have no shingles and are linked with nothing.  A null key keeps its row and never names a
    component, and its row isn't kept.  Repeated rows stay, each with the same verdict; rows of one key with different texts are
    different documents.  Very long texts are whole sets, 0.5 KB of signature each.  An empty table gives an empty
    result; extra columns of any name are ignored.
    """
    sketched = put(ready(sketches(docs, text, key, width)), "minhash-sketches")
    grouped = sketched.where("digest is not null").groupBy("digest").agg(F.min("k").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    named = put(grouped.withColumn("c", F.monotonically_increasing_id()), "minhash-classes")
    classes = named.where("signature is not null")
    heads = postings(classes).groupBy("bucket").agg(F.min("c").alias("a"), F.count("*").alias("held")).where("held > 1").select("bucket", "a")
    stars = postings(classes).join(heads, "bucket").where("a < c").select("a", F.col("c").alias("b")).distinct()
    near = put(pruned(stars, classes, percent, miss), "minhash-pairs")
    links = verified(near, classes, sketched, width, percent)
    found = put(components(links), "minhash-groups")
    parts = classes.select("c", "n").join(found.toDF("c", "g"), "c", "left").select("c", "n", F.coalesce("g", "c").alias("part"))
    more = open_links(classes, sketched, parts, spread, width, percent, miss)
    groups = components(links.union(more)).toDF("c", "g")
    rooted = put(named.select("c", "digest", "least").join(groups, "c", "left").select("digest", "least", F.coalesce("g", "c").alias("g")), "minhash-roots")
    known = rooted.join(rooted.groupBy("g").agg(F.min("least").alias("component_id")), "g").select("digest", "component_id")
    out = sketched.select("k", "n", "digest").join(known, "digest", "left").withColumn("component_id", F.coalesce("component_id", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(False)).alias("kept"))
