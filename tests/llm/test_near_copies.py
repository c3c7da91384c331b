"""SimHash groups and both kinds of repeat removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import fingerprint_log, simhash, suffix_dedup
from feedloom.llm.anchors import Anchors
from feedloom.llm.common import components
from feedloom.llm.vector_text import VALUES, joined


@pytest.fixture(scope="module")
def rows(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    base = [(r["doc_id"], r["text"]) for r in t][:120]
    rng = random.Random(4)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(90))
    extra = [(900, None), (901, ""), (902, "  \n "), (903, "one"), (904, "one two"), (905, "ab" * 400), (906, "ab" * 300), (907, "go " * 90), (908, long), (909, "start " + long + " end"), (910, base[0][1]), (911, base[0][1].upper())]
    return base + extra


def fingerprint(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    count = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in count.items() if 2 * n > len(shingles))


@pytest.mark.parametrize("spread", [4096, 2])
def test_simhash_groups(spark, rows, spread, monkeypatch):
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (spread,))
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            root[i] = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    want = {(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    assert {tuple(r) for r in simhash.simhash_groups(docs).drop("text_hash").collect()} == want


def test_simhash_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "quite another text")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.component_id or 0) for r in simhash.simhash_groups(docs).collect())
    assert got == [(False, 0), (False, 5), (True, 5), (True, 5)]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_simhash_of_a_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{k * k % 7919}" for k in range(90_000))
    rows = [(1, long, "x", "y"), (2, long + " end", "x", "y"), (3, "short", "x", "y")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, name string, component_id string")).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{fingerprint(t):016x}") for i, t, *_ in rows}
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_blocks_reach_every_three_bytes():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(any(set(c) <= set(b) for b in simhash.BLOCKS) for c in combinations(range(8), 3))
    assert all(tuple(sorted({*range(8)} - {*b})) in simhash.BLOCKS for b in simhash.BLOCKS)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (5, 6), (5, 6)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_anchors_serve_each_window_once():
    data, at = joined(["the quick brown fox jumps over the lazy dog " * 6, "short", "x" * 200])
    found = Anchors(VALUES[data], at[:-1], at[1:] - 1, 50, 16)
    served = [int(f) + k for f, n in zip(found.first, found.windows, strict=True) for k in range(n)]
    want = [s for d in range(3) for s in range(at[d], max(at[d], at[d + 1] - 1 - 49))]
    assert sorted(served) == want
    assert all(f <= p <= f + 34 for f, p in zip(found.first, found.place, strict=True))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for n, letters in ((1500, 2), (900, 4), (40, 1), (7, 3), (1, 1)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        raw, order = data.tobytes(), suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        same = lambda a, b: next((k for k in range(50) if max(a, b) + k >= n or raw[a + k] != raw[b + k]), 50)  # noqa: B023, E731
        assert suffix_dedup.common_prefixes(data, order, 50, 7).tolist()[1:] == [same(order[i - 1], order[i]) for i in range(1, n)]


def test_suffix_array_of_a_shard_of_over_two_megabytes():
    """Groups' numbers take 22 bits there, and few suffixes stay open: all are in order, held by those one byte further on."""
    rng = np.random.default_rng(6)
    own = rng.integers(97, 123, (1 << 21) - 40_000).astype(np.uint8)
    data = np.concatenate([own, own[5_000:55_000], own[-30_000:], own[100_000:120_000]])
    n = len(data)
    order = suffix_dedup.suffix_array(data)
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.arange(1, n + 1)
    a, b = order[:-1], order[1:]
    assert n > 1 << 21 and len(np.unique(order)) == n
    assert ((data[a] < data[b]) | (data[a] == data[b]) & (rank[a + 1] < rank[b + 1])).all()


@pytest.mark.parametrize("shard", [1 << 20, 16 << 20])
def test_suffix_dedup_of_shards_of_any_size(spark, shard):
    """Pieces of 60 bytes that end in one of a few strings of 16 or so: the strings' contexts differ, so shards have that many bytes."""
    rng = random.Random(7)
    ends = ["".join(rng.choices("abcdefgh", k=24)) for _ in range(40)]
    texts = ["".join("".join(rng.choices("ijklmnopqrstuvwxyz", k=36)) + rng.choice(ends) for _ in range(150)) for _ in range(500)]
    texts[400] = texts[399][:4_000] + "x" + texts[10][1_000:5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs, shard=shard, hot=1 << 20).collect()}
    assert {i: n for i, n in removed.items() if n > 100} == {400: 8_000}


def cut_bytes(rows, width=50):
    """Result of each distinct (key, text); a string of a document of the same key doesn't count."""
    least, raw = {}, {(i, t): (t or "").encode() for i, t in rows if i is not None}
    for (i, _), b in raw.items():
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            least[s] = min(i, least.get(s, i))
    for (i, _), b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = True
        spans = int((np.diff(np.append([False], gone).astype(int)) == 1).sum())
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def byte_cuts(docs, **options):
    got = suffix_dedup.suffix_dedup(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return Counter(tuple(r) for r in got if r.doc_id is not None)


@pytest.mark.parametrize(("hot", "width", "shard"), [(2000, 50, 2 << 20), (1, 50, 500), (40, 50, 2 << 20), (3, 30, 20_000), (2000, 300, 2 << 20), (2, 300, 1000), (5, 7, 2 << 20)])
def test_suffix_dedup(spark, rows, hot, width, shard):
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("__doc", F.lit("x"))
    got = suffix_dedup.suffix_dedup(docs, hot=hot, width=width, shard=shard).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert len(got) == len(rows) + 1
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == Counter(cut_bytes(rows, width))
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


def test_suffix_dedup_repeats_text_and_nothing(spark):
    t = "é" * 40
    docs = spark.createDataFrame([(1, t), (2, "x" + t), (2, "x" + t)], "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(docs, as_text=True).select("doc_id", "kept", "n_removed").collect())
    assert got == [(1, t, 0), (2, "x", 80), (2, "x", 80)]
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs, width=0)


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_of_one_key_with_different_texts(spark, hot):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = word(200)
    rows = [(1, word(50) + shared), (2, word(317)), (2, word(40) + shared + word(30)), (3, shared), (3, word(20) + shared[:120]), (3, shared), (2, shared[:90])]
    distinct = list(dict.fromkeys(rows))
    by = dict(zip(distinct, cut_bytes(rows), strict=True))
    want = Counter(by[r] for r in rows)
    assert byte_cuts(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot) == want
    assert by[rows[1]][2] == 0 < by[rows[2]][2]


def test_suffix_dedup_of_string_keys(spark, rows):
    """Keys that sort as strings do; kept as they are."""
    named = [(f"k{i}", t) for i, t in rows]
    assert byte_cuts(spark.createDataFrame(named, "doc_id string, text string")) == Counter(cut_bytes(named))


def test_suffix_dedup_of_long_runs(spark):
    """A million times one letter, and a turning text: each has one context for all its places."""
    rows = [(1, "b" * 60), (2, "a" * 1_000_000), (3, "xy" + "a" * 70 + "z"), (4, "abc" * 100_000), (5, "q" + "bca" * 30 + "Q")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed").collect()}
    assert got == {1: 0, 2: 0, 3: 70, 4: 0, 5: 90}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.createDataFrame([(0, "a" * 64), *rows], "doc_id long, text string"), hot=20).select("doc_id", "n_removed").collect()}
    assert got == {0: 0, 1: 0, 2: 1_000_000, 3: 70, 4: 0, 5: 90}


def test_suffix_dedup_deals_a_line_of_many_documents(spark):
    """A line of 39 bytes, too short to be removed, in every document: its anchor's places are dealt over shards."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    line = "this line is in each of all documents!!"
    rows = [(k, word(60) + line + word(60)) for k in range(3000)] + [(5000, line + "x" * 40), (5001, line + "x" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    contexts = docs.select(F.lit(7).cast("long").alias("h"), F.lit(30).alias("parts"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("name"), F.expr("cast(left(text, 110) as binary)").alias("context"), F.array(F.lit(0)).alias("firsts"))
    contexts = contexts.union(contexts.where("doc = 0").crossJoin(spark.range(10_000, 13_000)).selectExpr("h", "parts", "id doc", "id name", "context", "firsts"))
    sizes = [r["count"] for r in suffix_dedup.dealt(contexts).groupBy("h", "salt").count().collect()]
    assert sum(sizes) == 6002 and len(sizes) == 30 and max(sizes) < 300  # different lines and one that 3,001 documents have
    assert byte_cuts(docs, hot=100) == Counter(cut_bytes(rows))


def test_suffix_dedup_deals_copies(spark):
    """Copies of one text share an anchor and everything else but their ids."""
    contexts = spark.range(20_000).select(F.lit(7).cast("long").alias("h"), F.lit(10).alias("parts"), F.col("id").alias("doc"), F.lit(1).cast("long").alias("name"))
    sizes = [r["count"] for r in suffix_dedup.dealt(contexts).groupBy("h", "salt").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 10 and max(sizes) < 2400
    rows = [(k, "the very same sentence, copied over and over again. " * 3) for k in range(300)]
    assert byte_cuts(spark.createDataFrame(rows, "doc_id long, text string"), hot=20) == Counter(cut_bytes(rows))


def test_suffix_dedup_of_lines_that_a_salted_shard_repeats(spark):
    """Document 2 has each line twice with the same surroundings, document 1 has it with others."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for k in range(40):
        line, side = word(90), word(80)
        twice = side + line + side[::-1]
        rows += [(2 * k, word(80) + line + word(80)), (2 * k + 1, twice + word(70) + twice)]
    assert byte_cuts(spark.createDataFrame(rows, "doc_id long, text string"), hot=1) == Counter(cut_bytes(rows))


def cut_words(rows, width=35):
    own = {i: (t or "").encode().split() for i, t in rows}
    count = Counter(tuple(w[k : k + width]) for w in own.values() for k in range(len(w) - width + 1))
    for i, w in own.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = True
        yield i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (4, 1)])
def test_fingerprint_log(spark, rows, batches, fan):
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").withColumn("h", F.lit(1))
    got = fingerprint_log.log_dedup(docs, batches=batches, fan=fan).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {tuple(r) for r in got if r.doc_id is not None} == set(cut_words(rows))
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_fingerprint_log_of_repeated_keys(spark):
    rng = random.Random(8)
    word = lambda n: [rng.choice("abcdefghijklmnop") + rng.choice("qrstuvw") for _ in range(n)]
    rows = []
    for k in range(20):  # an anchor's words only, with others around them
        shared = word(10)
        one, other, apart = (" ".join(word(40) + shared + word(40)) for _ in range(3))
        rows += [(3 * k, one), (3 * k, one), (3 * k + 1, other), (3 * k + 2, apart), (3 * k + 2, " ".join(word(60)) + " " + one)]
    whole = dict.fromkeys(rows)  # each document once
    cut = {i: tuple(r) for i, *r in cut_words([(i, t) for i, (_, t) in enumerate(whole)])}
    at = {r: i for i, r in enumerate(whole)}
    want = Counter((r[0], *cut[at[r]]) for r in rows)
    got = fingerprint_log.log_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_removed for r in got) > 0 < sum(r.n_removed == 0 for r in got)


def test_fingerprint_log_over_three_calls(spark, rows):
    """Each call's documents are judged against those of the calls before as well; the index is opened by name and compacted on the way."""
    own = [(f"k{i}", t) for i, t in rows]
    rng = random.Random(3)
    rng.shuffle(own)
    parts, log = [own[0::3], own[1::3], own[2::3]], fingerprint_log.FingerprintIndex(spark, "seen_windows")
    log.delete()
    before = []
    for k, part in enumerate(parts):
        frame = lambda x: spark.createDataFrame(x, "doc_id string, text string")
        got = fingerprint_log.log_dedup(frame(part), batches=1, fan=2, index="seen_windows", earlier=frame(before) if before else None).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        before += part
        want = {r[0]: r for r in cut_words(before)}
        assert {tuple(r) for r in got} == {want[i] for i, _ in part}
        assert len(fingerprint_log.FingerprintIndex(spark, "seen_windows").runs()) == min(k + 1, 2)
    plan = log.lookup(spark.createDataFrame([(1, 2, 3, 4, 1, [0])], fingerprint_log.ENTRY)).where("times > 1")._jdf.queryExecution().executedPlan().toString()
    scans = [k for k, line in enumerate(plan.split("\n")) if "FileScan" in line and "Bucketed: true" in line]
    lines = plan.split("\n")
    assert len(scans) == 4 and not any("Sort" in lines[j] or "Exchange" in lines[j] for k in scans for j in range(k - 3, k))
    log.delete()
    assert not log.runs()


def test_fingerprint_log_looks_batches_up_as_they_come(spark, rows):
    """Every batch against the runs of those before it and its own: finds of all batches together are those of one lookup at the end."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").where("text is not null").select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("name"), "text")
    entries = docs.mapInArrow(fingerprint_log.entries_of(35), fingerprint_log.ENTRY).cache()
    log, found = fingerprint_log.FingerprintIndex(spark), []
    for k in range(3):
        part = entries.where(F.col("doc") % 3 == k)
        log.add(part)
        found += log.lookup(part).collect()
    last = log.lookup(entries).collect()
    assert {(r.h, r.context) for r in found if r.times > 1} == {(r.h, r.context) for r in last if r.times > 1}
    assert {r.h for r in found if r.near} == {r.h for r in last if r.near}
    log.delete()


def test_fingerprint_log_of_nothing(spark):
    assert fingerprint_log.log_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
