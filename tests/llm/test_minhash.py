"""MinHash groups against brute force over all pairs."""

import random

import pyarrow.parquet as pq
import pytest

from feedloom.llm import minhash


def shingles(text, width=4):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def groups(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.fixture(scope="module")
def rows(sf):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=200) for _ in range(6)]
    out = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    for k in range(60):  # near copies about the bound: few are near the least one, more are near each other
        one = list(base[k % 6])
        for _ in range(rng.randrange(12)):
            one[rng.randrange(len(one))] = rng.choice(words)
        out.append((5000 + k, " ".join(one)))
    out += [(6000, None), (6001, ""), (6002, " \t\n"), (6003, "one"), (6004, "One"), (6005, "a b c"), (6006, "A B C"), (6007, "a b c d"), (6008, "a  b\nc d"), (6009, "go " * 300), (6010, "go go go go"), (6011, "a b c d e")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("spread", [1024, 3])
def test_equals_all_pairs(spark, rows, spread):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    got = minhash.minhash_groups(docs, spread=spread)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == groups(rows)


def test_links_that_no_star_finds(spark):
    """A chain of texts, each near the next only, whose least member is near none but one."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 120])) for k in range(30)]
    assert {r[2] for r in groups(rows)} == {0}
    assert sorted(map(tuple, minhash.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), spread=2).collect())) == groups(rows)


def test_nulls_repeats_long_texts_and_nothing(spark):
    long = " ".join(str(k % 70_000) for k in range(120_000))
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (7, "f g h i j"), (3, "f g h i j"), (None, None), (None, "quite another text of words"), (9, long), (8, long + " tail")]
    got = minhash.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (0, 2, 0, False), (0, 2, 7, False), (3, 2, 3, True), (7, 2, 3, False), (7, 2, 7, True), (7, 2, 7, True), (8, 70_001, 8, True), (9, 70_000, 8, False)]
    assert minhash.minhash_groups(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_bounds_of_matches():
    """The bound against a sum over the posterior's density."""
    for n, m in [(16, 2), (32, 10), (128, 80)]:
        grid = [(k + 0.5) / 20_000 for k in range(20_000)]
        density = [s**m * (1 - s) ** (n - m) for s in grid]
        tail = sum(d for s, d in zip(grid, density, strict=True) if s >= 0.8) / sum(density)
        assert minhash.least_matches(n, 80, tail * 0.99) <= m < minhash.least_matches(n, 80, tail * 1.01)
