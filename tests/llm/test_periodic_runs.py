"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from feedloom.llm import queries
from feedloom.llm.periodic_runs import Grammar, periodic_runs, runs_of_texts


def runs(words, least=12):
    """(start, length, period) by definition: each period's maximal stretches, each stretch with its smallest period only."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    v, seen, out = [number[w] for w in words], set(), []
    for q in range(1, len(v) // 2 + 1):
        i = 0
        while i + q < len(v):
            j = i
            while j + q < len(v) and v[j] == v[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in out)


def listed(texts, least=12):
    out = [[] for _ in texts]
    for t, s, n, q in zip(*runs_of_texts([x.encode() for x in texts], least), strict=True):
        out[t].append((int(s), int(n), int(q)))
    return out


def ordered(found):
    return sorted((s, q, n) for s, n, q in found)


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        kind, letters = rng.randrange(5), "abcdefgh"[: rng.randrange(1, 6)]
        n = rng.randrange(0, 150)
        if kind == 0:
            w = rng.choices(letters, k=n)
        elif kind == 1:  # cycles within cycles
            w = rng.choices(letters, k=rng.randrange(1, 8)) * rng.randrange(1, 6) + rng.choices(letters, k=rng.randrange(4))
            w = w * rng.randrange(1, 5) + rng.choices(letters, k=rng.randrange(9))
        elif kind == 2:  # a few changed words
            w = rng.choices(letters, k=rng.randrange(1, 30)) * 6
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice("abcxyz")
        elif kind == 3:
            w, v = list("a"), list("ab")  # Fibonacci words
            while len(v) < n:
                w, v = v, v + w
            w = v
        else:  # Thue-Morse words, whose polynomial hashes collide
            w = ["ab"[k.bit_count() % 2] for k in range(n * 20)]
        yield " ".join(w)


@pytest.mark.parametrize("seed", range(4))
def test_equals_definition(seed):
    docs = list(texts(seed, 250))
    for text, got in zip(docs, listed(docs), strict=True):
        assert ordered(got) == ordered(runs(text.split())), text


@pytest.mark.parametrize("least", [12, 13, 20])
def test_other_bounds(least):
    docs = list(texts(9, 120))
    for text, got in zip(docs, listed(docs, least), strict=True):
        assert ordered(got) == ordered(runs(text.split(), least)), text


def test_grammar_derives_its_text():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(60):
        ids = rng.integers(0, 4, rng.integers(2, 300))
        last = rng.random(len(ids)) < 0.03
        last[-1] = True
        g = Grammar(ids, last)

        def spelled(s, g=g):
            return [s] if s < g.terminals else spelled(g.left[s - g.terminals]) + spelled(g.right[s - g.terminals])

        assert [x for s in g.final[g.final >= 0] for x in spelled(s)] == ids.tolist()
        assert all(spelled(g.terminals + r) == ids[p : p + g.size[g.terminals + r]].tolist() for r, p in enumerate(g.place))
        rule, place = g.places(np.ones(len(g.left), bool))
        assert all(spelled(g.terminals + r) == ids[p : p + g.size[g.terminals + r]].tolist() for r, p in zip(rule, place, strict=True))


def changed(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
    if doc_id is None or h % 10 or not n:
        return [w.decode() for w in words]
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [(words[i] if i < a else words[a + (i - a) % p]).decode() for i in range(n)]


def digests(doc_id, text):
    words = changed(doc_id, text)
    found = sorted(runs(words), key=lambda r: (r[0], r[2]))
    lost = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in lost)))


def test_query(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = queries.op11_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == {digests(r["doc_id"], r["text"]) for r in rows}


def test_odd_rows(spark, tmp_path):
    sizes = [1, 2, 11, 12, 13, 24, 200]
    rows = [(None, "la " * 20), (None, None), (5, None), (6, ""), (7, " \n\t"), (8, "one"), (8, "one")] + [(30 + k, "go " * k) for k in sizes] + [(k, " ".join(f"w{j}" for j in range(k % 97))) for k in range(100, 300)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digests(*r) for r in rows), key=str)
    assert periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_very_long_text():
    words = [f"w{k}" for k in range(30_000)]
    text = " ".join(words + words + words[:100] + ["x"] * 40_000)
    assert listed([text])[0] == [(0, 60_100, 30_000), (60_100, 40_000, 1)]
