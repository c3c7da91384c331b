"""The prefix trie against a brute-force one, and its queue against sorting."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from feedloom.llm import prefix_trie, queries
from feedloom.llm.prefix_trie import MessageQueue, shared_beginnings

KIND = "conv_id long, turn int, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie(convs):
    members, sets = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            sets.setdefault(node[:-1], []).append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        below = sets.get(node, [])
        words = len(node[-1][1].encode().split()) if node else 0
        total[node] = (sum(total[k][0] for k in below) or 1, sum(total[k][1] for k in below) + (len(members[node]) - 1) * words)
    out = []
    for node, cs in members.items():
        ends = sorted(c for c in cs if len(convs[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else -1, len(cs), len(sets.get(node, [])), *total[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "hi there you", "no", None, ""])) for c in range(0, 400) for t in range(1, rng.randrange(1, 7)) if c % 40]
    rows += [(c, None, "user", "first of nulls") for c in range(100, 140)] + [(c, 2, "user", "tie") for c in range(100, 120)] * 2
    rows += [(None, 1, "user", "of nobody"), (9000, 1, "a", "b c"), (9000, 1, "a", "b"), (-5, 1, "a", "long " * 50_000)]
    rows += [(c, t, "user", f"turn {t} of a copied talk") for c in range(1000, 1300) for t in range(8)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("least", "limit"), [(1024, 1 << 20), (4, 16), (1, 1)])
def test_equals_brute_force(spark, odd, least, limit, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_UNIT", least)
    df = spark.createDataFrame([(*r, "x") for r in odd if r[0] != -5], KIND + ", a string").repartition(4)
    assert found(prefix_trie.prefix_trie(*shared_beginnings(df), limit=limit)) == trie(rebuilt([r for r in odd if r[0] != -5]))


def test_query(spark, sf):
    rows = [tuple(r[k] for k in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist()]
    assert found(queries.op13_prefix_trie(spark, sf)) == trie(rebuilt(rows))


def test_turnless_long_and_none(spark):
    one = [(c, t, "user", "long " * 50_000 if t else "x") for c in (21, 22, 23) for t in range(2)]
    got = found(prefix_trie.prefix_trie(*shared_beginnings(spark.createDataFrame(one, KIND))))
    assert got == trie(rebuilt(one))
    assert any(r[1] == 0 and r[-1] != hashlib.sha256().hexdigest() for r in got)  # a conversation that has lost all turns ends at the root
    assert prefix_trie.prefix_trie(*shared_beginnings(spark.createDataFrame([], KIND))).count() == 0
    assert prefix_trie.prefix_trie(*shared_beginnings(spark.createDataFrame([(None, 1, "a", "b")], KIND))).count() == 0


def test_queue_spills_and_sums():
    rng = np.random.default_rng(1)
    for limit in (1, 7, 10_000):
        queue, want = MessageQueue(limit), {}
        for _ in range(40):
            keys, totals = rng.integers(0, 50, 20), rng.integers(0, 9, (20, 3))
            level = int(rng.integers(0, 4))
            queue.push(level, keys, totals)
            for k, t in zip(keys, totals, strict=True):
                want[level, int(k)] = want.get((level, int(k)), 0) + t
        got = []
        for level in (3, 2, 1, 0):
            for key in (10, 30, 49):
                got += [((-int(r[0]), int(r[1])), r[2:].tolist()) for r in queue.take(level, key)]
        assert [k for k, _ in got] == sorted(want, key=lambda k: (-k[0], k[1]))
        assert dict(got) == {k: v.tolist() for k, v in want.items()}
