"""Scores of fitted models against their equations, a word and a unit at a time."""

import math
import random

import numpy as np
import pytest

from feedloom.llm import toxicity, weak_quality


def sig(v):
    return 1 / (1 + math.exp(-v))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = "The quick fox!! ### a|b 12 ÉTÉ über |  stop, STOP go-go $$$ it's end. xx".split()
    out = ["", " \n", "one", "Zwei  drei"]
    for n in (5, 23, 24, 25, 40, 41, 57, 130):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n\n", "\t"]) for _ in range(n)))
    out.append("same line\n" * 6 + "other line\n\nsame line")
    return [*out, None]


def test_toxicity_scores_by_hand(texts):
    net = toxicity.Network(embed=3, hidden=2, seed=4)
    rng = np.random.default_rng(1)
    net.p |= {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.3) for k, v in net.p.items() if k.startswith("bias_")}
    p = {k: v.astype(float) for k, v in net.p.items() if v.ndim < 2 or len(v) < 100}

    def logit(rows):
        states = [[], []]
        for side, way in enumerate("fb"):
            h = [0.0, 0.0]
            order = rows if way == "f" else rows[::-1]
            for x in order:
                g = [p[f"bias_{way}"][k] + sum(a * p[f"in_{way}"][i][k] for i, a in enumerate(x)) for k in range(6)]
                r = [sum(a * p[f"rec_{way}"][i][k] for i, a in enumerate(h)) for k in range(6)]
                z, reset = [sig(g[k] + r[k]) for k in range(2)], [sig(g[2 + k] + r[2 + k]) for k in range(2)]
                c = [math.tanh(g[4 + k] + reset[k] * r[4 + k]) for k in range(2)]
                h = [h[k] + z[k] * (c[k] - h[k]) for k in range(2)]
                states[side].append(h)
        both = [a + b for a, b in zip(states[0], states[1][::-1], strict=True)]
        e = [math.exp(sum(a * w for a, w in zip(s, p["attend"], strict=True))) for s in both]
        pooled = [sum(w * s[k] for w, s in zip(e, both, strict=True)) / sum(e) for k in range(4)]
        return p["bias"][0] + sum(a * w for a, w in zip(pooled, p["out"], strict=True))

    want = []
    for t in texts:
        own = toxicity.Words([t])
        rows = net.inputs(own)[own.word].astype(float).tolist() if len(own.word) else []
        n = len(rows)
        starts = sorted({*range(0, max(n - 24, 0), 16), max(n - 24, 0)}) if n else []
        want.append(max((sig(logit(rows[s : s + 24])) for s in starts), default=0.0))
    assert net.scores(texts) == pytest.approx(want, abs=1e-5)
    assert len(set(np.round(want, 4))) > 6


def kind_of(byte):
    return 1 if 65 <= byte <= 90 else 0 if 97 <= byte <= 122 else 2 if 48 <= byte <= 57 else 3 if byte > 127 else byte - 29 if 33 <= byte <= 126 else 0


def slot(kind):
    x, m = kind, (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
    return (x ^ x >> 31) % weak_quality.DIMENSIONS


def test_quality_features_and_scores_by_hand(texts):
    rng = np.random.default_rng(3)
    prior, weights = rng.random(weak_quality.DIMENSIONS) / 50, rng.standard_normal(weak_quality.DIMENSIONS + 1)
    m = weak_quality.Measures(texts)
    got = m.features()
    scores = weak_quality.shrunk(got, m.words, prior) @ weights[:-1] + weights[-1]
    for k, t in enumerate(texts):
        words, row = (t or "").encode().split(), [0.0] * weak_quality.DIMENSIONS
        for j, w in enumerate(words):
            c = [kind_of(w[max(len(w) - d, 0)]) for d in (1, 2, 3)]
            head = kind_of(w[0]) * 98 + kind_of(w[min(1, len(w) - 1)])
            same, again = j > 0 and words[j - 1] == w, w in words[:j]
            for kind in ((c[0] * 98 + c[1]) * 98 + c[2], head + 1_000_000, same + 2_000_000, again + 2_000_010, min(len(w), 30) + 2_000_100):
                row[slot(kind)] += 1
        n = max(len(words), 1)
        row = [v / n for v in row]
        lines = [x for x in (t or "").encode().split(b"\n") if x]
        if len(lines) >= 4:
            row[0] += 3 * (1 - len(set(lines)) / len(lines))
        assert got[k].tolist() == pytest.approx(row), t
        by_hand = weights[-1] + sum(w * (v * n + 4 * q) / (n + 4) for w, v, q in zip(weights, row, prior, strict=False))
        assert scores[k] == pytest.approx(by_hand), t
