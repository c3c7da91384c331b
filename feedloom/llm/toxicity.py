"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written and trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, ready
from feedloom.llm.vector_text import VALUES, joined, mix, prefix, spans, window

WORDS, TRIGRAMS = 1 << 15, 1 << 12  # sizes of the hashed tables
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 10 if b == 10 else 32 for b in range(256)], np.uint8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """The words of texts (runs of letters and digits, A-Z lower-cased) as numbers of distinct words with their inputs."""

    def __init__(self, texts: list[str | None]):
        data, at = joined(texts)
        data = LETTERS[data]
        starts, ends = spans(data)
        self.at = np.searchsorted(starts, at)
        sums = prefix(VALUES[data])
        own, first, self.word = np.unique(window(sums, starts, ends), return_index=True, return_inverse=True)
        self.inputs = np.stack([(own & np.uint64(WORDS - 1)).astype(np.int64), (own >> np.uint64(40) & np.uint64(WORDS - 1)).astype(np.int64)], 1)
        # trigrams of each distinct word with the spaces around it; the word before may lend its last sign, never a letter
        starts, ends = starts[first], ends[first]
        n = np.maximum(ends - starts, 1)
        self.owner = np.repeat(np.arange(len(first)), n)
        place = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + starts[self.owner]
        left, right = np.maximum(place - 1, starts[self.owner]), np.minimum(place + 2, ends[self.owner])
        edges = (place == starts[self.owner]).astype(np.uint64) + np.uint64(2) * (place + 1 == ends[self.owner]).astype(np.uint64)
        self.trigram = (mix(window(sums, left, right) + edges) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.share = (1 / n).astype(np.float32)[self.owner]


class Network:
    """Word and character embeddings, a gated recurrent layer each way, attention over its states, one logit a window."""

    def __init__(self, embed: int = 8, hidden: int = 8, length: int = 24, stride: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.length, self.stride = hidden, length, stride
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"one": np.zeros((WORDS, embed), np.float32), "two": np.zeros((WORDS, embed), np.float32), "tri": small(TRIGRAMS, embed) * np.float32(8), "attend": small(2 * hidden), "out": small(2 * hidden), "bias": np.full(1, -2, np.float32)}
        self.p["one"] += rng.standard_normal((WORDS, embed)).astype(np.float32) * np.float32(0.02)
        self.p["two"] += rng.standard_normal((WORDS, embed)).astype(np.float32) * np.float32(0.02)
        for way in "fb":
            self.p |= {f"in_{way}": small(2 * embed, 3 * hidden), f"rec_{way}": small(hidden, 3 * hidden), f"bias_{way}": np.zeros(3 * hidden, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """Embedding of each distinct word, its own and the mean of its trigrams'."""
        p = self.p
        own = p["one"][words.inputs[:, 0]] + p["two"][words.inputs[:, 1]]
        tri = np.zeros_like(own)
        if len(words.trigram):
            cut = np.flatnonzero(np.append(True, words.owner[1:] != words.owner[:-1]))
            tri = np.add.reduceat(p["tri"][words.trigram] * words.share[:, None], cut, axis=0)
        return np.hstack([own, tri]).astype(np.float32)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of all windows: every ``stride`` words, the last one up to the end of the text."""
        n = np.diff(at)
        count = np.where(n > self.length, -(-(n - self.length) // self.stride) + 1, (n > 0).astype(np.int64))
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
        first = np.minimum(k * self.stride, np.maximum(n[text] - self.length, 0))
        return text, first + at[text], np.minimum(n[text], self.length)

    def states(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, way: str, keep: list | None = None) -> np.ndarray:
        """States (window, step, hidden) of one direction; ``keep`` gets what the way back needs."""
        h_, rec = self.hidden, self.p[f"rec_{way}"]
        n, steps = index.shape
        h = np.zeros((n, h_), np.float32)
        out = np.empty((n, steps, h_), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x = gates[index[:, t]]
            r = h @ rec
            zr = sigmoid(x[:, : 2 * h_] + r[:, : 2 * h_])
            z, reset = zr[:, :h_], zr[:, h_:]
            c = 2 * sigmoid(2 * (x[:, 2 * h_ :] + reset * r[:, 2 * h_ :])) - 1
            new = h + z * (c - h)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, reset, c, r[:, 2 * h_ :]))
            out[:, t] = h = new
        return out

    def logits(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([self.states(gates[w], index, mask, w) for w in "fb"], axis=2)
        return self.pool(states, mask)[0]

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        a = states @ self.p["attend"]
        if mask is not None:
            a = np.where(mask, a, -1e9)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * states).sum(1)
        return pooled @ self.p["out"] + self.p["bias"][0], a, pooled

    def index(self, words: Words, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        step = np.arange(self.length)
        mask = None if (size == self.length).all() else step < size[:, None]
        place = first[:, None] + step
        return words.word[place if mask is None else np.where(mask, place, first[:, None])], mask

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text being toxic: that of its highest window; 0 without words."""
        words = Words(texts)
        out = np.full(len(texts), -np.inf, np.float32)
        if not len(words.word):
            return np.zeros(len(texts))
        x = self.inputs(words)
        gates = {w: x @ self.p[f"in_{w}"] + self.p[f"bias_{w}"] for w in "fb"}
        text, first, size = self.windows(words.at)
        for part in (np.flatnonzero(size == self.length), np.flatnonzero(size < self.length)):
            for at in range(0, len(part), 4096):
                own = part[at : at + 4096]
                np.maximum.at(out, text[own], self.logits(gates, *self.index(words, first[own], size[own])))
        return np.where(np.isneginf(out), 0.0, sigmoid(out.astype(np.float64)))

    def gradient(self, texts: list[str], labels: np.ndarray, sharp: float = 3.0) -> dict[str, np.ndarray]:
        """Of the mean log loss of texts, whose logit is a smooth maximum of their windows'."""
        p, h_ = self.p, self.hidden
        words = Words(texts)
        x = self.inputs(words)
        gates = {w: x @ p[f"in_{w}"] + p[f"bias_{w}"] for w in "fb"}
        text, first, size = self.windows(words.at)
        index, mask = self.index(words, first, size)
        kept = {"f": [], "b": []}
        states = np.concatenate([self.states(gates[w], index, mask, w, kept[w]) for w in "fb"], axis=2)
        logit, attention, pooled = self.pool(states, mask)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, text, logit)
        weight = np.exp(sharp * (logit - top[text]))
        total = np.bincount(text, weights=weight, minlength=len(texts))
        whole = np.where(total > 0, np.where(np.isneginf(top), 0, top) + np.log(np.maximum(total, 1e-30)) / sharp, 0)
        d_logit = ((sigmoid(whole) - labels)[text] * weight / total[text] / len(texts)).astype(np.float32)
        g = {n: np.zeros_like(v) for n, v in p.items() if n not in ("one", "two", "tri")}
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_attention = (states * d_pooled[:, None]).sum(2)
        d_score = attention * (d_attention - (attention * d_attention).sum(1, keepdims=True))
        d_states = attention[:, :, None] * d_pooled[:, None] + d_score[:, :, None] * p["attend"]
        g["attend"] = (states * d_score[:, :, None]).sum((0, 1))
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            d_gates, rec = np.zeros_like(gates[way]), p[f"rec_{way}"]
            d_h = np.zeros((len(index), h_), np.float32)
            for t, h, z, reset, c, rc in reversed(kept[way]):
                d_h = d_h + d_states[:, t, k * h_ : (k + 1) * h_]
                live = 1.0 if mask is None else mask[:, t, None].astype(np.float32)
                d = d_h * live
                d_c = d * z * (1 - c * c)
                d_z = d * (c - h) * z * (1 - z)
                d_r = d_c * rc * reset * (1 - reset)
                d_in = np.hstack([d_z, d_r, d_c])
                d_rec = np.hstack([d_z, d_r, d_c * reset])
                g[f"rec_{way}"] += h.T @ d_rec
                np.add.at(d_gates, index[:, t], d_in)
                d_h = d_h * (1 - live) + d * (1 - z) + d_rec @ rec.T
            g[f"in_{way}"], g[f"bias_{way}"] = x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ p[f"in_{way}"].T
        embed = p["one"].shape[1]
        for n, at, d in (("one", words.inputs[:, 0], d_x[:, :embed]), ("two", words.inputs[:, 1], d_x[:, :embed]), ("tri", words.trigram, d_x[words.owner, embed:] * words.share[:, None])):
            g[n] = np.zeros_like(p[n])
            np.add.at(g[n], at, d)
        return g

    def fit(self, texts: list[str], labels: np.ndarray, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over shuffled batches, the rate falling to nothing."""
        rng = np.random.default_rng(seed)
        first, second = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        steps, step = rounds * -(-len(texts) // batch), 0
        for _ in range(rounds):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                step += 1
                now = rate * (1 - (step - 1) / steps)
                for n, g in self.gradient([texts[i] for i in own], labels[own]).items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.001 * (g * g - second[n])
                    self.p[n] -= (now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", each: int = 1000, most_chars: int = 4000) -> Network:
    """A network fitted to ``each`` toxic and twice as many other labelled documents at most, of the least hash, of those of up
    to ``most_chars`` characters, so to 3 * each * most_chars characters; held-out rows are never read."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = own.where("toxic = 1").orderBy(*order).limit(2 * each).union(own.where("toxic = 0").orderBy(*order).limit(3 * each))
    rows = docs.select(F.col(key).try_cast(labels.schema["doc_id"].dataType).alias("doc_id"), F.col(text).alias("text")).where(F.length("text").between(1, most_chars)).join(F.broadcast(drawn), "doc_id")
    halves = [rows.where(F.col("toxic") == t).orderBy(*order, "text").limit(n) for t, n in ((1, each), (0, 2 * each))]
    found = halves[0].union(halves[1]).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = Network()
    if found.num_rows:
        model.fit(found.column("text").to_pylist(), np.asarray(found.column("toxic")).astype(np.float32))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs; only the text enters a score.

    Windows of 24 words, every 16, cover the whole text; the score is of the highest.  Null and wordless texts
    score 0.  A null key counts as not held out.  Keys are of any type; those that can't be read as the labels' have no label.  Repeated rows stay.  Without labels the network is as it starts.
    Very long texts are scored by all their windows, a block of texts at a time.  An empty table gives an empty result.  Other columns
    may have any names and aren't returned.
    """
    docs = ready(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text, key))

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text", 3_000_000)):
            s = model.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(s.astype(np.float64))], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, score double")
    return scored.select(F.col("k").alias(key), F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
