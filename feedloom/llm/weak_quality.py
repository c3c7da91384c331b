"""Quality classifier from weak labels: heuristic voters, their accuracies by expectation-maximisation, a linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.llm.common import blocks, put
from feedloom.llm.vector_text import joined, mix, spans, word_hashes

#: Classes of bytes for word shapes: lower, upper, digit, other letters' bytes, and each ASCII sign by itself.
CLASS = np.zeros(256, np.int64)
CLASS[np.arange(33, 127)] = np.arange(4, 98)
CLASS[np.arange(48, 58)] = 2
CLASS[np.arange(65, 91)] = 1
CLASS[np.arange(97, 123)] = 0
CLASS[np.arange(128, 256)] = 3
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&|<>~^_=+@\\{}[]")] = True
#: Voters in order: each says 1 (fine), 0 (poor) or 2 (nothing) of a document.
VOTERS = ("signs", "capitals", "shouting", "signed words", "bars", "stutter", "repeated lines", "variety", "word length")
#: Kinds of poor documents by the voters that overlap on them.
KINDS = (("signs", "signed words", "bars"), ("capitals", "shouting"), ("stutter", "repeated lines", "variety"), ("word length",))
DIMENSIONS = 1024


class Measures:
    """Figures of each text of a block, from its bytes."""

    def __init__(self, texts: list[str | None]):
        self.data, self.at = data, at = joined(texts)
        n = len(texts)
        self.starts, self.ends = starts, ends = spans(data)
        self.doc = doc = np.searchsorted(at, starts, "right") - 1
        self.n_docs, self.n_words = n, np.bincount(doc, minlength=n)
        self.words = np.maximum(self.n_words, 1)
        self.hash = word_hashes(data, starts, ends)
        sums = lambda mask: np.diff(np.append(0, mask.cumsum())[at])
        self.bytes = np.maximum(np.diff(at) - 1, 1)
        lower, upper = sums((data >= 97) & (data <= 122)), sums((data >= 65) & (data <= 90))
        self.signs = sums(SIGNS[data]) / self.bytes
        self.capitals = upper / np.maximum(lower + upper, 1)
        count = lambda mask: np.bincount(doc[mask], minlength=n) / self.words
        self.last = [data[np.maximum(ends - k, starts)] for k in (1, 2, 3)]
        tail = CLASS[self.last[0]]
        self.shouting = count((self.last[0] == 33) & (self.last[1] == 33))
        self.signed = count((tail > 3) & (self.last[1] == self.last[0]) & (ends - starts > 2))
        self.bars = count((ends - starts == 1) & (data[starts] == 124))
        self.same = np.append(False, (self.hash[1:] == self.hash[:-1]) & (doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, bool)
        self.stutter = count(self.same)
        keyed = self.hash + mix(doc.astype(np.uint64))
        _, first = np.unique(keyed, return_index=True)
        self.again = np.ones(len(doc), bool)
        self.again[first] = False
        self.variety = 1 - count(self.again)
        breaks = np.append(-1, np.flatnonzero(data == 10))
        line_doc = np.searchsorted(at, breaks[:-1] + 1, "right") - 1
        lines = word_hashes(data, breaks[:-1] + 1, breaks[1:]) + mix(line_doc.astype(np.uint64))
        full = np.diff(breaks) > 1
        lines, line_doc = lines[full], line_doc[full]
        _, first = np.unique(lines, return_index=True)
        n_lines = np.bincount(line_doc, minlength=n)
        self.repeated_lines = 1 - np.bincount(line_doc[first], minlength=n) / np.maximum(n_lines, 1)
        self.n_lines = n_lines
        self.word_length = np.bincount(doc, weights=ends - starts, minlength=n) / self.words

    def votes(self) -> np.ndarray:
        """Pattern of each text's votes, a number in base 3."""

        def vote(x, fine, poor, only=True):
            return np.where(~(only & (self.n_words > 0)), 2, np.where(x >= poor, 0, np.where(x <= fine, 1, 2)))

        all_ = (
            vote(self.signs, 0.02, 0.06),
            vote(self.capitals, 0.2, 0.5),
            vote(self.shouting, 0.02, 0.15),
            vote(self.signed, 0.05, 0.2),
            vote(self.bars, 0.02, 0.15),
            vote(self.stutter, 0.05, 0.25),
            vote(self.repeated_lines, 0.2, 0.5, self.n_lines >= 4),
            vote(1 - self.variety, 0.6, 0.85, (self.n_words >= 40) & (self.n_words <= 1000)),
            vote(np.abs(self.word_length - 6), 3, 9),
        )
        return sum(v * 3**k for k, v in enumerate(all_))

    def features(self) -> np.ndarray:
        """Hashed linear features, a row of DIMENSIONS for each text: shares of words by shape, ending and repetition."""
        ending = (CLASS[self.last[0]] * 98 + CLASS[self.last[1]]) * 98 + CLASS[self.last[2]]
        head = CLASS[self.data[self.starts]] * 98 + CLASS[self.data[np.minimum(self.starts + 1, self.ends - 1)]]
        kinds = (ending, head + 1_000_000, self.same + 2_000_000, self.again + 2_000_010, np.minimum(self.ends - self.starts, 30) + 2_000_100)
        out = np.zeros(self.n_docs * DIMENSIONS)
        for kind in kinds:
            column = (mix(kind.astype(np.uint64)) % np.uint64(DIMENSIONS)).astype(np.int64)
            out += np.bincount(self.doc * DIMENSIONS + column, minlength=len(out))
        out = out.reshape(-1, DIMENSIONS) / self.words[:, None]
        out[:, 0] += 3 * self.repeated_lines * (self.n_lines >= 4)
        return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of being fine for each pattern, each voter's chance [voter, class] of voting poor if it votes, share of each
    class), by expectation-maximisation; what a voter abstains from says nothing.

    The classes are fine documents and a poor kind for each of KINDS, since voters of different kinds don't fire together; within a
    class voters are independent.  A voter's accuracy is what it says of a kind against what it says of fine documents.
    Chances and shares have priors of ``strength`` documents, whatever the number of documents: a poor vote in four of a poor kind, in a
    hundred of fine ones.  Starts from the share of a kind's votes that are poor.
    """
    votes = patterns[:, None] // 3 ** np.arange(len(VOTERS)) % 3
    poor, cast = votes == 0, votes < 2
    kinds = [[VOTERS.index(v) for v in kind] for kind in KINDS]
    start = np.stack([poor[:, k].sum(1) / np.maximum(cast[:, k].sum(1), 1) for k in kinds], 1)
    likely = np.hstack([1 - start.max(1, keepdims=True), start]) + 0.01
    likely /= likely.sum(1, keepdims=True)
    prior = np.array([0.01] + [0.25] * len(KINDS))
    for _ in range(rounds):
        weight = likely * counts[:, None]
        chance = (poor.T @ weight + strength * prior) / (cast.T @ weight + strength)
        share = (weight.sum(0) + strength / len(prior)) / (counts.sum() + strength)
        log = np.log(share) + poor @ np.log(chance) + (cast & ~poor) @ np.log1p(-chance)
        likely = np.exp(log - log.max(1, keepdims=True))
        likely /= likely.sum(1, keepdims=True)
    return likely[:, 0], chance, share


def shrunk(x: np.ndarray, words: np.ndarray, prior: np.ndarray, weight: int = 4) -> np.ndarray:
    """Shares as if each text had ``weight`` more words of the usual kind: a few words alone are little evidence."""
    return (x * words[:, None] + weight * prior) / (words[:, None] + weight)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, the intercept last, by gradient steps with momentum; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = 0.9 * v + x.T @ ((p - y) * weight) + decay * w
        w -= 2.0 * v
    return w


def weak_quality(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 4000, threshold: float = 0.5) -> DataFrame:
    """All columns of docs with quality_score (0 to 1) and kept (quality_score >= threshold).

    Nine overlapping heuristics vote on every document; only the number of documents with each of the 3 ** 9 possible
    patterns reaches the driver, where expectation-maximisation estimates the voters' accuracies and turns patterns into posterior labels.  A logistic
    scorer over DIMENSIONS hashed features is fitted to the posteriors of ``sample`` documents at most, half of either
    kind where there are as many, those of the least hash; it scores every document.
    Shares are drawn to those of fine documents by four words' weight, so that very short texts aren't judged by one word.
    Null and wordless texts get score 0 and aren't kept.  Rows are independent of their order; repeated rows and null keys
    stay.  Very long texts are judged whole.  A column of docs named quality_score or kept is replaced, others may have any names.  With no
    poor votes at all everything is kept; an empty table gives an empty result.
    """
    slim = docs.select(F.col(text).alias("text"))

    def vote(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text", 4_000_000)):
            m = Measures(batch.column("text").to_pylist())
            found, n = np.unique(m.votes()[m.n_words > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pattern", "n"])

    found = slim.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    patterns, counts = (np.asarray(found.column(k)).astype(np.int64) for k in (0, 1))
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    fine = estimate(patterns, counts)[0] if len(patterns) else np.zeros(0)
    posterior = dict(zip(patterns.tolist(), fine.tolist(), strict=True))
    share = {c: min(1.0, 1.3 * sample / 2 / max(1, counts[(fine >= 0.5) == c].sum())) for c in (False, True)}

    def drawn(batches):
        for batch in (b for whole in batches for b in blocks(whole, "text", 4_000_000)):
            m = Measures(batch.column("text").to_pylist())
            whole = mix(word_hashes(m.data, m.at[:-1], m.at[1:]))
            p = np.array([posterior.get(v, 0.0) for v in m.votes().tolist()])
            luck = whole.astype(np.float64) / 2.0**64
            take = np.flatnonzero((m.n_words > 0) & (luck < np.where(p >= 0.5, share[True], share[False])))
            if len(take):
                x = m.features()[take].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(whole[take].view(np.int64)), pa.array(p[take]), pa.array(m.words[take]), pa.array([r.tobytes() for r in x], pa.binary())], ["h", "p", "n", "x"])

    rows = slim.mapInArrow(drawn, "h long, p double, n long, x binary")
    weights = prior = None
    if len(patterns) and fine.min() < 0.5 <= fine.max():
        rows = put(rows, "drawn")  # about as many as the sample: the texts are read once for both halves
        halves = [rows.where(c).orderBy("h", "p").limit(sample // 2) for c in ("p >= 0.5", "p < 0.5")]
        kept = put(halves[0].union(halves[1]), "sample").orderBy("h", "p").toArrow()
        x = np.stack([np.frombuffer(r, np.float32) for r in kept.column("x").to_pylist()]).astype(np.float64)
        p, n = np.asarray(kept.column("p")), np.asarray(kept.column("n"))
        prior = x[p >= 0.5].mean(0)
        weights = fit(shrunk(x, n, prior), p)

    def score(batches):
        for whole in batches:
            for batch in blocks(whole, text, 4_000_000):
                m = Measures(batch.column(text).to_pylist())
                s = np.ones(m.n_docs) if weights is None else 1 / (1 + np.exp(-np.clip(shrunk(m.features(), m.words, prior) @ weights[:-1] + weights[-1], -30, 30)))
                s = np.where(m.n_words > 0, s, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= threshold)], [*batch.schema.names, "quality_score", "kept"])

    docs = docs.drop("quality_score", "kept")
    kind = StructType([*docs.schema.fields]).add("quality_score", "double").add("kept", "boolean")
    return docs.mapInArrow(score, kind)
