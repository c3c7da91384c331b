"""Search features of items: plain text, terms, vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as T
from feedloom.functions.arrow import html_to_text, nfkc

Embedder = Callable[[list[str]], list[list[float]]]


def prepared(items: DataFrame, exact: bool = True) -> DataFrame:
    """Items (id, title, summary_text, content) with plain text, hash, length, terms, model text and a reason to skip them.

    With ``exact`` references are decoded and Unicode forms unified by Arrow UDFs; without, regular expressions alone serve.
    """
    plain: Callable[[Column], Column] = html_to_text if exact else T.tag_free
    clean: Callable[[Column], Column] = nfkc if exact else T.collapsed
    rows = items.select("id", clean(F.col("title")).alias("title_text"), plain(F.col("summary_text")).alias("short_text"), plain(F.col("content")).alias("body"))
    rows = rows.withColumn("body", T.without_prefix(F.col("body"), F.col("title_text")))
    rows = rows.withColumn("body", F.trim(F.left(T.without_prefix(F.col("body"), F.col("short_text")), F.lit(T.MAX_BODY))))
    rows = rows.withColumn("plain", F.array_join(T.segments(F.col("title_text"), F.col("short_text"), F.col("body")), "\n\n"))
    return rows.select(
        "id", "title_text", "short_text", "body", "plain", T.input_hash(F.col("plain")).alias("input_hash"), T.utf16_length(F.col("plain")).alias("plain_text_length"),
        T.search_terms(F.col("title_text"), F.col("short_text")).alias("lexical_terms"), T.skip_reason(F.col("plain")).alias("skip_reason"), F.concat(F.lit(T.MODEL_PREFIX), F.col("plain")).alias("model_text"),
    )


class Places(dict):
    """Place and sign of words in a hashed vector, worked out once for most."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        at = h % self.size * 2 + (h >> 16 & 1)
        if len(self) < 1 << 18:
            self[word] = at
        return at


def hashed_embedder(size: int = 64) -> Embedder:
    """Deterministic stand-in for a model: signed hashed counts of words, of unit length."""
    places = Places(size)

    def embed(texts: list[str]) -> list[list[float]]:
        found = [np.bincount(np.fromiter(map(places.__getitem__, t.lower().split()), np.int64), minlength=2 * size) for t in texts]
        out = np.array(found, float).reshape(len(texts), size, 2)
        out = out[:, :, 1] - out[:, :, 0]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embedded(rows: DataFrame, embedder: Embedder, size: int, batch_size: int = 8) -> DataFrame:
    """(id, embedding, error) of (id, model_text): a batch whose vectors are missing, of another size or not finite gives error rows."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                try:
                    got = np.asarray(embedder(part.model_text.fillna("").tolist()), float)
                    if got.shape != (len(part), size) or not np.isfinite(got).all():
                        raise ValueError(f"vectors of shape {got.shape} or not finite")
                    yield pd.DataFrame({"id": part.id, "embedding": list(got.astype(np.float32)), "error": None})
                except Exception as e:  # any model failure is reported with its rows, and other batches go on
                    yield pd.DataFrame({"id": part.id, "embedding": None, "error": str(e)[:2000]})

    return rows.select("id", "model_text").mapInPandas(run, "id long, embedding array<float>, error string")


RESULTS = ("claimed", "ready", "skipped", "failed")


def results() -> list[Column]:
    """What became of the items of a batch, as aggregates over their rows (status): claimed, ready, skipped, failed."""
    return [F.count("*").alias("claimed"), *(F.count_if(F.col("status") == s).alias(s) for s in RESULTS[1:])]


def feature_rows(items: DataFrame, embedder: Embedder, size: int, version: str, batch_size: int = 8, exact: bool = True) -> DataFrame:
    """(item_id, algorithm_version, status, input_hash, plain_text_length, lexical_terms, embedding, skip_reason, error) of items: skipped where the
    text is too short, failed where the model gave no valid vector, else ready."""
    rows = prepared(items, exact)
    found = embedded(rows.where("skip_reason is null"), embedder, size, batch_size)
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("embedding").isNull(), "failed").otherwise("ready")
    return rows.join(found, "id", "left").select(F.col("id").alias("item_id"), F.lit(version).alias("algorithm_version"), status.alias("status"), "input_hash", "plain_text_length", "lexical_terms", "embedding", "skip_reason", "error")
