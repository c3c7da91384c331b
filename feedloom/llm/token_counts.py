"""Token counts of a piece model, from counts of distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, put, ready

#: A piece of the model holds the space mark only at its start and no line feed at all, so no merge crosses the
#: start of a run of spaces or either side of a line feed, and these parts are encoded independently.
PRE_TOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")
SPACE_MARK = "▁"
#: Texts on which the cut is tried before a model is used.
PROBES = ("a b", "  two  spaces ", "the\nnext line", "\n\n x\n", " \n ", "naïve  café\tΑβγ", "1,000 (and) more... 2\n3", "x\n▁y  z")


def pre_tokens(text: str | None) -> list[str]:
    """Keys of the pre-tokens of a text: each is what follows the space that the model puts in front."""
    if not text:
        return []
    return [t[1:] if t[0] == " " else t for t in PRE_TOKEN.findall(" " + text.replace(SPACE_MARK, " "))]


def piece_counter(model: str):
    """A function from a list of pre-token keys to their numbers of pieces; ValueError for a model whose pieces cross the cut."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)

    def count(keys: list[str]) -> list[int]:
        # "" is a lone space mark; a key that starts with a line feed is encoded behind a space mark of its own
        return [1 if not k else len(ids) - (k[0] == "\n") for k, ids in zip(keys, sp.encode(keys, num_threads=1), strict=True)]

    for t in PROBES:
        if sum(count(pre_tokens(t))) != len(sp.encode(t)):
            raise ValueError(f"{model} does not encode the parts of {t!r} independently")
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if SPACE_MARK in p[1:].lstrip(SPACE_MARK) or "\n" in p]
    if crossing:
        raise ValueError(f"{model} has pieces that cross the cut, such as {crossing[0]!r}")
    return count


def token_counts(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", limit: int = 4096, hot: int = 100_000, hot_bytes: int = 48) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of docs.

    Pieces are counted once for each distinct pre-token of the corpus.  Of these counts the ``hot`` most frequent
    (of at most ``hot_bytes`` characters each, so at most hot * (4 * hot_bytes + 100) bytes) go to all tasks; all
    others are joined by a shuffle to the frequencies within each document, and summed.  No ids are kept.
    Null text counts as empty, with no tokens.  Keys are of any type.  Rows are told apart by key and 64 bits of the text, so
    repeated keys, null keys too, stay rows of their own, and rows that repeat both are counted once and given back as often as they
    came.  Other columns aren't returned.  An empty table gives an empty result.
    """
    docs = ready(docs)
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("name"), F.col(text).alias("text"))

    def distinct(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    seen.update(set(pre_tokens(t)))
            if len(seen) > 1_000_000:
                yield pa.RecordBatch.from_pydict({"pre": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"pre": list(seen), "n": list(seen.values())})

    def count(batches):
        pieces = piece_counter(model)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pre": batch.column("pre"), "n": batch.column("n"), "pieces": pa.array(pieces(batch.column("pre").to_pylist()), pa.int32())})

    vocabulary = put(
        docs.select("text").mapInArrow(distinct, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n")).mapInArrow(count, "pre string, n long, pieces int"), "pre-tokens"
    )
    top = vocabulary.where(F.length("pre") <= hot_bytes).orderBy(F.desc("n"), "pre").limit(hot).select("pre", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def frequencies(batches):
        table = known.value
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
        for batch in (b for whole in batches for b in blocks(whole, "text", 2_000_000)):
            of: list[int] = []
            out: list[list] = [[] for _ in kinds]
            for i, t in enumerate(batch.column("text").to_pylist()):
                total, rest = 0, []
                for pre, times in Counter(pre_tokens(t)).items():
                    n = table.get(pre)
                    if n is None:
                        rest.append((None, None, pre, times))
                    else:
                        total += n * times
                rest.append((len((t or "").encode()), total, None, None))
                of += [i] * len(rest)
                for c, values in zip(out, zip(*rest, strict=True), strict=True):
                    c.extend(values)
            own = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(own), batch.column("name").take(own), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc", "name", "n_bytes", "tokens", "pre", "times"])

    # a document's own row joins nothing: its join key is its own, so that these rows don't meet in one task
    rows = docs.mapInArrow(frequencies, f"doc {kind}, name long, n_bytes long, tokens long, pre string, times long")
    rows = rows.withColumn("k", F.coalesce("pre", F.concat(F.lit("\n\n"), F.coalesce(F.xxhash64("doc", "name"), F.lit(0)).cast("string"))))
    rows = rows.drop("pre").join(vocabulary.select(F.col("pre").alias("k"), "pieces"), "k", "left")
    total = F.sum(F.coalesce("tokens", F.col("times") * F.col("pieces")))
    total = rows.groupBy("doc", "name").agg(F.max("n_bytes").alias("n_bytes"), total.alias("n"), F.count("n_bytes").alias("copies"))
    total = total.select(F.col("doc").alias(key), "n_bytes", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return total.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
