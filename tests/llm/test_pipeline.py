"""Each stage of the pipeline against what it is to do to its own input."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from feedloom.llm.byte_bpe import read_ranks
from feedloom.llm.common import put, table
from feedloom.llm.decontaminate import contaminated
from feedloom.llm.simhash import simhash_groups


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = put(stage(spark, docs, sf), "stage")
        seen.append((name, docs, out))
        docs = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    assert all(x.columns == columns for x in (b, c, d, e))
    assert a.count() > b.count() >= c.count() == d.count() >= e.count() == f.count() > 0
    groups = simhash_groups(b).collect()
    assert {r.doc_id for r in c.collect()} == {r.component_id for r in groups}
    leaks = {r.doc_id for r in contaminated(d, table(spark, sf, "benchmark")).collect()}
    assert {r.doc_id for r in e.collect()} == {r.doc_id for r in d.collect()} - leaks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in e.collect()}
    assert {r.doc_id: r.n_tokens for r in f.collect()} == {i: len(library.encode_ordinary(t)) for i, t in texts.items()}


def test_rows_with_nulls_and_no_rows(spark, sf):
    docs = table(spark, sf, "documents")
    odd = docs.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (7001, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() <= 5
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_copies_judges_rows(spark, sf):
    """One id with two texts: only the row that a lesser id's group holds goes."""
    a, b = "some words of the first text", "and quite other things said here"
    rows = [(2, b), (5, a), (5, b), (9, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, sf, "documents").schema)
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, sf).collect()}
    assert kept == {(2, b), (5, a), (None, a)}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
