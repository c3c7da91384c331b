"""Byte-level BPE and piece counts against the libraries' own results."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken

from feedloom.llm.byte_bpe import Bitmap, ByteBPE, encode_decode, read_ranks
from feedloom.llm.token_counts import piece_counter, pre_tokens, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n", "\n\nfoo", "a  b   c", "ab▁c d", "x" * 3000, "naïve café 漢字 \U0001f389\n\ttab", "<s> </s> <unk> don't", "the the the\nthe the"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(read_ranks(RANKS))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_bitmap_gives_the_least():
    b, own = Bitmap(50256), set()
    rng = random.Random(1)
    for _ in range(2000):
        x = rng.randrange(50256)
        if rng.random() < 0.6:
            b.add(x)
            own.add(x)
        elif own:
            y = b.first()
            assert y == min(own)
            b.discard(y)
            own.discard(y)
    assert Bitmap(10).first() == -1


def test_rank_queue_equals_library_on_odd_text(bpe, library):
    rng = random.Random(2)
    signs = " \t\n\r\x0b\x1c\x85\xa0　abcABC'stlvé漢12½\U0001f389%#-_́"
    find = regex.compile(public_tokenizers.PATTERN).findall
    for _ in range(400):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        assert bpe.encode([w.encode() for w in find(t)])[0].tolist() == library.encode_ordinary(t)
    long = "a" * 2000 + "".join(rng.choice("abcd") for _ in range(3000))
    ids = bpe.encode([long.encode()])[0].tolist()
    assert ids == library.encode_ordinary(long)
    assert bpe.decode(ids) == long.encode()


def test_long_pre_tokens_take_time_by_their_merges(bpe, library):
    """Ranks that can make lower pairs, in pre-tokens of up to a megabyte."""
    rng = random.Random(5)
    falling = [bpe.tokens[r] for r in sorted(bpe.falling)]
    words = [b"st" * 32_000, b"st" * 500_000, b"a" * 1_000_000, b"an" * 100_000, b"sts" * 30_000, b"".join(rng.choices(falling, k=30_000)), b"".join(rng.choices(falling[:40], k=60_000))]
    began = time.perf_counter()
    ids, sizes = bpe.encode(words)
    assert time.perf_counter() - began < 60
    at = 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library._core_bpe.encode_single_piece(w)
        at += n
    for _ in range(300):
        parts = rng.choices(falling, k=rng.randint(1, 4))
        w = b"".join(rng.choices(parts, k=rng.randint(1, 60)))
        ids, sizes = bpe.encode([w, parts[0], w])
        assert ids[: sizes[0]].tolist() == ids[-sizes[0] :].tolist() == library._core_bpe.encode_single_piece(w)


def test_encode_decode_rows(spark, library):
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_decode(docs, RANKS, public_tokenizers.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((i is not None, i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    for (_, _, ids, raw), g in zip(want, sorted(got, key=lambda g: (g.doc_id is not None, g.doc_id or 0, g.ids)), strict=True):
        assert (g.n_tokens, g.ids) == (len(ids), ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pre_tokens_sum_to_whole_text():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    count, rng = piece_counter(MODEL), random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice(" \n\t▁abcé漢%<s>1'\r") for _ in range(rng.randint(0, 30)))
        assert sum(count(pre_tokens(t))) == len(sp.encode(t))


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_counts(spark, hot):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(TEXTS)) + [(2, " "), (None, "foo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_counts(docs, MODEL, hot=hot, limit=10).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 10) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts(docs.limit(0), MODEL, hot=hot).count() == 0
    again = spark.createDataFrame([(f"k{i}", t, "clash", "clash") for i, t in rows] * 2, "doc_id string, text string, name string, pre string")
    got = token_counts(again, MODEL, hot=hot, limit=10).collect()
    assert sorted(map(tuple, got)) == sorted([(f"k{i}", *rest) for i, *rest in want] * 2)


def test_counts_of_a_very_long_text(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = " ".join(f"word{k % 9001}" for k in range(60_000)) + "\n" + "y" * 50_000
    assert [(r.n_tokens, r.over_limit) for r in token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).collect()] == [(len(sp.encode(text)), True)]


def test_a_model_that_the_cut_does_not_fit_is_refused(monkeypatch):
    import re

    from feedloom.llm import token_counts as own

    monkeypatch.setattr(own, "PRE_TOKEN", re.compile(r"(?s)."))
    with pytest.raises(ValueError, match="independently"):
        piece_counter(MODEL)
