import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from conftest import SF0001
from llm_fixture import EDGES, edge_docs
from pdcspark.llm import bpe, prefix_tokens
from pdcspark.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "th", " ", "  ", "\n", "é", "日", "\t", "0", "12", "ing", "<s>", "'s", "'ll", "​", "\U0001f600", "ß",
         "\x1c", "\x85", "\xa0", " ", ".", " the", "a" * 29, "abc" * 24, "\x00", "▁", "</s>", " " * 20]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library():
    ranks, texts = bpe.read_ranks(RANKS), random_texts(1500, 2) + ["a" * 3000, "ab" * 999, None, ""]
    encoder, decoder, theirs = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks), library()
    ids = encoder.encode(texts)
    assert [i.tolist() for i in ids] == [theirs.encode_ordinary(t or "") for t in texts]
    assert decoder.decode(ids) == [(t or "").encode() for t in texts]
    assert decoder.decode([i[::-1] for i in ids]) == [b"".join(map(theirs.decode_single_token_bytes, i[::-1].tolist())) for i in ids]


def test_bpe_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 20)
    texts = random_texts(200, 3)
    encoder, decoder, theirs = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), bpe.Decoder(bpe.read_ranks(RANKS)), library()
    for i in range(0, 200, 10):
        ids = encoder.encode(texts[i : i + 10])
        assert [x.tolist() for x in ids] == [theirs.encode_ordinary(t) for t in texts[i : i + 10]]
        assert decoder.decode(ids) == [t.encode() for t in texts[i : i + 10]]


def test_bpe_in_small_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 7)
    monkeypatch.setattr(bpe, "MOST_IDS", 5)
    texts = random_texts(120, 4) + ["", None, "word " * 40]
    encoder, decoder, theirs = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), bpe.Decoder(bpe.read_ranks(RANKS)), library()
    ids = encoder.encode(texts)
    assert [x.tolist() for x in ids] == [theirs.encode_ordinary(t or "") for t in texts]
    assert decoder.decode(ids) == [(t or "").encode() for t in texts]
    assert decoder.decode([]) == [] and decoder.decode([ids[-2]]) == [b""]


def test_ids_out_of_the_vocabulary_are_an_error():
    decoder = bpe.Decoder({b"a": 0, b"b": 2})
    assert decoder.decode([np.array([2, 0, 2], np.int32)]) == [b"bab"]
    for bad in (-1, 1, 3):
        with pytest.raises(ValueError):
            decoder.decode([np.array([0, bad], np.int32)])


def test_bpe_edges_and_empty(spark):
    theirs = library()
    coded = bpe.round_trip(edge_docs(spark), RANKS, public_tokenizers.PATTERN)
    got = sorted((str(r.id), r.ids, bytes(r.decoded)) for r in coded.collect())
    assert got == sorted((str(i), theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in EDGES)
    assert bpe.round_trip(edge_docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    encoded = bpe.encode(edge_docs(spark), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, _, _ in EDGES)


def test_op2_equals_the_library(spark):
    theirs = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    got = QUERIES["op2_byte_bpe"](spark, SF0001).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_prefix_counts_equal_the_library():
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        counter = prefix_tokens.PrefixCounter.of_model(f.read())
    rnd = random.Random(4)
    texts = random_texts(800, 5) + [None, ""]
    for i in range(0, len(texts), 100):
        for text, counts in zip(texts[i : i + 100], counter.texts(texts[i : i + 100]), strict=True):
            text = text or ""
            assert len(counts) == len(text) + 1
            for k in {0, len(text), rnd.randint(0, len(text))}:
                assert counts[k] == len(theirs.encode(text[:k]))


def test_budgets_and_edges(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counted = prefix_tokens.prefix_counts(edge_docs(spark), MODEL)
    got = prefix_tokens.budgeted(counted, 20).collect()
    texts = [t or "" for _, t, _, _ in EDGES]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (len(t.encode()), len(theirs.encode(t)), len(theirs.encode(t)) > 20) for t in texts)
    short = counted.where("id = 1").select(
        prefix_tokens.fits(F.col("counts"), 5).alias("fit"), prefix_tokens.tokens_of_prefix(F.col("counts"), F.lit(9)).alias("nine")).first()
    text = EDGES[0][1]
    assert short.nine == len(theirs.encode(text[:9]))
    assert short.fit == max(k for k in range(len(text) + 1) if len(theirs.encode(text[:k])) <= 5)
    assert prefix_tokens.prefix_counts(edge_docs(spark, []), MODEL).count() == 0


def test_op5_equals_the_library(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, SF0001).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n = len(theirs.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)


def test_beginnings_shared_by_neighbouring_chunks():
    """Whole columns are compared, so nothing is walked through twice; NUL characters look like padding and must not count."""
    chunks = sorted({"▁a", "▁ab", "▁abc", "▁ab\0c", "▁ab\0", "▁b", "\0", "\0\0", "▁" * 60, "▁" * 59 + "x", "é𝄞", "é𝄞a"})
    shared = prefix_tokens._shared(chunks)
    for before, chunk, n in zip(["", *chunks], chunks, shared):
        assert before[:n] == chunk[:n] and n <= min(len(before), len(chunk))
    plain = sorted(["▁the", "▁then", "▁thesis", "▁x"])
    assert prefix_tokens._shared(plain) == [0, 4, 4, 1] and prefix_tokens._shared([]) == []
