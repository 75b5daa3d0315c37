"""Token operators against the libraries that own the vocabularies."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from proofmark.llm import byte_codec, packing, token_counts, word_codec

PARTS = ["a", "E", " ", "  ", "the", "▁", "日", "\n", ".", "in", "ng", "\x1c", "①", "   ", "=", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "É", "é", "1", "23", "…", "　", "İ", "²", "'RE", "\x00", "ﬁ", "ß", "_", "\\", "}", "<s>", "\U0001f600", "\t"]
DOCS = "doc_id long, text string, n_bytes string, part string"


def texts(seed, n):
    rng = random.Random(seed)
    return ["", " ", "   "] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts(5, 150))]
    rows += [(1000, None, None, None), (1001, "the cat sat on the mat " * 900, "x", "y"), (3, rows[3][1], "clash", "clash"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_prefix_counts_match_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counter = token_counts.PrefixCounter(P.path("piece_bpe_32k.model"))
    for t in texts(1, 120):
        want = [len(sp.encode(t[:k])) for k in range(1, len(t) + 1)]
        assert counter.prefix_counts(t).tolist() == want
        counts = counter.totals([t])[0]
        assert sum(counts) == len(sp.encode(t))
        for budget in (0, 1, 4):
            assert counter.fit(t, counts, budget) == max([0, *(k for k, c in enumerate(want, 1) if c <= budget)])


def test_token_counts(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect())
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(sp.encode(r["text"] or "")), len(sp.encode(r["text"] or "")) > 4096) for r in docs.collect())
    assert got == want
    assert token_counts.token_counts(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_word_codec(spark, docs):
    file = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    for t, (ids, text) in zip(texts(2, 300), word_codec.codec(file).encode(texts(2, 300)), strict=True):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and text.decode() == tokenizer.decode(want, skip_special_tokens=False), t
    rows = {r["doc_id"]: r for r in word_codec.encode_digests(docs, file).collect()}
    assert rows[1000]["n_tokens"] == 0 and rows[1000]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_byte_codec():
    file = P.path("byte_bpe_50k.json")
    tokenizer, codec = Tokenizer.from_file(file), byte_codec.ByteCodec(file, P.PATTERN)
    for t in texts(3, 400):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, capacity=64).collect()
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        start, piece = 0, 0
        while start < len(ids):
            stop = start + (len(ids) % 64 or 64 if piece == 0 else 64)
            want.append((r["doc_id"] or -1, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, piece = stop, piece + 1
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert len(at) <= 1.02 * sum(r["length"] for r in rows) / 64 + 1
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_plans_use_each_piece_once():
    rng = random.Random(0)
    for _ in range(30):
        counts = {k: rng.randint(1, 30) for k in rng.sample(range(1, 101), 20)}
        plan = packing.plan(counts, 100)
        used = {}
        for lengths, times in plan:
            assert sum(lengths) <= 100 and times > 0
            for k in lengths:
                used[k] = used.get(k, 0) + times
        assert used == counts
    assert packing.plan({}) == []
