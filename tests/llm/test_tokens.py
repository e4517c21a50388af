"""Tokens, pieces, wavelet matrices and packing against the libraries and exact round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from synthloom.llm.common import tokenizer_path
from synthloom.llm.packing import pack_documents
from synthloom.llm.pieces import PieceEncoder, sentence_pieces
from synthloom.llm.tokens import WordEncoder
from synthloom.llm.tokenshards import token_shards
from synthloom.llm.wavelet import WaveletMatrix, read_shard, write_shard
from tests.llm.cases import documents, empty, rows

WORDS, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", "'s", "é", "É", "ß", "Σ", "1", ".", "!", "%%%", "<|endoftext|>", "<|", " ", "  ", "\n", "é", "İ",
         "中", "😀", "don't", "THE", "\x1c", "\x85", " ", "▁", "<s>", "\x00", "ing"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = np.random.default_rng(1)
    return ["".join(rng.choice(PARTS, rng.integers(0, 12))) for _ in range(4000)] + ["", " ", "▁"]


def test_words_equal_the_library(odd_texts):
    own = WordEncoder(WORDS)
    ids, at = own.encode(pa.array(odd_texts))
    for i, e in enumerate(own.whole.encode_batch(odd_texts, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == e.ids, odd_texts[i]


def test_pieces_equal_the_library(odd_texts):
    own = PieceEncoder(PIECES)
    ids, at = own.encode(pa.array(odd_texts))
    for i, e in enumerate(own.library.encode(odd_texts, add_bos=True, add_eos=True)):
        assert ids[at[i]:at[i + 1]].tolist() == e, odd_texts[i]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (64, 2), (1000, 7), (5000, 49408)])
def test_wavelet_matrix(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    names, sizes, m = read_shard(write_shard([5, None], np.array([n // 3, n - n // 3]), x))
    assert names == [5, None] and sizes.tolist() == [n // 3, n - n // 3]
    assert (m.decode() == x).all() and (m.access(np.arange(n)) == x).all()
    for s in set(x[:20].tolist()) | {top + 70000}:
        where = np.flatnonzero(x == s)
        assert m.count(s) == len(where) and m.occurrences(s).tolist() == where.tolist()
        assert m.count(s, n // 4, n // 2) == int((x[n // 4:n // 2] == s).sum())


def test_token_shards(spark):
    got = token_shards(documents(spark), WORDS, end_id=2).collect()
    whole = WordEncoder(WORDS).whole
    want = [(r["doc_id"], r["text"] or "") for r in documents(spark).collect()]
    start = 0
    for r, (name, text) in zip(sorted(got, key=lambda r: r["start"]),
                               sorted(want, key=lambda w: (w[0] is not None, w[0] or 0, w[1]))):
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (name, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)
    assert token_shards(empty(spark), WORDS).count() == 0


def test_sentence_pieces(spark):
    lib = PieceEncoder(PIECES).library
    got = {r["doc_id"]: r for r in sentence_pieces(documents(spark, False), PIECES).collect()}
    for name, text, *_ in rows():
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        assert got[name]["n_tokens"] == len(ids)
        assert got[name]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[name]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentence_pieces(documents(spark), PIECES).count() == documents(spark).count()
    assert sentence_pieces(empty(spark), PIECES).count() == 0


def test_packing(spark):
    pieces = pack_documents(documents(spark, False), WORDS, 2048, 1, tokens=True).collect()
    whole = WordEncoder(WORDS).whole
    texts = {r[0]: r[1] or "" for r in rows()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for name, own in by_doc.items():
        ids = whole.encode(texts[name], add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = ids[at:at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0 and p["ids"] == part
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)  # no padding at all
    assert pack_documents(documents(spark), WORDS).select("doc_id").count() >= documents(spark).count()
    assert pack_documents(empty(spark), WORDS).count() == 0
