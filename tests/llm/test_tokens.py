"""Token operators against the tokenizer libraries, on small documents with every odd case."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from barweave.llm import bpe_sql, packing, wavelet
from barweave.llm.common import UnitCoder
from barweave.llm.units import byte_level_units, library_encoder, word_units

SIGNS = list("ab'sZÉéß \n\n  \t12#!.　́\u0085Σς日\x1c\r\x00") + ["'re", "'ll", " the"]
SCHEMA = "doc_id long, text string, part string, word string, piece int, lang string"


def odd_rows(seed=5, n=60):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += [None, "", "the cat " * 3000, "a" * 5000, "same", "same"]
    rows = [(i * 3 - 7, t, "p", None, 1, "en") for i, t in enumerate(texts)]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,units", [("word_bpe_49k.json", word_units), ("byte_bpe_50k.json", byte_level_units)])
def test_units_encode_alone(name, units):
    rng = random.Random(11)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    ids, lengths = UnitCoder(library_encoder(P.path(name)), limit=50).encode([units(t) for t in texts])
    whole = library(name)
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == whole(text)


@pytest.mark.parametrize("name,units", [("word_bpe_49k.json", word_units), ("byte_bpe_50k.json", byte_level_units)])
def test_special_tokens_are_the_librarys(name, units):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    signs = [*SIGNS, "<|endoftext|>", "<|startoftext|>", " <|endoftext|> ", "<|endoftext|>,", "\n", "  "]
    texts = ["a <|endoftext|> b", *["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]]
    ids, lengths = UnitCoder(library_encoder(P.path(name)), limit=50).encode([units(t) for t in texts])
    whole = Tokenizer.from_file(P.path(name))
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(1).integers(0, 49408, 3000).astype(np.uint32)
    ids[::7] = 5
    m = wavelet.WaveletMatrix.build(ids, 16)
    assert (m.tokens() == ids).all()
    assert [m.access(i) for i in range(0, 3000, 41)] == ids[::41].tolist()
    assert m.occurrences(5) == np.flatnonzero(ids == 5).tolist()
    assert m.count(70_000) == 0 and m.rank(5, 700) == int((ids[:700] == 5).sum())
    assert wavelet.WaveletMatrix.build(ids[:0], 16).tokens().tolist() == []
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(ids, 8)


def test_wavelet_files_round_trip(spark, docs):
    whole = library("word_bpe_49k.json")
    got = wavelet.encode_and_read(docs, P.path("word_bpe_49k.json"), shard_tokens=500).collect()
    want, start = [], 0
    for doc, text, *_ in sorted(odd_rows(), key=lambda r: (r[0], r[1] or "")):
        ids = whole(text) + [1]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert len({(r.part, r.seq) for r in got}) > 3


def test_token_occurrences(spark):
    from barweave.llm.common import new_path

    path = new_path(spark, "test")
    frame = spark.createDataFrame([(1, "the cat the"), (2, None), (3, "the")], "doc_id long, text string")
    wavelet.write_shards(frame, P.path("word_bpe_49k.json"), 1, path)
    the = library("word_bpe_49k.json")("the")[0]
    assert wavelet.token_occurrences(spark, path, the).count() == 3


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert wavelet.encode_and_read(none, P.path("word_bpe_49k.json")).count() == 0
    assert bpe_sql.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert packing.pack(packing.tokenised_pieces(none, P.path("byte_bpe_50k.json"))).count() == 0


def test_sql_bpe_equals_tiktoken(docs, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = {}
    for r in bpe_sql.encode_decode(docs, path, P.PATTERN).collect():
        full.setdefault(r.doc_id, []).append((r.ids, bytes(r.decoded)))
    digest = {r.doc_id: r for r in bpe_sql.encode_decode_digest(docs, path, P.PATTERN).collect()}
    for doc, text, *_ in odd_rows():
        ids = enc.encode_ordinary(text or "")
        assert full[doc][0] == (ids, (text or "").encode())
        assert digest[doc].n_tokens == len(ids)
        assert digest[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert len(full[odd_rows()[3][0]]) == 2  # the repeated row stays


def test_long_runs_decode_in_parts(monkeypatch):
    monkeypatch.setattr(bpe_sql, "QUERY_ROWS", 7)
    model = bpe_sql.SqlBpe(P.path("byte_bpe_50k.tiktoken"))
    words = ["hello", " wörld", "日本語", "x" * 40]
    flat, counts = model.encode_words(words)
    assert model.decode(flat, counts) == [w.encode() for w in words]
    assert model.decode(flat, np.array([len(flat), 0])) == ["".join(words).encode(), b""]


def test_pieces_and_packing(docs):
    whole = library("byte_bpe_50k.json")
    got = packing.pack(packing.tokenised_pieces(docs, P.path("byte_bpe_50k.json"), max_tokens=300), max_tokens=300, group_tokens=4000).collect()
    want = []
    for doc, text, *_ in odd_rows():
        ids = whole(text) + [0]
        for k, (s, n) in enumerate(packing.cut(len(ids), 300)):
            want.append((doc, k, s, n, crc(ids[s : s + n])))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 300
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 300 + 8


def test_cut_shortens_only_the_first():
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert packing.cut(4, 2) == [(0, 2), (2, 2)] and packing.cut(2, 2) == [(0, 2)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 60, 400)
    bins = packing.best_fit(lengths, (100, 4, 5000), rule=rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 5000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), (100, 4, 20000))


def test_best_fit_is_near_the_bound():
    lengths = np.random.default_rng(3).integers(1, 2049, 3000)
    bins = packing.best_fit(lengths, (2048, 2048, 2048**2))
    assert len(np.unique(bins)) <= 1.02 * lengths.sum() / 2048 + 1
