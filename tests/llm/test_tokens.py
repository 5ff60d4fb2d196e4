"""Operators 2, 3 and 9: ids and counts as the libraries give them, files that decode to what was written."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from resurvey.llm import bpe, rans, token_counts, tokens
from resurvey.llm.base import fresh_path

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "²", "中", "<|endoftext|>", " ", " ", "\x1c", "foo", "Bar", "_", "-", "\r\n", "\U0001f600", "́", "!", "?", " ", " "]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(JSON).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cut_texts_encode_as_whole_texts(odd_texts):
    want = library(odd_texts)
    ids = tokens.Pieces(JSON, lengths=False).of(odd_texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in ids] == want
    assert tokens.Pieces(JSON, lengths=True).of(odd_texts) == [len(w) for w in want]


def test_a_small_memory_gives_the_same(odd_texts, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 10)
    pieces = tokens.Pieces(JSON, lengths=True)
    assert [n for i in range(0, 4000, 100) for n in pieces.of(odd_texts[i : i + 100])] == [len(w) for w in library(odd_texts)]


def test_sections_add_up(odd_texts):
    text = " ".join(odd_texts)
    parts = list(token_counts.sections(text, 500))
    assert "".join(parts) == text and len(parts) > 20
    assert sum(map(len, library(parts))) == len(library([text])[0])
    assert list(token_counts.sections("x" * 5000, 500)) == ["x" * 5000]


def test_token_counts(corner, corner_rows, nothing, rows):
    got = Counter(map(tuple, token_counts.token_counts(corner, JSON, limit=50).collect()))
    texts = [r[1] for r in corner_rows]
    want = Counter((r[0], len((r[1] or "").encode()), len(i), len(i) > 50) for r, i in zip(corner_rows, library(texts), strict=True))
    assert got == want
    assert token_counts.token_counts(nothing, JSON).collect() == []


def test_words_of_the_pattern_alone(odd_texts):
    encode = bpe.encoder_of(bpe.load_ranks(RANKS), P.PATTERN).encode_ordinary
    for t in odd_texts:
        words = [p[1:] if p[:1] == tokens.MARK else " " + p for p in tokens.cut_text(t)] if t else []
        assert [i for w in words for i in encode(w)] == encode(t)


@pytest.mark.parametrize("block_bytes", [1, 1000, 1 << 20])
def test_byte_bpe_round_trip(corner, corner_rows, block_bytes):
    encode = bpe.encoder_of(bpe.load_ranks(RANKS), P.PATTERN).encode_ordinary
    encoded = bpe.encode_documents(corner, RANKS, P.PATTERN, block_bytes=block_bytes)
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode_documents(encoded, RANKS).collect())
    want = Counter((r[0], np.array(encode(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in corner_rows)
    assert got == want


def test_byte_bpe_digests(corner, corner_rows, nothing):
    encode = bpe.encoder_of(bpe.load_ranks(RANKS), P.PATTERN).encode_ordinary
    got = Counter(map(tuple, bpe.round_trip(corner, RANKS, P.PATTERN).collect()))
    want = Counter()
    for r in corner_rows:
        ids = encode(r[1] or "")
        want[r[0], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).collect() == []


def test_unknown_id_is_an_error(spark):
    bad = spark.createDataFrame([(1, bytearray(np.array([60_000], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_documents(bad, RANKS).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 5000, 200_000])
def test_coder_round_trip_from_every_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 50_000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    coder = rans.Coder(rans.Table.of_counts(symbols, counts))
    lanes, marks, words = coder.encode(ids)
    words = words.astype(np.uint64)
    assert (coder.decode(n, lanes, marks, words) == ids).all()
    for k in range(len(marks)):
        begin = k * rans.CHECKPOINT_STEPS * lanes
        assert (coder.decode(n, lanes, marks, words, k) == ids[begin:]).all()
        part = coder.decode(n, lanes, marks, words, k, k + 1)
        assert (part == ids[begin : begin + rans.CHECKPOINT_STEPS * lanes]).all()


def test_table_keeps_rare_symbols():
    counts = np.concatenate(([10**9], np.ones(40_000)))
    table = rans.Table.of_counts(np.arange(40_001), counts)
    assert table.freqs.min() >= 1 and int(table.freqs.sum()) == 1 << rans.SCALE


@pytest.mark.parametrize("n", [1, 1000, 70_000, 200_000])
def test_table_of_a_large_vocabulary(n):
    """One frequent id beside many rare ones, and counts near each other: shares add up and ids come back."""
    rng = np.random.default_rng(n)
    for counts in (np.r_[10**9, np.ones(n - 1, np.int64)], rng.integers(1, 50, n), np.sort(rng.pareto(0.5, n) * 3 + 1).astype(np.int64)):
        table = rans.Table.of_counts(np.arange(n), counts)
        assert int(table.freqs.sum()) == 1 << rans.SCALE and table.freqs.min() >= 1
        coder = rans.Coder(table)
        ids = rng.integers(0, n, 30_000).astype(np.uint32)
        lanes, marks, words = coder.encode(ids)
        assert (coder.decode_all(len(ids), lanes, marks, words.astype(np.uint64)) == ids).all()


def test_checkpoints_are_used(monkeypatch):
    """Each stretch is decoded from its own checkpoint: a damaged one spoils its stretch and no other."""
    monkeypatch.setattr(rans, "CHECKPOINT_STEPS", 4)
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 300, 128 * 4 * 5 + 77).astype(np.uint32)
    monkeypatch.setattr(rans, "LANES", 128)
    coder = rans.Coder(rans.Table.of_counts(*np.unique(ids, return_counts=True)))
    lanes, marks, words = coder.encode(ids)
    words = words.astype(np.uint64)
    stretch = lanes * 4
    assert len(marks) == -(-len(ids) // stretch) > 4
    assert (coder.decode_all(len(ids), lanes, marks, words) == ids).all()
    for k in range(len(marks)):
        at, state = marks[k]
        broken = [m if j != k else (at, state ^ np.uint64(0b1010101)) for j, m in enumerate(marks)]
        try:
            wrong = np.flatnonzero(coder.decode_all(len(ids), lanes, broken, words) != ids)
        except (IndexError, ValueError):  # ran beyond the words
            continue
        assert len(wrong) and wrong.min() // stretch == wrong.max() // stretch == k


def test_damaged_blocks_are_found():
    coder = rans.Coder(rans.Table.of_counts(np.arange(3), np.array([5, 2, 1])))
    block = rans.pack_block(coder, [7, None], [3, 1], np.array([0, 1, 0, 2])) + b"\0"
    (read,) = rans.read_blocks(block, coder.name)
    assert read.keys == [7, None] and read.ids(coder).tolist() == [0, 1, 0, 2] and rans.ids_in(block + block) == 8
    for bad in (block[:30] + bytes([block[30] ^ 1]) + block[31:], block[:-3], block[:20]):
        with pytest.raises(ValueError):
            list(rans.read_blocks(bad, coder.name))
    with pytest.raises(ValueError, match="another table"):
        list(rans.read_blocks(block, coder.name + 1))


@pytest.mark.parametrize("file_ids", [200, 8 << 20])
def test_token_id_files(spark, corner, corner_rows, file_ids, monkeypatch):
    monkeypatch.setattr(rans, "FILES_PER_GROUP", 2)
    path = fresh_path(spark, "ids")
    rans.write_ids(corner, path, JSON, 2, file_ids=file_ids)
    got = sorted(map(tuple, rans.read_ids(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    ids = library([r[1] for r in corner_rows])
    want = Counter((r[0], tuple(i) + (2,)) for r, i in zip(corner_rows, ids, strict=True))
    assert Counter((r[0], tuple(r[4])) for r in got) == want
    keys = [-1 if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys)
    before = 0
    for _, start, n, crc, i in got:
        assert start == before and n == len(i) and crc == zlib.crc32(np.array(i, "<u4").tobytes())
        before += n


def test_token_id_files_of_nothing(spark, nothing):
    path = fresh_path(spark, "ids")
    rans.write_ids(nothing, path, JSON, 2)
    assert rans.read_ids(spark, path).collect() == []
