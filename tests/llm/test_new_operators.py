"""Whitening, packing and alignment against plain versions, on corner cases and on vocabularies' whole texts."""

import hashlib
import random
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from resurvey.llm import alignment, packing, whitening

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int, x int, n string, component string"


# --- whitening


def plain_whitening(vectors):
    """x, deviations, whitened (up to signs), explained by exact sums and a double eigensolver."""
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    total = [sum(r[k] for r in fit) for k in range(d)]
    cov = [[sum((n * r[i] - total[i]) * (n * r[j] - total[j]) for r in fit) for j in range(d)] for i in range(d)]
    v = np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    y = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, total)] for r in x])
    return n, [sum((n * c - t) ** 2 for c, t in zip(r, total)) for r in x], y @ vecs / np.sqrt(np.abs(values) + 1e-300), values / values.sum()


def check_whitening(rows, vectors, k):
    n, deviations, white, explained = plain_whitening(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert all(sorted(g) == list(range(1, k + 1)) for g in got.values())
    flat = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in range(len(vectors))])
    signs = np.sign((flat * white[:, :k]).sum(0))
    assert np.abs(flat - white[:, :k] * signs).max() < 1e-6
    for i, dev in enumerate(deviations):
        for c in range(1, k + 1):
            r = got[i][c]
            assert r.n == n and int(r.deviation) == dev and r.identity_error <= 1e-8
            assert abs(r.explained - explained[c - 1]) <= 1e-9 * explained[c - 1]


def test_whitening_of_the_table(spark):
    rows = entry.queries()["op12_whitening"](spark, SF).collect()
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitening(rows, vectors, 16)


def test_whitening_corner_cases(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.normal(0, s, 5)] for s in (0.1, 1, 30, 1000) for _ in range(8)]
    good += good[:6]  # repeated vectors count once in the fit
    rows = [(i, v, 0, 1, "a", "b") for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 2.0, 3.0, 4.0], [float("inf")] + [0.0] * 4, [1.0, 2.0], [3e30] * 5]
    frame = spark.createDataFrame(rows + [(1000 + i, v, 0, 1, "a", "b") for i, v in enumerate(bad)], VECTORS)
    out = whitening.whiten(frame).collect()
    assert {r.vec_id for r in out} == set(range(len(good)))
    check_whitening(out, good, 5)
    # repeated rows and rows without a key keep their rows
    twice = frame.unionByName(spark.createDataFrame([(None, good[0], 0, 1, "a", "b"), rows[1]], VECTORS))
    counts = Counter(r.vec_id for r in whitening.whiten(twice, components=2).collect())
    assert counts[None] == 2 and counts[1] == 4 and counts[0] == 2
    assert whitening.whiten(frame.where("vec_id < 0")).collect() == []
    assert whitening.whiten(frame.where("vec_id = 3")).collect() == []  # one vector has no spread


def test_whitening_of_lower_rank(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(b), 1.0, float(a)], 0, 1, "", "") for i, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.component for r in out} == {1, 2}
    assert abs(sum(r.explained for r in out if r.vec_id == 0) - 1) < 1e-12
    assert out[0].identity_error < 1e-10


def test_wide_numbers_are_exact():
    z = np.array([[1 << 40, -3], [5, (1 << 40) - 1]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(2)] for i in range(2)]
    assert whitening.gram(z).tolist() == want
    assert int(whitening._wide(3**60) / whitening._wide(3**58)) == 9
    w = whitening.Whitener(10, [1 << 45, -7], np.zeros(2, np.int64), np.zeros(2), np.eye(2), np.ones(2))
    assert w.deviations(z) == [(10 * (1 << 40) - (1 << 45)) ** 2 + (10 * -3 + 7) ** 2, (50 - (1 << 45)) ** 2 + (10 * ((1 << 40) - 1) + 7) ** 2]


@pytest.mark.parametrize("gap", [0.0, 1e-12, 1e-9, 1e-5, 1.0])
def test_refined_eigenvectors(gap):
    """Clusters of eigenvalues: pairs with small gaps, one triple value, one far below."""
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal in extended precision
        q = q @ (1.5 * np.eye(12, dtype=np.longdouble) - 0.5 * (q.T @ q))
    values = np.array([5, 5 - gap, 3, 3, 3, 2, 2 - gap, 1, 0.5, 1e-4, 1e-4 - gap * 1e-5, 1e-6], np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.abs(x.T @ x - np.eye(12)).max() < 1e-16
    assert np.abs(np.asarray(found - np.sort(values)[::-1], float)).max() < 1e-16
    assert np.abs(a @ x - x * found).max() < 1e-16
    alone = [k for k in range(12) if np.abs(np.delete(values, k) - values[k]).min() > 1e-10]
    for k in alone:
        at = int(np.abs(found - values[k]).argmin())
        assert 1 - abs(float(x[:, at] @ q[:, k])) < 1e-12


# --- packing


def check_pieces(pieces, lengths, size):
    """pieces: (document, start, length, sequence, offset)."""
    by_doc, by_sequence = {}, {}
    for d, start, n, s, at in pieces:
        assert n > 0
        by_doc.setdefault(d, []).append((start, n))
        by_sequence.setdefault(s, []).append((at, n))
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {d: n for d, n in lengths.items() if n}
    for parts in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    filled = [sum(n for _, n in p) for p in by_sequence.values()]
    assert all(n <= size and n & (n - 1) == 0 for n in filled)
    return filled


def test_pack_by_cost():
    rng = np.random.default_rng(1)
    for lengths in ([], [1], [2048], [4096, 1], [1] * 500, [2047] * 64, [5000] * 7, (rng.pareto(1.2, 3000) * 200 + 1).astype(int).tolist()):
        pieces = packing.pack(lengths, 2048)
        filled = check_pieces(pieces, dict(enumerate(lengths)), 2048)
        assert sum(n < 2048 for n in filled) <= 11  # only what the full sequences leave
    cost = Counter()
    for _, start, n, s, _ in pieces:
        cost[s] += packing.cost_of(n)
    shared = {s for _, _, n, s, _ in pieces if n < 2048}
    full = [c for s, c in cost.items() if s in shared and sum(p[2] for p in pieces if p[3] == s) == 2048]
    assert np.std(full) / np.mean(full) < 0.1


def test_pack_takes_the_cheapest_sequence():
    """Against a plain loop over all sequences, as long as nothing has to be cut."""
    lengths = [1500, 1400, 400, 300, 248, 248]
    room, cost, want = packing.capacities(sum(lengths), 2048), [0, 0], []
    assert room == [2048, 2048]
    for i, n in enumerate(lengths):
        s = min((cost[s], s) for s in range(2) if room[s] >= n)[1]
        want.append((i, s))
        room[s] -= n
        cost[s] += packing.cost_of(n)
    assert [(d, s) for d, _, _, s, _ in packing.pack(lengths, 2048)] == want


def test_packed_documents(spark, corner, corner_rows, nothing):
    tokenizer = Tokenizer.from_file(A_PATH)
    out = packing.pack_documents(corner, A_PATH, 1, size=64, group_documents=5).collect()
    ids = {}
    for r in out:
        assert crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        ids.setdefault(r.doc_id, []).append(r)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    want = Counter()
    for d, text, *_ in corner_rows:
        coded = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[(d, len(coded), int(coded.astype(np.int64).sum()))] += 1
    # documents that share a key are told apart by their number of ids
    got = Counter()
    for d, parts in ids.items():
        for n in {p.doc_tokens for p in parts}:
            own = [p for p in parts if p.doc_tokens == n]
            copies = sum(p.length for p in own) // n
            total = sum(int(np.frombuffer(p.ids, "<u4").astype(np.int64).sum()) for p in own)
            got[(d, n, total // copies)] += copies
    assert got == want
    assert packing.pack_documents(nothing, A_PATH, 1).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(nothing, A_PATH, 1, size=100)


# --- alignment


class Plain:
    """Tokens of whole texts by the libraries, groups and links by a merge of byte offsets."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.token = {i: t for t, i in self.a.get_vocab().items()}
        self.letters = alignment.byte_of_character()

    def __call__(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in self.token[i]) for i in a]
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        owner_a = [i for i, t in enumerate(bytes_a) for _ in t]
        owner_b = [j for j, t in enumerate(bytes_b) for _ in t]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(owner_a, owner_b))]
        ends = [k for k in range(len(whole)) if k + 1 == len(whole) or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1])]
        groups, start = [], 0
        for end in ends:
            own_a, own_b = dict.fromkeys(owner_a[start : end + 1]), dict.fromkeys(owner_b[start : end + 1])
            groups.append(",".join(str(a[i]) for i in own_a) + "|" + ",".join(str(b[j]) for j in own_b))
            start = end + 1
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def plain_alignment(texts):
    plain = Plain()
    found = [plain(t) for t in texts]
    counts = Counter(x for f in found if f for x in f[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    rows = [
        (f[0], f[1], f[2], len(f[3]), sum(counts[x] == top[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, "")
        for f in found
    ]
    docs = Counter(x for f in found if f for x in set(f[3]))
    return rows, {x: (docs[x], n, n == top[x[1]]) for x, n in counts.items()}


ODD = [
    " leading", "trailing ", "two  spaces", "\n", "line\nends\n\nhere", "a\n b", "▁ is no space", "<0x0A> <s> </s> <unk>", "tab\tand\r\nreturn",
    "　wide space", "é combining", "\x1c \x85 odd", "ends\n", "'s don't 're", "x " * 50, "﻿mark", "中文\n中文 中文",
]


def test_alignment_of_corner_cases(spark, corner, corner_rows, nothing, monkeypatch):
    more = [(1000 + i, t, "en", "s", len(t), "x", 1, "y") for i, t in enumerate(ODD)]
    frame = corner.unionByName(spark.createDataFrame(more, corner.schema))
    texts = [r[1] for r in corner_rows + more]
    rows, pairs = plain_alignment(texts)
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for block_bytes in (1 << 24, 2000):
        found, counted = alignment.align(frame, A_PATH, B_PATH, block_bytes=block_bytes)
        got = Counter((r.doc_id, *[r[c] for c in cols]) for r in found.collect())
        assert got == Counter((r[0], *w) for r, w in zip(corner_rows + more, rows))
        assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in counted.collect()} == pairs
    found, counted = alignment.align(nothing, A_PATH, B_PATH)
    assert found.collect() == [] and counted.collect() == []


ALPHABET = [
    "a", "b", "é", "中", "😀", " ", "  ", "\n", "\t", "\x00", "\u2028", "\xa0", "　", "'s", "'ll", ".", ",", "#", "$$", "%", "1", "23", "<s>", "</s>",
    "<unk>", "<|endoftext|>", "<0x0A>", "\r", "\x85", "\x1c", "\u0308", "ǅ", "ß", "İ", "🇩🇪", "\xad", "\u200b", "words", " the",
]


def test_alignment_of_random_texts():
    rng, plain, units = random.Random(5), Plain(), alignment.Units(A_PATH, B_PATH)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(1, 40))) for _ in range(1500)]
    block = alignment.Block()
    block.add(units, list(range(len(texts))), texts)
    want = [((w[0], w[1], w[2], len(w[3])), w[4]) if w else ((0, 0, 0, 0), "") for w in map(plain, texts)]
    assert list(zip(block.numbers, block.digests)) == want


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows, _ = plain_alignment([r.text for r in docs])
    got = {r.doc_id: r for r in entry.queries()["op13_tokenizer_alignment"](spark, SF).collect()}
    for r, w in zip(docs, rows):
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups_sha256) == w


def test_a_long_text_in_parts(monkeypatch, corner_rows):
    """Texts beyond the units turned into links at once, and a memory that starts anew, give the same."""
    texts = [r[1] for r in corner_rows] + ["a bad ▁ unit " * 40, "good words again and again " * 60]

    def run():
        units, block = alignment.Units(A_PATH, B_PATH), alignment.Block()
        block.add(units, list(range(len(texts))), texts)
        pairs, n_docs, n_links, _ = block.postings()
        return dict(zip(block.ids, zip(block.numbers, block.digests))), pairs.tolist(), n_docs.tolist(), n_links.tolist()

    whole = run()
    monkeypatch.setattr(alignment, "UNITS_AT_ONCE", 40)
    monkeypatch.setattr(alignment, "KEPT_UNITS", 50)
    assert run() == whole


def test_planes():
    rng = np.random.default_rng(2)
    held = {(int(p), int(d)): int(n) for p, d, n in zip(rng.integers(0, 30, 900) ** 2, rng.integers(0, 61, 900), rng.integers(1, 40, 900))}
    held |= {(5000, d): 3 for d in range(61)}
    keys = sorted(held)
    pairs, n_docs, n_links, data = alignment.pack_postings(
        np.array([p for p, _ in keys]), np.array([d for _, d in keys], np.uint16), np.array([held[k] for k in keys]), 61
    )
    docs, links = Counter(p for p, _ in keys), Counter()
    for (p, _), n in held.items():
        links[p] += n
    assert dict(zip(pairs.tolist(), n_docs.tolist())) == docs and dict(zip(pairs.tolist(), n_links.tolist())) == links
    score = rng.integers(1, 1 << 40, len(pairs))
    best = rng.random(len(pairs)) < 0.5
    order = rng.permutation(len(pairs))
    n_best, total = alignment.returned_scores(data, pairs[order], score[order], best[order])
    at = {p: i for i, p in enumerate(pairs.tolist())}
    for d in range(61):
        mine = [(at[p], n) for (p, e), n in held.items() if e == d]
        assert n_best[d] == sum(n for i, n in mine if best[i]) and total[d] == sum(n * int(score[i]) for i, n in mine)
