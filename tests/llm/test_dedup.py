"""Operators 4 and 5 against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from resurvey.llm import line_dedup, near_dedup, wordhash
from resurvey.llm.components import connected_components

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text, lower=True):
    text = (text or "").translate(LOWER) if lower else (text or "")
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles_of(text):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(rows):
    sets = {}
    for key, text in rows:
        if key is not None:
            sets.setdefault((key, shingles_of(text)), None)
    nodes = [n for n in sets if n[1]]
    parent = {s: s for _, s in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: float("inf"))
    for k, s in nodes:
        least[find(s)] = min(least[find(s)], k)
    out = []
    for key, text in rows:
        s = shingles_of(text)
        root = key if key is None or not s else least[find(s)]
        out.append((key, len(s), root, key is None or key == root))
    return Counter(out)


def test_corner_rows(corner, corner_rows, nothing):
    got = Counter(map(tuple, near_dedup.near_duplicates(corner).collect()))
    assert got == brute_components([(r[0], r[1]) for r in corner_rows])
    assert near_dedup.near_duplicates(nothing).collect() == []
    assert near_dedup.without_copies(nothing).collect() == []


def test_families_of_near_copies(spark):
    """Chains of slowly changing copies, a large family, and texts at the border of the threshold."""
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(10**6))
    texts = []
    base = [word() for _ in range(120)]
    for _ in range(60):  # a chain: each differs from the last by one word
        base = list(base)
        base[int(rng.integers(len(base)))] = word()
        texts.append(" ".join(base))
    root = [word() for _ in range(200)]
    for _ in range(150):  # a family: each differs from the root by up to three words
        copy = list(root)
        for at in rng.integers(0, len(copy), int(rng.integers(0, 4))):
            copy[int(at)] = word()
        texts.append(" ".join(copy))
    for n in range(80, 130):  # beginnings of one text: similarity by length
        texts.append(" ".join(root[:n]) + " " + " ".join(word() for _ in range(3)))
    order = rng.permutation(len(texts))
    rows = [(int(k), texts[i]) for k, i in zip(order, range(len(texts)), strict=True)]
    got = Counter(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_components(rows)


def test_without_copies(corner, corner_rows):
    kept = near_dedup.without_copies(corner)
    assert kept.columns == corner.columns
    want = {(r[0], r[1]) for r in corner_rows}
    state = {k[0]: k[3] for k in brute_components([(r[0], r[1]) for r in corner_rows]) if k[0] != 12}
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert set(got) == {(k, t) for k, t in want if k is None or state.get(k, True)}
    assert max(got.values()) == 1


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for share in (0.02, 0.05, 0.1):
        for _ in range(40):
            a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            b = a.copy()
            b[: int(share * 1000)] = rng.integers(0, 2**63, int(share * 1000), dtype=np.uint64)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            differ = int(np.bitwise_count(near_dedup.odd_sketch(near_dedup.min_samples(a)) ^ near_dedup.odd_sketch(near_dedup.min_samples(b))).sum())
            bits = near_dedup.SKETCH_WORDS * 64
            errors.append(1 + np.log(1 - 2 * differ / bits) * bits / (4 * near_dedup.BANDS * near_dedup.ROWS) - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


@pytest.mark.parametrize("limit", [16, 1 << 22])
def test_word_hashes(limit, monkeypatch):
    monkeypatch.setattr(wordhash.pieces, "__defaults__", (limit, wordhash.SPACE))
    text = "Été  a b\tA\x0bb " + "long" * 30_000 + " a\x85b a"
    h = wordhash.word_hashes(text.encode(), lower=True)
    w = words_of(text)
    assert len(h) == len(w)
    assert len(set(h.tolist())) == len(set(w)) and (h == h[w.index("a")]).sum() == w.count("a")


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(200)] + [(1000, int(x)) for x in range(1001, 1400)] + [(5, 5)]
    edges += [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in list(parent)} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def brute_lines(rows, min_sites):
    sites, same = defaultdict(set), defaultdict(set)
    for r in rows:
        same[tuple(x.strip(" ") for x in (r[1] or "").split("\n") if x.strip(" "))].add(r[:2])
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if line.strip(" ") and r[3] is not None:
                sites[line.strip(" ")].add(r[3])
    out = Counter()
    for r in rows:
        if r[1] is None:
            out[r[0], None, 0, 0, 0] += 1
            continue
        lines = r[1].split("\n")
        flags = [bool(line.strip(" ")) and len(sites[line.strip(" ")]) >= min_sites for line in lines]
        n = sum(flags)
        own = tuple(x.strip(" ") for x in lines if x.strip(" "))
        copy = n == len(own) and len(same[own]) > 1
        text = r[1] if copy or not n else "\n".join(line for line, f in zip(lines, flags, strict=True) if not f)
        out[r[0], text, len(lines), n, 0 if copy else n] += 1
    return out


@pytest.mark.parametrize("min_sites", [2, 3, 12])
def test_boilerplate_lines(spark, corner_rows, min_sites):
    kind = "doc_id long, text string, lang string, source string, h long, at string, doc string, n_lines string"
    rows = [(*r[:4], 1, "a", "d", "old") for r in corner_rows]
    for i in range(100, 160):
        shared = [f"shared line {k}" for k in range(15) if (i * (k + 3)) % 7 < 3]
        own = [f"own line {i} {k} with some more words" for k in range(i % 6)]
        rows.append((i, "\n".join([*shared[:1], *own, "", *shared[1:], " menu "]), "en", f"site{i % (3 + i % 11)}" if i % 9 else None, 1, "a", "d", "old"))
    docs = spark.createDataFrame(rows, kind).repartition(4)
    done = line_dedup.remove_boilerplate(docs, min_sites=min_sites)
    assert done.columns == ["doc_id", "text", "lang", "source", "h", "at", "doc", "n_lines", "n_boilerplate", "n_removed"]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_boilerplate, r.n_removed) for r in done.collect())
    assert got == brute_lines(rows, min_sites)
    assert any(k[4] for k in got)


def test_boilerplate_above_half_goes_from_all_but_copies(spark):
    menu, foot = "the same long menu on every page " * 3, "the same long foot on every page " * 3
    rows = [(i, f"{menu}\nown line {i}\n\n{foot}", f"site{i}") for i in range(6)]
    rows += [(i, f"{menu}\n{foot}" if i % 2 else f" {menu}\n\n{foot}", f"site{i % 3}") for i in range(10, 14)]  # copies
    rows += [(i, f"{menu}\nowned by two\n{foot}", f"site{i % 3}") for i in (15, 16)]  # copies with a line of their own
    rows += [(20, f"{foot}\n{menu}", "site0"), (20, f"{foot}\n{menu}", "site0")]  # a repeated row is no other document
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter(map(tuple, line_dedup.remove_boilerplate(docs).select("doc_id", "text", "n_removed").collect()))
    want = Counter((i, f"own line {i}\n", 2) for i in range(6))
    want += Counter((i, text, 0) for i, text, _ in rows if 10 <= i < 14)
    assert got == want + Counter({(15, "owned by two", 2): 1, (16, "owned by two", 2): 1, (20, "", 2): 2})


def test_pipeline_removes_boilerplate_above_half(spark):
    menu = "the same long menu on every page " * 3
    docs = spark.createDataFrame(
        [(i, f"{menu}\nown line {i}", "en", f"site{i}", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {i: (f"own line {i}", 10) for i in range(6)}


def test_boilerplate_of_nothing(nothing):
    assert line_dedup.remove_boilerplate(nothing).collect() == []
