"""Operators 7, 8 and 10: brute-force statistics and overlaps, and accuracy on documents that were held out."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from resurvey.llm import decontam, quality, toxicity, wordhash
from tests.llm.test_dedup import words_of

SF = "/root/testdata/sf0.01"


def brute_stats(text):
    text = text or ""
    w = words_of(text, lower=False)
    lines = [x for x in text.split("\n") if words_of(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) for k in range(5) if seen[tuple(w[i : i + 5])] > 1}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(spark, corner, corner_rows, nothing):
    labels = spark.createDataFrame([(i, i % 4 and 1) for i in range(20)] + [(None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    got = quality.quality_rules(corner, labels).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.BASE)) for r in got) == Counter((r[0], *brute_stats(r[1])) for r in corner_rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    none = labels.where("quality > 5")
    assert all(r.kept != r.base_failed for r in quality.quality_rules(corner, none).collect())
    assert quality.quality_rules(nothing, labels).collect() == []


def test_repeated_windows_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        text = " ".join(rng.choice(list("ab"), int(rng.integers(0, 40))))
        assert quality.rule_stats(text.encode())[:5] == brute_stats(text)


def test_forest_isolates_what_no_good_row_shows():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (2000, 5))
    good[:, 4] = 0
    bad = rng.normal(0, 1, (50, 5))
    bad[:, 4] = rng.uniform(3, 6, 50)
    both = np.vstack((good, bad))
    forest = quality.grow_forest(good, both.min(0), both.max(0))
    limit = np.quantile(quality.anomaly(forest, good), 0.99)
    assert (quality.anomaly(forest, bad) > limit).mean() > 0.9


def test_anomaly_is_the_mean_path_length():
    """Against a walk down each tree, row by row, and on a table whose verdict is computed plainly."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 4))
    forest = quality.grow_forest(x[:200], x.min(0), x.max(0), trees=20, rows=64)
    want = []
    for row in x:
        total = 0.0
        for feature, value, left, length in forest:
            at, depth = 0, 0
            while feature[at] >= 0:
                at, depth = int(left[at]) + int(row[feature[at]] >= value[at]), depth + 1
            assert length[at] >= depth
            total += length[at]
        want.append(2.0 ** (-total / len(forest) / quality.mean_path(64)))
    assert np.abs(quality.anomaly(forest, x, 64) - want).max() < 1e-12


def test_threshold_keeps_the_good_rows():
    good, bad = np.zeros(100, int), np.zeros(100, int)
    good[30:60] = 10
    bad[55:90] = 4
    limit = quality.best_threshold(good, bad, 0.9)
    kept = good[: round(limit * 100)].sum() / good.sum()
    others = [b for b in range(1, 101) if good[:b].sum() >= 0.9 * good.sum()]
    worth = {b: good[:b].sum() / good.sum() + bad[b:].sum() / bad.sum() for b in others}
    assert kept >= 0.9 and worth[round(limit * 100)] == max(worth.values())
    assert quality.best_threshold(good, np.zeros(100, int), 0.9) == 1.0


def test_quality_verdict_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_rules(docs, labels).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.99
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) >= 0.9


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic == 1) / sum(r.toxic == 1 for r in rows)
    wrong = sum(r.predicted for r in rows if r.toxic == 0) / sum(r.toxic == 0 for r in rows)
    assert caught >= 0.85 and wrong <= 0.01


def test_machine_learns_pairs():
    """Toxic only where both terms meet, which no sum of weights can tell."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (3000, 6)).astype(np.uint8)
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    model = toxicity.fit(x, y, np.zeros(0, np.int64))
    got = np.array([model.score(np.flatnonzero(row)) > 0.5 for row in x])
    assert (got == (y == 1)).mean() > 0.95


def test_toxicity_of_pairs_whose_terms_say_nothing_alone(spark):
    """Toxic where just one of two words stands: neither has a chi square, so no term is picked for it."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(4000):
        a, b = i % 2, i // 2 % 2  # each of the four cases equally often
        words = [f"{'qwertyuiop'[k // 10]}{'asdfghjklz'[k % 10]}" for k in rng.choice(100, 15, replace=False)]
        docs.append((i, " ".join([*words, *["dog"] * a, *["cat"] * b])))
        labels.append((i, a ^ b))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    t = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, t).where("held_out").join(t, "doc_id").collect()
    assert len(got) > 500 and np.mean([r.predicted == r.toxic for r in got]) > 0.95


def test_scores_are_the_sums_over_all_pairs():
    """Scores of batches against a loop over the pairs of a text's terms, and a worker's memory that starts anew."""
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "do", "Ki") for b in ("nan", "rat", "m") for c in ("a", "elum!", "")]
    texts = [None, "", " \n", *[" ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))) for _ in range(60)]]
    rows = [np.array(sorted({x for w in toxicity.distinct_words(t) for x in toxicity.terms_of_word(w)}), np.int64) for t in texts]
    n_words = np.array([len(toxicity.distinct_words(t)) for t in texts])
    y = np.array([float("banana" in (t or "")) for t in texts])
    m = toxicity.fit_machines([r.astype(np.uint32) for r in rows], n_words, y)
    assert len(m.first.terms) > 1 and len(m.used) > 10
    first, used = {t: i for i, t in enumerate(m.first.terms.tolist())}, {t: i for i, t in enumerate(m.used.tolist())}
    want = []
    for r, n in zip(rows, n_words):
        one = [first[t] for t in r.tolist() if t in first] + [len(first) + min(int(n).bit_length(), toxicity.SIZES - 1)]
        two = sorted({used[t % toxicity.SLOTS] for t in r.tolist() if t % toxicity.SLOTS in used})
        z = m.first.bias + sum(m.first.weights[i] for i in one) + sum(m.rest.weights[i] for i in two)
        z += sum(m.first.vectors[i] @ m.first.vectors[j] for i, j in itertools.combinations(one, 2))
        share = min(1, toxicity.REST_TERMS / max(1, len(two)))
        z += share * sum(m.rest.vectors[i] @ m.rest.vectors[j] for i, j in itertools.combinations(two, 2))
        want.append(z)
    scorer = toxicity.Scorer(m)
    assert np.abs(scorer.logits(texts) - want).max() < 1e-4
    again = [scorer.logits([t])[0] for t in texts for _ in (scorer.clear(),)]
    assert np.abs(np.array(again) - want).max() < 1e-4


def test_rest_takes_gradient_steps(monkeypatch):
    """One step over one batch against the dense gradient of the log loss."""
    for name, value in (("REST_EPOCHS", 1), ("REST_PULL", 0.0), ("REST_DECAY", 0.0), ("REST_BOUND", 1e9)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(8)
    x = (rng.random((40, 12)) < 0.4).astype(float)
    x[:, 0] = 1
    y, offset = (rng.random(40) < 0.5).astype(float), rng.normal(0, 1, 40)
    got = toxicity.fit_rest([np.flatnonzero(r).astype(np.int32) for r in x], y, offset, 12)
    v = np.random.Generator(np.random.PCG64(toxicity.SEED)).normal(0, toxicity.REST_START, (12, toxicity.REST_RANK)).astype(np.float32).astype(float)
    sums = x @ v
    z = offset + 0.5 * ((sums**2).sum(1) - x @ (v**2).sum(1))
    e = 1 / (1 + np.exp(-z)) - y
    weights = x.T @ e
    vectors = x.T @ (e[:, None] * sums) - v * (x.T @ e)[:, None]
    seen = x.any(0)
    assert np.abs(got.vectors - (v - toxicity.REST_PACE / 40 * vectors))[seen].max() < 1e-5
    assert np.abs(got.weights + toxicity.REST_RATE * np.sign(weights))[seen & (np.abs(weights) > 0.1)].max() < 1e-3


def test_toxicity_sample_is_bounded(spark):
    """A key with many rows among the sampled ones counts once."""
    docs = [(7, f"word{i} bad" if i % 2 else f"word{i} good") for i in range(500)] + [(i, "some good text") for i in range(100, 400)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), *[(i, i % 2) for i in range(100, 400)]], "doc_id long, toxic int")
    for rows in (20, 1000):
        sample = toxicity.training_sample(d, labels, "doc_id", "text", "toxic", rows).collect()
        assert len(sample) == min(rows, len({r.id for r in sample})) == min(rows, sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [7, *range(100, 400)]))
    assert toxicity.toxicity(d, labels, sample_rows=20).count() == len(docs)


def test_toxicity_corner_cases(spark, corner, corner_rows, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(None, 1), (2, None), (2, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(corner, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corner_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    one_kind = labels.where("toxic = 1")
    assert len({r.score for r in toxicity.toxicity(corner, one_kind).collect()}) == 1
    assert len({r.score for r in toxicity.toxicity(corner, labels.where("toxic > 5")).collect()}) == 1
    assert toxicity.toxicity(nothing, labels).collect() == []
    kept = toxicity.without_toxic(corner, labels)
    assert kept.columns == corner.columns


def test_masks_meet_every_window():
    n, on = decontam.WINDOW, [decontam._places(m) for m in decontam.MASKS]
    for bad in itertools.combinations(range(n), n - decontam.EQUAL):
        assert any(not {p + i for i in places} & set(bad) for places in on for p in range(n - places[-1]))


def brute_overlaps(docs, items):
    found = set()
    for d, dt in docs:
        dw = decontam.words_of((dt or "").encode()).tolist()
        for i, it in items:
            iw = decontam.words_of((it or "").encode()).tolist()
            n = len(iw)
            if d is None or i is None or n < decontam.LEAST_WORDS:
                continue
            width = min(n, decontam.WINDOW)
            need = n if n < decontam.WINDOW else decontam.EQUAL
            for at in range(-n + 1, len(dw)):
                same = [0 <= at + k < len(dw) and dw[at + k] == iw[k] for k in range(n)]
                if any(sum(same[k : k + width]) >= need for k in range(n - width + 1)):
                    found.add((d, i))
                    break
    return found


@pytest.mark.parametrize(("bits", "hits"), [(16, 2), (27, 4096)])
def test_overlaps(spark, corner_rows, bits, hits, monkeypatch):
    """With a filter that lets much through, and a document's hits compared a few at a time."""
    make = decontam.bloom_filter
    monkeypatch.setattr(decontam, "bloom_filter", lambda seeds: make(seeds, bits))
    monkeypatch.setattr(decontam, "HITS_AT_ONCE", hits)
    rng = np.random.default_rng(6)
    word = lambda: "wort" + str(rng.integers(1000))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 45, 13, 12, 7, 5, 4, 1])]
    items += [(8, None), (9, ""), (None, items[0][1]), (11, items[1][1]), (1, items[1][1])]
    docs = [(r[0], r[1]) for r in corner_rows]
    for k in range(120):
        i, text = items[k % 6]
        w = text.split(" ")
        for at in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 4)), replace=False):
            w[int(at)] = word()
        w = w[int(rng.integers(0, 1 + len(w) // 2)) :] if k % 3 == 0 else w
        text = " ".join([word() for _ in range(int(rng.integers(0, 30)))] + w + [word() for _ in range(int(rng.integers(0, 30)))])
        docs.append((1000 + k, text.upper().replace(" ", ", ") if k % 5 == 0 else text))
    docs += [docs[-1], (1000, "short"), (None, items[0][1])]
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, item long, seed string")
    t = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, place int")
    got = decontam.overlaps(d, t).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_overlaps(docs, items) and len(got) == len({r[:2] for r in got})
    assert all(0 < r.n_equal <= r.n_item for r in got)
    leaks = {r.doc_id for r in got}
    assert Counter(map(tuple, decontam.without_leaks(d, t).collect())) == Counter((*x, 1, "s") for x in docs if x[0] not in leaks)


def test_filter_holds_every_seed(spark):
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    frame = spark.createDataFrame([(int(s),) for s in seeds.view(np.int64)], "seed long").repartition(3)
    filter_ = decontam.bloom_filter(frame)
    assert len(decontam.passes(filter_, seeds)) == len(seeds)
    others = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)
    assert len(decontam.passes(filter_, others)) < 100


def test_many_hits_move_a_text_once(spark):
    """A long text that holds an item many times: what is compared has the size of the items, not of the text."""
    item = " ".join(f"w{i}" for i in range(20))
    text = " ".join([item, "x y z"] * 2000)
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = decontam.overlaps(docs, items).collect()
    assert [tuple(r) for r in rows] == [(1, 5, 20, 20, 0)]


def test_overlaps_of_nothing(spark, corner, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(corner, items).collect() == []
    full = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontam.overlaps(nothing, full).collect() == []


def test_marks_end_words():
    assert len(wordhash.word_hashes(b"a-b c.d!e", breaks=wordhash.MARKS)) == 5
