"""Operator 7: rule statistics of documents and an isolation forest over them.

The statistics of every document are computed from its bytes.  Trees of random splits isolate
unusual rows of statistics after few steps; the mean path length over the trees is the score.  A
tree takes ``TREE_ROWS`` good documents of a bounded sample of labelled ones (``SAMPLE_ROWS``) and
splits the cells of the space that all rows of the sample span, not only where good rows vary, so
that a kind of junk that no good document shows is isolated at once.  The threshold is set on all
labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm import wordhash
from resurvey.llm.base import hash_sample, lean, only, written

SYMBOLS = b"#*$%&|<>"
WIDTH = 5
# Rows of the sample the forest is grown on, trees, rows of a tree, its greatest depth.
SAMPLE_ROWS, TREES, TREE_ROWS, DEPTH = 8192, 100, 256, 10
# Scores are counted in this many steps when the threshold is set.
STEPS = 2000
# Share of the labelled good documents that the threshold must keep.
KEEP_GOOD = 0.995
SEED = 11

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_distinct", "n_punct")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?")] = True
_BLANK = " \t\n\x0b\x0c\r"


def rule_stats(data: bytes | None) -> tuple[int, ...]:
    """The statistics ``BASE + MORE`` of a text in UTF-8; zeros for NULL."""
    if not data:
        return (0,) * (len(BASE) + len(MORE))
    chars = symbols = upper = digits = punct = 0
    for piece in wordhash.pieces(data):
        counts = np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        starts = counts.copy()
        starts[0x80:0xC0] = 0  # bytes that continue a code point
        chars += int(starts[~wordhash.SPACE].sum())
        symbols += int(counts[_SYMBOL].sum())
        upper += int(counts[_UPPER].sum())
        digits += int(counts[_DIGIT].sum())
        punct += int(counts[_PUNCT].sum())
    words = wordhash.word_hashes(data)
    lines = [line for line in data.decode().split("\n") if line.strip(_BLANK)]
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words),
        len(lines), upper, digits, len(np.unique(words)), punct,
    )


def repeated_words(words: np.ndarray, width: int = WIDTH) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    h = wordhash.windows(words, width)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), np.int64)
    twice[order[1:][equal]] = 1
    twice[order[:-1][equal]] = 1
    steps = np.zeros(len(words) + 1, np.int64)
    steps[: len(h)] += twice
    steps[width : width + len(h)] -= twice
    return int((np.cumsum(steps) > 0).sum())


def stats_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the statistics ``BASE + MORE``, as long."""
    names = BASE + MORE
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([rule_stats(t) for t in wordhash.each(batch.column(1))], np.int64).reshape(-1, len(names))
            yield pa.record_batch([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(names))]], ["id", *names])

    rows = only(docs, key, text).select(F.col(key).alias("id"), F.encode(text, "UTF-8").alias("text"))
    stats = rows.mapInArrow(lean(run), f"id {kind}, " + ", ".join(f"{n} long" for n in names))
    return stats.withColumnRenamed("id", key)


def as_features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Sizes and shares of a document on a logarithmic scale, one row each."""
    words = np.maximum(x["n_words"], 1)
    chars = np.maximum(x["word_chars"], 1)
    lines = np.maximum(x["n_lines"], 1)
    shares = [
        x["n_words"] / 100, x["word_chars"] / words, x["n_symbols"] / words, x["n_dup_lines"] / lines,
        x["n_repeat_words"] / words, x["n_upper"] / chars, x["n_digits"] / chars, x["n_punct"] / words,
        x["n_distinct"] / words,
    ]
    return np.log(0.01 + np.column_stack(shares))


def grow_forest(
    x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = SEED
) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays: feature (-1: leaf), split value, left child (right is the next), path length of a leaf.

    ``x`` are the rows to grow on, ``low`` and ``high`` the corners of the space to be split.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    forest = []
    for _ in range(trees):
        feature, value, left, length = [-1], [0.0], [0], [0.0]
        part = x[rng.choice(len(x), min(rows, len(x)), replace=False)]
        todo = [(0, part, 0, low, high)]
        while todo:
            node, part, level, lo, hi = todo.pop()
            if level == depth or len(part) < 2:
                length[node] = level + mean_path(len(part))
                continue
            f = int(rng.integers(len(lo)))
            v = rng.uniform(lo[f], hi[f])
            below = part[:, f] < v
            first = len(feature)
            feature[node], value[node], left[node] = f, v, first
            upto, onward = hi.copy(), lo.copy()
            upto[f] = onward[f] = v
            todo += [(first, part[below], level + 1, lo, upto), (first + 1, part[~below], level + 1, onward, hi)]
            feature += [-1, -1]
            value += [0.0, 0.0]
            left += [0, 0]
            length += [0.0, 0.0]
        forest.append((np.array(feature), np.array(value), np.array(left), np.array(length)))
    return forest


def mean_path(n: int) -> float:
    """Mean steps of an unsuccessful search in a binary tree of ``n`` rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def anomaly(forest: list[tuple[np.ndarray, ...]], x: np.ndarray, rows: int = TREE_ROWS) -> np.ndarray:
    """Scores from 0 to 1; higher is more unusual."""
    total = np.zeros(len(x))
    for feature, value, left, length in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                break
            here = at[go]
            at[go] = left[here] + (x[go, f[go]] >= value[here])
        total += length[at]
    return 2.0 ** (-total / max(len(forest), 1) / max(mean_path(rows), 1e-9))


def scored(stats: DataFrame, forest: list, key: str = "doc_id") -> DataFrame:
    """``key``, the base statistics, and ``anomaly``."""
    kind = stats.schema[key].dataType.simpleString()
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(n).to_numpy() for n in BASE + MORE}
            score = anomaly(shared.value, as_features(x)) if shared.value else np.zeros(len(batch))
            yield pa.record_batch([batch.column(key), *[batch.column(n) for n in BASE], pa.array(score)], [key, *BASE, "anomaly"])

    return stats.mapInArrow(lean(run), f"{key} {kind}, " + ", ".join(f"{n} long" for n in BASE) + ", anomaly double")


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def best_threshold(good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """Of counts by score step: the border above which most bad rows lie, with ``keep_good`` of the good ones below."""
    kept = np.cumsum(good) / max(good.sum(), 1)
    caught = 1 - np.cumsum(bad) / max(bad.sum(), 1)
    worth = np.where(kept >= keep_good, caught + kept, -1.0)
    return (int(np.argmax(worth)) + 1) / len(good) if bad.sum() and worth.max() > 0 else 1.0


def quality_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    keep_good: float = KEEP_GOOD, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``BASE``, ``anomaly``, ``base_failed``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``n_symbols`` counts ``#*$%&|<>``; a line equals an earlier
    one only to the character.  A NULL or empty text has zeros and fails the base rules.  The
    verdict is that the anomaly lies below the threshold; without labelled good rows it keeps all.
    Labels of one key count once, 0 if they differ; NULL labels and keys are left out.  Repeated
    rows are treated alike; an empty table gives no rows; other columns are not read.
    """
    stats = written(stats_of(docs, key, text), "rule-stats")
    known = only(labels, key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(key).agg(F.min(label).alias("_label"))
    passed = written(stats.where(~base_failed()).join(known, key), "rule-labelled")
    sample = hash_sample(passed, sample_rows, key, *BASE, *MORE).select(*BASE, *MORE, "_label").toPandas()
    good_rows = sample["_label"].to_numpy() == 1
    forest = []
    if good_rows.any():
        x = as_features({c: sample[c].to_numpy() for c in BASE + MORE})
        forest = grow_forest(x[good_rows], x.min(0), x.max(0))
    scores = written(scored(stats, forest, key), "rule-scores")
    step = F.least(F.floor(F.col("anomaly") * STEPS), F.lit(STEPS - 1)).cast("int")
    counts = (
        scores.where(~base_failed()).join(known, key).groupBy(step.alias("step"))
        .agg(F.sum((F.col("_label") == 1).cast("long")).alias("good"), F.sum((F.col("_label") != 1).cast("long")).alias("bad"))
        .collect()  # at most STEPS rows
    )
    good, bad = np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64)
    for r in counts:
        good[r["step"]], bad[r["step"]] = r["good"], r["bad"]
    limit = best_threshold(good, bad, keep_good)
    failed = base_failed()
    return scores.select(
        key, *BASE, "anomaly", failed.alias("base_failed"), (~failed & (F.col("anomaly") < limit)).alias("kept")
    )
