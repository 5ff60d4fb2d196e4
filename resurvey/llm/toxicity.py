"""Operator 8: a factorization machine over hashed terms scores toxicity.

A text's terms are its distinct words and beginnings of words, hashed to 32 bits.  Document counts
of every term in the training sample pick the terms that tell the labels apart; a factorization
machine over these learns a weight for each term and, through a short vector per term, one for each
pair of terms, so that two harmless terms can be harmful together.  A second machine over all
terms, hashed to ``SLOTS`` columns, learns what the first leaves unexplained: terms that say nothing
alone have their pairs there.

The sample is at most ``SAMPLE_ROWS`` labelled documents that are not held out, chosen by the hash
of their keys.  Keys alone choose them, so no text moves but the terms of the sample.  Both machines
are fitted in one task, which returns the model; the driver only passes it on.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import Grown, hash_sample, lean, only, ragged, written
from resurvey.llm.tokens import chunks

# Rows of the fitting sample; terms of the model; length of a term's vector.
SAMPLE_ROWS, TERMS, RANK = 20_000, 1024, 8
# A term must occur in so many training documents, and tell the labels apart by this much (chi square).
LEAST_DOCUMENTS, LEAST_CHI = 5, 20.0
# Beginnings of words that are terms too.
HEADS = (4, 5, 6, 7, 8)
SIZES = 20  # terms for the number of distinct words, by powers of two
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 256, 0.05, 1e-4, 5
# The second machine: columns, length of a vector, passes; step and absolute pull to zero of the
# weights, step of the vectors, relative pull of both; size of the first vectors, bound of a step.
SLOTS, REST_RANK, REST_EPOCHS = 1 << 20, 4, 30
REST_RATE, REST_PULL, REST_PACE, REST_DECAY, REST_START, REST_BOUND = 0.1, 0.3, 0.3, 0.6, 0.03, 5.0
# The pairs of a text with more terms count by this number over its terms, so that long texts do not drown in them.
REST_TERMS = 32
KEPT_WORDS = 150_000
# Text bytes handled at once.
CHUNK_BYTES = 500_000
HELD_OUT = 5

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def terms_of_word(word: str) -> tuple[int, ...]:
    """Hashes of a word (lower case, marks at its ends do not count) and of its beginnings."""
    w = _EDGES.sub("", word)
    if not w:
        return ()
    return (crc32(w.encode()), *[crc32(b"^" + w[:k].encode()) for k in HEADS if len(w) > k])


def distinct_words(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


@dataclass
class Model:
    terms: np.ndarray  # term hashes, rising; their places are the first columns, the sizes come behind them
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, columns: np.ndarray) -> float:
        return float(_share(self.bias + _pair_sums(np.zeros(len(columns), np.int64), columns, self.weights, self.vectors, 1)[0]))


@dataclass
class Rest:
    weights: np.ndarray
    vectors: np.ndarray


@dataclass
class Machines:
    """The machine over picked terms and the one over all terms; a text's logits add up."""

    first: Model
    used: np.ndarray  # hashed columns that a term of enough documents has, rising; their places are the columns of ``rest``
    rest: Rest


def size_of(n_words: int) -> int:
    """The term for a number of distinct words."""
    return min(n_words.bit_length(), SIZES - 1)


def places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted numbers stand in the rising ``known``; -1 if they don't."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


class Scorer:
    """Scores batches of texts; remembers the columns of up to ``KEPT_WORDS`` words."""

    def __init__(self, machines: Machines):
        self.machines = machines
        self.shift = len(machines.first.terms)  # columns of the second machine come after those of the first
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.counts, self.columns = Grown(), Grown(np.int32), Grown(np.int32)

    def learn(self, new: list[str]) -> None:
        found = [terms_of_word(w) for w in new]
        word = np.repeat(np.arange(len(new)), [len(t) for t in found])
        terms = np.array([x for t in found for x in t], np.uint32)
        one, two = places(self.machines.first.terms, terms), places(self.machines.used, terms % SLOTS)
        word = np.concatenate((word[one >= 0], word[two >= 0]))
        column = np.concatenate((one[one >= 0], two[two >= 0] + self.shift))
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=len(new))
        self.numbers.update(zip(new, range(self.starts.n, self.starts.n + len(new)), strict=True))
        self.starts.add(self.columns.n + np.cumsum(count) - count)
        self.counts.add(count)
        self.columns.add(column[order])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if len(self.numbers) > KEPT_WORDS:
            self.clear()
        words = [list(distinct_words(t)) for t in texts]
        found = [list(map(self.numbers.get, w)) for w in words]
        new = list(dict.fromkeys(w for ws, f in zip(words, found, strict=True) if None in f for w, x in zip(ws, f, strict=True) if x is None))
        if new:
            self.learn(new)
            found = [list(map(self.numbers.__getitem__, w)) if None in f else f for w, f in zip(words, found, strict=True)]
        flat = np.fromiter(chain.from_iterable(found), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        n = self.counts.data[flat].astype(np.int64)
        at = ragged(self.starts.data[flat], n)
        width = self.shift + len(self.machines.used) + 1
        pairs = np.unique(np.repeat(doc, n) * width + self.columns.data[at])
        doc, column = pairs // width, pairs % width
        sizes = np.array([size_of(len(w)) for w in words], np.int64)
        own = column < self.shift
        first, rest = self.machines.first, self.machines.rest
        total = first.bias + _pair_sums(
            np.concatenate((doc[own], np.arange(len(texts)))), np.concatenate((column[own], self.shift + sizes)), first.weights, first.vectors, len(texts)
        )
        slots = np.bincount(doc[~own], minlength=len(texts))
        return total + _pair_sums(doc[~own], column[~own] - self.shift, rest.weights, rest.vectors, len(texts), np.minimum(1, REST_TERMS / np.maximum(1, slots)))


def _pair_sums(doc: np.ndarray, column: np.ndarray, weights: np.ndarray, vectors: np.ndarray, n: int, scale: float | np.ndarray = 1.0) -> np.ndarray:
    """Per document, the sum of its columns' weights and, times ``scale``, of the products of all pairs of their vectors."""
    v = vectors[column].astype(np.float64)
    pairs = np.zeros(n)
    for k in range(v.shape[1]):
        pairs += np.bincount(doc, v[:, k], n) ** 2 - np.bincount(doc, v[:, k] ** 2, n)
    return np.bincount(doc, weights[column], n) + 0.5 * scale * pairs


def _share(z: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, terms: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit by Adam on the log loss; ``x`` has one row of bits per document."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n, d = x.shape
    rate = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    params = [np.array([bias]), np.zeros(d), rng.normal(0, 0.01, (d, RANK))]
    if n == 0 or y.min() == y.max():
        return Model(terms, bias, params[1], np.zeros((d, RANK)))
    m = [np.zeros_like(p) for p in params]
    s = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        pace = RATE * (1 - 0.9 * epoch / epochs)
        for start in range(0, n, BATCH):
            part = order[start : start + BATCH]
            xb = x[part].astype(np.float64)
            b, w, v = params
            sums = xb @ v
            z = b[0] + xb @ w + 0.5 * ((sums**2).sum(1) - xb @ (v**2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            grads = [
                np.array([e.sum()]),
                xb.T @ e + DECAY * w,
                xb.T @ (sums * e[:, None]) - v * (xb.T @ e)[:, None] + DECAY * v,
            ]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                params[k] = params[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(terms, float(params[0][0]), params[1], params[2])


def fit_rest(rows: list[np.ndarray], y: np.ndarray, offset: np.ndarray, size: int, seed: int = SEED) -> Rest:
    """Fit by gradient steps on the log loss, beside the logits ``offset``; a row lists its columns, each once."""
    rng = np.random.Generator(np.random.PCG64(seed))
    w, v = np.zeros(size, np.float32), rng.normal(0, REST_START, (size, REST_RANK)).astype(np.float32)
    gw = np.full(size, 1e-8, np.float32)
    order = rng.permutation([i for i, r in enumerate(rows) if len(r)]).astype(np.int64)
    parts = []
    for start in range(0, len(order), BATCH):
        part = order[start : start + BATCH]
        length = np.array([len(rows[i]) for i in part])
        at, inverse = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
        inverse = inverse.astype(np.int32)
        by_column = np.argsort(inverse, kind="stable").astype(np.int32)
        begin = np.searchsorted(inverse[by_column], np.arange(len(at)))
        row = np.repeat(np.arange(len(part), dtype=np.int32), length)[by_column]
        parts.append((part, at.astype(np.int32), inverse, np.cumsum(length) - length, row, begin, np.minimum(1, REST_TERMS / length).astype(np.float32)))
    for _ in range(REST_EPOCHS if len(set(y.tolist())) > 1 else 0):
        for k in rng.permutation(len(parts)):
            part, at, inverse, first, row, begin, scale = parts[k]
            wa, va = w[at], v[at]
            sums = np.add.reduceat(va[inverse], first)
            own = np.add.reduceat((va**2).sum(1)[inverse], first)
            z = offset[part] + np.add.reduceat(wa[inverse], first) + 0.5 * scale * ((sums**2).sum(1) - own)
            e = (_share(z) - y[part]).astype(np.float32)
            g = np.add.reduceat(e[row], begin)
            # the bound keeps the steps of long texts from running away
            root = np.sqrt(scale)[:, None]
            pull = e[:, None] * root * np.clip(root * sums, -REST_BOUND, REST_BOUND)
            h = np.add.reduceat(pull[row], begin) - va * np.add.reduceat((e * scale)[row], begin)[:, None] + REST_DECAY * va
            g += REST_DECAY * wa
            gw[at] += g * g
            pace = REST_RATE / np.sqrt(gw[at])
            wa = wa - pace * g
            w[at] = np.sign(wa) * np.maximum(np.abs(wa) - REST_PULL * pace, 0)
            v[at] = va - REST_PACE / len(part) * h
    return Rest(w, v)


def held_out(key: str) -> Column:
    """Documents whose labels are not learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % HELD_OUT == 0, F.lit(False))


def fit_machines(rows: list[np.ndarray], n_words: np.ndarray, y: np.ndarray) -> Machines:
    """From the distinct term hashes of each document, its number of distinct words, and its label (0 or 1).

    ``rows`` is emptied on the way.
    """
    n, toxic = len(rows), int(y.sum())
    none = np.zeros(0, np.uint32)
    if not 0 < toxic < n:
        first = fit(np.zeros((int(n > 0), SIZES), np.uint8), np.array([float(toxic > 0)] * int(n > 0)), none)
        return Machines(first, none, Rest(np.zeros(0, np.float32), np.zeros((0, REST_RANK), np.float32)))
    # sorted copies only: the numbers of all terms' places are never held at once
    terms, count = np.unique(np.concatenate(rows), return_counts=True)
    toxic_terms, toxic_count = np.unique(np.concatenate([r for r, label in zip(rows, y, strict=True) if label]), return_counts=True)
    with_toxic = np.zeros(len(terms))
    with_toxic[np.searchsorted(terms, toxic_terms)] = toxic_count
    enough = count >= LEAST_DOCUMENTS
    terms, count, with_toxic = terms[enough], count[enough].astype(float), with_toxic[enough]
    # chi square of the two by two table of term and label
    chi = n * (with_toxic * (n - toxic) - (count - with_toxic) * toxic) ** 2 / np.maximum(count * (n - count + 0.5) * toxic * (n - toxic), 1e-9)
    telling = np.flatnonzero(chi >= LEAST_CHI)
    picked = terms[np.sort(telling[np.lexsort((terms[telling], -chi[telling]))[:TERMS]])]
    used = np.unique(terms % SLOTS)
    x = np.zeros((n, len(picked) + SIZES), np.uint8)
    x[np.arange(n), len(picked) + np.array([size_of(int(w)) for w in n_words])] = 1
    own = []
    for i, r in enumerate(rows):
        at = places(picked, r)
        x[i, at[at >= 0]] = 1
        at = places(used, np.unique(r % SLOTS))
        own.append(at[at >= 0].astype(np.int32))
        rows[i] = None  # each row is needed once
    first = fit(x, y, picked)
    which, place = np.nonzero(x)
    offset = first.bias + _pair_sums(which, place, first.weights, first.vectors, n)
    del x, which, place
    return Machines(first, used, fit_rest(own, y, offset, len(used)))


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int) -> DataFrame:
    """id, y, n_words, terms of at most ``sample_rows`` labelled documents that are not held out."""
    known = only(labels, key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    known = known.groupBy(key).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    # keys only, each once
    known = written(known.join(only(docs, key).distinct(), key, "left_semi"), "toxic-known")
    chosen = hash_sample(known, sample_rows, key)  # so many short rows at most
    rows = only(docs, key, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key)
    rows = rows.select(F.col(key).alias("id"), "y", F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch, "text", CHUNK_BYTES)):
            words = [distinct_words(t.as_py()) for t in part.column("text")]
            terms = [np.fromiter({x for w in ws for x in terms_of_word(w)}, np.int64) for ws in words]
            columns = [part.column("id"), part.column("y"), part.column("h"), pa.array([len(w) for w in words], pa.int32()), pa.array(terms, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["id", "y", "h", "n_words", "terms"])

    found = rows.mapInArrow(lean(run), f"id {kind}, y int, h long, n_words int, terms array<long>")
    # of documents that share a key, one is learned from
    one = found.groupBy("id").agg(F.min_by(F.struct("y", "n_words", "terms"), "h").alias("r"))
    return one.select("id", "r.y", "r.n_words", "r.terms")


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """The fitted machines, pickled; the fit is one task over the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        y, n_words, rows = [], [], []
        for batch in batches:
            y += batch.column("y").to_pylist()
            n_words += batch.column("n_words").to_pylist()
            rows += [r.values.to_numpy().astype(np.uint32) for r in batch.column("terms")]
        model = pickle.dumps(fit_machines(rows, np.array(n_words, np.int64), np.array(y, np.float64)))
        yield pa.record_batch([pa.array([model], pa.binary())], ["model"])

    sample = written(training_sample(docs, labels, key, text, label, sample_rows), "toxic-sample")
    found = sample.coalesce(1).sortWithinPartitions("id").select("y", "n_words", "terms").mapInArrow(lean(run), "model binary").collect()  # one row
    return bytes(found[0]["model"]) if found else pickle.dumps(fit_machines([], np.zeros(0, np.int64), np.zeros(0)))


def toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Only the text is an input of a score.  Labels are learned from rows that are not held out, at
    most ``sample_rows`` of them; a key with several labels counts as toxic if one says so; of
    several documents with one key, the one whose text has the smallest hash is learned from; NULL
    labels are left out.  NULL and
    empty texts are scored as texts without terms.  With no labels, or labels of one kind only, all
    scores are equal.  Repeated rows are treated alike; a NULL key is not held out; an empty table
    gives no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label, sample_rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            for part in chunks(batch, text, CHUNK_BYTES):
                scores = _share(scorer.logits(part.column(1).to_pylist()))
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    scored = only(docs, key, text).mapInArrow(lean(run), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(key), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows and columns of ``docs`` without those predicted to be toxic.

    Rows with NULL key stay; of rows that share a key, one predicted to be toxic takes all along.
    """
    gone = toxicity(docs, labels, key, text).where("predicted = 1").select(key).distinct()
    return docs.join(written(gone, "toxic"), key, "left_anti")
