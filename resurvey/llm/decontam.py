"""Operator 10: passages of a benchmark inside documents, found by spaced seeds.

A seed hashes the words of a window at the places of a fixed mask and ignores the others, so a
substituted word at an ignored place does not hide the window.  The two masks together meet every
window of 13 words with at most two substitutions.  Equal seeds of test items and documents are
joined; each hit names a diagonal (place in the document minus place in the item), along which the
words around it are compared.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm import wordhash
from resurvey.llm.base import lean, only, small_side, written

MASKS = ("11101011", "110100111")
# An overlap is a window of this many words of which at least so many are equal.
WINDOW, EQUAL = 13, 11
# Shorter items, of at least this many words, must occur whole and without substitutions.
LEAST_WORDS = 5
# Tasks get the seeds of the benchmark as a Bloom filter of two bits a seed, in 64 times as many bits,
# at most 2**27 (16 MB); what it lets through by mistake goes in the join.
LEAST_FILTER_BITS, FILTER_BITS = 16, 27
FILTER_PART_BITS = 16
# Hits of one document that are compared at once.
HITS_AT_ONCE = 4096


def _places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def words_of(data: bytes | None) -> np.ndarray:
    """Words in lower case; punctuation and white space end a word.

    Letters outside ASCII are lowered too.
    """
    if not data:
        return wordhash.EMPTY
    if not data.isascii():
        data = data.decode().lower().encode()
    return wordhash.word_hashes(data, lower=True, breaks=wordhash.MARKS)


def seeds(words: np.ndarray, short: Iterable[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of all windows under each mask and as whole windows of the ``short`` lengths."""
    found = []
    for m, mask in enumerate(MASKS):
        h = wordhash.masked_windows(words, _places(mask), 1000 + m)
        found.append((np.arange(len(h)), h))
    for n in short:
        h = wordhash.windows(words, n)
        found.append((np.arange(len(h)), h))
    return found


def _words(df: DataFrame, name: str) -> DataFrame:
    """(name, words): the word hashes of rows (name, text)."""
    kind = df.schema[name].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t).view(np.int64) for t in wordhash.each(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.list_(pa.int64()))], [name, "words"])

    return df.select(name, F.encode("text", "UTF-8").alias("text")).mapInArrow(lean(run), f"{name} {kind}, words array<long>")


def _slots(seeds_: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of seeds (unsigned) in a filter of 2**bits bits."""
    return seeds_ >> np.uint64(64 - bits), (seeds_ >> np.uint64(8)) & np.uint64((1 << bits) - 1)


def bloom_filter(seeds_: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """The bits of all seeds, eight to a byte; made in parts, of which the driver gets 2**most_bits bits at most."""
    bits = min(most_bits, max(LEAST_FILTER_BITS, (64 * seeds_.count()).bit_length()))

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pa.record_batch([pa.array(found >> FILTER_PART_BITS), pa.array(found & ((1 << FILTER_PART_BITS) - 1))], ["part", "slot"])

    def part(rows: pa.Table) -> pa.Table:
        marks = np.zeros(1 << FILTER_PART_BITS, bool)
        marks[rows.column("slot").to_numpy()] = True
        return pa.table([rows.column("part").slice(0, 1), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    parts = seeds_.select("seed").mapInArrow(slots, "part long, slot long").distinct().groupBy("part").applyInArrow(part, "part long, bits binary")
    out = np.zeros((1 << bits - FILTER_PART_BITS, 1 << FILTER_PART_BITS - 3), np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def passes(filter_: np.ndarray, seeds_: np.ndarray) -> np.ndarray:
    """Places of the seeds that may be in the filter."""
    one, two = _slots(seeds_, 3 + len(filter_).bit_length() - 1)
    bit = lambda at: (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    keep = np.flatnonzero(bit(one))
    return keep[bit(two[keep]) != 0]


def _seed_rows(df: DataFrame, name: str, short: list[int], whole: bool, known: np.ndarray | None) -> DataFrame:
    """(name, place, seed) of rows (name, text).

    ``whole``: items shorter than a window give one seed as a whole, longer ones those of the
    masks.  ``known``: leaves out seeds that are not in this filter.
    """
    kind = df.schema[name].dataType.simpleString()
    shared = None if known is None else df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        filter_ = None if shared is None else shared.value
        for batch in batches:
            rows, places, hashes = [], [], []
            for i, data in enumerate(wordhash.each(batch.column(1))):
                words = words_of(data)
                if whole and len(words) < WINDOW:
                    found = [(np.zeros(1, int), wordhash.windows(words, len(words)))] if len(words) >= LEAST_WORDS else []
                else:
                    found = seeds(words, short)
                for at, h in found:
                    if filter_ is not None and len(h):
                        keep = passes(filter_, h)
                        at, h = at[keep], h[keep]
                    rows.append(np.full(len(h), i))
                    places.append(at)
                    hashes.append(h)
            rows = np.concatenate(rows or [np.zeros(0, int)])
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(np.concatenate(places or [np.zeros(0, int)]), pa.int64()),
                    pa.array(np.concatenate(hashes or [wordhash.EMPTY]).view(np.int64), pa.int64()),
                ],
                [name, "place", "seed"],
            )

    return df.select(name, F.encode("text", "UTF-8").alias("text")).mapInArrow(lean(run), f"{name} {kind}, place long, seed long")


def _stretches(rows: DataFrame, item_kind: str) -> DataFrame:
    """doc, item, diagonal, doc_words: of rows (doc, text, hits) the stretch of the text that each hit (item, diagonal, n) lies along.

    A text is hashed once however many hits it has; what it gives has the size of the items.  Places
    outside the text are NULL.
    """
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            for i, data in enumerate(wordhash.each(batch.column("text"))):
                words = words_of(data).view(np.int64)
                mine = hits[i].values
                begin, size = mine.field("diagonal").to_numpy(), mine.field("n").to_numpy()
                for a in range(0, len(mine), HITS_AT_ONCE):
                    b, n = begin[a : a + HITS_AT_ONCE], size[a : a + HITS_AT_ONCE]
                    ends = np.cumsum(n)
                    at = np.repeat(b - (ends - n), n) + np.arange(int(ends[-1]))
                    inside = (at >= 0) & (at < len(words))
                    found = np.zeros(len(at), np.int64)
                    found[inside] = words[at[inside]]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(found, mask=~inside))
                    columns = [pa.array([batch.column("doc")[i].as_py()] * len(b), batch.column("doc").type), mine.field("item").slice(a, len(b)), pa.array(b), lists]
                    yield pa.record_batch(columns, ["doc", "item", "diagonal", "doc_words"])

    ready = rows.select("doc", F.encode("text", "UTF-8").alias("text"), "hits")
    return ready.mapInArrow(lean(run), f"doc {kind}, item {item_kind}, diagonal long, doc_words array<long>")


def overlaps(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and item that overlap: ``doc_id``, ``item_id``, ``n_equal``, ``n_item``, ``doc_word``.

    They overlap if 13 consecutive words of the item stand in the document with at most two of
    them substituted; an item of 5 to 12 words must stand there whole.  Items with fewer words
    are not looked for.  ``n_equal``: equal words along the best diagonal, over the whole item;
    ``n_item``: words of the item; ``doc_word``: place of the item's first word in the document
    (negative if the overlap begins inside the item), the first of equally good ones.

    NULL texts and keys and empty texts overlap with nothing; rows that share a key count as one
    document or item; empty tables give no rows; other columns are not read.
    """
    train = only(docs, key, text).select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    test = only(items, item_key, item_text).select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL")
    item_words = written(_words(test, "item").where(F.size("words") >= LEAST_WORDS), "leak-items")
    lengths = item_words.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # at most WINDOW - LEAST_WORDS numbers
    item_seeds = written(_seed_rows(test, "item", [], True, None).withColumnRenamed("place", "item_place").distinct(), "leak-seeds")
    hits = _seed_rows(train, "doc", short, False, bloom_filter(written(item_seeds.select("seed").distinct(), "leak-known")))
    diagonals = (
        hits.join(item_seeds, "seed")
        .select("doc", "item", (F.col("place") - F.col("item_place")).alias("diagonal"))
        .distinct()
    )
    # items that share a key are one: each of their texts is compared
    longest = item_words.groupBy("item").agg(F.max(F.size("words")).alias("n"))
    along = diagonals.join(longest, "item").groupBy("doc").agg(F.collect_list(F.struct("item", "diagonal", "n")).alias("hits"))
    found = small_side(written(along, "leak-hits"))
    stretches = _stretches(train.where("text IS NOT NULL").join(found, "doc"), test.schema["item"].dataType.simpleString())
    aligned = stretches.join(item_words.alias("i"), "item")
    same = F.transform(F.col("i.words"), lambda w, k: F.coalesce(F.get("doc_words", k) == w, F.lit(False)).cast("int"))
    n = F.size("same")
    width = F.least(n, F.lit(WINDOW))
    sums = F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x))
    needed = F.when(n < WINDOW, n).otherwise(F.lit(EQUAL))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    judged = aligned.select("doc", "item", "diagonal", same.alias("same")).select(
        "doc", "item", "diagonal", n.alias("n_item"), total.alias("n_equal"), (F.array_max(sums) >= needed).alias("overlap")
    )
    best = judged.where("overlap").groupBy("doc", "item").agg(
        F.max(F.struct("n_equal", (-F.col("diagonal")).alias("at"), "n_item")).alias("b")
    )
    return best.select(
        F.col("doc").alias(key), F.col("item").alias(item_key),
        F.col("b.n_equal").cast("long").alias("n_equal"), F.col("b.n_item").cast("long").alias("n_item"), (-F.col("b.at")).alias("doc_word"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows and columns of ``docs`` without the documents that overlap with an item."""
    leaks = overlaps(docs, items, key, text).select(F.col(key)).distinct()
    return docs.join(small_side(written(leaks, "leaks")), key, "left_anti")
