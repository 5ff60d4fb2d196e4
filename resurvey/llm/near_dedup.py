"""Operator 5: near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. Documents with equal sets of word shingles are one class; only classes go on.
2. Each class has ``BANDS * ROWS`` MinHash samples.  A band of samples names a bucket; the samples
   also fold into an odd sketch, a parity bitmap.  The population count of the XOR of two sketches
   estimates how many samples differ, most precisely where few do.
3. In each bucket every class is paired with the most central one, the hub.  Pairs whose sketches
   are far apart are dropped.  Of its hubs, a class is confirmed on the full sets first with the
   closest, then with those outside the component it has come to.
4. Classes of buckets that still hold several components are paired across components, by the rare
   shingles that any two linked sets must share; sketches and full sets decide as before.  So no
   link between components is lost, and a group of thousands of near copies is not paired with
   itself.
5. All links give the components.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resurvey.llm import wordhash
from resurvey.llm.base import lean, only, small_side, written
from resurvey.llm.components import connected_components

WIDTH = 5
# Two documents are linked from this similarity on, in percent of the union.
PERCENT = 85
# A pair of similarity 0.85 misses all bands with probability (1 - 0.85**4)**32 < 1e-10.
BANDS, ROWS = 32, 4
SKETCH_WORDS = 8
# Estimates of pairs at the threshold have a standard deviation of about 0.035.
SKETCH_SLACK = 0.2
# Closest hubs of a class that are confirmed in the first round.
FIRST_HUBS = 2

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)
_BAND = _rng.integers(0, 2**63, (BANDS, 1), dtype=np.uint64)
_SAMPLE = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(32)


def min_samples(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = None
    for start in range(0, len(low), 2048):
        least = (low[start : start + 2048][None, :] * _A + _B).min(1)
        best = least if best is None else np.minimum(best, least)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND[:, 0].copy()
    for r in range(ROWS):
        key = wordhash.mix(key ^ (rows[:, r] + np.uint64(r + 1)))
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each (function, sample) flips one bit of the bitmap."""
    bits = SKETCH_WORDS * 64
    at = (wordhash.mix(samples.astype(np.uint64) ^ _SAMPLE) % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64)


def set_of(data: bytes) -> np.ndarray:
    """The shingle set of a text in UTF-8, as sorted hashes."""
    return wordhash.shingles(wordhash.word_hashes(data, lower=True), WIDTH)


def set_name(s: np.ndarray) -> int:
    """A hash of the set as a whole."""
    total = wordhash.mix(np.array([s.sum() ^ np.uint64(len(s)), np.bitwise_xor.reduce(wordhash.mix(s))], np.uint64))
    return int(wordhash.mix(total[:1] + (total[1:] << np.uint64(1)))[0].view(np.int64))


def text_features(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Set size, set name, band keys, sketch of a text in UTF-8; None without words."""
    s = set_of(data)
    if not len(s):
        return None
    samples = min_samples(s)
    return len(s), set_name(s), band_keys(samples), odd_sketch(samples)


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, n (set size), node (hash of the set; NULL without words), bands, sketch."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            sizes, nodes, bands, sketches = [], [], [], []
            for t in batch.column(1):
                f = text_features(t.as_buffer().to_pybytes()) if t.is_valid else None
                n, node, band, sketch = f or (0, None, None, None)
                sizes.append(n)
                nodes.append(node)
                bands.append(None if band is None else band.view(np.int64))
                sketches.append(None if sketch is None else sketch.view(np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)]
            yield pa.record_batch(columns, ["doc", "n", "node", "bands", "sketch"])

    rows = only(docs, key, text).select(F.col(key).alias("doc"), F.encode(text, "UTF-8").alias("text"))
    found = rows.mapInArrow(lean(run), f"doc {kind}, n long, node long, bands array<long>, sketch array<long>")
    return found.withColumn("node", F.when(F.col("doc").isNotNull(), F.col("node")))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, shingles (sorted hashes) of rows (node, text in UTF-8); once for each node and task.

    A text whose set has another name belongs to a row that shares its key only, and is left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = set_of(t.as_buffer().to_pybytes()) if t.is_valid else wordhash.EMPTY
                if len(s) and set_name(s) == node:
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(lean(run), "node long, shingles array<long>")


def sketch_similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity from the share of differing bits."""
    bits, samples = SKETCH_WORDS * 64, BANDS * ROWS
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    share = F.least(2.0 * differ / bits, F.lit(0.999))
    return 1 + F.log(1 - share) * (bits / (4.0 * samples))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` of their union in common."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return both.where(100 * F.col("common") >= percent * union).select("a", "b").distinct()


def compared(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs with their estimate ``like``, without those that are far apart or too unlike in size."""
    a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    rated = sized.select("a", "b", sketch_similarity(F.col("ka"), F.col("kb")).alias("like"))
    return rated.where(F.col("like") >= percent / 100.0 - SKETCH_SLACK)


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def prefix_pairs(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (node, component) across components that can reach ``percent``.

    Two sets that do so have a shingle in common among their first n - ceil(n * percent / 100) + 1,
    in any common order of shingles, and from the first one on enough shingles are left for the
    overlap they need.  In the order from rare to frequent, a passage that thousands of texts share
    comes last and pairs no two of them.
    """
    rows = sets.join(nodes, "node").select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    counted = rows.join(often, "s")
    order = Window.partitionBy("node").orderBy("f", "s")  # one text's shingles
    # those that no other set has come first and pair nothing
    single = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    length = F.floor(F.col("n") * (100 - percent) / 100) + 1
    heads = counted.withColumn("place", F.row_number().over(order) + single).where(F.col("place") <= length)
    left_over = F.col("n") - F.col("place") + 1
    heads = written(heads.select("s", "node", "component", "n", left_over.alias("rest")), "near-heads")
    left = heads.select("s", *[F.col(c).alias(f"{c}_a") for c in ("node", "component", "n", "rest")])
    right = heads.select("s", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "rest")])
    enough = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = left.join(right, "s").where((F.col("component_a") < F.col("component_b")) & enough)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``; a text with fewer than five words is one
    shingle as a whole.  Texts without words (also NULL) have no shingles and are linked with
    nothing.  ``component_id`` is the least key reachable over links, ``kept`` tells whether it is
    the row's own.  Repeated rows get equal results; rows that share a key but not a text are
    joined through nothing but their texts.  A row with NULL key is linked with nothing; its
    component is NULL and it is kept.  An empty table gives no rows; other columns are not read.
    """
    feats = written(features(docs, key, text), "near-features")
    same = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]  # equal in all documents of a class
    classes = written(feats.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least"), *same), "near-classes")
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    shared = written(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-buckets")
    members = written(entries.join(shared, "bucket"), "near-members")
    # the hub of a bucket is its most central class: the one that shares most places with others
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    stars = members.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    sketches = classes.select("node", "n", "sketch")

    # the full sets of all classes that share a bucket, each from one of its documents
    wanted = classes.select("node", "least").join(members.select("node").distinct(), "node", "left_semi")
    texts = only(docs, key, text).select(F.col(key).alias("least"), F.encode(text, "UTF-8").alias("text"))
    sets = shingle_sets(texts.join(small_side(written(wanted, "near-wanted")), "least").select("node", "text"))
    sets = written(sets, "near-sets")

    # first the closest hubs, then the other hubs beyond the components found so far
    stars = written(compared(stars, sketches, percent), "near-stars")
    best = stars.groupBy("a").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("like", "b")), False), 1, FIRST_HUBS).alias("near")
    )  # at most BANDS entries
    links = written(confirmed(best.select("a", F.explode("near.b").alias("b")), sets, percent), "near-links")
    labels = written(connected_components(links, "a", "b"), "near-labels")
    more = confirmed(across(stars.select("a", "b"), labels), sets, percent)
    links = written(links.unionByName(more), "near-links")
    labels = written(connected_components(links, "a", "b"), "near-labels")

    # then every pair of classes in different components that can be linked at all
    placed = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    open_ = written(placed.join(split, "bucket", "left_semi").select("node", "component").distinct(), "near-open")
    rest = written(compared(prefix_pairs(sets, open_, percent), sketches, percent).select("a", "b"), "near-rest")
    more = confirmed(rest, sets, percent)
    labels = connected_components(written(links.unionByName(more), "near-links"), "a", "b")

    joined = classes.select("node", "least").join(labels, "node", "left")
    joined = joined.select("node", "least", F.coalesce("component", "node").alias("component"))
    roots = joined.groupBy("component").agg(F.min("least").alias("root"))
    named = written(joined.join(roots, "component").select("node", "root"), "near-named")
    return (
        feats.select("doc", "n", "node").join(named, "node", "left")
        .select(
            F.col("doc").alias(key), F.col("n").alias("n_shingles"),
            F.coalesce("root", "doc").alias("component_id"),
            F.coalesce(F.col("doc") == F.coalesce("root", "doc"), F.col("root").isNull()).alias("kept"),
        )
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows and columns of ``docs`` without the near copies of a document with a smaller key.

    Of rows that are equal in key and text one stays.  Rows without words and rows with NULL key
    all stay.
    """
    found = near_duplicates(docs, key, text).where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    found = written(found.groupBy(key).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "near-found")
    gone = small_side(found.where("NOT kept").select(key))
    twice = small_side(found.where("kept").select(key))
    kept = docs.join(gone, key, "left_anti")
    alone, among = kept.join(twice, key, "left_anti"), kept.join(twice, key, "left_semi")
    return alone.unionByName(among.dropDuplicates([key, text]))
