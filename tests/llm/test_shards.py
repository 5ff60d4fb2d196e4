"""Operator 1: near equal bytes, gapless slots, whole tables."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from resurvey.llm import shards


def check(rows, docs_rows, n_shards, slack):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in docs_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n_shards))
    mean = sum(sizes.values()) / n_shards
    assert max(sizes.values()) <= mean + slack and min(sizes.values()) >= mean - slack


def test_corner_rows(corner, corner_rows, nothing):
    rows = shards.shard_documents(corner, shards=3).collect()
    check(rows, corner_rows, 3, 30_001 + 30_000)  # the longest texts are not split
    assert shards.shard_documents(nothing, shards=3).collect() == []


@pytest.mark.parametrize("n", [1, 5, 8])
def test_one_source_and_equal_texts(spark, n):
    """A source with most of the rows, one text in a third of them, equal sizes."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))).alias("text"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.lit("en").alias("lang"), F.lit(1).alias("node"), F.lit(2).alias("shard"),
    )
    rows = shards.shard_documents(docs, shards=n).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], n, 200)


def test_target_bytes(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('y', 99) AS text", "'s' AS source", "'en' AS lang")
    rows = shards.shard_documents(docs, target_bytes=5000).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 8, 300)
    with pytest.raises(ValueError):
        shards.shard_documents(docs)


def test_widest_dimension_is_cut(spark):
    """Leaves are boxes: two far groups of one dimension never share a leaf."""
    docs = spark.range(200).selectExpr("IF(id < 100, id, id + 1000000) AS doc_id", "'t' AS text", "'s' AS source", "'en' AS lang")
    rows = shards.shard_documents(docs, shards=2, dims=("doc_id",)).collect()
    assert {(r.doc_id < 1000, r.shard) for r in rows} in ({(True, 0), (False, 1)}, {(True, 1), (False, 0)})


def test_strings_are_told_apart_by_more_than_their_beginning(spark):
    """Sources that share their first letters are the widest dimension: each lies in one shard."""
    docs = spark.range(800).selectExpr("id AS doc_id", "'t' AS text", "concat('https://source/', id % 8) AS source", "'en' AS lang")
    rows = shards.shard_documents(docs, shards=8, dims=("source",)).collect()
    assert len({(r.doc_id % 8, r.shard) for r in rows}) == 8
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 8, 0)


def test_repeated_rows_are_parted(spark):
    """One row makes up two fifths of the table."""
    rows = [(7, "x" * 99, "s", "en")] * 400 + [(i, "y" * 99, "s", "en") for i in range(1000, 1600)] + [(None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(6)
    check(shards.shard_documents(docs, shards=4).collect(), rows, 4, 400)
