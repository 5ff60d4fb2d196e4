"""Operator 1: shards of near equal bytes by a k-d tree over the metadata of documents.

The tree splits a node at the weighted median of its widest dimension until every leaf holds
about the target number of bytes.  Only DataFrame operations are used, and a median is found
without sorting: the dimension becomes a 48-bit key whose digits are settled one after another
from sums by digit, so a round shuffles at most ``DIGIT`` sums per node and task, however many
rows a node has and however often one value occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resurvey.functions.order import number_by_range
from resurvey.llm.base import mixed, only, small_side, written

# Keys: 32 bits of the dimension, then 16 bits that part equal values; three digits of 16 bits.
VALUE_BITS, TIE_BITS, DIGIT_BITS = 32, 16, 16
DIGIT = 1 << DIGIT_BITS
ROUNDS = (VALUE_BITS + TIE_BITS) // DIGIT_BITS


def with_coordinates(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """A written table with ``dim_<c>`` for each dimension: a number that keeps the order, NULL first.

    Numbers stay as they are; a string becomes its place among the distinct strings of the column.
    """
    kinds = dict(rows.dtypes)
    for d in dims:
        if kinds[d] == "string":
            names = number_by_range(rows.select(F.col(d).alias("name")).where("name IS NOT NULL").distinct(), ["name"], f"dim_{d}")
            rows = rows.join(small_side(names.withColumnRenamed("name", d)), d, "left")
            rows = rows.withColumn(f"dim_{d}", F.coalesce(F.col(f"dim_{d}").cast("double"), F.lit(0.0)))
        else:
            rows = rows.withColumn(f"dim_{d}", F.coalesce(F.col(d).cast("double"), F.lit(-1.0)))
    return rows


def _settle(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The key at which each node is cut; rows have ``node``, ``key``, ``w``; nodes the ``want``ed left weight.

    Returns node, cut: rows with key < cut go left.
    """
    state = nodes.select("node", "want", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for r in range(ROUNDS):
        shift = DIGIT_BITS * (ROUNDS - 1 - r)
        sums = (
            rows.join(state.select("node", "prefix"), "node")
            .where(F.shiftright("key", shift + DIGIT_BITS) == F.col("prefix"))
            .groupBy("node", F.shiftright("key", shift).bitwiseAND(DIGIT - 1).alias("d"))
            .agg(F.sum("w").alias("s"))
            .groupBy("node")  # at most DIGIT entries
            .agg(F.sort_array(F.collect_list(F.struct("d", "s"))).alias("digits"))
        )
        # walk the digits until the wanted weight lies inside one
        walk = F.aggregate(
            "digits",
            F.struct(F.lit(-1).cast("long").alias("d"), F.col("before").alias("b"), F.lit(0).cast("long").alias("s")),
            lambda a, x: F.when(a["d"] < 0, F.struct(x["d"].alias("d"), a["b"].alias("b"), x["s"].alias("s")))
            .when(a["b"] + a["s"] > F.col("want"), a)
            .otherwise(F.struct(x["d"].alias("d"), (a["b"] + a["s"]).alias("b"), x["s"].alias("s"))),
        )
        state = (
            state.join(sums, "node")
            .withColumn("at", walk)
            .select(
                "node",
                "want",
                (F.col("prefix") * DIGIT + F.col("at.d")).alias("prefix"),
                F.col("at.b").alias("before"),
                F.col("at.s").alias("inside"),
            )
        )
    # the rows of the last key go to the side that comes closer
    left = F.abs(F.col("before") + F.col("inside") - F.col("want")) < F.abs(F.col("want") - F.col("before"))
    return state.select("node", (F.col("prefix") + F.when(left, 1).otherwise(0)).alias("cut"))


def kd_leaves(
    rows: DataFrame, dims: Sequence[str], weight: str, tie: Column, leaves: int | None = None, target: int | None = None
) -> DataFrame:
    """``rows`` with a column ``leaf`` from 0, of a tree with ``leaves`` leaves or leaves of ``target`` weight.

    A node that must hold k leaves is cut so that its left side gets floor(k / 2) / k of its
    weight.  ``dims`` are numbers; the widest is the one whose range takes the largest part of
    its range over all rows, the first of them if several do.  Rows with equal values are parted
    by the hash ``tie``.
    """
    spans = [F.max(d).alias(f"hi_{d}") for d in dims] + [F.min(d).alias(f"lo_{d}") for d in dims]
    whole = rows.agg(F.sum(weight).alias("w"), *spans).first()  # one row
    if leaves is None:
        leaves = max(1, -(-(whole["w"] or 0) // target))
    scaled = []
    for d in dims:
        lo, hi = whole[f"lo_{d}"], whole[f"hi_{d}"]
        width = (hi - lo) if hi is not None and hi > lo else 1.0
        scaled.append(F.floor((F.col(d) - F.lit(lo or 0.0)) / F.lit(width) * F.lit(float(2**VALUE_BITS - 1))).alias(f"x_{d}"))
    rest = [c for c in rows.columns if c not in dims]
    level = rows.select(
        *rest, F.col(weight).alias("w"), *scaled, F.pmod(tie, F.lit(1 << TIE_BITS)).alias("tie"),
        F.lit(0).cast("long").alias("node"), F.lit(leaves).cast("long").alias("k"),
    )
    level = written(level, "shard-level")
    xs = [f"x_{d}" for d in dims]
    depth = max(0, (leaves - 1).bit_length())
    for _ in range(depth):
        widths = F.array(*[(F.max(x) - F.min(x)) for x in xs])
        nodes = (
            level.where("k > 1")
            .groupBy("node", "k")
            .agg(F.sum("w").alias("total"), widths.alias("widths"))
            .select(
                "node",
                (F.array_position("widths", F.array_max("widths")) - 1).cast("int").alias("dim"),
                F.floor(F.col("total") * F.floor(F.col("k") / 2) / F.col("k")).cast("long").alias("want"),
            )
        )
        nodes = written(nodes, "shard-nodes")
        key = F.element_at(F.array(*xs), F.col("dim") + 1) * (1 << TIE_BITS) + F.col("tie")
        keyed = level.where("k > 1").join(nodes.select("node", "dim"), "node").select("node", key.alias("key"), "w")
        cuts = nodes.select("node", "dim").join(_settle(keyed, nodes), "node")
        # names of nodes: the number of leaves to the left, so a leaf ends as its own number
        right = F.coalesce(key >= F.col("cut"), F.lit(False))
        half = F.floor(F.col("k") / 2)
        moved = level.join(cuts, "node", "left")
        level = moved.select(
            *rest, "w", *xs, "tie",
            F.when(right, F.col("node") + half).otherwise(F.col("node")).cast("long").alias("node"),
            F.when(F.col("k") == 1, F.col("k")).when(right, F.col("k") - half).otherwise(half).cast("long").alias("k"),
        )
        level = written(level, "shard-level")
    return level.select(*rest, F.col("node").cast("int").alias("leaf"))


def shard_documents(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    key: str = "doc_id", text: str = "text", dims: Sequence[str] = ("source", "lang", "doc_id", "size"),
) -> DataFrame:
    """Every document in a shard of near equal bytes; one row per document.

    Columns: ``key``, ``size`` (UTF-8 bytes of the text plus 1; a NULL text has none), ``text_crc32``
    (0 without text), ``shard`` from 0, ``slot`` (gapless from 0 in each shard).  Give ``shards`` or
    ``target_bytes``.  ``size`` among ``dims`` means that column; strings and numbers may be
    dimensions, NULLs come first.  Repeated rows are placed one by one; an empty table gives no
    rows; other columns are not read.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    plain = [d for d in dims if d != "size"]
    slim = only(docs, *dict.fromkeys([key, text, *plain])).select(
        F.col(key).alias("key"),
        *[F.col(f"`{d}`").alias(f"own_{d}") for d in plain],
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),  # written, so it stays; repeated rows are told apart by it
    )
    slim = written(slim.withColumn("own_size", F.log2("size")), "shard-rows")
    names = [f"own_{d}" for d in dims]
    placed = kd_leaves(with_coordinates(slim, names).drop(*names), [f"dim_{d}" for d in names], "size", mixed("key", "text_crc32", "row"), shards, target_bytes)
    placed = placed.withColumnRenamed("leaf", "shard")
    return number_in_shards(placed).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", "slot"
    )


def number_in_shards(placed: DataFrame) -> DataFrame:
    """``slot``: gapless numbers from 0 in each shard, in the order of (key, crc, row)."""
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"))  # a row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = number_by_range(placed.select("shard", "key", "text_crc32", "row", "size"), ["shard", "key", "text_crc32", "row"], "number")
    return numbered.join(small_side(starts), "shard").withColumn("slot", F.col("number") - F.col("start") - 1)
