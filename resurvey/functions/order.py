"""Ranks, running totals and exact quantiles that never put one group in one task.

A plain ``Window.partitionBy(group).orderBy(value)`` sorts a whole group in a single
task, and ``percentile`` keeps a whole group in one aggregation buffer.  Both fail when
one group holds a large share of the rows.  The helpers here work at two levels:

1. rows are counted per (group, bucket), where the bucket is an order-preserving coarse
   form of the value, so this is an ordinary map-side combined aggregate;
2. a running total over the *buckets* (at most a few ten thousand per group) gives every
   bucket its offset, and the exact work is done inside single buckets.

Groups with a NULL in their keys are groups like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resurvey.session import exchange_dir

# Hot keys are broadcast up to this many of them (a key row is well below 100 bytes).
BROADCAST_GROUPS = 50_000
# Levels of a gap that one row expands to.
GAP_LEVELS = 1 << 16
# Leading decimal digits kept by the coarse bucket: 9,000 buckets per power of ten.
COARSE_DIGITS = 3


def coarse_key(value: Column, digits: int = COARSE_DIGITS) -> Column:
    """Monotone bucket number of a finite number: sign, decimal exponent, leading digits."""
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log10(size))
    lead = F.floor(size / F.pow(F.lit(10.0), exponent) * F.lit(float(10**digits)))
    key = (exponent + 400) * F.lit(10 ** (digits + 2)) + lead
    return (
        F.when(value.isNull(), F.lit(None).cast("long"))
        .when(size < 1e-300, F.lit(0).cast("long"))
        .when(value > 0, key.cast("long"))
        .otherwise((-key).cast("long"))
    )


def _before(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``by`` in which NULL meets NULL, so that a group with a NULL key is kept."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & left[c].eqNullSafe(renamed[f"_right_{c}"])
    return left.join(renamed, on, how).drop(*[f"_right_{c}" for c in by])


def running_total(
    df: DataFrame, by: Sequence[str], value: str, weight: str, out: str = "running"
) -> DataFrame:
    """Running sum of ``weight`` in ``value`` order within ``by``; one row per (by, value).

    ``value`` must not be NULL.
    """
    by = list(by)
    rows = df.withColumn("_bucket", coarse_key(F.col(value)))
    offsets = (
        rows.groupBy(*by, "_bucket")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_offset", F.coalesce(F.sum("_w").over(_before(by, "_bucket")), F.lit(0)))
        .drop("_w")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = join_groups(rows.withColumn("_inside", F.sum(weight).over(inside)), offsets, by + ["_bucket"])
    return rows.withColumn(out, F.col("_inside") + F.col("_offset")).drop("_bucket", "_inside", "_offset")


def number_rows(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence, out: str) -> DataFrame:
    """Row number from 1 within ``by``; ``bucket`` must be non-decreasing along ``order``.

    Rows with a NULL bucket come first, as NULLs do in an ascending order.
    """
    by = list(by)
    rows = df.withColumn("_bucket", F.coalesce(bucket.cast("long"), F.lit(-(2**63)).cast("long")))
    offsets = (
        rows.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(_before(by, "_bucket")), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    rows = join_groups(rows.withColumn("_inside", F.row_number().over(inside)), offsets, by + ["_bucket"])
    return rows.withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long")).drop("_bucket", "_inside", "_offset")


def split_hot(df: DataFrame, by: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``limit`` rows, and rows of larger groups with their size ``_n``.

    One counting job runs first and brings back the number of hot groups, nothing else.
    Without any, the data need no join at all; a checked number of them is broadcast; more
    than that are joined by shuffle.
    """
    by = list(by)
    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    count = hot.count()
    if count == 0:
        return df, None
    if count <= BROADCAST_GROUPS:
        hot = F.broadcast(hot)
    return join_groups(df, hot.select(*by), by, "left_anti"), join_groups(df, hot, by)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, ``_v`` (distinct values, NULL left out), ``_f`` (how many rows have it).

    What summaries and quantiles of a group need, in one scan: a shuffle by group *and* value, which
    no large group can skew.  Its consumers share that shuffle.
    """
    rows = df.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_f"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linearly interpolated quantiles (R type 7) of ``value`` per ``by``; NULL values are ignored."""
    return quantiles_of_counts(value_counts(df, by, value), by, probs, names)


def count_and_mean(n: str = "n", mean: str = "mean") -> list[Column]:
    """Aggregates over ``value_counts``: number of values, and their mean, exact up to one division for decimals."""
    return [F.sum("_f").alias(n), (F.sum(F.col("_v") * F.col("_f")).cast("double") / F.sum("_f")).alias(mean)]


def quantiles_of_counts(freq: DataFrame, by: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact quantiles (R type 7) per ``by`` of a table of ``value_counts``.

    Counts per coarse bucket say which buckets hold a wanted rank; only their values are ranked.  No
    group is ever gathered, nothing is counted before the plan runs.
    """
    by = list(by)
    rows = freq.withColumn("_v", F.col("_v").cast("double")).withColumn("_bucket", coarse_key(F.col("_v")))
    buckets = (
        rows.groupBy(*by, "_bucket")
        .agg(F.sum("_f").alias("_w"))
        .withColumn("_offset", F.coalesce(F.sum("_w").over(_before(by, "_bucket")), F.lit(0)))
        .withColumn("_n", F.sum("_w").over(Window.partitionBy(*by)))
    )
    # position p*(n-1): the rank below (even slots) and the rank above (odd slots), from 1
    ranks = []
    for p in probs:
        low = F.floor(F.lit(float(p)) * (F.col("_n") - 1)).cast("long") + 1
        ranks += [low, F.least(low + 1, F.col("_n"))]
    held = F.lit(False)
    for rank in ranks:
        held = held | ((rank > F.col("_offset")) & (rank <= F.col("_offset") + F.col("_w")))
    picks = buckets.where(held).select(*by, "_bucket", "_offset", "_n")
    running = Window.partitionBy(*by, "_bucket").orderBy("_v")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = join_groups(rows, picks, by + ["_bucket"]).withColumn("_upto", F.col("_offset") + F.sum("_f").over(running))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_f")), F.col("_v")))

    wide = exact.groupBy(*by, "_n").agg(*[at(rank).alias(f"_s{k}") for k, rank in enumerate(ranks)])
    out = []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        part = pos - F.floor(pos)
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        out.append((low + (high - low) * part).alias(name))
    return wide.select(*by, *out)


def fill_levels(
    freq: DataFrame, by: Sequence[str], level: str, weight: str, from_zero: bool = False, extra: int = 0
) -> DataFrame:
    """Frequency table with its empty levels, ``_upto`` (running sum) and ``_total``.

    ``freq`` has one row per integer level.  Every row fills the gap below it (down to 0 for the
    first one with ``from_zero``), the last one adds ``extra`` empty levels.  A gap is expanded in
    chunks of ``GAP_LEVELS``; running sums and the level below are found bucket by bucket, so that
    neither a far outlier nor a group of many levels meets in one task.
    """
    by = list(by)
    rows = freq.withColumn("_bucket", coarse_key(F.col(level)))
    whole = Window.partitionBy(*by)
    before = _before(by, "_bucket")
    buckets = rows.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_w"), F.max(level).alias("_top"))
    buckets = buckets.select(
        *by, "_bucket",
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_offset"),
        F.max("_top").over(before).alias("_under"),
        F.sum("_w").over(whole).alias("_total"),
        F.max("_top").over(whole).alias("_last"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(level)
    rows = rows.withColumn("_below", F.lag(level).over(inside)).withColumn(
        "_s", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    rows = join_groups(rows, buckets, by + ["_bucket"])
    start = F.coalesce(F.col("_below") + 1, F.col("_under") + 1, F.lit(0).cast("long") if from_zero else F.col(level).cast("long"))
    stop = (F.col(level) + F.when(F.col(level) == F.col("_last"), extra).otherwise(0)).cast("long")
    chunks = rows.select(
        *by, F.col(level).alias("_own"), F.col(weight).alias("_w"), (F.col("_s") + F.col("_offset")).alias("_s"), "_total",
        stop.alias("_stop"), F.explode(F.sequence(start.cast("long"), stop, F.lit(GAP_LEVELS).cast("long"))).alias("_from"),
    )
    # a wide gap is many chunks, which several tasks expand
    rows = chunks.repartition(*by, "_from").withColumn(
        level, F.explode(F.sequence("_from", F.least(F.col("_from") + GAP_LEVELS - 1, F.col("_stop"))))
    )
    reached = F.col(level) >= F.col("_own")
    return rows.select(
        *by,
        level,
        F.when(F.col(level) == F.col("_own"), F.col("_w")).otherwise(0).alias(weight),
        F.when(reached, F.col("_s")).otherwise(F.col("_s") - F.col("_w")).alias("_upto"),
        "_total",
    )


def number_by_range(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Row number from 1 over ``order`` (NULLs first), which must tell the rows apart where they meet in one value.

    Rows are parted by ranges of ``order``, written with their place in their part, and the rows of
    earlier parts are added: what is sorted in one task has the size of a part, whatever the values.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    path = exchange_dir(spark, "numbered")
    parted.write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_place", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per part
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(_before([], "_part")), F.lit(0)).alias("_offset"))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return rows.join(offsets, "_part").withColumn(out, F.col("_offset") + inside + 1).drop("_part", "_place", "_offset")


def number_in_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Row number from 1 within ``by`` over ``order``, as ``number_by_range``: no group meets in one task."""
    by = list(by)
    numbered = number_by_range(df, [*by, *order], "_global")
    first = numbered.groupBy(*by).agg(F.min("_global").alias("_first"))
    return join_groups(numbered, first, by).withColumn(out, F.col("_global") - F.col("_first") + 1).drop("_global", "_first")
