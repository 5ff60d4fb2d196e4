"""Data-quality checks; each returns the offending rows (or a count of them)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covers_required(required: DataFrame, available: DataFrame, group: str, item: str) -> DataFrame:
    """A3. Per group: how many required items there are, how many are available, and whether all are.

    A group without requirements does not occur in ``required`` and so is never reported complete.
    """
    need = required.select(group, item).distinct()
    have = available.select(item).distinct().withColumn("_have", F.lit(True))
    return (
        need.join(have, item, "left")
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("required_items"), F.count("_have").alias("available_items"))
        .withColumn("complete", F.col("required_items") == F.col("available_items"))
    )


def missing_required(required: DataFrame, available: DataFrame, group: str, item: str) -> DataFrame:
    """A3. The missing items, one row per group and item."""
    need = required.select(group, item).distinct()
    return need.join(available.select(item).distinct(), item, "left_anti").select(group, item)


def conflicting_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """K1. Lookup keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("values")).where(F.col("values") > 1)


def not_exact_pair(df: DataFrame, unit: str) -> DataFrame:
    """K2. Units without exactly two role entries."""
    return df.groupBy(unit).agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") != 2)


def missing_sides(df: DataFrame, unit: str, v1: str, v2: str) -> DataFrame:
    """K3. Pairs with a missing side and pairs with both missing."""
    a, b = F.col(v1).isNull(), F.col(v2).isNull()
    problem = F.when(a & b, "both missing").when(a, "first missing").otherwise("second missing")
    return df.where(a | b).select(unit, problem.alias("problem"))


def too_many_children(df: DataFrame, parent: Sequence[str], child: str, limit: int) -> DataFrame:
    """K4. Parents with more than ``limit`` distinct children."""
    return df.groupBy(*parent).agg(F.count_distinct(child).alias("children")).where(F.col("children") > limit)


def illegal_codes(df: DataFrame, keys: Sequence[str], col: str, legal: Sequence) -> DataFrame:
    """K5. Rows whose code is not on the legal list; a missing code counts as illegal."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(list(legal))).select(*keys, col)


def orphans(side: DataFrame, main: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K7. Side records absent from the main table."""
    keys = list(keys)
    return side.select(*keys).distinct().join(main.select(*keys), keys, "left_anti")


def without_value(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """K7. Main rows without a value (a year)."""
    return df.where(F.col(col).isNull()).select(*keys)


def incomplete_parents(df: DataFrame, parent: Sequence[str], child: str, expected: Sequence) -> DataFrame:
    """K8. Parents not surveyed at every expected sub-position, with the positions missing.

    Only expected positions are gathered, so the set is never longer than ``expected``.
    """
    listed = F.when(F.col(child).isin(list(expected)), F.col(child))
    wanted = F.array(*[F.lit(x) for x in expected])
    return (
        df.groupBy(*parent)
        .agg(F.collect_set(listed).alias("_seen"))
        .where(F.size("_seen") < len(expected))
        .select(
            *parent,
            F.size("_seen").cast("long").alias("seen"),
            F.array_join(F.array_sort(F.array_except(wanted, F.col("_seen"))), ",").alias("missing"),
        )
    )
