"""Joins that pair, look up, backfill and compare survey tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resurvey.operators.clean import cycle_no, parse_key


def pair_by_link(
    n: DataFrame, q: DataFrame, link: str, q_id: str, cols: Sequence[str], both_null_mismatch: bool = True
) -> DataFrame:
    """D1. Pair first surveys with re-surveys where ``n.link = q.q_id``.

    Gives ``link``, ``<col>_1``, ``<col>_2`` and ``<col>_match`` (a NULL side is no match).
    With ``both_null_mismatch=False`` a pair missing on both sides is left out for one column;
    its ids are those of ``missing_both``.
    """
    left = n.select(F.col(link).alias("link"), *[F.col(c).alias(f"{c}_1") for c in cols])
    right = q.select(F.col(q_id).alias("link"), *[F.col(c).alias(f"{c}_2") for c in cols])
    out = left.join(right, "link")
    if not both_null_mismatch:
        for c in cols:
            out = out.where(F.col(f"{c}_1").isNotNull() | F.col(f"{c}_2").isNotNull())
    return out.withColumns({f"{c}_match": F.coalesce(F.col(f"{c}_1") == F.col(f"{c}_2"), F.lit(False)) for c in cols})


def missing_both(n: DataFrame, q: DataFrame, link: str, q_id: str, col: str) -> DataFrame:
    """D1. Ids of linked pairs where ``col`` is missing on both sides."""
    pairs = pair_by_link(n, q, link, q_id, [col])
    return pairs.where(F.col(f"{col}_1").isNull() & F.col(f"{col}_2").isNull()).select("link")


def unlinked(n: DataFrame, q: DataFrame, n_link: str, n_id: str, q_link: str, q_id: str) -> DataFrame:
    """D2. Records of either table whose partner does not exist: (id, side)."""
    only_n = n.join(q.select(F.col(q_id).alias(n_link)), n_link, "left_anti")
    only_q = q.join(n.select(F.col(n_id).alias(q_link)), q_link, "left_anti")
    return only_n.select(F.col(n_id).alias("id"), F.lit("no re-survey").alias("side")).unionByName(
        only_q.select(F.col(q_id).alias("id"), F.lit("no first survey").alias("side"))
    )


def both_status(n: DataFrame, q: DataFrame, link: str, q_id: str, status: str, allowed: Sequence[int]) -> DataFrame:
    """D3. Links whose two records both have an allowed status."""
    ok = list(allowed)
    left = n.where(F.col(status).isin(ok)).select(F.col(link).alias("link"))
    right = q.where(F.col(status).isin(ok)).select(F.col(q_id).alias("link"))
    return left.join(right, "link")


def lookup(df: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """D4. Left join of a dimension with unique keys.  No hint: Spark broadcasts a dimension
    below its size limit and otherwise sort-merges with skew splitting."""
    return df.join(dim, [key] if isinstance(key, str) else list(key), "left")


def backfill_events(
    df: DataFrame, main: DataFrame, event: str, groups: DataFrame, origin: int, width: int
) -> tuple[DataFrame, DataFrame]:
    """D7. Fill the attributes of rows whose event is missing from ``main``.

    ``main`` has (event, park, plot, year, cycle_no, role, group), one row per event;
    ``groups`` has (plot, group).  Returns the filled rows and ``main`` with the new events.
    """
    attrs = ["park", "plot", "year", "cycle_no", "role", "group"]
    joined = df.join(main.select(event, *attrs).withColumn("_known", F.lit(True)), event, "left")
    parsed = parse_key(joined, event).join(
        groups.select(F.col("plot").alias("key_plot"), F.col("group").alias("_group")), "key_plot", "left"
    )
    known = F.col("_known").isNotNull()

    def pick(name: str, value: Column) -> Column:
        return F.when(known, F.col(name)).otherwise(value).alias(name)

    filled = parsed.select(
        *[c for c in df.columns],
        pick("park", F.col("key_park")),
        pick("plot", F.col("key_plot")),
        pick("year", F.col("key_year")),
        pick("cycle_no", cycle_no(F.col("key_year"), origin, width)),
        pick("role", F.lit("N")),
        pick("group", F.col("_group")),
        (~known).alias("backfilled"),
    )
    new = filled.where("backfilled").select(event, *attrs).dropDuplicates([event])
    return filled, main.unionByName(new, allowMissingColumns=True)


def high_value_flag(
    df: DataFrame, keys: Sequence[str], col: str, minimum: float, base: Column, out: str = "high"
) -> DataFrame:
    """D8. TRUE when any role has ``col`` above ``minimum`` for the key; NULL outside the base set."""
    keys = list(keys)
    high = df.where(F.col(col) > minimum).select(*keys).distinct().withColumn("_high", F.lit(True))
    flag = F.when(base, F.col("_high").isNotNull())
    return df.join(high, keys, "left").withColumn(out, flag).drop("_high")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """D9. Keys in ``a`` and not in ``b``, and the other way round: (key, only_in)."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return ka.join(kb, key, "left_anti").withColumn("only_in", F.lit("a")).unionByName(
        kb.join(ka, key, "left_anti").withColumn("only_in", F.lit("b"))
    )


def merge_summaries(dfs: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """D10. Full outer merge of summaries that share a key."""
    return reduce(lambda x, y: x.join(y, list(key), "full"), dfs)


def stack_metrics(tables: Mapping[str, DataFrame], name: str = "metric") -> DataFrame:
    """D11. Union of per-metric tables with the metric as a column."""
    parts = [df.select(F.lit(metric).alias(name), "*") for metric, df in tables.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
