"""Detection of items by two surveys of the same unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resurvey.functions.order import number_in_groups
from resurvey.operators.reshape import pair_by_role


def _seen(role: str, code: str, flag: Column | None = None) -> Column:
    hit = F.col(role) == code
    if flag is not None:
        hit = hit & flag
    return F.coalesce(F.bool_or(hit), F.lit(False))


def match_type(n: Column, q: Column) -> Column:
    """Type text ``TRUE-FALSE`` (first survey, re-survey)."""
    word = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    return F.concat(word(n), F.lit("-"), word(q))


def detection_match(df: DataFrame, unit: Sequence[str], item: str, role: str = "role") -> DataFrame:
    """E18. Per unit and item: seen by N, by Q, by both, and the type text."""
    seen = df.groupBy(*unit, item).agg(_seen(role, "N").alias("n_seen"), _seen(role, "Q").alias("q_seen"))
    return seen.withColumn("both_seen", F.col("n_seen") & F.col("q_seen")).withColumn(
        "match_type", match_type(F.col("n_seen"), F.col("q_seen"))
    )


def summary_columns() -> list[Column]:
    """The derived columns of a detection summary, from n_only, q_only and matched."""
    n = F.col("n_only") + F.col("matched")
    q = F.col("q_only") + F.col("matched")
    unique = F.col("n_only") + F.col("q_only") + F.col("matched")
    mean = (n + q) / 2
    pct = lambda a, b: F.bround(F.try_divide(100 * a, b)).cast("long")
    return [
        F.col("n_only"),
        F.col("q_only"),
        n.alias("n_richness"),
        q.alias("q_richness"),
        pct(F.col("n_only") + F.col("q_only"), n + q).alias("turnover"),
        (q - n).alias("rich_diff"),
        pct(F.abs(q - n), mean).alias("rich_diff_percent"),
        unique.alias("unique_items"),
        F.col("matched"),
        pct(F.col("matched"), mean).alias("match_by_mean"),
        pct(F.col("matched"), unique).alias("match_by_unique"),
    ]


def detection_summary(df: DataFrame, group: Sequence[str], n: str = "n_seen", q: str = "q_seen") -> DataFrame:
    """E19. Counts and agreement rates per group of the items in a detection table."""
    a, b = F.col(n), F.col(q)
    return (
        df.groupBy(*group)
        .agg(
            F.count(F.when(a & ~b, 1)).alias("n_only"),
            F.count(F.when(~a & b, 1)).alias("q_only"),
            F.count(F.when(a & b, 1)).alias("matched"),
        )
        .select(*group, *summary_columns())
    )


def scale_columns(modules: Mapping[str, Sequence[str]], cells: Sequence[str]) -> dict[tuple[str, str], str]:
    """(scale, position) to flag column: the plot, its modules, its cells."""
    out = {("plot", "plot"): "in_plot"}
    out.update({("module", m): m for m in modules})
    out.update({("cell", c): c for c in cells})
    return out


def scaled_detection(
    df: DataFrame, unit: Sequence[str], item: str, flags: Mapping[tuple[str, str], str], high: Column, role: str = "role"
) -> DataFrame:
    """Per unit and item the scales and positions seen by N and by Q, as two bit masks, and
    whether ``high`` holds in any row.  One shuffle serves all scales; nothing is exploded."""
    if len(flags) > 63:
        raise ValueError("a bit mask holds 63 positions")
    bits = F.lit(0).cast("long")
    for k, col in enumerate(flags.values()):
        bits = bits + F.when(F.col(col), F.lit(1 << k)).otherwise(0)
    by = lambda code: F.coalesce(F.bit_or(F.when(F.col(role) == code, bits)), F.lit(0).cast("long"))
    return df.groupBy(*unit, item).agg(by("N").alias("_n"), by("Q").alias("_q"), F.bool_or(high).alias("_high"))


def scaled_match(
    df: DataFrame, unit: Sequence[str], item: str, flags: Mapping[tuple[str, str], str]
) -> DataFrame:
    """Detection table at every scale and position, long: an item seen anywhere in the unit has a
    row at each position, with both flags FALSE where nobody saw it.  Expanded after the shuffle."""
    unit = list(unit)
    masks = scaled_detection(df, unit, item, flags, F.lit(False)).where((F.col("_n") + F.col("_q")) > 0)
    at = lambda mask, k: F.col(mask).bitwiseAND(F.lit(1 << k).cast("long")) != 0
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(scale).alias("scale"), F.lit(pos).alias("position"), at("_n", k).alias("n_seen"), at("_q", k).alias("q_seen")
                )
                for k, (scale, pos) in enumerate(flags)
            ]
        )
    )
    return masks.select(*unit, item, rows.alias("_r")).select(*unit, item, "_r.*")


def detection_report(
    base: DataFrame, rolled: DataFrame, unit: Sequence[str], item: str, flags: Mapping[tuple[str, str], str], high: Column
) -> DataFrame:
    """E20. Detection summaries of all items, of items with high cover, and of items rolled up to
    genus, at all scales, long: subset, scale, position.

    ``base`` and ``rolled`` carry the flags of ``presence_flags``; ``high`` is a row condition
    on ``base`` that makes its unit and item high.  A unit without detections in a subset has no rows.
    """
    unit = list(unit)
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("_high"), F.lit("high_cover"))))
    rows = (
        scaled_detection(base, unit, item, flags, high)
        .select(*unit, "_n", "_q", F.explode(subsets).alias("subset"))
        .unionByName(
            scaled_detection(rolled, unit, item, flags, F.lit(False)).select(
                *unit, "_n", "_q", F.lit("rolled_up").alias("subset")
            )
        )
    )
    n, q = F.col("_n"), F.col("_q")
    masks = {"n_only": n.bitwiseAND(F.bitwise_not(q)), "q_only": q.bitwiseAND(F.bitwise_not(n)), "matched": n.bitwiseAND(q)}
    count = lambda mask, k: F.sum(F.shiftright(mask, k).bitwiseAND(F.lit(1).cast("long")))
    wide = rows.groupBy("subset", *unit).agg(
        *[count(mask, k).alias(f"_{name}{k}") for k in range(len(flags)) for name, mask in masks.items()]
    )
    long = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(scale).alias("scale"),
                    F.lit(pos).alias("position"),
                    *[F.col(f"_{name}{k}").alias(name) for name in masks],
                )
                for k, (scale, pos) in enumerate(flags)
            ]
        )
    )
    plot = next(k for k, (scale, _) in enumerate(flags) if scale == "plot")
    seen = F.col(f"_n_only{plot}") + F.col(f"_q_only{plot}") + F.col(f"_matched{plot}")
    return (
        wide.where(seen > 0)
        .select("subset", *unit, long.alias("_r"))
        .select("subset", *unit, "_r.*")
        .select("subset", *unit, "scale", "position", *summary_columns())
    )


def unmatched_items(df: DataFrame, item: str, min_detect: int, min_pct: float = 50) -> DataFrame:
    """E21. Items with at least ``min_detect`` detection rows of which more than ``min_pct`` percent
    are unmatched, with the rank by that percent (ties share it).

    At a fine scale a row that neither survey saw counts as a row and as unmatched, as in the source
    tables."""
    rates = (
        df.groupBy(item)
        .agg(
            F.count(F.lit(1)).alias("detections"),
            F.count(F.when(~(F.col("n_seen") & F.col("q_seen")), 1)).alias("unmatched"),
        )
        .where(F.col("detections") >= min_detect)
        .withColumn("unmatched_percent", F.bround(100 * F.col("unmatched") / F.col("detections")).cast("long"))
        .where(F.col("unmatched_percent") > min_pct)
    )
    # one row per item by now; whole percents above the floor are at most 100 levels
    levels = rates.groupBy("unmatched_percent").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(F.desc("unmatched_percent")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select("unmatched_percent", (1 + F.coalesce(F.sum("_n").over(above), F.lit(0))).alias("position"))
    return rates.join(ranks, "unmatched_percent").select(
        item, "detections", "unmatched", "unmatched_percent", "position"
    )


def match_rows(df: DataFrame, unit: Sequence[str], item: str) -> DataFrame:
    """E22, long form: every item of a unit with its list (``both_surveys``, ``first_only``, ``resurvey_only``) and its position there.

    ``df`` is a detection table, one row per unit and item; any number of items per unit.
    """
    n, q = F.col("n_seen"), F.col("q_seen")
    which = F.when(n & q, "both_surveys").when(n, "first_only").when(q, "resurvey_only")
    rows = df.select(*unit, item, which.alias("list")).where("list IS NOT NULL")
    return number_in_groups(rows, [*unit, "list"], [item], "position")


def match_lists(df: DataFrame, unit: Sequence[str], item: str, joint: str = " - ", most: int = 10_000) -> DataFrame:
    """E22. Per unit three name lists: both surveys, first only, re-survey only.

    ``df`` is a detection table, one row per unit and item, so a list holds each item once; a unit has
    at most ``most`` of them (``match_rows`` has the long form).
    """
    stop = F.raise_error(F.lit(f"match_lists: more than {most} items in a unit")).cast("string")
    pick = lambda cond: F.when(F.count(F.lit(1)) > most, stop).otherwise(
        F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col(item)))), joint)
    )
    n, q = F.col("n_seen"), F.col("q_seen")
    return df.groupBy(*unit).agg(
        pick(n & q).alias("both_surveys"),
        pick(n & ~q).alias("first_only"),
        pick(~n & q).alias("resurvey_only"),
    )


def class_difference(df: DataFrame, unit: Sequence[str], item: str, value: str, role: str = "role") -> DataFrame:
    """E23. Class values of items found by both surveys and their absolute difference.

    A missing class does not drop the item; its difference is NULL.
    """
    some = df.withColumn("_v", F.coalesce(F.col(value), F.lit(0)))
    wide = pair_by_role(some, [*unit, item], role, ["_v"], {"N": "n", "Q": "q"})
    return (
        wide.na.drop(subset=["n__v", "q__v"])
        .select(
            *unit,
            item,
            F.nullif(F.col("n__v"), F.lit(0)).alias("n_class"),
            F.nullif(F.col("q__v"), F.lit(0)).alias("q_class"),
        )
        .withColumn("abs_diff", F.abs(F.col("q_class") - F.col("n_class")))
    )
