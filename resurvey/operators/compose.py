"""Composition of units: richness, cover, leading items, priority items, map metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resurvey.functions.order import number_in_groups
from resurvey.operators.clean import plain_number


def composition(df: DataFrame, unit: Sequence[str], exotic: str, confirmed: Column, cover: str) -> DataFrame:
    """F1. Per unit and type (native, exotic): richness = species-level rows, cover, total cover of
    both types, relative cover percent.  An absent type gives 0.  One aggregate, then two rows per unit."""
    unit = list(unit)
    aggs = [F.sum(cover).alias("total_cover")]
    for name, is_type in (("native", ~F.col(exotic)), ("exotic", F.col(exotic))):
        aggs.append(F.count(F.when(is_type & confirmed, 1)).alias(f"_{name}_rich"))
        aggs.append(F.coalesce(F.sum(F.when(is_type, F.col(cover))), F.lit(0.0)).alias(f"_{name}_cover"))
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("type"),
                    F.col(f"_{name}_rich").alias("richness"),
                    F.col(f"_{name}_cover").alias("cover"),
                )
                for name in ("native", "exotic")
            ]
        )
    )
    return (
        df.groupBy(*unit)
        .agg(*aggs)
        .select(*unit, "total_cover", rows.alias("_r"))
        .select(*unit, "_r.*", "total_cover")
        .withColumn("rel_cover", F.bround(F.try_divide(100 * F.col("cover"), F.col("total_cover")), 2))
    )


def item_totals(df: DataFrame, group: Sequence[str], item: str, cover: str) -> DataFrame:
    """F2. Frequency and total cover of every item per group."""
    return df.groupBy(*group, item).agg(F.count(F.lit(1)).alias("freq"), F.sum(cover).alias("cover"))


def top_items(totals: DataFrame, group: Sequence[str], item: str, by: str, k: int) -> DataFrame:
    """F3. Top-k items per group, ties at the boundary kept: one row per item with its position, ties by name.

    Spark cuts every map partition to rank <= k before the shuffle; what remains, ties included, is
    numbered by ranges, so any number of tied items will do.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(by))
    ranked = totals.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= k)
    return number_in_groups(ranked, group, ["_rank", item], "position").drop("_rank")


# Items that one text may list.
MOST_LISTED = 10_000


def listed_text(position: str, text: Column, joint: str, name: str) -> Column:
    """Aggregate: texts in the order of ``position``, joined; more than ``MOST_LISTED`` in a group are an error."""
    stop = F.raise_error(F.lit(f"more than {MOST_LISTED} items in one text; use the long form")).cast("string")
    parts = F.collect_list(F.struct(F.col(position).alias("p"), text.alias("t")))
    return F.when(F.count(F.lit(1)) > MOST_LISTED, stop).otherwise(F.array_join(F.transform(F.array_sort(parts), lambda x: x["t"]), joint)).alias(name)


def top_list(totals: DataFrame, group: Sequence[str], item: str, by: str, k: int) -> DataFrame:
    """F3. The top-k items of each group as one text, best first, ties by name.

    For groups of few ties (``MOST_LISTED`` items in all); ``top_items`` has the long form.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(by))
    ranked = totals.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= k)
    ordered = ranked.withColumn("_place", F.struct("_rank", item))
    return ordered.groupBy(*group).agg(listed_text("_place", F.translate(F.col(item), "_", " "), ", ", "top_items"))


def priority_item_cover(
    df: DataFrame, unit: Sequence[str], item: str, cover: str, items: Sequence[str]
) -> DataFrame:
    """F4. Cover of every listed item on every unit, zero when absent, with relative cover and presence.

    The list is a parameter: each unit gets one conditional sum per item in the aggregate that
    also makes the total, then one row per item.
    """
    unit = list(unit)
    aggs = [F.sum(cover).alias("total_cover")]
    aggs += [
        F.coalesce(F.sum(F.when(F.col(item) == name, F.col(cover))), F.lit(0.0)).alias(f"_p{i}")
        for i, name in enumerate(items)
    ]
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("item"), F.col(f"_p{i}").alias("cover")) for i, n in enumerate(items)])
    )
    return (
        df.groupBy(*unit)
        .agg(*aggs)
        .select(*unit, "total_cover", rows.alias("_r"))
        .select(*unit, "_r.*", "total_cover")
        .withColumn("rel_cover", F.bround(F.try_divide(100 * F.col("cover"), F.col("total_cover")), 2))
        .withColumn("present", F.col("rel_cover") > 0)
    )


def unit_metrics(
    comp: DataFrame, priority: DataFrame, keys: Sequence[str], plot: str, year: str, extra: Mapping[str, DataFrame] | None = None,
    line_end: str = "<br/>",
) -> DataFrame:
    """F5. Map-ready rows: (keys, metric, item, value, label).

    ``keys`` are the unit columns incl. coordinates.  ``extra`` adds further metrics that
    already carry ``value`` and ``label``; ``line_end`` breaks the lines of a label.
    """
    keys = list(keys)
    head = F.concat(F.col(plot), F.lit(" ("), F.col(year).cast("string"), F.lit(")"))
    none = F.lit(None).cast("string")

    def row(metric: str, value: Column, text: Column, what: str, item: Column = none) -> Column:
        label = F.concat(head, F.lit(":" + line_end), text, F.lit(what))
        return F.struct(F.lit(metric).alias("metric"), item.alias("item"), value.cast("double").alias("value"), label.alias("label"))

    rich, pct = F.col("richness"), plain_number(F.col("rel_cover"))
    exotic = F.array(
        row("exotic_cover", F.col("rel_cover"), pct, "% exotic cover"),
        row("exotic_richness", rich, rich.cast("string"), " exotic herb species"),
    )
    native = F.array(row("native_richness", rich, rich.cast("string"), " native herb species"))
    # one row of the composition gives all its metrics, so it is computed once
    out = comp.select(*keys, F.explode(F.when(F.col("type") == "exotic", exotic).when(F.col("type") == "native", native)).alias("_m"))
    listed = row("priority_cover", F.col("rel_cover"), pct, "% cover", F.translate(F.col("item"), "_", " "))
    out = out.unionByName(priority.select(*keys, listed.alias("_m"))).select(*keys, "_m.*")
    for metric, df in (extra or {}).items():
        more = df.select(*keys, F.lit(metric).alias("metric"), none.alias("item"), F.col("value").cast("double").alias("value"), "label")
        out = out.unionByName(more)
    return out
