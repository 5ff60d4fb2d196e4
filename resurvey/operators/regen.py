"""Regeneration: survey counts, box counts, tree counts, sustainability index, importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resurvey.functions.order import count_and_mean, join_groups, quantiles_of_counts, value_counts
from resurvey.operators.clean import cycle_display, cycle_label
from resurvey.operators.reshape import complete_grid, pair_by_role
from resurvey.session import written

# ---- fixed values ---------------------------------------------------------------
PLOT_M2 = 400  # plot area
SEED_M2 = 8  # eight corners of 1 m2 for seedlings
SAPLING_M2 = 80  # eight corners of 10 m2 for saplings
HECTARE_M2 = 10000
SEED_FACTOR = 50  # seedlings to the plot
SAPLING_FACTOR = 5  # saplings to the plot
IMPORTANCE_POINTS = {"p1": 1, "p2": 2, "p10": 10, "p50": 50}
# ---------------------------------------------------------------------------------

INDEX_CLASSES = {
    "seedlings": ["seed5_15", "seed15_30", "seed30_50", "seed50_137"],
    "small_saplings": ["sap0_1", "sap1_25"],
    "large_saplings": ["sap25_5", "sap5_10"],
}
IMPORTANCE_CLASSES = {
    "p1": ["seed5_15", "seed15_30"],
    "p2": ["seed30_50"],
    "p10": ["seed50_137"],
    "p50": ["sap0_1", "sap1_25", "sap25_5", "sap5_10"],
}
BOX_CLASSES = ["sap0_1", "sap1_25", "sap25_5"]


def total(cols: Sequence[str]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0))


def resurvey_counts(df: DataFrame, area: str, plot: str, event: str, cycle: str, role: str) -> DataFrame:
    """F11. Per area: units, units with more than one first survey, and re-surveyed unit-cycles."""
    n, q = F.col(role) == "N", F.col(role) == "Q"
    per_cycle = (
        df.groupBy(area, plot, cycle, event, role)
        .agg(F.lit(1).alias("_x"))
        .groupBy(area, plot, cycle)
        .agg(F.count(F.when(n, 1)).alias("_n"), F.max(F.when(q, 1).otherwise(0)).alias("_q"))
    )
    per_plot = per_cycle.groupBy(area, plot).agg(F.sum("_n").alias("_n"), F.sum("_q").alias("_q"))
    return per_plot.groupBy(area).agg(
        F.count(F.lit(1)).alias("units"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("resurveyed"),
        F.sum("_q").alias("quality_surveys"),
    )


def box_counts(
    df: DataFrame, event: Sequence[str], corner: str, target: str, classes: Sequence[str], n_boxes: int
) -> DataFrame:
    """F12. Target-species counts of the first ``n_boxes`` numbered boxes of every event, zero-filled.

    Corners with a count are numbered in corner order.  More corners than boxes is an error
    (see ``too_many_children``), never a silent cut.
    """
    event = list(event)
    boxes = df.where(F.col(target)).groupBy(*event, corner).agg(F.sum(total(classes)).alias("box_count"))
    number = F.row_number().over(Window.partitionBy(*event).orderBy(corner)).cast("long")
    stop = F.raise_error(F.lit("box_counts: more corners than boxes")).cast("long")
    numbered = boxes.withColumn("_no", number).select(
        *event, F.when(F.col("_no") <= n_boxes, F.col("_no")).otherwise(stop).alias("box"), "box_count"
    )
    grid = df.select(*event).distinct().withColumn("box", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_boxes).cast("long"))))
    return grid.join(numbered, event + ["box"], "left").fillna(0, subset=["box_count"])


def module_tree_counts(
    df: DataFrame, event: Sequence[str], lo: float | None, hi: float | None, modules: Sequence[int], targets: Sequence[bool] = (True, False),
    role: str | None = "N",
) -> DataFrame:
    """F13. Live trees of one role (first survey by default) within the size range per module and
    target flag, zero-filled for events with any such tree.  ``None`` leaves a side of the range
    open; role None counts all roles, which then belong into ``event``."""
    keep = (F.col("status") == 1) & F.col("target").isin(list(targets))
    if role is not None:
        keep = keep & (F.col("role") == role)
    if lo is not None:
        keep = keep & (F.col("dbh") >= lo)
    if hi is not None:
        keep = keep & (F.col("dbh") <= hi)
    counts = df.where(keep).groupBy(*event, "target", "module").agg(F.count(F.lit(1)).alias("trees"))
    return complete_grid(counts, event, {"target": list(targets), "module": list(modules)}, ["trees"])


def ratio(part: Column, other: Column) -> Column:
    """Share of ``part``; undefined (nothing counted or a side missing) is 0."""
    return F.coalesce(F.try_divide(part, part + other), F.lit(0.0))


def index_columns(s: str, t: str) -> tuple[Column, Column]:
    """Seed and sapling densities of one target side from its sums (prefix ``s``, trees ``t``)."""
    seed = F.bround(SEED_FACTOR * F.col(f"{s}_seedlings") + SAPLING_FACTOR * F.col(f"{s}_small_saplings"))
    sap = F.bround(SAPLING_FACTOR * F.col(f"{s}_large_saplings") + F.coalesce(F.col(t), F.lit(0)))
    return seed, sap


def regen_index(df: DataFrame, trees: DataFrame, event: Sequence[str], classes: Mapping[str, Sequence[str]] = INDEX_CLASSES) -> DataFrame:
    """F14. Sustainability index of every event: seed ratio + sapling ratio, each target share
    between 0 and 1.

    ``df``: corner rows with the size ``classes`` and ``target``; ``trees``: counts of F13.
    """
    event = list(event)
    aggs, tree_aggs = [], []
    for side, is_side in (("t", F.col("target")), ("o", ~F.col("target"))):
        for name, cols in classes.items():
            aggs.append(F.coalesce(F.sum(F.when(is_side, total(cols))), F.lit(0)).alias(f"{side}_{name}"))
        tree_aggs.append(F.sum(F.when(is_side, F.col("trees"))).alias(f"{side}_trees"))
    sums = df.groupBy(*event).agg(*aggs).join(trees.groupBy(*event).agg(*tree_aggs), event, "left")
    seed_t, sap_t = index_columns("t", "t_trees")
    seed_o, sap_o = index_columns("o", "o_trees")
    return (
        sums.withColumn("seed_ratio", ratio(seed_t, seed_o))
        .withColumn("sap_ratio", ratio(sap_t, sap_o))
        .withColumn("regen_index", F.col("seed_ratio") + F.col("sap_ratio"))
        .select(*event, "seed_ratio", "sap_ratio", "regen_index")
    )


def importance_value(p1: Column, p2: Column, p10: Column, p50: Column, trees: Column) -> Column:
    """Natural log of the weighted counts per hectare plus one."""
    w = IMPORTANCE_POINTS
    per_seed, per_sap, per_tree = HECTARE_M2 / SEED_M2, HECTARE_M2 / SAPLING_M2, HECTARE_M2 / PLOT_M2
    points = (
        p1 * w["p1"] * per_seed
        + p2 * w["p2"] * per_seed
        + p10 * w["p10"] * per_seed
        + p50 * w["p50"] * per_sap
        + trees * w["p50"] * per_tree
    )
    return F.log1p(points)


def importance_score(df: DataFrame, trees: DataFrame, event: Sequence[str]) -> DataFrame:
    """F15. Importance of the target species of every event; ``df`` and ``trees`` as in F14."""
    event = list(event)
    sums = df.where("target").groupBy(*event).agg(
        *[F.sum(total(cols)).alias(name) for name, cols in IMPORTANCE_CLASSES.items()]
    )
    tree = trees.where("target").groupBy(*event).agg(F.sum("trees").alias("_trees"))
    value = importance_value(
        *[F.col(c) for c in IMPORTANCE_CLASSES], F.coalesce(F.col("_trees"), F.lit(0))
    )
    return sums.join(tree, event, "left").select(*event, value.alias("importance"))


def regen_table(
    metrics: DataFrame,
    history: DataFrame,
    plot: str,
    cycles: Sequence[int],
    keys: Sequence[str],
    origin: int,
    width: int,
) -> DataFrame:
    """F16. Every unit x every cycle with its indices, survey date, burn flags and cycle labels.

    ``metrics`` has one row per event (plot, cycle_no, keys, values); ``history`` the answers of
    the as-of operators per ``keys``.  Cycles without a survey keep NULL values and a FALSE
    ``event_since``.  ``metrics`` may be costly (bootstrap intervals) and is needed twice, for the units and
    for their values, so it is computed once and written.
    """
    metrics = written(metrics, "metrics")
    rows = metrics.join(history, list(keys), "left")
    grid = metrics.select(plot).distinct().withColumn(
        "cycle_no", F.explode(F.array(*[F.lit(c).cast("long") for c in cycles]))
    )
    return (
        grid.join(rows, [plot, "cycle_no"], "left")
        .fillna(False, subset=["event_since"])
        .withColumn("cycle", cycle_label(F.col("cycle_no"), origin, width))
        .withColumn("cycle_display", cycle_display(F.col("cycle_no"), origin, width))
    )


def role_index_difference(df: DataFrame, unit: Sequence[str], role: str, value: str) -> DataFrame:
    """F17. Difference first survey minus re-survey of an index: pairs, mean, 5 and 95 percentiles."""
    wide = pair_by_role(df, unit, role, [value], {"N": "n", "Q": "q"})
    d = wide.select(F.lit(1).alias("_all"), (F.col(f"n_{value}") - F.col(f"q_{value}")).alias("_d")).where("_d IS NOT NULL")
    freq = value_counts(d, ["_all"], "_d")
    plain = freq.groupBy("_all").agg(*count_and_mean("pairs", "mean_difference"))
    return plain.join(quantiles_of_counts(freq, ["_all"], [0.05, 0.95], ["p05", "p95"]), "_all").drop("_all")


def box_stats(df: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    """F19. Quartiles, whiskers at the most extreme value within 1.5 IQR, and outlier count per group."""
    group = list(group)
    freq = value_counts(df, group, col)
    q = quantiles_of_counts(freq, group, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return (
        join_groups(freq, q, group)
        .groupBy(*group, "q1", "median", "q3")
        .agg(
            F.sum("_f").alias("n"),
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_f"))).cast("long").alias("outliers"),
        )
    )


def shares(mapping: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Sums of size classes as named columns."""
    return {name: total(cols) for name, cols in mapping.items()}
