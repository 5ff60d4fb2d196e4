"""Grouped summaries and threshold bands (good, caution, concern)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.functions.order import count_and_mean, join_groups, quantiles_of_counts, value_counts
from resurvey.operators.roles import stack_metrics

# ---- fixed values ---------------------------------------------------------------
OPEN_EDGE = 99999.0  # upper edge of an open band
CUT_OFFS = {
    "woody_debris": (15, 5),
    "snag_density": (8, 3),
    "exotic_species": (0.5, 3.5),
    "tree_mortality": (1.6,),
    "tree_growth": (60,),
}
# ---------------------------------------------------------------------------------


def two_grains(df: DataFrame, keys: Sequence[str], bin_col: str) -> DataFrame:
    """Rows at the coarse grain (bin NULL) and, when the bin is known, at the fine grain too.

    The ``grain_bin`` helper key is never NULL: ``""`` stands for all bins.
    """
    b = F.col(bin_col).cast("string")
    grains = F.array_compact(
        F.array(
            F.struct(F.lit("subunit").alias("grain"), F.lit("").alias("grain_bin")),
            F.when(b.isNotNull(), F.struct(F.lit("bin").alias("grain"), b.alias("grain_bin"))),
        )
    )
    rest = [c for c in df.columns if c != bin_col]
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        *rest, F.explode(grains).alias("_g")
    ).select(*rest, "_g.*")


def subunit_summary(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """F6. Count, mean and exact median per group (see ``two_grains`` for both grains at once).

    One scan, one shuffle of distinct values with their counts; decimal values are summed exactly.
    """
    keys = list(keys)
    freq = value_counts(df, keys, y)
    mid = quantiles_of_counts(freq, keys, [0.5], ["median"])
    return join_groups(freq.groupBy(*keys).agg(*count_and_mean()), mid, keys).select(*keys, "n", "mean", "median")


def _bands(cutoffs: Sequence[float], one_is_concern: bool | None, high_is_good: bool | None):
    """(band, lower, upper) from best to worst; None as an edge is the open lower edge."""
    low, top = None, OPEN_EDGE
    if len(cutoffs) == 2:
        first, second = cutoffs
        if first < second:  # small values are good
            out = [("good", low, first), ("caution", first, second), ("concern", second, top)]
        else:
            out = [("good", first, top), ("caution", second, first), ("concern", low, second)]
        return [b for b in out if b[1] is None or b[1] <= OPEN_EDGE]
    if len(cutoffs) != 1 or one_is_concern is None or high_is_good is None:
        raise ValueError("one cut-off needs one_is_concern and high_is_good; otherwise give two")
    (cut,) = cutoffs
    if one_is_concern:
        if high_is_good:
            return [("caution", cut, top), ("concern", low, cut)]
        return [("caution", 0.0, cut), ("concern", cut, top)]
    if high_is_good:
        return [("good", cut, top), ("caution", low, cut)]
    return [("good", low, cut), ("caution", cut, top)]


def band_limits(
    df: DataFrame, y: str, cutoffs: Sequence[float], one_is_concern: bool | None = None, high_is_good: bool | None = None
) -> DataFrame:
    """F7. Bands (band, band_min, band_max); the open lower edge is min(smallest value, 0)."""
    low = F.least(F.col("_min"), F.lit(0.0))
    bands = F.array(
        *[
            F.struct(
                F.lit(name).alias("band"),
                (low if a is None else F.lit(float(a))).alias("band_min"),
                F.lit(float(b)).alias("band_max"),
            )
            for name, a, b in _bands(cutoffs, one_is_concern, high_is_good)
        ]
    )
    return df.agg(F.min(y).cast("double").alias("_min")).select(F.explode(bands).alias("_b")).select("_b.*")


def close_bands(bands: DataFrame, summary: DataFrame, param: str, values: Sequence[str]) -> DataFrame:
    """F8. Replace the open edge, per parameter, by the larger of the largest summary value or
    interval end and 1.2 times the largest finite edge."""
    largest = F.greatest(*[F.max(c) for c in values]) if len(values) > 1 else F.max(values[0])
    top = summary.groupBy(param).agg(largest.alias("_top"))
    finite = bands.groupBy(param).agg(F.max(F.when(F.col("band_max") != OPEN_EDGE, F.col("band_max"))).alias("_fin"))
    closed = F.when(F.col("band_max") == OPEN_EDGE, F.greatest(F.col("_top"), 1.2 * F.col("_fin")))
    return (
        bands.join(top, param, "left")
        .join(finite, param, "left")
        .withColumn("band_max", F.coalesce(closed, F.col("band_max")))
        .drop("_top", "_fin")
    )


def band_status(summary: DataFrame, bands: DataFrame, param: str, value: str) -> DataFrame:
    """F9. Band of every summary value, lower edge included.

    A parameter has at most three bands, so they travel as one small array per parameter and
    the join is an equi-join, not a range join.
    """
    listed = bands.groupBy(param).agg(
        F.array_sort(F.collect_list(F.struct("band_min", "band_max", "band"))).alias("_bands")
    )
    v = F.col(value)
    hits = F.filter("_bands", lambda b: (b["band_min"] <= v) & (v < b["band_max"]))
    last = F.element_at("_bands", -1)
    status = F.when(F.size(hits) > 0, F.element_at(hits, 1)["band"]).when(v == last["band_max"], last["band"])
    return summary.join(listed, param, "left").withColumn("status", status).drop("_bands")


def threshold_table(
    tables: Mapping[str, DataFrame], stat: str, by_bin: bool = False, param: str | None = None, unit: str | None = None,
    summarize: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """F10. One long table over parameters with the mean or median and its 68 and 95 percent limits.

    A summary holds grain, unit, subunit, grain_bin, period, n, mean, median and the limits of
    ``mean_median_interval``.  ``param`` keeps one parameter, ``unit`` one unit, ``by_bin`` the
    fine grain instead of the coarse one.  ``tables`` are summaries; for a parameter that
    ``summarize`` names it is the measured rows (see ``two_grains``), of which the wanted groups
    alone are then summarized and resampled: no predicate passes a Python node by itself.
    """
    if stat not in ("mean", "median"):
        raise ValueError(f"stat must be 'mean' or 'median', not {stat!r}")
    wanted = {}
    for name, df in tables.items():
        if param not in (None, name):
            continue
        rows = df.where(F.col("grain") == ("bin" if by_bin else "subunit"))
        rows = rows if unit is None else rows.where(F.col("unit") == unit)
        wanted[name] = summarize[name](rows) if summarize and name in summarize else rows
    return stack_metrics(wanted, "param").select(
        "param",
        "unit",
        "subunit",
        F.nullif(F.col("grain_bin"), F.lit("")).alias("bin"),
        "period",
        "n",
        F.col(stat).alias("value"),
        *[F.col(f"{stat}_{q}").alias(q) for q in ("lo68", "hi68", "lo95", "hi95")],
    )
