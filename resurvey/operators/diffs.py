"""Paired differences, frequency tables, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resurvey.functions.order import count_and_mean, fill_levels, join_groups, quantiles_of_counts, running_total, value_counts
from resurvey.operators.reshape import complete_grid, pair_by_role

ROLE_MAP = {"N": "n", "Q": "q"}


def paired_difference(
    df: DataFrame, n: str, q: str, kind: str = "abs", tolerances: Sequence[int] = (1, 2)
) -> DataFrame:
    """E1. ``pair_mean``, ``diff`` = q - n, ``metric`` and one flag per tolerance.

    ``abs``: metric = diff, flag ``within_k`` = |metric| <= k.
    ``percent``: metric = round(100 * diff / mean), flag = |metric| < k.
    """
    out = df.withColumn("pair_mean", (F.col(n) + F.col(q)) / 2).withColumn("diff", F.col(q) - F.col(n))
    if kind == "abs":
        out = out.withColumn("metric", F.col("diff"))
        return out.withColumns({f"within_{k}": F.abs("metric") <= k for k in tolerances})
    if kind == "percent":
        pct = F.bround(F.try_divide(100 * F.col("diff"), F.col("pair_mean")))
        out = out.withColumn("metric", pct)
        return out.withColumns({f"within_{k}": F.abs("metric") < k for k in tolerances})
    raise ValueError(f"kind must be 'abs' or 'percent', not {kind!r}")


def role_counts(
    df: DataFrame, unit: Sequence[str], role: str, role_map: Mapping[str, str] = ROLE_MAP,
    sub: str | None = None, sub_levels: Sequence = (),
) -> DataFrame:
    """E2. Records per unit (x sub-position) in one column per role, 0 when absent.

    With ``sub`` every unit gets every level of ``sub_levels``.
    """
    keys = list(unit) + ([sub] if sub else [])
    counts = df.groupBy(*keys).agg(
        *[F.count(F.when(F.col(role) == code, 1)).alias(f"{p}_count") for code, p in role_map.items()]
    )
    if not sub:
        return counts
    return complete_grid(counts, unit, {sub: sub_levels}, [f"{p}_count" for p in role_map.values()])


def role_means(df: DataFrame, unit: str, role: str, sub: str, value: str) -> DataFrame:
    """E3. Mean per role at unit and at unit x sub grain.

    One scan: the sub grain keeps sum and count, the unit grain is their roll-up.
    """
    parts = []
    for code, p in ROLE_MAP.items():
        here = F.when(F.col(role) == code, F.col(value))
        parts += [F.sum(here).alias(f"_{p}_s"), F.count(here).alias(f"_{p}_c")]
    grains = df.groupBy(unit, sub).agg(*parts).rollup(unit, sub)
    sums = [F.sum(c).alias(c) for c in ("_n_s", "_n_c", "_q_s", "_q_c")]
    return (
        grains.agg(F.grouping_id().alias("_g"), *sums)
        .where(F.col("_g") < 3)
        .select(
            F.when(F.col("_g") == 0, "sub").otherwise("unit").alias("grain"),
            unit,
            sub,
            F.try_divide("_n_s", "_n_c").alias("n_mean"),
            F.try_divide("_q_s", "_q_c").alias("q_mean"),
        )
    )


def role_class_sums(
    df: DataFrame, unit: Sequence[str], role: str, sub: str, sub_levels: Sequence, cols: Sequence[str]
) -> DataFrame:
    """E4. Sum of every class column per unit x sub x role on the full sub grid, long by class."""
    unit = list(unit)
    aggs = []
    for code, p in ROLE_MAP.items():
        here = F.col(role) == code
        aggs += [F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0)).alias(f"{p}_{c}") for c in cols]
    sums = df.groupBy(*unit, sub).agg(*aggs)
    full = complete_grid(sums, unit, {sub: sub_levels}, [f"{p}_{c}" for p in ROLE_MAP.values() for c in cols])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("size_class"), F.col(f"n_{c}").alias("n_sum"), F.col(f"q_{c}").alias("q_sum"))
                for c in cols
            ]
        )
    )
    return full.select(*unit, sub, rows.alias("_r")).select(*unit, sub, "_r.*")


def difference_cdf(df: DataFrame, col: str, by: Sequence[str] = (), width: float = 1.0) -> DataFrame:
    """E5. Frequency of absolute differences on the grid ``k * width`` from smallest to largest,
    empty levels kept, and the cumulative percent to one decimal.

    Values are assigned to the nearest grid level, so off-grid values are counted, not lost.
    """
    by = list(by)
    freq = (
        df.where(F.col(col).isNotNull())
        .select(*by, F.bround(F.abs(F.col(col)) / width).cast("long").alias("level"))
        .groupBy(*by, "level")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    return (
        fill_levels(freq, by, "level", "frequency")
        .withColumn("cdf", F.bround(100 * F.col("_upto") / F.col("_total"), 1))
        .select(*by, (F.col("level") * F.lit(float(width))).alias("difference"), "frequency", "cdf")
    )


def difference_freq(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """E6. Frequency of the absolute differences that occur."""
    return (
        df.where(F.col(col).isNotNull())
        .select(*by, F.abs(F.col(col)).alias("difference"))
        .groupBy(*by, "difference")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def interval_freq(
    df: DataFrame, col: str, step: float, by: Sequence[str] = (), include_zero: bool = False
) -> DataFrame:
    """E7. Frequency of absolute differences in (0,1], (1,step], (step,2*step], ... up to the
    data maximum, empty intervals kept.  A difference of zero lies in no interval unless
    ``include_zero``."""
    by = list(by)
    a = F.abs(F.col(col))
    number = F.when(a <= 1, 0).otherwise(F.ceil(a / step)).cast("long")
    rows = df.where(F.col(col).isNotNull()).select(*by, a.alias("_a"), number.alias("_no"))
    counted = F.count(F.lit(1)) if include_zero else F.count(F.when(F.col("_a") > 0, 1))
    freq = rows.groupBy(*by, "_no").agg(counted.alias("frequency"))
    k = F.col("_no")
    return fill_levels(freq, by, "_no", "frequency", from_zero=True).select(
        *by,
        F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise((k - 1) * F.lit(float(step))).alias("above"),
        F.when(k == 0, 1.0).otherwise(k * F.lit(float(step))).alias("up_to"),
        "frequency",
    )


def ecdf_at(df: DataFrame, col: str, step: float, by: Sequence[str] = ()) -> DataFrame:
    """E8. Rounded percent of absolute values at or below 0, step, 2*step, ... up to one step
    above the first grid point covering the maximum.  Rows are counted per grid interval, then
    a running sum runs over the intervals."""
    by = list(by)
    freq = (
        df.where(F.col(col).isNotNull())
        .select(*by, F.ceil(F.abs(F.col(col)) / step).cast("long").alias("level"))
        .groupBy(*by, "level")
        .agg(F.count(F.lit(1)).alias("_f"))
    )
    return fill_levels(freq, by, "level", "_f", from_zero=True, extra=1).select(
        *by,
        (F.col("level") * F.lit(float(step))).alias("up_to"),
        F.bround(100 * F.col("_upto") / F.col("_total")).alias("cum_percent"),
    )


def ecdf(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """E28. Every distinct absolute value with the share of values at or below it."""
    by = list(by)
    freq = difference_freq(df, col, by)
    total = freq.groupBy(*by).agg(F.sum("frequency").alias("_total"))
    upto = running_total(freq, by, "difference", "frequency", "_upto")
    if by:
        upto = join_groups(upto, total, by)
        share = F.col("_upto") / F.col("_total")
    else:
        share = F.col("_upto") / total.scalar()
    return upto.select(*by, "difference", "frequency", share.alias("share"))


def joint_counts(df: DataFrame, n: str, q: str) -> DataFrame:
    """E24. Count of every (n, q) value pair, with the modal count flagged."""
    counts = df.groupBy(n, q).agg(F.count(F.lit(1)).alias("pairs"))
    modal = counts.agg(F.max("pairs").alias("m")).scalar()
    return counts.withColumn("modal_count", modal).withColumn("is_modal", F.col("pairs") == F.col("modal_count"))


def bland_altman(df: DataFrame, n: str, q: str, by: Sequence[str] = ()) -> DataFrame:
    """E25. Bias and the 2.5 and 97.5 percentiles of q - n, with the pair count."""
    by = list(by)
    d = df.withColumn("_d", (F.col(q) - F.col(n)).cast("double"))
    if not by:
        d = d.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    freq = value_counts(d, keys, "_d")
    limits = quantiles_of_counts(freq, keys, [0.025, 0.975], ["lower_limit", "upper_limit"])
    return join_groups(freq.groupBy(*keys).agg(*count_and_mean("pairs", "bias")), limits, keys).drop("_all")


def bland_altman_points(df: DataFrame, n: str, q: str) -> DataFrame:
    """E25. The plotted points: mean and difference of every pair."""
    return df.withColumn("pair_mean", (F.col(n) + F.col(q)) / 2).withColumn("diff", F.col(q) - F.col(n))


def numeric_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """E26. min, q1, median, mean, q3, max per column (and group), long."""
    by, numbers = list(by), [F.col(c).cast("double").alias(c) for c in cols]
    long = df.select(*by, *numbers).unpivot(by, list(cols), "variable", "value")
    keys = [*by, "variable"]
    freq = value_counts(long, keys, "value")
    plain = freq.groupBy(*keys).agg(F.min("_v").alias("minimum"), F.max("_v").alias("maximum"), *count_and_mean())
    mid = quantiles_of_counts(freq, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return join_groups(plain, mid, keys).select(*keys, "minimum", "q1", "median", "mean", "q3", "maximum")


def histogram(df: DataFrame, col: str, width: float, center: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """E27. Bars of equal width with one bar centred on ``center``; edges belong to the bar above."""
    number = F.floor((F.col(col) - center) / width + 0.5).cast("long")
    return (
        df.where(F.col(col).isNotNull())
        .select(*by, number.alias("_no"))
        .groupBy(*by, "_no")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .select(*by, (F.col("_no") * F.lit(float(width)) + F.lit(float(center))).alias("bar_center"), "frequency")
    )


def pair_values(df: DataFrame, unit: Sequence[str], role: str, value: str, role_map: Mapping[str, str] = ROLE_MAP) -> DataFrame:
    """Both role values of complete pairs as columns ``n_val`` and ``q_val``."""
    wide = pair_by_role(df, unit, role, [value], role_map)
    return wide.select(
        *unit, F.col(f"n_{value}").alias("n_val"), F.col(f"q_{value}").alias("q_val")
    ).na.drop(subset=["n_val", "q_val"])


def zero_zero_share(df: DataFrame, n: str, q: str) -> DataFrame:
    """K6. Rounded percent of pairs that are 0-0, and the largest count of any survey."""
    zero: Column = F.when((F.col(n) == 0) & (F.col(q) == 0), 1).otherwise(0)
    return df.agg(
        F.bround(100 * F.avg(zero)).alias("zero_zero_percent"),
        F.max(F.greatest(F.col(n), F.col(q))).cast("double").alias("max_count"),
    )
