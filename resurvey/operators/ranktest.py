"""Paired signed-rank test per group."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rank sums up to this one are counted; their numbers of subsets stay below 1e160.
COUNTED = 40_000


@lru_cache(maxsize=16)
def _subset_counts(n: int) -> np.ndarray:
    """Subsets of the ranks 1 .. n with a sum of at most v, for v = 0 .. min(COUNTED, half of all ranks' sum).

    Counts are only added, so their relative error stays near n roundings.
    """
    top = min(COUNTED, n * (n + 1) // 4)
    ways = np.zeros(top + 1)
    ways[0] = 1
    for rank in range(1, min(n, top) + 1):
        ways[rank:] += ways[:-rank].copy()
    return np.cumsum(ways)


def _tilted_log_tail(n: int, v: int) -> float:
    """log P(V <= v) for v below the mean, by Fourier inversion of the distribution tilted to have its mean at v.

    Under weights exp(t * V) rank k counts with probability 1 / (1 + exp(-t * k)).  The tilted
    distribution is wide and smooth here, so that a few frequencies hold all of it that a double
    can show, and its values near v are not small: nothing cancels, however small the tail.
    """
    k = np.arange(1, n + 1, dtype=float)
    low, high = -50.0, 0.0
    for _ in range(200):
        t = (low + high) / 2
        if (k / (1 + np.exp(np.minimum(-t * k, 700)))).sum() < v:
            low = t
        else:
            high = t
        if high - low <= 1e-14 * -t:
            break
    p = 1 / (1 + np.exp(np.minimum(-t * k, 700)))
    sigma = math.sqrt((k * k * p * (1 - p)).sum())
    period = 2 * math.ceil(20 * sigma)  # the distribution lies well inside one period
    depth = period // 2
    total = 0.0
    for j in range(math.ceil(10 * period / (2 * math.pi * sigma)) + 1):
        theta = 2 * math.pi * j / period
        log_phi = np.log1p(p * np.expm1(1j * theta * k)).sum()
        step = complex(t, theta)
        terms = depth + 1 if abs(step) < 1e-12 else (1 - np.exp(step * (depth + 1))) / (1 - np.exp(step))
        value = (np.exp(log_phi - 1j * ((theta * v) % (2 * math.pi))) * terms).real
        total += value if j == 0 else 2 * value
    log_weight = np.logaddexp(0, t * k).sum() - n * math.log(2) - t * v
    return log_weight + math.log(total / period)


def null_log_tail(n: int, v: int) -> float:
    """log P(V <= v) of the rank sum V under the null hypothesis, no ties; exact at every n."""
    pairs = n * (n + 1) // 2
    if v < 0:
        return -math.inf
    if v >= pairs:
        return 0.0
    if 2 * v >= pairs:  # the two tails mirror each other
        return math.log1p(-math.exp(null_log_tail(n, pairs - v - 1)))
    if v <= COUNTED:
        return math.log(_subset_counts(n)[v]) - n * math.log(2)
    return _tilted_log_tail(n, v)


def null_quantile(n: int, p: float) -> int:
    """The smallest v with P(V <= v) >= p, for p up to one half."""
    low, high = 0, n * (n + 1) // 4 + 1
    while low < high:
        mid = (low + high) // 2
        if null_log_tail(n, mid) >= math.log(p):
            high = mid
        else:
            low = mid + 1
    return low


def walsh_order_statistic(v: np.ndarray, f: np.ndarray, rank: int) -> int:
    """The ``rank``-th smallest (from 1) of all sums v_i + v_j, i <= j, values repeated f times.

    Integer bisection with a count by sorted lookup; no pair is ever listed.
    """
    cum = np.concatenate([[0], np.cumsum(f)])

    def count(s: int) -> int:
        ordered = int((f * cum[np.searchsorted(v, s - v, side="right")]).sum())
        return (ordered + int(cum[np.searchsorted(2 * v, s, side="right")])) // 2

    low, high = int(2 * v[0]), int(2 * v[-1])
    while low < high:
        mid = (low + high) // 2
        if count(mid) >= rank:
            high = mid
        else:
            low = mid + 1
    return low


def signed_rank(v: np.ndarray, f: np.ndarray, level: float) -> dict:
    """Statistic, two-sided p and location shift of integer differences ``v`` with counts ``f``."""
    keep = v != 0
    zeros = int(f[~keep].sum())
    v, f = v[keep], f[keep].astype(np.int64)
    n = int(f.sum())
    if n == 0:
        return {"v": 0.0, "p": None, "log_p": None, "shift2": 0, "lo2": None, "hi2": None, "method": None}
    size, inverse = np.unique(np.abs(v), return_inverse=True)
    ties = np.bincount(inverse, weights=f)
    mean_rank = np.cumsum(ties) - (ties - 1) / 2
    stat = float((f * mean_rank[inverse])[v > 0].sum())
    pairs = n * (n + 1) // 2
    exact = zeros == 0 and ties.max() == 1
    alpha = 1 - level
    if exact:
        tail = min(int(stat), pairs - int(stat))
        log_p = min(0.0, math.log(2) + null_log_tail(n, tail))
        order = max(1, null_quantile(n, alpha / 2))
    else:
        z = stat - pairs / 2
        spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48)
        z = (z - math.copysign(0.5, z) * (z != 0)) / spread
        log_p = min(0.0, _log_erfc(abs(z) / math.sqrt(2)))
        quantile = _normal_quantile(1 - alpha / 2)
        order = max(1, int(math.floor(pairs / 2 - quantile * math.sqrt(n * (n + 1) * (2 * n + 1) / 24))))
    middle = [walsh_order_statistic(v, f, r) for r in ((pairs + 1) // 2, pairs // 2 + 1)]
    return {
        "v": stat,
        "p": math.exp(log_p),
        "log_p": log_p,
        "method": "exact" if exact else "normal",
        "shift2": sum(middle) / 2,
        "lo2": walsh_order_statistic(v, f, order),
        "hi2": walsh_order_statistic(v, f, pairs + 1 - order),
    }


def _log_erfc(x: float) -> float:
    """log erfc(x) for x >= 0, also where erfc(x) itself is too small for a double."""
    if x < 20:
        return math.log(math.erfc(x))
    y = 1 / (2 * x * x)
    return -x * x - math.log(x * math.sqrt(math.pi)) + math.log1p(-y * (1 - 3 * y * (1 - 5 * y)))


def _normal_quantile(p: float) -> float:
    low, high = -10.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        if math.erfc(-mid / math.sqrt(2)) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def signed_rank_by_group(
    df: DataFrame, group: Sequence[str], unit: str, cycle: str, value: str, first: int, last: int,
    min_n: int = 6, digits: int = 2, level: float = 0.9,
) -> DataFrame:
    """G6. Signed-rank test of ``value`` in the last against the first cycle, per group.

    One row per unit and cycle; two are an error.  As in the source tables the values are rounded to ``digits``
    first, so a group is a short table of distinct differences with counts whatever its number of
    units, and that table is all a task receives.  Groups below ``min_n`` pairs get NULLs.
    Zero differences are left out of the ranks.  p is exact without ties or zeros, whatever the
    number of pairs (which rounding bounds, as no two differences of such a group are equal in
    size), otherwise the normal approximation with tie and continuity correction; ``method`` tells
    which.  ``log_p`` is the logarithm of p, which stays finite where p is too small for a double.
    The interval is read from the ordered pairwise averages.
    """
    group = list(group)
    scale = 10**digits
    stop = F.raise_error(F.lit("signed_rank_by_group: more than one row for a unit and cycle")).cast("double")

    def side(c: int):
        one = F.when(F.col(cycle) == c, F.bround(F.col(value), digits))
        return F.when(F.count(F.when(F.col(cycle) == c, 1)) > 1, stop).otherwise(F.max(one))

    delta = (
        df.where(F.col(cycle).isin(first, last))
        .groupBy(*group, unit)
        .agg(side(last).alias("_b"), side(first).alias("_a"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .select(*group, F.bround((F.col("_b") - F.col("_a")) * scale).cast("long").alias("_d"))
    )
    tables = (
        delta.groupBy(*group, "_d")
        .agg(F.count(F.lit(1)).alias("_f"))
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_d", "_f"))).alias("table"))
    )
    numbers = ["v_stat", "p_value", "log_p", "shift", "shift_lo", "shift_hi"]
    out = T.StructType(
        [*[df.schema[c] for c in group], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in numbers],
         T.StructField("method", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for table in pdf["table"]:
                v = np.array([x["_d"] for x in table], dtype=np.int64)
                f = np.array([x["_f"] for x in table], dtype=np.int64)
                n = int(f.sum())
                if n < min_n:
                    rows.append([n] + [None] * 7)
                    continue
                r = signed_rank(v, f, level)
                half = lambda x: None if x is None else x / 2 / scale
                rows.append([n, r["v"], r["p"], r["log_p"], half(r["shift2"]), half(r["lo2"]), half(r["hi2"]), r["method"]])
            res = pd.DataFrame(rows, columns=["n", *numbers, "method"])
            res[numbers] = res[numbers].astype(float)
            yield pd.concat([pdf[group].reset_index(drop=True), res], axis=1)

    fine = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in numbers]
    return tables.mapInPandas(run, out).select(*group, "n", *fine, "method")
