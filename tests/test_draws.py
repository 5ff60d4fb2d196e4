import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resurvey.functions import draws


def test_spark_and_numpy_draw_alike(spark):
    df = spark.range(40).withColumnRenamed("id", "rep").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    df = df.withColumn("s", draws.stratum_number(F.lit("P1"), F.lit(2))).withColumn(
        "x", draws.portable_index(F.col("rep"), F.col("i"), F.col("s"), 11, F.lit(86))
    )
    pdf = df.toPandas()
    want = draws.portable_indices(np.arange(40), np.arange(8), int(pdf["s"][0]), 11, 86)
    assert (pdf.pivot(index="rep", columns="i", values="x").to_numpy() == want).all()


def test_index_stays_exact_for_large_groups(spark):
    n = 3_000_000_000
    x = spark.range(50).select(draws.portable_index(F.col("id"), F.lit(3), F.lit(77), 5, F.lit(n)).alias("x")).toPandas()["x"]
    want = draws.portable_indices(np.arange(50), np.array([3]), 77, 5, n)[:, 0]
    assert list(x) == list(want) and x.max() < n


def test_portable_draws_are_uniform():
    reps, strata = np.arange(1000), range(0, 2_000_000, 100_003)
    for n in (3, 7, 8, 86, 700):
        i = np.arange(min(n, 64))
        for s in strata:
            idx = draws.portable_indices(reps, i, s, 3, n)
            assert idx.min() >= 0 and idx.max() < n
            count = np.bincount(idx.ravel(), minlength=n)
            expect = idx.size / n
            chi = ((count - expect) ** 2 / expect).sum()
            assert abs(chi - (n - 1)) / np.sqrt(2 * (n - 1)) < 5


def test_portable_draws_do_not_follow_each_other():
    x = draws.portable_state(np.arange(1000), np.arange(8), 123_456, 9) / draws.MODULUS
    for a, b in ((x[:-1], x[1:]), (x[:, :-1], x[:, 1:])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.05
    means = x.mean(axis=1)
    assert 0.85 < means.var() / (1 / 12 / 8) < 1.15


def test_binomial_quantiles_are_exact():
    u = (np.arange(2000) + 0.5) / 2000
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.02), (300, 0.97)):
        pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        want = np.searchsorted(np.cumsum(pmf), u, side="right")
        assert (draws.binomial_quantile(u, np.full(2000, n), p) == want).mean() > 0.999
    big = draws.binomial_quantile(u[::20], np.full(100, 10**7), 0.25)
    assert abs(big.mean() - 2.5e6) < 50 and abs(big.std() / np.sqrt(10**7 * 0.25 * 0.75) - 1) < 0.05
    assert (draws.binomial_quantile(u, np.arange(2000), 1.0) == np.arange(2000)).all()


def test_portable_multinomial():
    counts = np.array([500, 0, 20, 300, 1])
    got = draws.multinomial(counts, np.arange(4000), 77, 3)
    assert (got.sum(axis=1) == counts.sum()).all() and (got >= 0).all() and not got[:, 1].any()
    share = counts / counts.sum()
    assert np.abs(got.mean(axis=0) - counts).max() < 1.5
    assert np.allclose(np.cov(got.T)[0, [0, 3]], [counts.sum() * share[0] * (1 - share[0]), -counts.sum() * share[0] * share[3]], rtol=0.08)


@pytest.mark.parametrize("n", [1, 7, 857, draws.TILE + 1, 300_001, draws.MODULUS - 1])
@pytest.mark.parametrize("stratum, seed", [(0, 0), (draws.MODULUS - 1, 20), (123456789, -5)])
def test_draws_without_divisions_are_the_portable_ones(n, stratum, seed):
    reps = np.array([0, 1, 2, 999, 10**6])
    count = min(n, 40_000)
    for first in {0, n - count}:
        want = draws.portable_indices(reps, np.arange(first, first + count), stratum, seed, n)
        assert np.array_equal(draws.Draws(first, count, stratum, seed).indices(reps, n), want)
