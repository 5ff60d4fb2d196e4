import itertools
import math
import time

import numpy as np
import pytest

from resurvey.operators import ranktest


def brute(d, level=0.9):
    """Signed-rank statistic, exact p by enumeration and location shift, no ties or zeros."""
    d = np.array(d)
    rank = np.abs(d).argsort().argsort() + 1
    v = rank[d > 0].sum()
    n = len(d)
    sums = np.array([sum(s) for k in range(n + 1) for s in itertools.combinations(range(1, n + 1), k)])
    tail = min((sums <= v).mean(), (sums >= v).mean())
    walsh = sorted((d[i] + d[j]) / 2 for i in range(n) for j in range(i, n))
    return v, min(1, 2 * tail), np.median(walsh), walsh


@pytest.mark.parametrize("seed", range(6))
def test_exact_case_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(6, 11))
    d = rng.permutation(np.arange(1, 60))[:n] * rng.choice([-1, 1], n)
    v, p, shift, walsh = brute(d)
    order = np.argsort(d)
    got = ranktest.signed_rank(d[order].astype(np.int64), np.ones(n, dtype=np.int64), 0.9)
    assert got["v"] == v and got["p"] == pytest.approx(p) and got["shift2"] / 2 == pytest.approx(shift)
    assert got["lo2"] / 2 in walsh and got["hi2"] / 2 in walsh and got["lo2"] <= 2 * shift <= got["hi2"]


@pytest.mark.parametrize("n", [49, 50, 51, 200])
def test_exact_at_every_size(n):
    """Counts of rank sums by an integer recursion, beyond the sizes that can be enumerated."""
    rng = np.random.default_rng(n)
    d = np.arange(1, n + 1) * rng.choice([-1, 1], n, p=[0.4, 0.6])
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        ways = [w + (ways[v - rank] if v >= rank else 0) for v, w in enumerate(ways)]
    v = int(d[d > 0].sum())
    low, high = sum(ways[: v + 1]), sum(ways[v:])
    got = ranktest.signed_rank(np.sort(d), np.ones(n, dtype=np.int64), 0.9)
    assert got["method"] == "exact" and got["v"] == v
    assert got["p"] == pytest.approx(min(1.0, 2 * min(low, high) / 2**n), rel=1e-11)


def subsets(n):
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for v in range(len(ways) - 1, rank - 1, -1):
            ways[v] += ways[v - rank]
    return list(itertools.accumulate(ways))


@pytest.mark.parametrize("n", [*range(1, 21), 90])
def test_tails_by_counting(n):
    """All tails against whole-number counts of subsets, by both methods where both apply."""
    upto = subsets(n)
    for v in range(len(upto)):
        want = math.log(upto[v]) - n * math.log(2)
        assert ranktest.null_log_tail(n, v) == pytest.approx(want, abs=1e-11)
        if n == 90 and 700 < v < len(upto) // 2 and v % 50 == 0:
            assert ranktest._tilted_log_tail(n, v) == pytest.approx(want, abs=1e-9)
    for p in (0.5, 0.05, 0.005):
        at = ranktest.null_quantile(n, p)
        assert upto[at] >= p * 2**n * (1 - 1e-12) and (at == 0 or upto[at - 1] < p * 2**n * (1 + 1e-12))


def test_ten_thousand_pairs():
    n, rng = 10_000, np.random.default_rng(1)
    start = time.perf_counter()
    d = np.sort(np.arange(1, n + 1) * rng.choice([-1, 1], n, p=[0.48, 0.52]))
    got = ranktest.signed_rank(d, np.ones(n, dtype=np.int64), 0.9)
    assert time.perf_counter() - start < 2
    assert got["method"] == "exact" and 0 < got["p"] < 1 and got["lo2"] < got["shift2"] < got["hi2"]
    # far out, p itself is too small for a double; the tilted value meets the counted one at the border
    far = ranktest.signed_rank(np.arange(1, n + 1), np.ones(n, dtype=np.int64), 0.9)
    assert far["p"] == 0.0 and far["log_p"] == pytest.approx((1 - n) * math.log(2))
    assert ranktest._tilted_log_tail(n, ranktest.COUNTED) == pytest.approx(ranktest.null_log_tail(n, ranktest.COUNTED), rel=1e-11)
    # near the middle the normal approximation is good
    half = n * (n + 1) / 4
    sigma = math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    for z in (0.1, 1, 2, 4):
        v = int(half - z * sigma)
        assert ranktest.null_log_tail(n, v) == pytest.approx(math.log(math.erfc((half - v - 0.5) / sigma / math.sqrt(2)) / 2), rel=1e-3)


def test_normal_tail_stays_finite():
    v = np.repeat(np.arange(1, 20_001, dtype=np.int64), 1)
    got = ranktest.signed_rank(v, np.full(len(v), 3, dtype=np.int64), 0.9)
    assert got["method"] == "normal" and got["p"] == 0.0 and -1e6 < got["log_p"] < -1e4
    assert ranktest._log_erfc(19.999999) == pytest.approx(ranktest._log_erfc(20.000001), rel=1e-5)


def test_all_positive_six_pairs():
    got = ranktest.signed_rank(np.arange(1, 7, dtype=np.int64), np.ones(6, dtype=np.int64), 0.9)
    assert got["v"] == 21 and got["p"] == pytest.approx(2 / 64)


@pytest.mark.parametrize("seed", range(5))
def test_pair_averages_with_repeats(seed):
    rng = np.random.default_rng(seed)
    v = np.unique(rng.integers(-30, 31, 12)).astype(np.int64)
    f = rng.integers(1, 5, len(v)).astype(np.int64)
    full = np.repeat(v, f)
    walsh = sorted(int(full[i] + full[j]) for i in range(len(full)) for j in range(i, len(full)))
    got = [ranktest.walsh_order_statistic(v, f, r) for r in range(1, len(walsh) + 1)]
    assert got == walsh


def test_ties_use_the_normal_form():
    v, f = np.array([-2, 1, 3], dtype=np.int64), np.array([10, 30, 30], dtype=np.int64)
    got = ranktest.signed_rank(v, f, 0.9)
    # mean ranks: 15.5 for |1|, 35.5 for |2|, 55.5 for |3|
    assert got["v"] == 30 * 15.5 + 30 * 55.5
    assert got["p"] < 0.001 and got["method"] == "normal"


def test_groups_below_the_minimum_have_no_test(spark):
    data = [("a", f"u{i}", c, float(i * c)) for i in range(8) for c in (1, 2)]
    data += [("b", f"u{i}", c, float(i)) for i in range(3) for c in (1, 2)] + [("a", "half", 1, 1.0)]
    df = spark.createDataFrame(data, "g string, unit string, cycle int, v double")
    got = {r.g: r for r in ranktest.signed_rank_by_group(df, ["g"], "unit", "cycle", "v", 1, 2).collect()}
    assert got["a"].n == 8 and got["a"].shift == pytest.approx(4.0) and got["a"].v_stat == 28
    assert got["b"].n == 3 and got["b"].v_stat is None and got["b"].p_value is None
