import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from resurvey.functions import draws
from resurvey.operators import resample


@pytest.fixture(scope="module")
def measures(spark):
    rng = np.random.default_rng(1)
    data = [("flat", 5.0)] * 40 + [("one", 3.0)] + [("wide", float(x)) for x in rng.normal(100, 20, 900)]
    data += [("even", float(round(x))) for x in rng.normal(50, 5, 400)]
    return spark.createDataFrame(data, "g string, y double")


def intervals(df, **kw):
    out = resample.mean_median_interval(df, ["g"], "y", 400, 7, **kw)
    return {r.g: r.asDict() for r in out.collect()}


def test_interval_of_a_constant_has_no_width_and_single_values_have_none(measures):
    got = intervals(measures)
    assert got["flat"]["mean_lo95"] == got["flat"]["median_hi95"] == 5.0
    assert all(got["one"][c] is None for c in resample.INTERVAL_COLUMNS)


def test_interval_width_agrees_with_theory(measures):
    got = intervals(measures)["wide"]
    y = np.array([r.y for r in measures.where("g = 'wide'").collect()])
    se = y.std() / np.sqrt(len(y))
    assert got["mean_hi95"] - got["mean_lo95"] == pytest.approx(2 * 1.96 * se, rel=0.15)
    assert got["mean_lo95"] < got["mean_lo68"] < y.mean() < got["mean_hi68"] < got["mean_hi95"]


@pytest.mark.parametrize("block_rows", [37, 128, 100_000])
def test_both_paths_give_the_same_limits(measures, block_rows, monkeypatch):
    """To the last bit, with draws counted in ranges and replicates dealt to several tasks."""
    near = intervals(measures, block_rows=block_rows)
    monkeypatch.setattr(resample, "WORK_DRAWS", 5000)
    assert intervals(measures, direct_rows=100, block_rows=block_rows) == near


@pytest.mark.parametrize("task_rows", [37, 200, 10_000])
def test_spans_of_blocks_give_the_same_limits(measures, task_rows, monkeypatch):
    """One span of all blocks, whose draws are made once, and several spans, whose hits are counted first."""
    near = intervals(measures, block_rows=37)
    monkeypatch.setattr(resample, "WORK_DRAWS", 50_000)
    assert intervals(measures, direct_rows=100, block_rows=37, task_rows=task_rows) == near


def test_both_sides_of_the_limit(spark):
    """Groups of one value fewer and one more than a task takes, against plain resampling."""
    rng = np.random.default_rng(4)
    data = {n: np.round(rng.normal(50, 9, n), 2) for n in (9_999, 10_000, 10_001)}
    df = spark.createDataFrame([(str(n), float(y)) for n, v in data.items() for y in v], "g string, y double")
    got = {r.g: r.asDict() for r in resample.mean_median_interval(df, ["g"], "y", 40, 7).collect()}
    assert got == {r.g: r.asDict() for r in resample.mean_median_interval(df, ["g"], "y", 40, 7, direct_rows=20_000).collect()}
    number = {r.g: r.s for r in df.select("g", draws.stratum_number(F.col("g")).alias("s")).distinct().collect()}
    for n, v in data.items():
        drawn = np.sort(v)[draws.portable_indices(np.arange(40), np.arange(n), number[str(n)], 7, n)]
        for name, stat in (("mean", drawn.mean(axis=1)), ("median", np.median(drawn, axis=1))):
            want = np.quantile(stat, list(resample.INTERVAL_PROBS.values()))
            assert [got[str(n)][f"{name}_{q}"] for q in resample.INTERVAL_PROBS] == pytest.approx(list(want), rel=1e-12)


def test_interval_does_not_depend_on_partitioning(measures):
    assert intervals(measures.repartition(5, "y")) == intervals(measures.coalesce(1))
    far = dict(direct_rows=100, block_rows=64)
    assert intervals(measures.repartition(5, "y"), **far) == intervals(measures.coalesce(1), **far)


@pytest.fixture(scope="module")
def pairs(spark):
    data = [("A", "A")] * 60 + [("A", "B")] * 20 + [("B", "B")] * 30 + [("C", None)] * 2 + [("B", None)] * 3
    return spark.createDataFrame(data, "v1 string, v2 string")


def test_agreement_interval(pairs):
    got = {r.category: r for r in resample.psa_interval(pairs, "v1", "v2", ["A", "B", "C"], 500, 3).collect()}
    a = got["A"]
    assert (a.num, a.denom, a.psa) == (120, 140, 86.0)
    assert a.psa_lo < 86 < a.psa_hi and a.psa_hi - a.psa_lo < 15
    assert got["C"].denom == 2 and got["C"].psa_lo is None and got["C"].psa_hi is None
    assert got["XXX"].psa == 0.0


def test_agreement_interval_by_group_equals_the_group_alone_in_its_point_part(pairs):
    both = pairs.withColumn("g", F.lit("x")).unionByName(pairs.limit(50).withColumn("g", F.lit("y")))
    out = resample.psa_interval(both, "v1", "v2", ["A", "B", "C"], 200, 3, by=["g"])
    x = {r.category: r.psa for r in out.where("g = 'x'").collect()}
    whole = {r.category: r.psa for r in resample.psa_interval(pairs, "v1", "v2", ["A", "B", "C"], 200, 3).collect()}
    assert x == whole


@pytest.fixture(scope="module")
def box_rows(spark):
    rng = np.random.default_rng(2)
    data = [("p", f"u{u}", int(x)) for u in range(60) for x in rng.poisson(1 + u % 4, 8)]
    data += [("q", "only", 2)] * 8
    return spark.createDataFrame(data, "area string, unit string, y long")


def cluster(df, **kw):
    out = resample.cluster_bootstrap(df, ["area"], "unit", "y", 8, 600, 5, **kw)
    return {r.area: r for r in out.collect()}


def test_cluster_bootstrap(box_rows):
    got = cluster(box_rows)
    mean = box_rows.where("area = 'p'").agg(F.avg("y")).first()[0]
    assert got["p"].units == 60 and got["p"].p05 < mean < got["p"].p95
    assert got["p"].p50 == pytest.approx(mean, rel=0.05)
    assert (got["q"].p05, got["q"].p50, got["q"].p95) == (2.0, 2.0, 2.0)


@pytest.mark.parametrize("block_units", [7, 1000])
def test_cluster_bootstrap_of_a_large_area(box_rows, block_units, monkeypatch):
    near = cluster(box_rows, block_units=block_units)
    monkeypatch.setattr(resample, "WORK_DRAWS", 3000)
    assert cluster(box_rows, direct_units=10, block_units=block_units) == near


def test_a_unit_of_many_boxes(spark):
    """Ten million equal boxes are one entry of a table."""
    table = [[{"v": 1.0, "f": 4_000_000}, {"v": 3.0, "f": 6_000_000}], [{"v": 2.0, "f": 8}]]
    tracemalloc.start()
    units = resample._Units(table)
    hits = units.hits(np.arange(2000), 2, 0, 8, 5, 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and (hits.sum(axis=1) == 16).all()
    assert hits[:, 1].sum() / hits[:, :2].sum() == pytest.approx(0.6, abs=0.02)


@pytest.fixture(scope="module")
def strata(spark):
    rng = np.random.default_rng(3)
    corners, trees = [], []
    for plot in ("a", "b"):
        for event in range(3):
            for target in (True, False):
                for c in range(8):
                    corners.append((plot, 1, f"{plot}{event}", target, f"C{c}", *map(int, rng.poisson(2, 3))))
                for m in range(4):
                    trees.append((plot, 1, f"{plot}{event}", target, m, int(rng.poisson(1))))
    schema = "plot string, cycle_no long, event string, target boolean, "
    c = spark.createDataFrame(corners, schema + "corner string, seedlings long, small_saplings long, large_saplings long")
    return c, spark.createDataFrame(trees, schema + "module long, trees long")


def table(df):
    return {r.event: (round(r.mean, 9), round(r.lo95, 9), round(r.hi95, 9)) for r in df.collect()}


def test_index_interval_is_the_same_on_both_paths(strata):
    args = (*strata, ["plot", "cycle_no"], "event", 60, 4)
    near = table(resample.regen_index_interval(*args))
    far = table(resample.regen_index_interval(*args, direct_rows=1))
    assert len(near) == 6 and near == far
    assert all(0 <= lo <= mean <= hi <= 2 for mean, lo, hi in near.values())


def test_index_interval_computes_its_rows_once(spark, strata):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [df.mapInPandas(count, df.schema) for df in strata]
    for direct_rows in (8_000, 1):
        seen.value = 0
        out = resample.regen_index_interval(*rows, ["plot", "cycle_no"], "event", 60, 4, direct_rows=direct_rows)
        assert len(table(out)) == 6 and seen.value == sum(df.count() for df in strata)


def test_importance_interval_is_the_same_on_both_paths(strata):
    corners, trees = strata
    c = corners.withColumnsRenamed({"seedlings": "p1", "small_saplings": "p2", "large_saplings": "p10"}).withColumn("p50", F.lit(1))
    args = (c, trees, ["plot", "cycle_no"], "event", 60, 4)
    near = table(resample.importance_interval(*args))
    assert len(near) == 6 and near == table(resample.importance_interval(*args, direct_rows=1))


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 999, 1000])
def test_short_quantiles_are_those_of_numpy(n):
    rng = np.random.default_rng(n)
    probs = [0.025, 0.16, 0.5, 0.84, 0.975, 0.0, 1.0]
    for v in (rng.normal(3, 9, n), rng.integers(0, 4, n).astype(float), np.full(n, 0.1)):
        assert resample._quantiles(v, probs) == list(np.quantile(v, probs))
    v[-1] = np.nan
    assert np.isnan(resample._quantiles(v, probs)).all()
