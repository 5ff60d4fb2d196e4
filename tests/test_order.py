import numpy as np
import pytest
from pyspark.sql import functions as F

from resurvey.functions import order
from resurvey.operators import bands
from resurvey.functions.order import coarse_key, exact_quantiles, fill_levels, number_rows, running_total, split_hot


@pytest.fixture(scope="module")
def mixed(spark):
    """Three groups with ties, negatives, zeros and several magnitudes; one value holds a third of the rows."""
    rng = np.random.default_rng(5)
    data = []
    for g in range(3):
        v = np.concatenate([rng.lognormal(3, 3, 300), -rng.lognormal(0, 2, 200), np.zeros(250), rng.integers(-5, 6, 100)])
        data += [(g, float(x)) for x in v]
    return spark.createDataFrame(data, "g int, v double").repartition(7)


def test_coarse_key_is_monotone(spark):
    edges = [10.0**k * m for k in range(-12, 13) for m in (0.999999999999, 1.0, 1.0000001, 2.5, 9.9999)]
    values = sorted({0.0, *edges, *[-e for e in edges]})
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", coarse_key(F.col("v")).alias("k"))
    keys = [r.k for r in df.orderBy("v").collect()]
    assert keys == sorted(keys)


def test_exact_quantiles_match_numpy(mixed):
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: [r[n] for n in names] for r in exact_quantiles(mixed, ["g"], "v", probs, names).collect()}
    pdf = mixed.toPandas()
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(part["v"], probs)), rel=1e-12)


def test_exact_quantiles_of_one_and_two_values(spark):
    df = spark.createDataFrame([("a", 4.0), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    out = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    assert out == {"a": 4.0, "b": 1.5}


def test_groups_with_a_null_key_are_kept(mixed):
    """Quantiles, running totals, row numbers and split groups, with a large NULL group."""
    df = mixed.withColumn("g", F.when(F.col("g") > 0, F.col("g"))).withColumn("tie", F.monotonically_increasing_id())
    pdf = df.toPandas()
    parts = {None: pdf[pdf.g.isna()], 1: pdf[pdf.g == 1], 2: pdf[pdf.g == 2]}
    got = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", [0.3], ["m"]).collect()}
    assert got == pytest.approx({g: np.quantile(p["v"], 0.3) for g, p in parts.items()})
    total = running_total(df.groupBy("g", "v").count(), ["g"], "v", "count").groupBy("g").agg(F.max("running").alias("n"))
    assert {r.g: r.n for r in total.collect()} == {g: len(p) for g, p in parts.items()}
    numbered = number_rows(df, ["g"], coarse_key(F.col("v")), ["v", "tie"], "no").toPandas()
    assert sorted(numbered[numbered.g.isna()]["no"]) == list(range(1, len(parts[None]) + 1))
    small, large = split_hot(df.unionByName(df.where("g IS NULL")), ["g"], len(parts[None]) + 10)
    assert {r.g for r in large.select("g").distinct().collect()} == {None} and large.count() == 2 * len(parts[None])
    assert {r.g for r in small.select("g").distinct().collect()} == {1, 2}


def test_summaries_scan_once(spark, tmp_path):
    """Count, mean and quantiles read the rows once, and nothing runs before the result is asked for."""
    path = str(tmp_path / "rows")
    spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") % 911).cast("double").alias("v")).write.parquet(path)
    runs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    df = spark.read.parquet(path)
    runs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    out = bands.subunit_summary(df, ["g"], "v")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == runs
    got = {r.g: (r.n, round(r["mean"], 6), r.median) for r in out.collect()}
    pdf = df.toPandas()
    assert got == {g: (len(p), round(p["v"].mean(), 6), p["v"].median()) for g, p in pdf.groupby("g")}
    final = out._jdf.queryExecution().executedPlan().toString()
    final = final[: final.index("Initial Plan")]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_running_total_matches_a_plain_running_sum(mixed):
    freq = mixed.groupBy("g", "v").count()
    got = running_total(freq, ["g"], "v", "count").toPandas().sort_values(["g", "v"])
    want = got.groupby("g")["count"].cumsum()
    assert (got["running"] == want).all()


def test_number_rows_is_a_dense_order(mixed):
    keyed = mixed.withColumn("tie", F.monotonically_increasing_id())
    got = number_rows(keyed, ["g"], coarse_key(F.col("v")), ["v", "tie"], "no").toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["v", "tie"])
        assert list(part["no"]) == list(range(1, len(part) + 1))


def test_split_hot_keeps_every_row(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "g string, v int")
    small, large = split_hot(df, ["g"], 10)
    assert small.count() == 1 and large.count() == 30 and {r._n for r in large.collect()} == {30}
    whole, none = split_hot(df, ["g"], 100)
    assert none is None and whole.count() == 31


def test_fill_levels(spark, rows):
    df = spark.createDataFrame([("a", 2, 3), ("a", 5, 1), ("b", 0, 7)], "g string, l long, f long")
    assert rows(fill_levels(df, ["g"], "l", "f")) == [
        ("a", 2, 3, 3, 4), ("a", 3, 0, 3, 4), ("a", 4, 0, 3, 4), ("a", 5, 1, 4, 4), ("b", 0, 7, 7, 7),
    ]
    extended = rows(fill_levels(df, ["g"], "l", "f", from_zero=True, extra=1))
    assert extended[0] == ("a", 0, 0, 0, 4) and ("a", 6, 0, 4, 4) in extended and ("b", 1, 0, 7, 7) in extended


def test_a_far_outlier_is_expanded_in_chunks(spark, monkeypatch):
    """Gaps over many chunks, a group with a NULL key, and levels in several buckets."""
    monkeypatch.setattr(order, "GAP_LEVELS", 100)
    levels = {"a": [0, 3, 7, 5000], None: [2, 950, 1040, 12_345], "c": [11]}
    df = spark.createDataFrame([(g, v, v % 5 + 1) for g, vs in levels.items() for v in vs], "g string, l long, f long")
    got = fill_levels(df, ["g"], "l", "f", from_zero=True, extra=2).collect()
    for g, vs in levels.items():
        part = sorted((r.l, r.f, r._upto, r._total) for r in got if r.g == g)
        f = {v: v % 5 + 1 for v in vs}
        want = np.array([f.get(v, 0) for v in range(max(vs) + 3)])
        assert part == list(zip(range(max(vs) + 3), want, np.cumsum(want), [want.sum()] * len(want)))


@pytest.mark.parametrize("tie", [False, True])
def test_numbers_by_range(spark, tie):
    """A value that a third of the rows share, NULLs first, several parts."""
    rows = [(None if i % 50 == 0 else 7.0 if i % 3 == 0 else float((i * 7919) % 1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, k int").repartition(5)
    got = order.number_by_range(df, ["v", "k"] if tie else ["k"], "no").collect()
    key = (lambda r: (r.v is not None, r.v, r.k)) if tie else (lambda r: r.k)
    assert [r.no for r in sorted(got, key=key)] == list(range(1, 3001))
