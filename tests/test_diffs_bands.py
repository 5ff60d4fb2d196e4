import pytest

from resurvey.operators import bands, diffs, reshape


def test_difference_table_worked_numbers(spark):
    # 526 pairs, 407 without difference and 109 off by one
    data = [(0,)] * 407 + [(1,)] * 60 + [(-1,)] * 49 + [(4,)] * 10
    got = {r.difference: (r.frequency, r.cdf) for r in diffs.difference_cdf(spark.createDataFrame(data, "d int"), "d").collect()}
    assert got == {0.0: (407, 77.4), 1.0: (109, 98.1), 2.0: (0, 98.1), 3.0: (0, 98.1), 4.0: (10, 100.0)}


def test_difference_table_of_eighteen_in_thirty_six(spark):
    data = [(k,) for k, f in enumerate((1, 4, 5, 8, 18)) for _ in range(f)]
    got = {r.difference: r.cdf for r in diffs.difference_cdf(spark.createDataFrame(data, "d int"), "d").collect()}
    assert got[3.0] == 50.0 and got[4.0] == 100.0


def test_values_off_the_grid_are_counted(spark):
    df = spark.createDataFrame([(0.2,), (0.9,), (1.4,)], "d double")
    assert sum(r.frequency for r in diffs.difference_cdf(df, "d").collect()) == 3


def test_paired_difference_flags(spark, rows):
    df = spark.createDataFrame([(10.0, 10.5), (10.0, 11.0), (0.0, 0.0)], "n double, q double")
    out = diffs.paired_difference(df, "n", "q", "percent", (5, 10))
    assert rows(out, "metric", "within_5", "within_10") == [(10.0, False, False), (5.0, False, True), (None, None, None)]
    out = diffs.paired_difference(df, "n", "q", "abs", (1,))
    assert rows(out, "metric", "within_1") == [(0.0, True), (0.5, True), (1.0, True)]


def test_zero_lies_in_no_interval(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (-7.0,)], "d double")
    assert rows(diffs.interval_freq(df, "d", 3)) == [(0.0, 1.0, 2), (1.0, 3.0, 1), (3.0, 6.0, 0), (6.0, 9.0, 1)]
    assert rows(diffs.interval_freq(df, "d", 3, include_zero=True))[0] == (0.0, 1.0, 3)


def test_ecdf_at_grid_and_at_values(spark, rows):
    df = spark.createDataFrame([(0.0,), (4.0,), (-5.0,), (11.0,)], "d double")
    assert rows(diffs.ecdf_at(df, "d", 5)) == [(0.0, 25.0), (10.0, 75.0), (15.0, 100.0), (20.0, 100.0), (5.0, 75.0)]
    assert rows(diffs.ecdf(df, "d")) == [(0.0, 1, 0.25), (11.0, 1, 1.0), (4.0, 1, 0.5), (5.0, 1, 0.75)]


def test_zero_filled_counts(spark, rows):
    df = spark.createDataFrame([("u", "N", 1), ("u", "N", 1), ("u", "Q", 2)], "u string, role string, m int")
    got = rows(diffs.role_counts(df, ["u"], "role", sub="m", sub_levels=[1, 2, 3]))
    assert got == [("u", 1, 2, 0), ("u", 2, 0, 1), ("u", 3, 0, 0)]
    counts = diffs.role_counts(df, ["u"], "role", sub="m", sub_levels=[1, 2, 3])
    r = diffs.zero_zero_share(counts, "n_count", "q_count").first()
    assert (r.zero_zero_percent, r.max_count) == (33.0, 2.0)


def test_means_at_both_grains_weigh_records(spark, rows):
    df = spark.createDataFrame([("u", "N", 1, 2.0), ("u", "N", 1, 4.0), ("u", "N", 2, 9.0)], "u string, role string, m int, v double")
    assert rows(diffs.role_means(df, "u", "role", "m", "v")) == [
        ("sub", "u", 1, 3.0, None), ("sub", "u", 2, 9.0, None), ("unit", "u", None, 5.0, None),
    ]


def test_histogram_centred_on_zero(spark, rows):
    df = spark.createDataFrame([(-0.05,), (0.04,), (0.06,), (0.1,)], "d double")
    assert rows(diffs.histogram(df, "d", 0.1)) == [(0.0, 2), (0.1, 2)]


def test_joint_counts(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "n int, q int")
    assert rows(diffs.joint_counts(df, "n", "q")) == [(1, 1, 2, 2, True), (2, 1, 1, 2, False)]


def test_complete_grid_keeps_levels_never_seen(spark, rows):
    df = spark.createDataFrame([("u", "N", 5), ("w", "Q", 1)], "u string, role string, n long")
    assert rows(reshape.complete_grid(df, ["u"], {"role": ["N", "Q"]}, ["n"])) == [
        ("u", "N", 5), ("u", "Q", 0), ("w", "N", 0), ("w", "Q", 1),
    ]


def test_large_grids_and_repeated_cells(spark, rows, monkeypatch):
    df = spark.createDataFrame([("u", "N", 1, 5), ("w", "Q", 2, 1), ("w", "Z", 2, 9)], "u string, role string, m int, n long")
    levels = {"role": ["N", "Q"], "m": [1, 2, 3]}
    small = rows(reshape.complete_grid(df, ["u"], levels, ["n"]), "u", "role", "m", "n")
    monkeypatch.setattr(reshape, "MAX_WIDE_AGGREGATES", 1)
    assert small == rows(reshape.complete_grid(df, ["u"], levels, ["n"]), "u", "role", "m", "n") and len(small) == 12
    monkeypatch.undo()
    with pytest.raises(Exception, match="more than one row"):
        reshape.complete_grid(df.unionByName(df), ["u"], levels, ["n"]).collect()


@pytest.mark.parametrize(
    "cutoffs, kw, want",
    [
        ((15, 5), {}, {"concern": (0, 5), "caution": (5, 15), "good": (15, 99999)}),
        ((0.5, 3.5), {}, {"good": (0, 0.5), "caution": (0.5, 3.5), "concern": (3.5, 99999)}),
        ((60,), dict(one_is_concern=False, high_is_good=True), {"caution": (0, 60), "good": (60, 99999)}),
        ((1.6,), dict(one_is_concern=False, high_is_good=False), {"good": (0, 1.6), "caution": (1.6, 99999)}),
        ((3,), dict(one_is_concern=True, high_is_good=True), {"concern": (0, 3), "caution": (3, 99999)}),
        ((3,), dict(one_is_concern=True, high_is_good=False), {"caution": (0, 3), "concern": (3, 99999)}),
    ],
)
def test_band_limits(spark, cutoffs, kw, want):
    df = spark.createDataFrame([(2.0,), (80.0,)], "y double")
    got = {r.band: (r.band_min, r.band_max) for r in bands.band_limits(df, "y", cutoffs, **kw).collect()}
    assert got == want


def test_negative_data_lower_the_open_edge(spark):
    df = spark.createDataFrame([(-4.0,), (80.0,)], "y double")
    got = {r.band: r.band_min for r in bands.band_limits(df, "y", (15, 5)).collect()}
    assert got["concern"] == -4.0


def test_bands_close_and_classify(spark, rows):
    limits = spark.createDataFrame(
        [("p", "concern", 0.0, 5.0), ("p", "caution", 5.0, 15.0), ("p", "good", 15.0, 99999.0)],
        "param string, band string, band_min double, band_max double",
    )
    low = spark.createDataFrame([("p", 4.9), ("p", 5.0), ("p", 15.0), ("p", None)], "param string, v double")
    closed = bands.close_bands(limits, low, "param", ["v"])
    assert rows(closed.where("band = 'good'"), "band_max") == [(18.0,)]
    assert rows(bands.band_status(low, closed, "param", "v"), "v", "status") == [
        (15.0, "good"), (4.9, "concern"), (5.0, "caution"), (None, None),
    ]
    high = spark.createDataFrame([("p", 40.0)], "param string, v double")
    assert rows(bands.band_status(high, bands.close_bands(limits, high, "param", ["v"]), "param", "v"), "status") == [("good",)]


def test_both_grains(spark, rows):
    data = [("u", "s", 2010, "x", 1.0), ("u", "s", 2010, "x", 3.0), ("u", "s", 2010, None, 8.0)]
    df = spark.createDataFrame(data, "unit string, subunit string, period int, bin string, y double")
    long = bands.two_grains(df, ["unit", "subunit", "period"], "bin")
    got = rows(bands.subunit_summary(long, ["grain", "grain_bin"], "y"))
    assert got == [("bin", "x", 2, 2.0, 2.0), ("subunit", "", 3, 4.0, 3.0)]


def test_groups_with_a_null_key_are_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "g string, y double")
    assert {tuple(r) for r in bands.subunit_summary(df, ["g"], "y").collect()} == {("a", 2, 2.0, 2.0), (None, 2, 7.0, 7.0)}
    pairs = df.withColumn("q", df.y + 1)
    assert {r.g for r in diffs.bland_altman(pairs, "y", "q", ["g"]).collect()} == {"a", None}


def test_large_grids_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reshape, "MAX_WIDE_AGGREGATES", 1)
    spark.createDataFrame([("u", 1, 5), (None, 2, 7)], "unit string, level int, n long").write.parquet(f"{tmp_path}/t")
    out = reshape.complete_grid(spark.read.parquet(f"{tmp_path}/t"), ["unit"], {"level": [1, 2]}, ["n"])
    assert {tuple(r) for r in out.collect()} == {("u", 1, 5), ("u", 2, 0), (None, 1, 0), (None, 2, 7)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 24])
def test_both_grids_refuse_duplicates_and_keep_null_units(spark, limit, monkeypatch):
    monkeypatch.setattr(reshape, "MAX_WIDE_AGGREGATES", limit)
    df = spark.createDataFrame([("u", 1, 5), (None, 2, 7), ("u", 9, 1), ("u", 9, 1)], "unit string, level int, n long")
    got = {tuple(r) for r in reshape.complete_grid(df, ["unit"], {"level": [1, 2]}, ["n"]).collect()}
    assert got == {("u", 1, 5), ("u", 2, 0), (None, 1, 0), (None, 2, 7)}
    with pytest.raises(Exception, match="more than one row"):
        reshape.complete_grid(spark.createDataFrame([("u", 1, 5), ("u", 1, 6)], df.schema), ["unit"], {"level": [1, 2]}, ["n"]).collect()
