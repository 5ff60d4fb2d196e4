from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from resurvey.operators import asof, checks, compose, regen, roles
from resurvey.plans.views import Views

S = "unit string, role string, cycle_no long, survey_date date"


def surveys(spark, data):
    return spark.createDataFrame(data, S)


def test_burn_on_the_survey_day_is_not_prior(spark):
    s = surveys(spark, [("u", "N", 1, date(2012, 6, 1)), ("u", "N", 2, date(2017, 6, 1)), ("u", "Q", 2, date(2017, 6, 8)), ("w", "N", 1, None)])
    e = spark.createDataFrame([("u", date(2012, 6, 1)), ("u", date(2012, 6, 1)), ("u", date(2016, 1, 1))], "unit string, d date")
    out = asof.asof_prior(s, e, "unit", "survey_date", "d", "role")
    got = {(r.unit, r.role, r.cycle_no): (r.prior_event, r.has_prior) for r in out.collect()}
    assert got[("u", "N", 1)] == (None, False)
    assert got[("u", "N", 2)] == (date(2016, 1, 1), True)
    assert got[("u", "Q", 2)] == (None, None)
    assert got[("w", "N", 1)] == (None, False)


def test_event_since_previous_survey(spark):
    data = [
        ("first", "N", 1, date(2012, 6, 1)), ("first", "N", 2, date(2017, 6, 1)),
        ("gap", "N", 1, date(2012, 6, 1)), ("gap", "N", 3, date(2022, 6, 1)),
        ("none", "N", 2, date(2017, 6, 1)),
    ]
    e = spark.createDataFrame([("first", date(2000, 1, 1)), ("gap", date(2014, 1, 1))], "unit string, d date")
    prior = asof.asof_prior(surveys(spark, data), e, "unit", "survey_date", "d", "role")
    out = asof.event_since_previous(prior, "unit", "cycle_no", "survey_date", "prior_event", "role", 1825)
    got = {(r.unit, r.cycle_no): r.event_since for r in out.collect()}
    assert got[("first", 1)] is True  # any event counts, however old
    assert got[("first", 2)] is False  # nothing after the first survey
    assert got[("gap", 1)] is False
    assert got[("gap", 3)] is False  # cycle 2 is missing: five years back, not to cycle 1
    assert got[("none", 2)] is False


def test_years_since_event(spark):
    s = surveys(spark, [("u", "N", 1, date(2013, 1, 1)), ("u", "Q", 1, date(2013, 1, 2))]).withColumn("e", F.lit("2012-01-02").cast("date"))
    assert [r.years_since for r in asof.years_since_event(s, "survey_date", "e", "role").collect()] == [1.0]


def corner_rows(spark, data):
    cols = [c for cs in regen.INDEX_CLASSES.values() for c in cs]
    schema = "event string, target boolean, corner string, " + ", ".join(f"{c} long" for c in cols)
    full = [(*k, *[v.get(c, 0) for c in cols]) for k, v in data]
    return spark.createDataFrame(full, schema)


TREES = "event string, target boolean, trees long"


def test_index_and_importance(spark):
    df = corner_rows(
        spark,
        [
            (("e", True, "C1"), {"seed5_15": 1, "sap0_1": 2, "sap5_10": 1}),
            (("e", False, "C1"), {"seed50_137": 2, "sap25_5": 3}),
            (("empty", True, "C1"), {}),
        ],
    )
    trees = spark.createDataFrame([("e", True, 4), ("e", False, 1)], TREES)
    got = {r.event: r for r in regen.regen_index(df, trees, ["event"]).collect()}
    # seed 60 of 160; sap 9 of 9 + 16
    assert got["e"].seed_ratio == pytest.approx(60 / 160) and got["e"].sap_ratio == pytest.approx(9 / 25)
    assert got["empty"].regen_index == 0.0
    imp = {r.event: r.importance for r in regen.importance_score(df, trees, ["event"]).collect()}
    import math

    assert imp["e"] == pytest.approx(math.log(1250 + 3 * 50 * 125 + 4 * 50 * 25 + 1)) and imp["empty"] == 0.0


def test_boxes_are_filled_to_eight_and_never_cut(spark, rows):
    df = corner_rows(spark, [(("e", True, "C3"), {"sap0_1": 2, "sap25_5": 1}), (("e", True, "C1"), {}), (("f", False, "C1"), {"sap0_1": 9})])
    got = rows(regen.box_counts(df, ["event"], "corner", "target", regen.BOX_CLASSES, 8))
    assert len(got) == 16 and ("e", 2, 3) in got and sum(r[2] for r in got if r[0] == "f") == 0
    with pytest.raises(Exception, match="more corners than boxes"):
        regen.box_counts(df, ["event"], "corner", "target", regen.BOX_CLASSES, 1).collect()


def test_module_counts(spark):
    data = [("e", True, 1, 12.0, 1, "N"), ("e", True, 1, 15.0, 1, "N"), ("e", False, 2, 10.0, 1, "N"), ("e", True, 3, 9.9, 1, "N"),
            ("e", True, 3, 12.0, 2, "N"), ("e", True, 3, 12.0, 1, "Q"), ("dead", True, 1, 12.0, 2, "N")]
    df = spark.createDataFrame(data, "event string, target boolean, module long, dbh double, status int, role string")
    out = regen.module_tree_counts(df, ["event"], 10, 15, [1, 2, 3, 4])
    got = {(r.event, r.target, r.module): r.trees for r in out.collect()}
    assert len(got) == 8 and got[("e", True, 1)] == 2 and got[("e", False, 2)] == 1 and got[("e", True, 3)] == 0


def test_resurvey_counts(spark, rows):
    data = [("a", "p", "p1", 1, "N"), ("a", "p", "p2", 2, "N"), ("a", "p", "p2q", 2, "Q"), ("a", "r", "r1", 1, "N"), ("a", "r", "r1", 1, "N")]
    df = spark.createDataFrame(data, "area string, plot string, event string, cycle int, role string")
    assert rows(regen.resurvey_counts(df, "area", "plot", "event", "cycle", "role")) == [("a", 2, 1, 1)]


def test_box_stats(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)], "g string, v double")
    r = regen.box_stats(df, ["g"], "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_composition_has_both_types_and_sums_to_hundred(spark):
    data = [("u", "a_b", True, 10.0), ("u", "c", False, 30.0), ("u", "d_e", False, 60.0), ("v", "x_y", False, 5.0)]
    df = spark.createDataFrame(data, "u string, item string, exotic boolean, cover double")
    got = {(r.u, r.type): (r.richness, r.cover, r.rel_cover) for r in
           compose.composition(df, ["u"], "exotic", F.instr("item", "_") > 0, "cover").collect()}
    assert got == {
        ("u", "native"): (1, 90.0, 90.0), ("u", "exotic"): (1, 10.0, 10.0), ("v", "native"): (1, 5.0, 100.0), ("v", "exotic"): (0, 0.0, 0.0),
    }


def test_top_items_keep_ties(spark, rows):
    totals = spark.createDataFrame([("g", i, c) for i, c in (("d", 1), ("b", 5), ("a", 3), ("c", 3), ("e", 3))], "g string, item string, cover long")
    assert rows(compose.top_items(totals, ["g"], "item", "cover", 2), "item", "position") == [("a", 2), ("b", 1), ("c", 3), ("e", 4)]
    assert rows(compose.top_list(totals, ["g"], "item", "cover", 2)) == [("g", "b, a, c, e")]


def test_priority_items_on_every_unit(spark, rows):
    df = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 3.0), ("v", "b", 2.0)], "u string, item string, cover double")
    got = rows(compose.priority_item_cover(df, ["u"], "item", "cover", ["a", "z"]), "u", "item", "rel_cover", "present")
    assert got == [("u", "a", 25.0, True), ("u", "z", 0.0, False), ("v", "a", 0.0, False), ("v", "z", 0.0, False)]


def test_backfill(spark, rows):
    main = spark.createDataFrame(
        [("PARK001 - 2012", "PARK", "PARK001", 2012, 1, "N", "G1")],
        "event string, park string, plot string, year long, cycle_no long, role string, group string",
    )
    groups = main.select("plot", "group").distinct()
    side = spark.createDataFrame([("PARK001 - 2012", 1), ("PARK001 - 2017", 2), ("PARK009 - 2017", 3)], "event string, n int")
    filled, new_main = roles.backfill_events(side, main, "event", groups, 2010, 5)
    got = {r.event: (r.park, r.plot, r.year, r.cycle_no, r.role, r.group, r.backfilled) for r in filled.collect()}
    assert got["PARK001 - 2012"] == ("PARK", "PARK001", 2012, 1, "N", "G1", False)
    assert got["PARK001 - 2017"] == ("PARK", "PARK001", 2017, 2, "N", "G1", True)
    assert got["PARK009 - 2017"] == ("PARK", "PARK009", 2017, 2, "N", None, True)
    assert new_main.count() == 3


def test_checks(spark, rows):
    df = spark.createDataFrame([("p", "C1"), ("p", "C2"), ("q", "C1"), ("q", "C9"), ("q", None)], "e string, c string")
    assert rows(checks.incomplete_parents(df, ["e"], "c", ["C1", "C2"])) == [("q", 1, "C2")]
    assert rows(checks.illegal_codes(df, ["e"], "c", ["C1", "C2"])) == [("q", "C9"), ("q", None)]
    assert rows(checks.too_many_children(df, ["e"], "c", 1)) == [("p", 2), ("q", 2)]
    need = spark.createDataFrame([("maps", "a"), ("maps", "b"), ("herbs", "a")], "g string, i string")
    have = spark.createDataFrame([("a",)], "i string")
    assert rows(checks.covers_required(need, have, "g", "i")) == [("herbs", 1, 1, True), ("maps", 2, 1, False)]
    assert rows(checks.missing_required(need, have, "g", "i")) == [("maps", "b")]


def test_many_tied_items_are_numbered(spark):
    """Every item of one group is tied; the NULL group and a small one stay what they are."""
    totals = spark.range(20_000).select(
        F.when(F.col("id") < 10_000, "big").when(F.col("id") < 10_004, "small").alias("g"),
        F.concat(F.lit("i"), F.format_string("%05d", "id")).alias("item"), F.when(F.col("id") < 10_000, 1).otherwise(F.col("id")).alias("cover"),
    )
    got = compose.top_items(totals, ["g"], "item", "cover", 3)
    big = {r.item: r.position for r in got.where("g = 'big'").collect()}
    assert big == {f"i{k:05d}": k + 1 for k in range(10_000)}
    assert [(r.item, r.position) for r in got.where("g = 'small'").orderBy("position").collect()] == [("i10003", 1), ("i10002", 2), ("i10001", 3)]
    assert [r.item for r in got.where("g IS NULL").orderBy("position").collect()] == ["i19999", "i19998", "i19997"]
    with pytest.raises(Exception, match="long form"):
        compose.top_list(totals.unionByName(totals.where("g = 'big'").withColumn("item", F.concat("item", F.lit("x")))), ["g"], "item", "cover", 3).collect()


def test_regen_table_computes_its_metrics_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    metrics = spark.createDataFrame([("a", 1, "a1", 0.5), ("a", 2, "a2", 0.7), ("b", 1, "b1", None), (None, 1, "c1", 0.1)], "plot string, cycle_no long, event string, value double")
    history = spark.createDataFrame([("a1", True), ("b1", False)], "event string, event_since boolean")
    out = regen.regen_table(metrics.mapInPandas(count, metrics.schema), history, "plot", [1, 2, 3], ["event"], 1994, 5)
    got = {(r.plot, r.cycle_no): (r.event, r.value, r.event_since) for r in out.collect()}
    assert seen.value == 4
    assert got == {
        ("a", 1): ("a1", 0.5, True), ("a", 2): ("a2", 0.7, False), ("a", 3): (None, None, False),
        ("b", 1): ("b1", None, False), ("b", 2): (None, None, False), ("b", 3): (None, None, False),
        (None, 1): (None, None, False), (None, 2): (None, None, False), (None, 3): (None, None, False),
    }


def test_views_send_no_table_of_parts_or_suppliers_to_the_driver(spark, tmp_path):
    schemas = {
        "lineitem": "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string, l_shipdate timestamp",
        "part": "p_partkey long, p_type string, p_size int",
        "supplier": "s_suppkey long, s_nationkey int",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "region": "r_regionkey int, r_name string",
    }
    day = datetime(1996, 5, 1)
    tables = {
        "lineitem": [(1, 1, 1, 6.0, "O", day), (1, 1, 1, 11.0, "O", day), (2, 1, 2, 6.0, "O", day), (None, 1, 1, 6.0, "O", day), (9, 1, 1, 6.0, "O", day), (1, None, 1, 6.0, "O", day)],
        "part": [(1, "ECONOMY", 10), (1, "ECONOMY", 10), (2, "OTHER", 50), (None, "PROMO", 12)],
        "supplier": [(1, 3), (None, 3)],
        "nation": [(3, "here", 4)],
        "region": [(4, "there")],
    }
    for name, kind in schemas.items():
        spark.createDataFrame(tables[name], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    v = Views(spark, str(tmp_path))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    corners = v.regen()
    assert sorted((r.event, r.area, r.corner, r.target, r.seed15_30, r.sap5_10) for r in corners.collect()) == [
        ("1-1996", "here", "C1", True, 34, 0), ("1-1996", "here", "C2", False, 0, 6),
    ]
    trees = v.stem_counts(["event"], 10, 15)
    assert sorted((r.module, r.trees) for r in trees.where("target").collect()) == [(1, 0), (2, 4), (3, 0), (4, 0)]
    for df in (corners, trees):
        for key in ("l_partkey", "l_suppkey"):
            assert f"SortMergeJoin [{key}" in plan(df) and f"BroadcastHashJoin [{key}" not in plan(df)
