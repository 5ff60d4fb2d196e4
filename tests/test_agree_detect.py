import pytest
from pyspark.sql import functions as F

from resurvey.operators import agree, detect, reshape, roles


def test_specific_agreement_worked_example(spark, rows):
    df = spark.createDataFrame([(5, 5), (5, 1)], "a int, b int")
    got = {r.category: (r.num, r.denom, r.psa) for r in agree.specific_agreement(df, "a", "b", range(1, 6)).collect()}
    assert got["5"] == (2, 3, 67.0) and got["1"] == (0, 1, 0.0)
    assert got["2"] == (0, 0, None) and got["XXX"] == (0, 0, None) and len(got) == 6


def test_three_agreed_of_seven_uses(spark):
    df = spark.createDataFrame([("G031", "G031")] * 3 + [("G031", "G552")], "a string, b string")
    got = {r.category: r for r in agree.specific_agreement(df, "a", "b", ["G031", "G552"]).collect()}
    assert (got["G031"].num, got["G031"].denom, got["G031"].psa) == (6, 7, 86.0)


def test_missing_is_a_category_of_its_own(spark):
    df = spark.createDataFrame([(None, None), ("A", None)], "a string, b string")
    got = {r.category: (r.num, r.denom, r.psa) for r in agree.specific_agreement(df, "a", "b", ["A"]).collect()}
    assert got == {"A": (0, 1, 0.0), "XXX": (2, 3, 67.0)}


def test_value_outside_the_levels_is_an_error(spark):
    df = spark.createDataFrame([("A", "Z")], "a string, b string")
    with pytest.raises(Exception, match="value not in levels"):
        agree.specific_agreement(df, "a", "b", ["A"]).collect()


def test_matrix_has_one_triangle_and_all_pairs(spark):
    data = [("1", "2"), ("2", "1"), ("1", "1"), (None, "2"), ("10", "2")]
    df = spark.createDataFrame(data, "a string, b string")
    got = {(r.high, r.low): r.pairs for r in agree.interrater_matrix(df, "a", "b", ["1", "2", "10"]).collect()}
    assert len(got) == 10 and sum(got.values()) == len(data)
    # level order counts, not text order
    assert got[("2", "1")] == 2 and got[("10", "2")] == 1 and got[("XXX", "2")] == 1 and got[("10", "1")] == 0


def test_contingency_keeps_empty_cells(spark):
    df = spark.createDataFrame([("A", "B"), ("A", "A"), (None, "A"), ("A", "A")], "a string, b string")
    got = {(r.rating1, r.rating2): (r.pairs, r.proportion) for r in agree.contingency(df, "a", "b", ["A", "B"]).collect()}
    assert len(got) == 9 and got[("A", "A")] == (2, 0.5) and got[("B", "B")] == (0, 0.0) and got[("XXX", "A")][0] == 1


def test_binary_types(spark, rows):
    data = [("x", True, True), ("x", False, False), ("x", True, False), ("x", None, False), ("x", None, None), ("y", False, False)]
    df = spark.createDataFrame(data, "c string, a boolean, b boolean")
    assert rows(agree.binary_match_types(df, "c", "a", "b")) == [("x", 1, 1, 3), ("y", 0, 1, 0)]
    got = {r.c: r for r in agree.code_agreement(df, "c", "a", "b").collect()}
    assert (got["x"].n11, got["x"].n10, got["x"].n00, got["x"].denom, got["x"].psa) == (1, 3, 1, 3, 67.0)
    assert got["x"].missing_uses == 3 and got["y"].psa == 0.0


def test_optional_types(spark, rows):
    df = spark.createDataFrame([("x", 1, 1), ("x", 1, 2), ("x", None, 2), ("x", None, None)], "c string, a int, b int")
    assert rows(agree.match_types_optional(df, "c", "a", "b")) == [("x", 1, 1, 2)]


def test_fit_classes(spark, rows):
    data = [("A", "A", 1, 1), ("A", "B", 1, 2), ("A", None, None, 3), ("B", "B", 2, None)]
    df = spark.createDataFrame(data, "v1 string, v2 string, f1 int, f2 int")
    got = rows(agree.fit_crosstab(df, "v1", "v2", "f1", "f2"))
    assert got == [("++", 1, 1), ("1+/+1", 0, 1), ("11", 1, 0)]


def test_rater_rates_ignore_a_missing_rater(spark, rows):
    data = [("x", "ann", True, "bob", False), ("x", "ann", True, "bob", True), ("x", "ann", False, None, True)]
    df = spark.createDataFrame(data, "c string, r1 string, v1 boolean, r2 string, v2 boolean")
    got = rows(agree.rater_rates(df, "c", "r1", "v1", "r2", "v2"))
    assert got == [("ann", "x", 2, 3, 3, 66), ("bob", "x", 1, 2, 2, 50)]


def test_pairs_by_link(spark, rows):
    n = spark.createDataFrame([("n1", "q1", 5), ("n2", "q2", None), ("n3", "q9", 1)], "id string, link string, v int")
    q = spark.createDataFrame([("q1", "n1", 5), ("q2", "n2", None), ("q4", "n7", 2)], "id string, link string, v int")
    assert rows(roles.pair_by_link(n, q, "link", "id", ["v"])) == [("q1", 5, 5, True), ("q2", None, None, False)]
    assert rows(roles.pair_by_link(n, q, "link", "id", ["v"], False)) == [("q1", 5, 5, True)]
    assert rows(roles.missing_both(n, q, "link", "id", "v")) == [("q2",)]
    assert rows(roles.unlinked(n, q, "link", "id", "link", "id")) == [("n3", "no re-survey"), ("q4", "no first survey")]
    assert rows(roles.both_status(n, q, "link", "id", "v", [5])) == [("q1",)]


def test_duplicate_role_row_is_an_error(spark):
    df = spark.createDataFrame([("u", "N", 1), ("u", "N", 1), ("u", "Q", 1)], "u string, r string, v int")
    with pytest.raises(Exception, match="more than one N row"):
        reshape.pair_by_role(df, ["u"], "r", ["v"], {"N": "n", "Q": "q"}).collect()


def test_detection_summary(spark):
    data = [("u", "a", "N"), ("u", "a", "Q"), ("u", "b", "N"), ("u", "c", "Q"), ("u", "d", "Q"), ("u", "a", "N")]
    df = detect.detection_match(spark.createDataFrame(data, "u string, item string, role string"), ["u"], "item")
    assert {r.item: r.match_type for r in df.collect()} == {
        "a": "TRUE-TRUE", "b": "TRUE-FALSE", "c": "FALSE-TRUE", "d": "FALSE-TRUE"
    }
    r = detect.detection_summary(df, ["u"]).first()
    assert (r.n_only, r.q_only, r.matched, r.unique_items) == (1, 2, 1, 4)
    assert (r.n_richness, r.q_richness, r.rich_diff) == (2, 3, 1)
    # 3/5, 1/2.5, 1/2.5, 1/4
    assert (r.turnover, r.rich_diff_percent, r.match_by_mean, r.match_by_unique) == (60, 40, 40, 25)
    lists = detect.match_lists(df, ["u"], "item").first()
    assert (lists.both_surveys, lists.first_only, lists.resurvey_only) == ("a", "b", "c - d")


def test_unit_without_detections_has_no_rates(spark):
    df = spark.createDataFrame([("u", False, False)], "u string, n_seen boolean, q_seen boolean")
    r = detect.detection_summary(df, ["u"]).first()
    assert r.turnover is None and r.match_by_mean is None and r.unique_items == 0


def test_unmatched_items_rank_with_ties(spark, rows):
    data = [(i, n, q) for i, k in (("a", 3), ("b", 3), ("c", 1)) for n, q in [(True, False)] * k + [(True, True)]]
    data += [("few", True, False)]
    df = spark.createDataFrame(data, "item string, n_seen boolean, q_seen boolean")
    assert rows(detect.unmatched_items(df, "item", 2, 40)) == [("a", 4, 3, 75, 1), ("b", 4, 3, 75, 1), ("c", 2, 1, 50, 3)]
    assert rows(detect.unmatched_items(df, "item", 2, 50), "item") == [("a",), ("b",)]


def test_class_difference_keeps_missing_classes(spark, rows):
    data = [("u", "a", "N", 3), ("u", "a", "Q", 5), ("u", "b", "N", None), ("u", "b", "Q", 2), ("u", "c", "N", 1)]
    df = spark.createDataFrame(data, "u string, item string, role string, cc int")
    assert rows(detect.class_difference(df, ["u"], "item", "cc")) == [("u", "a", 3, 5, 2), ("u", "b", None, 2, None)]


def test_scaled_match_keeps_positions_nobody_saw(spark, rows):
    schema = "u string, item string, role string, in_plot boolean, m1 boolean, m2 boolean"
    data = [("u", "a", "N", True, True, False), ("u", "a", "Q", True, True, False), ("u", "b", "N", False, False, False)]
    flags = {("plot", "plot"): "in_plot", ("module", "m1"): "m1", ("module", "m2"): "m2"}
    got = rows(detect.scaled_match(spark.createDataFrame(data, schema), ["u"], "item", flags))
    assert got == [
        ("u", "a", "module", "m1", True, True), ("u", "a", "module", "m2", False, False), ("u", "a", "plot", "plot", True, True),
    ]
    unmatched = detect.unmatched_items(detect.scaled_match(spark.createDataFrame(data, schema), ["u"], "item", flags), "item", 1, 0)
    assert rows(unmatched) == [("a", 3, 1, 33, 1)]


def test_detection_report(spark):
    schema = "u string, item string, role string, cc int, in_plot boolean, m1 boolean, c1 boolean"
    data = [
        ("u", "a", "N", 1, True, True, False), ("u", "a", "Q", 9, True, True, True),
        ("u", "b", "N", 1, True, False, False), ("v", "c", "N", 1, False, False, False),
    ]
    df = spark.createDataFrame(data, schema)
    flags = {("plot", "plot"): "in_plot", ("module", "m1"): "m1", ("cell", "c1"): "c1"}
    out = detect.detection_report(df, df.where("item = 'b'"), ["u"], "item", flags, F.col("cc") > 8)
    got = {(r.subset, r.u, r.scale): (r.n_only, r.q_only, r.matched) for r in out.collect()}
    assert got == {
        ("all", "u", "plot"): (1, 0, 1), ("all", "u", "module"): (0, 0, 1), ("all", "u", "cell"): (0, 1, 0),
        ("high_cover", "u", "plot"): (0, 0, 1), ("high_cover", "u", "module"): (0, 0, 1), ("high_cover", "u", "cell"): (0, 1, 0),
        ("rolled_up", "u", "plot"): (1, 0, 0), ("rolled_up", "u", "module"): (0, 0, 0), ("rolled_up", "u", "cell"): (0, 0, 0),
    }


def test_codes_beyond_a_list_appear(spark, rows):
    units = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    codes = spark.createDataFrame([(1, "A"), (1, "Z"), (2, None), (9, "Q")], "u int, code string")
    got = rows(reshape.codes_to_flags(units, codes, ["u"], "code", ["B", "A"]))
    assert got == sorted([(u, c, (u, c) in {(1, "A"), (1, "Z")}) for u in (1, 2, 3) for c in "BAZQ"], key=repr)
    assert rows(reshape.codes_to_flags(units, codes, ["u"], "code")) == [r for r in got if r[1] != "B"]
    n = spark.createDataFrame([("q1", "a", None, "r1"), ("q2", None, None, "r1"), (None, "c", None, "r2")], "link string, c1 string, c2 string, rater string")
    q = spark.createDataFrame([("q1", "A", "b", "r3")], "id string, c1 string, c2 string, rater string")
    flags = rows(agree.flag_pairs(n, q, "link", "id", ["c1", "c2"], "rater"))
    assert {(f[0], f[1]): (f[3], f[5]) for f in flags if f[0] == "q1"} == {("q1", "A"): (True, True), ("q1", "B"): (False, True), ("q1", "C"): (False, False)}
    assert len(flags) == 9


def test_match_rows_number_the_items_of_each_list(spark, rows):
    det = spark.createDataFrame([(1, "b", True, True), (1, "a", True, True), (1, "c", True, False), (1, "d", False, False), (2, "e", False, True)], "u int, item string, n_seen boolean, q_seen boolean")
    got = rows(detect.match_rows(det, ["u"], "item"), "u", "list", "item", "position")
    assert got == [(1, "both_surveys", "a", 1), (1, "both_surveys", "b", 2), (1, "first_only", "c", 1), (2, "resurvey_only", "e", 1)]
    with pytest.raises(Exception, match="more than 2 items"):
        detect.match_lists(det, ["u"], "item", most=2).collect()
