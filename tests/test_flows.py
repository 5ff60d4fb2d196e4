"""The analyses end to end on small generated field tables, read back from CSV."""

import csv
import random
import statistics

import pytest
from pyspark.sql import functions as F

from resurvey.operators.bands import CUT_OFFS
from resurvey.plans import flows
from resurvey.sources import files, schemas

SPECIES = ["Quercus alba", "Carya ovata", "Hedera helix", "Viola sororia", "Acer rubrum", "Lonicera japonica", "Carex sp."]


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("field")

    def read(name, schema, data):
        path = root / f"{name}.csv"
        with open(path, "w", newline="") as f:
            w = csv.writer(f)
            names = list(data[0])
            w.writerow(names)
            w.writerows([["NA" if r.get(n) is None else r[n] for n in names] for r in data])
        return files.read_survey(spark, str(path), schema)

    return read


def plots():
    return [("ABCD", i) for i in range(1, 5)] + [("EFGH", i) for i in range(1, 4)]


@pytest.fixture(scope="module")
def vegetation(load):
    rnd = random.Random(1)
    veg, groups = [], []
    for park, no in plots():
        groups.append({"event_name_date_calc": f"{park}{no:03d} - 2012", "lastCommGroup": "G015" if no != 3 else "G030"})
        for year in (2012, 2017):
            for quality in (False, True) if no == 1 else (False,):
                for name in rnd.sample(SPECIES, 5):
                    veg.append(
                        {
                            "extra": "ignored", "EventYear": year, "GRTSOrder": no, "Park": park[:2], "SubPark": park,
                            "QAQCPlot": quality, "PlantName": name, "ExoticPlant": name in ("Hedera helix", "Lonicera japonica"),
                            "HighPriorityExotic": name == "Hedera helix", "CoverClass": rnd.randint(1, 10),
                            **{f"PresMod{m}Corn{c}": rnd.choice([None, 0, 1, 2, 3]) for m in range(1, 5) for c in (1, 2)},
                            "BotanistName": "_" if no == 2 else "Ann", "Latitude": 35.0 + no, "Longitude": -85.0,
                        }
                    )
    return flows.clean_vegetation(load("veg", schemas.VEGETATION, veg), load("groups", schemas.COMMUNITY_GROUPS, groups))


def test_reading_by_name_counts_bad_cells(load):
    data = [{"CommGroup": "G1", "Fit": "1", "event_year": "2012", "QAQC": "0", "location_name": "A", "Community_Code": "C"}]
    data += [{**data[0], "Fit": "one", "event_year": "2012.0"}, {**data[0], "QAQC": None}]
    df = load("community-bad", schemas.COMMUNITY, data)
    assert df.columns[0] == "location_name" and [r.event_year for r in df.collect()] == [2012] * 3
    r = files.scan_report(df).first()
    assert (r.total_rows, r.bad_rows, r.empty_cells) == (3, 1, 2)
    with pytest.raises(ValueError, match="Transect"):
        load("community-missing", schemas.DEBRIS, data)


def test_vegetation_and_map_metrics(vegetation, rows):
    v = vegetation["rows"]
    assert v.where("cycle_no IS NULL OR `group` IS NULL").count() == 0
    assert vegetation["conflicts"].count() == 0 and vegetation["coverage"].count() == 0
    assert v.where("botanist = '_'").count() == 0
    assert rows(v.where("taxon = 'Quercus_alba'").select("genus", "confirmed", "target").distinct()) == [("Quercus", True, True)]
    out = flows.map_metrics(v, ["Hedera_helix"])
    metrics = out["metrics"]
    units = 2 * len(plots())
    assert rows(metrics.groupBy("metric").count()) == [(m, units) for m in ("exotic_cover", "exotic_richness", "native_richness", "priority_cover")]
    cover = metrics.where("metric = 'exotic_cover'")
    want = v.where("role = 'N'").groupBy("plot", "year").agg(
        F.bround(100 * F.sum(F.when(F.col("exotic"), F.col("cover")).otherwise(0)) / F.sum("cover"), 2).alias("want")
    )
    assert cover.join(want, ["plot", "year"]).where("abs(value - want) > 0.011").count() == 0
    assert out["labels"].count() == units
    assert rows(out["top_cover"].groupBy("subpark").count()) == [("ABCD", 2), ("EFGH", 2)]
    assert out["top_frequency"].count() == 4


def test_thresholds(load):
    rnd = random.Random(2)
    extract = [
        {"UnitCode": "ab", "SubunitCode": f"s{i % 2}", "panel_init_year": 2011, "CEGL": f"C{i % 3}", "cwd": rnd.uniform(0, 20)}
        for i in range(40)
    ]
    extract.append({**extract[0], "cwd": 9e9})
    growth = [{"UnitCode": "AB", "SubunitCode": "S0", "panel_init_year": 2011, "rate": rnd.uniform(50, 150)} for _ in range(20)]
    bins = load("bins", schemas.BINS, [{"CEGL": "C0", "gp1": "Oak"}, {"CEGL": "C1", "gp1": "Pine"}])
    out = flows.threshold_scorecard(
        {
            "woody_debris": (load("cwd", schemas.threshold_extract("cwd", True), extract), "cwd"),
            "tree_growth": (load("growth", schemas.threshold_extract("rate", False), growth), "rate"),
        },
        bins,
        {
            "woody_debris": {"cutoffs": CUT_OFFS["woody_debris"]},
            "tree_growth": {"cutoffs": CUT_OFFS["tree_growth"], "one_is_concern": False, "high_is_good": True},
        },
        reps=50,
        seed=1,
    )
    status = {(r.param, r.grain, r.subunit, r.grain_bin): r for r in out["status"].collect()}
    assert status[("woody_debris", "subunit", "S0", "")].n == 20 and ("woody_debris", "bin", "S1", "Oak") in status
    assert sum(r.n for k, r in status.items() if k[1] == "bin") < 40
    for r in status.values():
        assert r.mean_lo95 <= r.mean <= r.mean_hi95
    assert status[("tree_growth", "subunit", "S0", "")].status == "good"
    assert out["bands"].where("band_max = 99999").count() == 0


@pytest.fixture(scope="module")
def unit_rows():
    return [{"location_name": f"ABCD{i:03d}", "event_year": 2015, "QAQC": q} for i in range(1, 13) for q in (0, -1)]


def test_sites(load, unit_rows):
    rnd = random.Random(3)
    sites = [{**u, "Stand_Height": 20 + rnd.random(), **{d: rnd.random() < 0.5 for d in schemas.DISTURBANCES}} for u in unit_rows]
    debris = [{**u, "Transect": rnd.choice(["X", "Y"]), "Diameter": 9.0, "Decay_Class": 2} for u in unit_rows for _ in range(rnd.randint(1, 4))]
    debris.append({**unit_rows[0], "Transect": None, "Diameter": 9.0, "Decay_Class": 2})
    groups = ["G015", "G030"]
    community = [{**u, "Community_Code": "C1", "CommGroup": rnd.choice(groups), "Fit": rnd.randint(1, 3)} for u in unit_rows]
    out = flows.site_agreement(
        load("sites", schemas.SITES, sites), load("debris", schemas.DEBRIS, debris), load("comm", schemas.COMMUNITY, community), groups, 100, 1
    )
    assert out["height"].count() == 12 and out["height"].where("within_10").count() == 12
    total = out["debris_plot"].agg(F.sum(F.col("n_count") + F.col("q_count"))).first()[0]
    assert total == len(debris)
    assert out["debris_transect"].count() == 24
    assert out["debris_transect"].agg(F.sum(F.col("n_count") + F.col("q_count"))).first()[0] == len(debris) - 1
    assert out["community_matrix"].agg(F.sum("pairs")).first()[0] == 12
    psa = {r.category: r for r in out["community_agreement"].collect()}
    assert sum(r.denom for r in psa.values()) == 24
    assert out["disturbances"].count() == 9 and out["disturbance_intervals"].count() == 27
    fit = out["group_by_fit"].agg(F.sum(F.col("matches") + F.col("mismatches"))).first()[0]
    assert fit == 12
    for name in ("height_ecdf", "height_limits", "debris_plot_freq", "debris_transect_freq", "code_by_fit"):
        assert out[name].count() > 0


def test_trees(load):
    rnd = random.Random(4)

    def tree(i, mine, other, key):
        live = i % 4 != 0
        return {
            "Tree_ID": f"{mine}{i}", key: f"{other}{i}", "DBH": 10.0 + i + rnd.choice([0, 0, 1]), "Tree_Status": 1 if live else 2,
            "Crown_Class": rnd.randint(1, 5), "Vigor": rnd.randint(1, 2), "Dieback": None if i == 1 else rnd.randint(1, 5),
            **{f"Condition_Damage_Code_{k}": rnd.choice(["ab", "CD", None]) if k == 1 else None for k in range(1, 6)},
            **{f"Foliage_Condition_{k}": rnd.choice(["W", None]) if k == 1 else None for k in range(1, 6)},
            **{f"Foliage_Percent_Class_{k}": rnd.randint(1, 5) if k == 1 else None for k in range(1, 6)},
            "Snag_Height": None if live else 5.0 + rnd.random(), "Dead_Tree_Decay_Class": None if live else rnd.randint(1, 5),
            "ArboristName": rnd.choice(["Ann", "Bob"]),
        }

    first = [tree(i, "n", "q", "qaqcPlotTree_ID") for i in range(40)]
    again = [tree(i, "q", "n", "normalPlotTree_ID") for i in range(2, 45)]
    out = flows.tree_agreement(
        load("tn", schemas.TREES_FIRST, first), load("tq", schemas.TREES_AGAIN, again), ["AB", "CD"], ["W"], 100, 1
    )
    assert out["unlinked"].count() == 7
    status = {r.category: r for r in out["class_agreement"].where("metric = 'status'").collect()}
    assert status["1"].psa == 100.0 and status["1"].denom + status["2"].denom == 76
    assert {r.metric: r.matches + r.mismatches for r in out["class_overall"].collect()} == {
        "status": 38, "crown": 29, "vigor": 29, "dieback": 29, "snag_decay": 9
    }
    assert out["dbh"].count() == 38 and out["snag_height"].count() == 9
    assert {r.cdf for r in out["dbh_table"].where("difference = 1").collect()} == {100.0}
    damage = {r.code: r.n11 + r.n00 + r.n10 for r in out["damage"].collect()}
    assert damage == {"AB": 29, "CD": 29}
    rated = out["damage_raters"].where("code = 'AB'").agg(F.sum("rated_units")).first()[0]
    assert rated == 58
    fol = out["foliage"].first()
    assert fol.both_missing + fol.matched + fol.mismatched == 29
    for name in ("damage_intervals", "foliage_agreement", "snag_height_ecdf", "dbh_limits"):
        assert out[name].count() > 0

    # codes are found in the data; a foliage code that a tree has twice is compared twice
    more = [{**t, "Condition_Damage_Code_2": "zz"} if t["Tree_ID"] == "n5" else t for t in first]
    more = [{**t, "Foliage_Condition_2": "X", "Foliage_Percent_Class_2": 1, "Foliage_Condition_3": "X", "Foliage_Percent_Class_3": 2} if t["Tree_ID"] == "n6" else t for t in more]
    out = flows.tree_agreement(load("tn2", schemas.TREES_FIRST, more), load("tq2", schemas.TREES_AGAIN, again), reps=50)
    damage = {r.code: (r.n11, r.n10, r.n11 + r.n00 + r.n10) for r in out["damage"].collect()}
    assert set(damage) == {"AB", "CD", "ZZ"} and damage["ZZ"] == (0, 1, 29)
    fol = {r.code: (r.both_missing, r.matched, r.mismatched) for r in out["foliage"].collect()}
    assert fol["X"] == (28, 0, 2)


def test_readiness(spark, tmp_path):
    for name in ("Herbs.csv", "SiteMetrics.csv", "CWD.csv", "notes.txt"):
        (tmp_path / name).write_text("a,b\n")
    out = flows.readiness(spark, str(tmp_path))
    got = {r.analysis: (r.required_items, r.available_items, r.complete) for r in out["analyses"].collect()}
    assert got["QAQC - Herbs"] == (1, 1, True) and got["QAQC - Site"] == (3, 2, False) and got["Maps"] == (5, 0, False)
    assert {r.item for r in out["missing"].where("analysis = 'QAQC - Site'").collect()} == {"Community.csv"}
    flows.require(spark, str(tmp_path), "QAQC - Herbs")
    with pytest.raises(FileNotFoundError, match="Community.csv"):
        flows.require(spark, str(tmp_path), "QAQC - Site")


def test_counts(load, unit_rows):
    rnd = random.Random(5)
    trees = [
        {"location_name": u["location_name"], "event_year": 2015, "qaqc": u["QAQC"], "Module": m, "Tree_Number": t}
        for u in unit_rows for m in (1, 2, 3) for t in range(rnd.randint(0, 3))
    ]
    classes = [c.split()[0] for c in schemas._CLASSES.split(", ")]
    seeds = [
        {**u, "Module": m, "Corner": c, **{k: rnd.randint(0, 3) for k in classes}} for u in unit_rows for m, c in ((1, 2), (2, 3))
    ]
    canopy = [{**u, "Module": m, "Direction": d, "Spherical_Densiometer_Tally": rnd.randint(80, 96)} for u in unit_rows for m in (1, 2) for d in "NS"]
    out = flows.count_agreement(
        load("all", schemas.ALL_TREES, trees), load("seeds", schemas.SEEDLINGS, seeds), load("canopy", schemas.DENSIOMETER, canopy)
    )
    assert out["trees"].count() == 4 * len({t["location_name"] for t in trees})
    assert out["trees"].agg(F.sum(F.col("n_count") + F.col("q_count"))).first()[0] == len(trees)
    assert out["trees_table"].orderBy(F.desc("difference")).first().cdf == 100.0
    assert out["classes"].count() == 12 * 8 * 8
    assert out["classes"].agg(F.sum(F.col("n_sum") + F.col("q_sum"))).first()[0] == sum(r[k] for r in seeds for k in classes)
    assert out["classes_table"].select("size_class").distinct().count() == 8
    assert out["canopy"].groupBy("grain").count().where("grain = 'unit'").first()["count"] == 12
    assert out["canopy_table"].count() > 0 and out["trees_zero"].first().zero_zero_percent >= 25


def test_herbs(load, unit_rows):
    rnd = random.Random(6)
    data = [
        {**u, "Species_Original": s, "Cover_Class": rnd.randint(1, 3), **{f"Presence_Column_{i}": rnd.choice([None, 0, 1, 2]) for i in range(1, 9)}}
        for u in unit_rows for s in rnd.sample(SPECIES, 5)
    ]
    out = flows.herb_agreement(load("herbs", schemas.HERBS, data))
    s = out["summary"]
    assert s.where("n_only + q_only + matched <> unique_items").count() == 0
    assert s.where("turnover < 0 OR turnover > 100 OR match_by_unique > 100").count() == 0
    scales = {r["scale"]: r["count"] for r in s.where("subset = 'all'").groupBy("scale").count().collect()}
    assert scales["module"] == 4 * scales["plot"] and scales["cell"] == 8 * scales["plot"]
    # a subset never has more items than the whole
    wide = s.where("scale = 'plot'").groupBy("unit").pivot("subset", ["all", "high_cover", "rolled_up"]).agg(F.first("unique_items"))
    assert wide.where("high_cover > `all` OR rolled_up > `all`").count() == 0
    assert out["difference_table"].where("cdf = 100").count() >= 9
    assert out["class_table"].count() > 0 and out["match_lists"].count() == 12
    assert out["class_matrix"].agg(F.sum("pairs")).first()[0] == out["class_difference"].count()
    assert out["unmatched"].where("unmatched_percent <= 50").count() == 0
    few = {r.scale: r.n for r in out["unmatched_report"].groupBy("scale").agg(F.min("detections").alias("n")).collect()}
    assert all(n >= flows.REPORT_DETECTIONS[scale] for scale, n in few.items())
    numbers = {(r.subset, r.scale, r.variable): r for r in out["numbers"].collect()}
    assert len(numbers) == 3 * 3 * 8
    turnover = sorted(r.turnover for r in s.where("subset = 'all' AND scale = 'module' AND turnover IS NOT NULL").collect())
    got = numbers["all", "module", "turnover"]
    assert (got.minimum, got.maximum, got.median) == (turnover[0], turnover[-1], statistics.median(turnover))


def test_regeneration(load, vegetation, spark):
    rnd = random.Random(7)
    classes = ["Seedling_Ht_5_50", *[c.split()[0] for c in schemas._CLASSES.split(", ")]]
    events = [f"{p}{n:03d} - {y}" for p, n in plots() for y in (2012, 2017)] + ["ABCD009 - 2017"]
    seeds = [
        {"event_name_date_calc": e, "Module": m, "Corner": c, "Plant_Name": s, **{k: rnd.randint(0, 4) for k in classes}}
        for e in events for m, c in ((1, 2), (1, 4), (2, 2), (3, 4)) for s in ("Quercus alba", "Acer rubrum")
    ]
    trees = [
        {"event_name_date_calc": e, "Tree_Number": t, "Module": 1 + t % 4, "Plant_Name": rnd.choice(["Carya ovata", "Acer rubrum"]),
         "DBH": rnd.uniform(8, 30), "Tree_Status": rnd.choice([0, 1, 1, 2, 4])}
        for e in events for t in range(8)
    ]
    burns = [
        {"Plot": f"{p}{n:03d}", "Date_Plot_Established": "6/1/2012", "Date_Plot_Revisited": "6/15/2017", "Fire_Start_Date": f}
        for p, n in plots() for f in (("3/1/2014", "6/15/2017") if n == 1 else (None,))
    ]
    out = flows.regeneration(
        vegetation["rows"], load("rs", schemas.REGEN_SEEDLINGS, seeds), load("rt", schemas.REGEN_TREES, trees),
        load("burns", schemas.BURNS, burns), [1, 2], 60, 3,
    )
    added = out["main"].where("event = 'ABCD009 - 2017'").collect()
    assert [(r.park, r.plot, r.year, r.cycle_no, r.role, r.group) for r in added] == [("ABCD", "ABCD009", 2017, 2, "N", None)]
    boxes = out["boxes"]
    assert boxes.groupBy("event").count().where("count <> 8").count() == 0
    table = out["table"].collect()
    assert len(table) == 2 * 5  # five target plots, two cycles
    for r in table:
        assert 0 <= r.index_lo95 <= r.index_mean <= r.index_hi95 <= 2 and r.importance_lo95 <= r.importance_mean
        burned = r.plot.endswith("001") and r.cycle_no == 2
        assert r.event_since is burned
        assert (str(r.prior_event) == "2014-03-01") is burned
        assert r.cycle_display == ("[2011,2015]" if r.cycle_no == 1 else "[2016,2020]")
    areas = {(r.community_type, r.park): r.units for r in out["box_intervals"].collect()}
    assert areas == {("target", "ABCD"): 3, ("target", "EFGH"): 2, ("ruderal", "ABCD"): 1, ("ruderal", "EFGH"): 1}
    assert {r.park: (r.units, r.resurveyed) for r in out["resurveys"].collect()} == {"ABCD": (3, 3), "EFGH": (2, 2)}
    assert sum(r.n for r in out["rank_test"].collect()) == 5
    assert sum(r.n for r in out["importance_rank_test"].collect()) == 5
    for name, value in (("index_boxes", "index_mean"), ("importance_boxes", "importance_mean")):
        got = {(r.park, r.has_prior): (r.n, r.median) for r in out[name].collect()}
        want = {}
        for r in table:
            want.setdefault((r.park, r.has_prior), []).append(r[value])
        assert got == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in want.items()}
    for name in ("index_difference", "importance_difference"):
        assert all(r.p05 <= r.mean_difference <= r.p95 for r in out[name].collect())
    assert out["illegal_corners"].count() == 0
    missing = {r.missing for r in out["incomplete_events"].collect()}
    assert missing == {"M2C3,M3C2,M4C2,M4C3"}
    assert out["orphan_dates"].count() == 0 and out["years_since"].count() == 2
