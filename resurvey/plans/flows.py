"""The analyses from source tables to results, as compositions of the operators.

Every flow takes tables as read by ``read_survey`` with the types of ``sources.schemas`` and
returns named DataFrames.  Nothing runs before a result is written or shown, with three exceptions:
the size-checked resampling paths count their groups first, numbers by ranges write the rows they
number, and ``regeneration`` writes its prepared tables to the shared folder because many results
read them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resurvey.operators import agree, asof, bands, checks, clean, compose, detect, diffs, ranktest, regen, resample, reshape, roles
from resurvey.operators.roles import stack_metrics
from resurvey.session import exchange_dir
from resurvey.sources.files import files_in, filter_options, write_dataset
from resurvey.sources.schemas import DISTURBANCES

ORIGIN, WIDTH = 2010, 5
CELLS = ["m1c2", "m1c4", "m2c2", "m2c3", "m3c2", "m3c4", "m4c2", "m4c3"]
PAIRS = [("m1c2", "m1c4"), ("m2c2", "m2c3"), ("m3c2", "m3c4"), ("m4c2", "m4c3")]
MODULES = {"m1": PAIRS[0], "m2": PAIRS[1], "m3": PAIRS[2], "m4": PAIRS[3]}
CORNERS = [c.upper() for c in CELLS]
BOTH = {"N": "n", "Q": "q"}


def _staged(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back.

    For tables with several expensive consumers: the lineage is cut, and a lost executor costs
    a re-read, not the joins behind the table.
    """
    spark = df.sparkSession
    return spark.read.parquet(write_dataset(df, exchange_dir(spark, name)))


def _survey(df: DataFrame, code: str = "QAQC") -> DataFrame:
    """Unit (plot-year) and role of a re-survey table."""
    keyed = clean.composite_key(df, {"unit": ["location_name", ("text", "_"), "event_year"]})
    return clean.role_from_code(keyed, code, 0, -1)


# ---- readiness --------------------------------------------------------------------

# ---- fixed values: the files each analysis needs
REQUIRED_FILES = {
    "Maps": ["VegDat.csv", "FinalCG.csv", "OakHickSS.csv", "OakHickTree.csv", "BurnPlots.csv"],
    "Oak-Hickory": ["VegDat.csv", "FinalCG.csv", "OakHickSS.csv", "OakHickTree.csv", "BurnPlots.csv"],
    "QAQC - Herbs": ["Herbs.csv"],
    "QAQC - Trees": ["TreesNorm.csv", "TreesQAQC.csv", "AllTrees.csv", "SeedlingsSaplings.csv", "Densiometer.csv"],
    "QAQC - Site": ["SiteMetrics.csv", "CWD.csv", "Community.csv"],
    "Thresholds": [
        "cegl_x_bin.csv", "qry_event_HPExotic_count_byPanelYear.csv", "qry_snagDensity_event_panel.csv",
        "qry_stat_cwd_byPanelYear.csv", "qry_tree_eventGrowthMort_panel.csv",
    ],
}
# ---------------------------------------------------------------------------------


def readiness(spark: SparkSession, folder: str, required: Mapping[str, Sequence[str]] = REQUIRED_FILES) -> dict[str, DataFrame]:
    """Which analyses can run on the files of a folder: ``analyses`` (A3) and the ``missing`` files.

    Only the names of the files are read.
    """
    rows = [(analysis, item) for analysis, items in required.items() for item in items]
    needed = spark.createDataFrame(rows, "analysis string, item string")
    found = files_in(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("item"))
    return {
        "analyses": checks.covers_required(needed, found, "analysis", "item"),
        "missing": checks.missing_required(needed, found, "analysis", "item"),
    }


def require(spark: SparkSession, folder: str, analysis: str, required: Mapping[str, Sequence[str]] = REQUIRED_FILES) -> None:
    """Stop with the names of the files that an analysis lacks; to be called in front of it."""
    missing = readiness(spark, folder, {analysis: required[analysis]})["missing"]
    names = sorted(r["item"] for r in missing.collect())  # files of one analysis
    if names:
        raise FileNotFoundError(f"{analysis} needs {', '.join(names)} in {folder}")


# ---- vegetation -------------------------------------------------------------------


def clean_vegetation(veg: DataFrame, groups: DataFrame, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cleaned vegetation rows with keys, cycle, cover, taxon parts, filled cells and community group.

    ``overrides`` (plot, group) replaces groups known to be wrong.  ``conflicts`` lists plots with
    more than one group and ``coverage`` the plots known to one table only.
    """
    dim = clean.parse_key(groups, "event_name_date_calc").select(
        F.col("key_plot").alias("plot"), F.col("lastCommGroup").alias("group")
    )
    dim = dim.distinct()
    raw_cells = [f"PresMod{m}Corn{c}" for m in range(1, 5) for c in (1, 2)]
    renamed = veg.select(
        F.col("EventYear").cast("long").alias("year"),
        F.concat("SubPark", clean.pad_id(F.col("GRTSOrder"), 3)).alias("plot"),
        F.col("Park").alias("park"),
        F.col("SubPark").alias("subpark"),
        F.when(F.col("QAQCPlot"), "Q").otherwise("N").alias("role"),
        "PlantName",
        F.col("ExoticPlant").alias("exotic"),
        F.col("HighPriorityExotic").alias("priority"),
        F.col("CoverClass").alias("cover_class"),
        clean.cover_percent(F.col("CoverClass")).alias("cover"),
        F.col("BotanistName").alias("botanist"),
        F.col("Latitude").alias("latitude"),
        F.col("Longitude").alias("longitude"),
        *[F.col(r).cast("long").alias(c) for r, c in zip(raw_cells, CELLS, strict=True)],
    )
    mark = F.when(F.col("role") == "Q", "Q").otherwise("")
    keyed = clean.composite_key(renamed, {"event": ["plot", mark, ("text", " - "), "year"]})
    keyed = clean.cycle_bin(keyed, "year", ORIGIN, WIDTH)
    named = clean.taxon_parts(keyed, "PlantName").drop("PlantName")
    named = clean.taxon_flag(named, "taxon", clean.DIFFICULT_PREFIXES, clean.DIFFICULT_EXCEPTIONS, clean.TARGET_GENERA)
    named = clean.normalise_tokens(named, {"botanist": "_"})
    joined = roles.lookup(named, dim, "plot")
    joined = clean.apply_overrides(joined, "plot", overrides)
    return {
        "rows": clean.impute_cells(joined, PAIRS),
        "conflicts": dim.groupBy("plot").count().where("count > 1").select("plot"),
        "coverage": roles.key_differences(dim, named, "plot"),
        "options": filter_options(joined, ["park", "subpark", "cycle"]),
    }


def map_metrics(rows: DataFrame, priority_items: Sequence[str]) -> dict[str, DataFrame]:
    """Map table of cover and richness per unit, leading exotics per area and cycle, unit labels."""
    first = rows.where(F.col("role") == "N")
    unit = ["park", "subpark", "plot", "cycle", "year", "longitude", "latitude"]
    comp = compose.composition(first, unit, "exotic", F.col("confirmed"), "cover")
    listed = first.withColumn("taxon", F.when(F.col("priority"), F.col("taxon")))
    priority = compose.priority_item_cover(listed, unit, "taxon", "cover", priority_items)
    exotics = compose.item_totals(first.where("exotic"), ["subpark", "cycle"], "taxon", "cover")
    total = first.groupBy("subpark", "plot", "cycle", "year").agg(F.sum("cover").alias("total"))
    title = F.concat(F.col("plot"), F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    return {
        "metrics": compose.unit_metrics(comp, priority, unit, "plot", "year"),
        "top_cover": compose.top_list(exotics, ["subpark", "cycle"], "taxon", "cover", 3),
        "top_frequency": compose.top_list(exotics, ["subpark", "cycle"], "taxon", "freq", 3),
        "labels": clean.describe_units(
            first.where("exotic"), ["subpark", "plot", "cycle", "year"], title, "taxon", "cover", total, "total", "EXOTIC COVER"
        ),
    }


# ---- thresholds -------------------------------------------------------------------


def threshold_scorecard(
    extracts: Mapping[str, tuple[DataFrame, str]],
    community_bins: DataFrame,
    limits: Mapping[str, dict],
    reps: int,
    seed: int,
    stat: str = "mean",
) -> dict[str, DataFrame]:
    """Summaries, bands and status of several measures.

    ``extracts`` maps a parameter to its table and measure column; ``limits`` to the arguments
    of ``band_limits`` (cutoffs, one_is_concern, high_is_good).
    """
    rows, limit_rows = {}, {}
    dim = community_bins.select("CEGL", F.col("gp1").alias("bin"))
    for param, (df, measure) in extracts.items():
        binned = roles.lookup(df, dim, "CEGL") if "CEGL" in df.columns else df.withColumn("bin", F.lit(None).cast("string"))
        good = clean.valid_rows(binned.withColumn("y", F.col(measure)), "y").select(
            F.upper("UnitCode").alias("unit"), F.upper("SubunitCode").alias("subunit"),
            F.col("panel_init_year").alias("period"), "bin", "y",
        )
        rows[param] = good
        limit_rows[param] = bands.band_limits(good, "y", **limits[param])
    keys = ["param", "grain", "unit", "subunit", "grain_bin", "period"]
    grains = bands.two_grains(stack_metrics(rows, "param"), ["unit", "subunit", "period"], "bin")
    summary = bands.subunit_summary(grains, keys, "y").join(
        resample.mean_median_interval(grains, keys, "y", reps, seed), keys, "left"
    )
    table = summary.withColumns({"value": F.col(stat), "hi95": F.col(f"{stat}_hi95")})
    closed = bands.close_bands(stack_metrics(limit_rows, "param"), table, "param", ["value", "hi95"])
    return {"summary": summary, "bands": closed, "status": bands.band_status(table, closed, "param", "value")}


# ---- agreement of re-surveys ------------------------------------------------------


def site_agreement(
    sites: DataFrame, debris: DataFrame, community: DataFrame, groups: Sequence[str], reps: int, seed: int
) -> dict[str, DataFrame]:
    """Stand height, woody debris counts, community calls and site disturbances."""
    s, d, c = _survey(sites), _survey(debris), _survey(community)
    height = diffs.paired_difference(
        diffs.pair_values(s, ["unit"], "role", "Stand_Height"), "n_val", "q_val", "percent", (5, 10)
    )
    plot = diffs.paired_difference(diffs.role_counts(d, ["unit"], "role"), "n_count", "q_count")
    known = d.where(F.col("Transect").isNotNull())
    transect = diffs.role_counts(known, ["unit"], "role", sub="Transect", sub_levels=["X", "Y"])
    transect = diffs.paired_difference(transect, "n_count", "q_count")
    calls = reshape.pair_by_role(c, ["unit"], "role", ["CommGroup", "Community_Code", "Fit"], BOTH)
    long = s.select("unit", "role", *DISTURBANCES).unpivot(["unit", "role"], DISTURBANCES, "code", "seen")
    seen = reshape.pair_by_role(long, ["unit", "code"], "role", ["seen"], BOTH)
    return {
        "height": height,
        "height_ecdf": diffs.ecdf_at(height, "metric", 5),
        "height_limits": diffs.bland_altman(height, "n_val", "q_val"),
        "debris_plot": plot,
        "debris_plot_freq": diffs.difference_freq(plot, "metric"),
        "debris_transect": transect,
        "debris_transect_freq": diffs.difference_freq(transect, "metric"),
        "community": calls,
        "community_agreement": resample.psa_interval(calls, "n_CommGroup", "q_CommGroup", groups, reps, seed),
        "community_matrix": agree.interrater_matrix(calls, "n_CommGroup", "q_CommGroup", groups),
        "group_by_fit": agree.fit_crosstab(calls, "n_CommGroup", "q_CommGroup", "n_Fit", "q_Fit"),
        "code_by_fit": agree.fit_crosstab(calls, "n_Community_Code", "q_Community_Code", "n_Fit", "q_Fit"),
        "disturbances": agree.code_agreement(seen, "code", "n_seen", "q_seen"),
        "disturbance_intervals": resample.psa_interval(
            seen, "n_seen", "q_seen", ["true", "false"], reps, seed, by=["code"]
        ),
    }


_TREE_VALUES = {
    "DBH": "DBH",
    "Tree_Status": "status",
    "Crown_Class": "crown",
    "Vigor": "vigor",
    "Dieback": "dieback",
    "Snag_Height": "snag_height",
    "Dead_Tree_Decay_Class": "snag_decay",
    "ArboristName": "rater",
}
_DAMAGE = [f"Condition_Damage_Code_{i}" for i in range(1, 6)]
_FOLIAGE = [(f"Foliage_Condition_{i}", f"Foliage_Percent_Class_{i}") for i in range(1, 6)]


def tree_agreement(
    first: DataFrame, again: DataFrame, damage_codes: Sequence[str] = (), foliage_codes: Sequence[str] = (), reps: int = 1000, seed: int = 1
) -> dict[str, DataFrame]:
    """Classes, diameters, snag heights, damage codes and foliage conditions of linked trees.

    Damage and foliage codes are all that occur, and those of the given lists.  A foliage code that a
    tree has several times is compared with each of the other survey's levels.
    """
    rename = {k: v for k, v in _TREE_VALUES.items() if k != v}
    n = first.withColumnsRenamed({**rename, "Tree_ID": "id", "qaqcPlotTree_ID": "link_id"})
    q = again.withColumnsRenamed({**rename, "Tree_ID": "id", "normalPlotTree_ID": "link_id"})
    cols = ["DBH", "status", "crown", "vigor", "dieback", "snag_height", "snag_decay"]
    pairs = roles.pair_by_link(n, q, "link_id", "id", cols)
    both = lambda ok: F.col("status_1").isin(ok) & F.col("status_2").isin(ok)

    # one long pass over all class variables; a pair missing on both sides drops out for dieback
    def entry(metric: str, c: str, keep: Column) -> Column:
        value = F.struct(F.lit(metric).alias("metric"), F.col(f"{c}_1").alias("value1"), F.col(f"{c}_2").alias("value2"))
        return F.when(keep, value)

    some = F.col("dieback_1").isNotNull() | F.col("dieback_2").isNotNull()
    classes = F.array_compact(
        F.array(
            entry("status", "status", F.lit(True)),
            entry("crown", "crown", both([1])),
            entry("vigor", "vigor", both([1])),
            entry("dieback", "dieback", both([1]) & some),
            entry("snag_decay", "snag_decay", both([2])),
        )
    )
    long = pairs.select("link", F.explode(classes).alias("_c")).select("link", "_c.*")
    dbh = pairs.where(both([1, 2])).select("link", F.col("DBH_1").alias("n_val"), F.col("DBH_2").alias("q_val"))
    dbh = diffs.paired_difference(clean.complete_cases(dbh, ["n_val", "q_val"]), "n_val", "q_val")
    snag = pairs.where(both([2])).select("link", F.col("snag_height_1").alias("n_val"), F.col("snag_height_2").alias("q_val"))
    snag = diffs.paired_difference(clean.complete_cases(snag, ["n_val", "q_val"]), "n_val", "q_val", "percent", (10,))

    live = roles.both_status(n, q, "link_id", "id", "status", [1])
    n1 = n.join(live, n["link_id"] == live["link"], "left_semi")
    q1 = q.join(live, q["id"] == live["link"], "left_semi")
    flags = agree.flag_pairs(n1, q1, "link_id", "id", _DAMAGE, "rater", damage_codes)

    def levels(df: DataFrame, key: str, out: str) -> DataFrame:
        cells = F.array(*[F.struct(F.coalesce(F.col(c), F.lit("NA")).alias("code"), F.col(p).alias("level")) for c, p in _FOLIAGE])
        return df.select(F.col(key).alias("link"), F.filter(cells, lambda x: (x["code"] != "NA") | x["level"].isNotNull()).alias(out))

    fol_n, fol_q = levels(n1, "link_id", "_a"), levels(q1, "id", "_b")
    found = fol_n.select(F.explode("_a").alias("x")).unionByName(fol_q.select(F.explode("_b").alias("x"))).select("x.code")
    fol = fol_n.join(fol_q, "link", "left").withColumn("code", F.explode(reshape.code_list(found, "code", foliage_codes)))

    def pick(c: str) -> Column:
        """All levels of the code, or one NULL."""
        own = F.transform(F.filter(F.coalesce(F.col(c), F.array().cast(fol_n.schema["_a"].dataType)), lambda x: x["code"] == F.col("code")), lambda x: x["level"])
        return F.explode(F.when(F.size(own) == 0, F.array(F.lit(None))).otherwise(own))

    fol = fol.select("link", "code", "_b", pick("_a").alias("v1")).select("link", "code", "v1", pick("_b").alias("v2"))
    return {
        "unlinked": roles.unlinked(n, q, "link_id", "id", "link_id", "id"),
        "classes": long,
        "class_agreement": resample.psa_interval(long, "value1", "value2", range(6), reps, seed, by=["metric"]),
        "class_overall": agree.overall_agreement(long, "value1", "value2", ["metric"]),
        "dbh": dbh,
        "dbh_table": diffs.difference_cdf(dbh, "metric"),
        "dbh_limits": diffs.bland_altman(dbh, "n_val", "q_val"),
        "snag_height": snag,
        "snag_height_ecdf": diffs.ecdf_at(snag, "metric", 10),
        "damage": agree.code_agreement(flags, "code", "v1", "v2"),
        "damage_intervals": resample.psa_interval(flags, "v1", "v2", ["true", "false"], reps, seed, missing=False, by=["code"]),
        "damage_raters": agree.rater_rates(flags, "code", "rater1", "v1", "rater2", "v2"),
        "foliage": agree.match_types_optional(fol, "code", "v1", "v2"),
        "foliage_agreement": resample.psa_interval(fol, "v1", "v2", range(1, 6), reps, seed, by=["code"]),
    }


def count_agreement(all_trees: DataFrame, seedlings: DataFrame, densiometer: DataFrame) -> dict[str, DataFrame]:
    """Tree counts per module, seedling and sapling counts per corner, canopy means at two grains."""
    trees = diffs.role_counts(_survey(all_trees, "qaqc"), ["unit"], "role", sub="Module", sub_levels=[1, 2, 3, 4])
    trees = diffs.paired_difference(trees, "n_count", "q_count")
    keyed = clean.composite_key(_survey(seedlings), {"corner": [("text", "M"), "Module", ("text", "C"), "Corner"]})
    cols = [c for c in seedlings.columns if c.startswith(("Seedling_", "Sapling_"))]
    sums = diffs.role_class_sums(keyed, ["unit"], "role", "corner", CORNERS, cols)
    sums = diffs.paired_difference(sums, "n_sum", "q_sum", tolerances=(1, 3))
    canopy = diffs.role_means(_survey(densiometer), "unit", "role", "Module", "Spherical_Densiometer_Tally")
    canopy = diffs.paired_difference(canopy, "n_mean", "q_mean", tolerances=(1, 3))
    return {
        "trees": trees,
        "trees_table": diffs.difference_cdf(trees, "metric"),
        "trees_zero": diffs.zero_zero_share(trees, "n_count", "q_count"),
        "classes": sums,
        "classes_table": diffs.difference_cdf(sums, "metric", ["size_class"]),
        "canopy": canopy,
        "canopy_table": diffs.interval_freq(canopy, "metric", 3, ["grain"]),
    }


# ---- fixed values: detections that make an item worth listing, on the charts and in the report
MIN_DETECTIONS = {"plot": 5, "module": 30, "cell": 30}
REPORT_DETECTIONS = {"plot": 5, "module": 30, "cell": 60}
# ---------------------------------------------------------------------------------
_HERB_NUMBERS = ["n_richness", "q_richness", "turnover", "rich_diff_percent", "unique_items", "matched", "match_by_mean", "match_by_unique"]


def herb_agreement(
    herbs: DataFrame, exclude: DataFrame | None = None, min_detections: Mapping[str, int] = MIN_DETECTIONS
) -> dict[str, DataFrame]:
    """Richness and detection of herbs by both surveys; ``exclude`` (item) leaves names out."""
    rows = _survey(herbs).select(
        "unit", "role", F.col("Species_Original").alias("item"), F.col("Cover_Class").alias("cover_class"),
        *[F.col(f"Presence_Column_{i}").cast("long").alias(c) for i, c in enumerate(CELLS, 1)],
    )
    if exclude is not None:
        rows = clean.apply_overrides(rows, "item", exclude=exclude)
    base_set = F.col("item").isNotNull() & ~F.col("item").endswith(" sp.")
    base = clean.presence_flags(clean.impute_cells(rows, PAIRS), CELLS, MODULES)
    rolled = clean.roll_up_taxa(rows, "item", clean.ROLL_UP_CODES, ["unit", "role"], CELLS)
    rolled = clean.presence_flags(clean.impute_cells(rolled, PAIRS), CELLS, MODULES)
    flags = detect.scale_columns(MODULES, CELLS)
    summary = detect.detection_report(base, rolled, ["unit"], "item", flags, (F.col("cover_class") > 1) & base_set)
    match = detect.detection_match(base.where("in_plot"), ["unit"], "item")
    scaled = detect.scaled_match(base, ["unit"], "item", flags)
    classes = detect.class_difference(base.where("in_plot"), ["unit"], "item", "cover_class")
    return {
        "summary": summary,
        "difference_table": diffs.difference_cdf(summary, "rich_diff", ["subset", "scale"]),
        "unmatched": stack_metrics(
            {s: detect.unmatched_items(scaled.where(F.col("scale") == s), "item", k) for s, k in min_detections.items()}, "scale"
        ),
        "unmatched_report": stack_metrics(
            {s: detect.unmatched_items(scaled.where(F.col("scale") == s), "item", k) for s, k in REPORT_DETECTIONS.items()}, "scale"
        ),
        "numbers": diffs.numeric_summary(summary, _HERB_NUMBERS, ["subset", "scale"]),
        "match_lists": detect.match_lists(match, ["unit"], "item"),
        "class_difference": classes,
        "class_table": diffs.difference_cdf(classes, "abs_diff"),
        "class_matrix": agree.interrater_matrix(classes, "n_class", "q_class", range(1, 11)),
    }


# ---- regeneration -----------------------------------------------------------------

_CLASS_NAMES = {
    "Seedling_Ht_5_50": "seed5_50",
    "Seedling_Ht_5_15": "seed5_15",
    "Seedling_Ht_15_30": "seed15_30",
    "Seedling_Ht_30_50": "seed30_50",
    "Seedling_Ht_50_137": "seed50_137",
    "Sapling_DBH_0_1": "sap0_1",
    "Sapling_DBH_1_2half": "sap1_25",
    "Sapling_DBH_2half_5": "sap25_5",
    "Sapling_DBH_5_10": "sap5_10",
}


def regeneration(
    rows: DataFrame,
    seedlings: DataFrame,
    trees: DataFrame,
    burns: DataFrame,
    cycles: Sequence[int],
    reps: int,
    seed: int,
    exclude: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Box counts, sustainability index, importance, burn history and rank tests of target plots.

    ``rows`` are the cleaned vegetation rows; ``exclude`` (event) leaves out incomplete events.
    """
    main = rows.select("event", F.col("subpark").alias("park"), "plot", "year", "cycle_no", "role", "group").distinct()
    groups = main.select("plot", "group").where(F.col("group").isNotNull()).distinct()

    def prepare(df: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = df.withColumnRenamed("event_name_date_calc", "event")
        if exclude is not None:
            named = clean.apply_overrides(named, "event", exclude=exclude)
        filled, whole = roles.backfill_events(named, known, "event", groups, ORIGIN, WIDTH)
        flagged = clean.taxon_flag(filled, "Plant_Name", [], [], clean.TARGET_GENERA).drop("difficult")
        kinds = {"target": clean.TARGET_COMMUNITIES, "ruderal": clean.RUDERAL_COMMUNITIES}
        return clean.classify_membership(flagged, "group", kinds, "other", "community_type"), whole

    corners, main = prepare(seedlings.withColumnsRenamed(_CLASS_NAMES), main)
    corners = clean.composite_key(corners, {"corner": [("text", "M"), "Module", ("text", "C"), "Corner"]})
    stems, main = prepare(trees.withColumnsRenamed({"DBH": "dbh", "Tree_Status": "status", "Module": "module"}), main)
    stems = clean.recode(stems, "status", {0: 2, 4: 2})
    corners, stems, main = _staged(corners, "corners"), _staged(stems, "stems"), _staged(main, "main")

    event = ["event", "park", "community_type", "plot", "cycle_no", "role"]
    boxes = regen.box_counts(
        corners.where("community_type <> 'other'"), event, "corner", "target", regen.BOX_CLASSES, 8
    )
    box_means = resample.cluster_bootstrap(
        boxes.where("cycle_no = 1"), ["community_type", "park"], "plot", "box_count", 8, 2 * reps, seed
    )

    # indices: first surveys of target plots on the full corner and module grids
    keep = (F.col("community_type") == "target") & (F.col("role") == "N")
    strata = ["plot", "cycle_no"]
    index_classes = {**regen.INDEX_CLASSES, "seedlings": ["seed5_50", *regen.INDEX_CLASSES["seedlings"]]}

    def grid(df: DataFrame, classes: Mapping[str, Sequence[str]], targets: Sequence[bool]) -> DataFrame:
        sums = df.groupBy("event", *strata, "target", "corner").agg(
            *[F.sum(e).alias(n) for n, e in regen.shares(classes).items()]
        )
        return reshape.complete_grid(sums, ["event", *strata], {"target": targets, "corner": CORNERS}, list(classes))

    keys = ["event", *strata]
    small = regen.module_tree_counts(stems.where(keep), keys, 10, 15, [1, 2, 3, 4])
    all_trees = regen.module_tree_counts(stems.where(keep), keys, None, None, [1, 2, 3, 4], targets=(True,))
    index = resample.regen_index_interval(
        grid(corners.where(keep), index_classes, [True, False]), small, strata, "event", reps, seed
    )
    importance = resample.importance_interval(
        grid(corners.where(keep & F.col("target")), regen.IMPORTANCE_CLASSES, [True]), all_trees, strata, "event", reps, seed
    )
    rename = lambda df, tag: df.withColumnsRenamed({c: f"{tag}_{c}" for c in ("mean", "lo95", "hi95")})
    metrics = rename(index, "index").join(rename(importance, "importance"), [*strata, "event"], "full")
    metrics = metrics.withColumns({c: F.bround(c, 2) for c in metrics.columns if c not in (*strata, "event")})
    metrics = _staged(metrics, "metrics")

    # burn history
    dates = clean.survey_dates(
        burns.withColumnRenamed("Plot", "plot"), "plot", ["Date_Plot_Established", "Date_Plot_Revisited"]
    )
    fires = burns.select(
        F.col("Plot").alias("plot"), F.try_to_date(F.col("Fire_Start_Date"), "M/d/y").alias("event_date")
    )
    events = main.where(F.col("role") == "N").select("event", "park", "plot", "year", "cycle_no", "role")
    dated = events.join(dates, ["plot", "year"], "left")
    history = asof.asof_prior(dated, fires.where("event_date IS NOT NULL").distinct(), "plot", "survey_date", "event_date", "role")
    history = asof.event_since_previous(history, "plot", "cycle_no", "survey_date", "prior_event", "role", 1825)
    table = regen.regen_table(
        metrics, history.select("event", "park", "survey_date", "prior_event", "has_prior", "event_since"),
        "plot", cycles, ["event"], ORIGIN, WIDTH,
    )

    exposed = history.groupBy("plot").agg(F.bool_or("has_prior").alias("exposed"))
    last, start = max(cycles), min(cycles)
    surveyed = table.where(F.col("event").isNotNull())
    tested = (
        surveyed.groupBy("park", "plot", "cycle_no")
        .agg(F.avg("index_mean").alias("index_mean"), F.avg("importance_mean").alias("importance_mean"))
        .join(exposed, "plot", "left")
        .withColumn("exposed", F.coalesce("exposed", F.lit(False)))
    )
    rank_test = lambda value: ranktest.signed_rank_by_group(tested, ["park", "exposed"], "plot", "cycle_no", value, start, last)

    # both surveys of a plot in one cycle
    paired = [*keys, "role"]
    both = F.col("community_type") == "target"
    sized = lambda lo, hi, targets: regen.module_tree_counts(
        stems.where(both), paired, lo, hi, [1, 2, 3, 4], targets=targets, role=None
    )
    indices = regen.regen_index(corners.where(both), sized(10, 15, (True, False)), paired, index_classes)
    scores = regen.importance_score(corners.where(both), sized(None, None, (True,)), paired)
    difference = lambda df, value: regen.role_index_difference(
        df.groupBy(*strata, "role").agg(F.avg(value).alias(value)), strata, "role", value
    )
    return {
        "main": main,
        "boxes": boxes,
        "box_intervals": box_means,
        "resurveys": regen.resurvey_counts(
            main.where(F.col("group").isin(clean.TARGET_COMMUNITIES)), "park", "plot", "event", "cycle_no", "role"
        ),
        "table": table,
        "illegal_corners": checks.illegal_codes(corners, ["event"], "corner", CORNERS),
        "incomplete_events": checks.incomplete_parents(corners, ["event"], "corner", CORNERS),
        "orphan_dates": dates.join(events.select("plot", "year"), ["plot", "year"], "left_anti"),
        "rank_test": rank_test("index_mean"),
        "importance_rank_test": rank_test("importance_mean"),
        "index_difference": difference(indices, "regen_index"),
        "importance_difference": difference(scores, "importance"),
        "index_boxes": regen.box_stats(surveyed, ["park", "has_prior"], "index_mean"),
        "importance_boxes": regen.box_stats(surveyed, ["park", "has_prior"], "importance_mean"),
        "years_since": asof.years_since_event(history, "survey_date", "prior_event", "role"),
    }
