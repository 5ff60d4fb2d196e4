"""Queries: sources and sinks (A), row cleaning (B), reshaping (C)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from resurvey.operators import checks, clean, reshape
from resurvey.operators.compose import composition
from resurvey.plans.registry import query, rounded, text_date
from resurvey.plans.views import CELLS, MODULES, PAIRS, Views
from resurvey.session import exchange_dir
from resurvey.sources import files

ITEM_CELLS = ["unit", "role", "item"]

# ---- A: sources and sinks ---------------------------------------------------------

_GRADED = "CASE WHEN o_orderpriority LIKE '4%' THEN 'x' ELSE substr(o_orderpriority, 1, 1) END"


def _orders_csv(v: Views) -> str:
    """The orders table written as CSV, one column holding text where numbers are expected."""
    path = exchange_dir(v.spark, "orders-csv")
    rows = v.table("orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("survey_date"),
        F.coalesce(F.expr(_GRADED), F.lit("NA")).alias("grade"),
        "o_totalprice",
    )
    return files.write_dataset(rows, path, "csv")


ORDERS_CSV = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("survey_date", T.DateType()),
        T.StructField("grade", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


@query(
    "csv_scan",
    sql="""
SELECT o_orderkey, o_orderdate::DATE AS survey_date,
       CASE WHEN o_orderpriority NOT LIKE '4%' THEN substr(o_orderpriority, 1, 1)::BIGINT END AS grade,
       o_totalprice, o_orderpriority LIKE '4%' AS bad_row
FROM orders""",
)
def csv_scan(v: Views):
    """A1."""
    df = files.read_survey(v.spark, _orders_csv(v), ORDERS_CSV)
    return df.withColumn("bad_row", F.col(files.BAD_CELLS) > 0).drop(files.BAD_CELLS)


@query(
    "csv_scan_report",
    sql="""
SELECT count(*) AS total_rows, count(*) FILTER (o_orderpriority LIKE '4%') AS bad_rows,
       count(*) FILTER (o_orderpriority LIKE '4%') AS empty_cells
FROM orders""",
)
def csv_scan_report(v: Views):
    """A1."""
    return files.scan_report(files.read_survey(v.spark, _orders_csv(v), ORDERS_CSV))


@query(
    "parquet_round_trip",
    sql="SELECT o_orderkey, o_custkey, o_orderdate::DATE AS survey_date, o_totalprice, o_orderstatus FROM orders",
)
def parquet_round_trip(v: Views):
    """A2."""
    rows = v.table("orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("survey_date"), "o_totalprice", "o_orderstatus"
    )
    path = files.write_dataset(rows, exchange_dir(v.spark, "orders"), "parquet", ["o_orderstatus"])
    return v.spark.read.parquet(path)


def _requirements(v: Views):
    need = v.table("lineitem").select(F.col("l_suppkey").alias("analysis"), F.col("l_partkey").alias("input"))
    have = v.table("lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("input"))
    return need, have


@query(
    "inputs_present",
    sql="""
WITH need AS (SELECT DISTINCT l_suppkey AS analysis, l_partkey AS input FROM lineitem),
have AS (SELECT DISTINCT l_partkey AS input, TRUE AS ok FROM lineitem WHERE l_quantity >= 40)
SELECT analysis, count(*) AS required_items, count(ok) AS available_items, count(*) = count(ok) AS complete
FROM need LEFT JOIN have USING (input) GROUP BY analysis""",
)
def inputs_present(v: Views):
    """A3."""
    need, have = _requirements(v)
    return checks.covers_required(need, have, "analysis", "input")


@query(
    "inputs_missing",
    sql="""
SELECT DISTINCT l_suppkey AS analysis, l_partkey AS input FROM lineitem
WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)""",
)
def inputs_missing(v: Views):
    """A3."""
    need, have = _requirements(v)
    return checks.missing_required(need, have, "analysis", "input")


@query(
    "filter_options",
    "thr",
    """
SELECT DISTINCT variable, value
FROM (SELECT unit, subunit, bin, period::VARCHAR AS period FROM v_thr)
     UNPIVOT (value FOR variable IN (unit, subunit, bin, period))""",
)
def filter_options(v: Views):
    """A4."""
    return files.filter_options(v.thr(), ["unit", "subunit", "bin", "period"])


@query(
    "extent_by_unit",
    "bound",
    """
SELECT unit, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
       round_even((min(x) + max(x)) / 2, 6) AS x_centre, round_even((min(y) + max(y)) / 2, 6) AS y_centre,
       count(DISTINCT piece) AS pieces
FROM v_bound GROUP BY unit""",
)
def extent_by_unit(v: Views):
    """A5."""
    return rounded(files.extent_by_unit(v.bound(), "unit", "x", "y", "piece"), 6, "x_centre", "y_centre")


# ---- B: row cleaning --------------------------------------------------------------


@query(
    "composite_keys",
    "spec",
    """
SELECT supp, year, role, item,
       CASE WHEN supp < 100000 THEN lpad(supp::VARCHAR, 5, '0') ELSE supp::VARCHAR END AS padded,
       concat(plot, '_', year) AS plot_year,
       concat(plot, CASE WHEN role = 'Q' THEN 'Q' ELSE '' END, ' - ', year) AS event_id,
       concat('M', 1 + supp % 4, 'C', 1 + supp % 8) AS module_corner
FROM v_spec""",
)
def composite_keys(v: Views):
    """B1."""
    supp = F.col("supp")
    spec = {
        "padded": [clean.pad_id(supp, 5)],
        "plot_year": ["plot", ("text", "_"), "year"],
        "event_id": ["plot", F.when(F.col("role") == "Q", "Q").otherwise(""), ("text", " - "), "year"],
        "module_corner": [("text", "M"), 1 + supp % 4, ("text", "C"), 1 + supp % 8],
    }
    return clean.composite_key(v.spec(), spec).select("supp", "year", "role", "item", *spec)


@query(
    "key_parts",
    "spec",
    """
SELECT DISTINCT event_id, substr(event_id, 1, 4) AS key_park, substr(event_id, 1, 7) AS key_plot,
       year AS key_year
FROM (SELECT CASE WHEN role = 'N' THEN concat(plot, ' - ', year) ELSE concat(plot, 'Q', year) END AS event_id, year
      FROM v_spec)""",
)
def key_parts(v: Views):
    """B2. First surveys carry the dash form, re-surveys the bare year at the end."""
    dash = F.concat("plot", F.lit(" - "), F.col("year").cast("string"))
    bare = F.concat("plot", F.lit("Q"), F.col("year").cast("string"))
    ids = v.spec().select(F.when(F.col("role") == "N", dash).otherwise(bare).alias("event_id")).distinct()
    return clean.parse_key(ids, "event_id")


@query(
    "cycle_bins",
    sql="""
WITH n AS (SELECT o_orderkey, year(o_orderdate) AS year,
                  CASE WHEN year(o_orderdate) > 1996 THEN ceil((year(o_orderdate) - 1996) / 5.0)::BIGINT END AS cycle_no
           FROM orders)
SELECT o_orderkey, year, cycle_no,
       '(' || (1996 + (cycle_no - 1) * 5) || ',' || (1996 + cycle_no * 5) || ']' AS cycle,
       '[' || (1997 + (cycle_no - 1) * 5) || ',' || (1996 + cycle_no * 5) || ']' AS cycle_display
FROM n""",
)
def cycle_bins(v: Views):
    """B3. The origin lies inside the data, so years at or below it give NULL."""
    rows = v.table("orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return clean.cycle_bin(rows, "year", 1996, 5)


@query(
    "cover_class_values",
    "spec",
    """
, b(code, lo, hi) AS (VALUES (1, 0.01, 0.1), (2, 0.1, 1), (3, 1, 2), (4, 2, 5), (5, 5, 10), (6, 10, 25), (7, 25, 50),
                             (8, 50, 75), (9, 75, 95), (10, 95, 100))
SELECT unit, role, item, cover_class,
       round_even((CASE WHEN code = 1 THEN hi / 2 ELSE (lo + hi) / 2 END)::DOUBLE, 6) AS midpoint,
       round_even(sqrt(lo::DOUBLE * hi::DOUBLE), 6) AS geometric
FROM v_spec LEFT JOIN b ON cover_class = code""",
)
def cover_class_values(v: Views):
    """B4."""
    c = F.col("cover_class")
    out = v.spec().select(
        *ITEM_CELLS,
        "cover_class",
        clean.class_value(c, clean.COVER_CLASS_BOUNDS, "midpoint").alias("midpoint"),
        clean.class_value(c, clean.COVER_CLASS_BOUNDS, "geometric").alias("geometric"),
    )
    return rounded(out, 6, "midpoint", "geometric")


@query(
    "taxon_parts",
    sql="""
SELECT p_partkey, replace(name, ' ', '_') AS taxon, split_part(name, ' ', 1) AS genus, contains(name, ' ') AS confirmed
FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name FROM part)""",
)
def taxon_parts(v: Views):
    """B5. Large parts play the records identified to genus only."""
    word = F.substring_index("p_name", " ", 1)
    rows = v.table("part").select("p_partkey", F.when(F.col("p_size") > 45, word).otherwise(F.col("p_name")).alias("name"))
    return clean.taxon_parts(rows, "name").drop("name")


@query(
    "taxon_flags",
    sql="""
SELECT p_partkey, p_name, (p_name LIKE 'hot%' OR p_name LIKE 'col%' OR p_name LIKE 'new r%') AND p_name <> 'hot ring' AS difficult,
       split_part(p_name, ' ', 1) IN ('red', 'blue') AS target
FROM part""",
)
def taxon_flags(v: Views):
    """B6."""
    rows = v.table("part").select("p_partkey", "p_name")
    return clean.taxon_flag(rows, "p_name", ["hot", "col", "new r"], ["hot ring"], ["red", "blue"])


_MAXES = ", ".join(f"max({c}) AS {c}" for c in CELLS)


@query(
    "roll_up_taxa",
    "spec",
    f"""
SELECT unit, role, CASE WHEN upper(substr(item, 1, 4)) IN ('SMAL', 'LARG') THEN upper(substr(item, 1, 4)) ELSE item END AS item,
       {_MAXES}
FROM v_spec WHERE item NOT LIKE '% sp.' GROUP BY ALL""",
)
def roll_up_taxa(v: Views):
    """B7."""
    return clean.roll_up_taxa(v.spec(), "item", ["SMAL", "LARG"], ["unit", "role"], CELLS)


_FIRST = ", ".join(f"coalesce({a}, CASE WHEN {b} IS NULL THEN 0 ELSE 1 END)::BIGINT AS {a}, {b}" for a, b in PAIRS)
_SECOND = ", ".join(f"{a}, coalesce({b}, CASE WHEN {a} = 0 THEN 0 ELSE 1 END)::BIGINT AS {b}" for a, b in PAIRS)
IMPUTED = f", f AS (SELECT * EXCLUDE ({', '.join(CELLS)}), {_FIRST} FROM v_spec), imp AS (SELECT * EXCLUDE ({', '.join(CELLS)}), {_SECOND} FROM f)"


@query("impute_cells", "spec", f"{IMPUTED} SELECT unit, role, item, {', '.join(CELLS)} FROM imp")
def impute_cells(v: Views):
    """B8."""
    return clean.impute_cells(v.spec().select(*ITEM_CELLS, *CELLS), PAIRS)


_PRESENT = (
    "TRUE AS in_plot, "
    + ", ".join(f"({a} + {b}) > 0 AS {m}" for m, (a, b) in MODULES.items())
    + ", "
    + ", ".join(f"{c} > 1 AS {c}" for c in CELLS)
)
PRESENCE = f"{IMPUTED}, pres AS (SELECT * EXCLUDE ({', '.join(CELLS)}), {_PRESENT} FROM imp WHERE {' + '.join(CELLS)} > 0)"


@query(
    "presence_scales",
    "spec",
    f"{PRESENCE} SELECT unit, role, item, in_plot, {', '.join([*MODULES, *CELLS])} FROM pres",
)
def presence_scales(v: Views):
    """B9."""
    return clean.presence_scales(clean.impute_cells(v.spec().select(*ITEM_CELLS, *CELLS), PAIRS), CELLS, MODULES)


@query(
    "normalise_tokens",
    "tree",
    """
SELECT id, CASE WHEN rater <> 0 THEN 'r' || rater END AS rater_name, code1 AS code,
       CASE WHEN crown IS NOT NULL AND crown <> 3 THEN crown::VARCHAR END AS crown_text,
       CASE WHEN status <> 0 THEN round_even(dbh / status, 6) END AS rate
FROM v_tree""",
)
def normalise_tokens(v: Views):
    """B10. The raw tokens are built first: ``_`` for rater 0, lower-case codes, text ``NA``, infinities."""
    raw = v.tree().select(
        "id",
        F.when(F.col("rater") == 0, "_").otherwise(F.concat(F.lit("r"), F.col("rater").cast("string"))).alias("rater_name"),
        F.lower("code1").alias("code"),
        F.when(F.col("crown") == 3, "NA").otherwise(F.col("crown").cast("string")).alias("crown_text"),
        F.when(F.col("status") == 0, F.lit(float("inf"))).otherwise(F.try_divide("dbh", "status")).alias("rate"),
    )
    out = clean.normalise_tokens(raw, {"rater_name": "_"}, ["code"], ["crown_text"], ["rate"])
    return rounded(out, 6, "rate")


@query(
    "apply_overrides",
    "thr",
    """
SELECT unit, subunit, CASE WHEN subunit IN ('NATION_3', 'NATION_7') THEN 'CORRECTED' ELSE bin END AS bin, period, y
FROM v_thr WHERE subunit <> 'NATION_11'""",
)
def apply_overrides(v: Views):
    """B11. The correction tables are rows of the nation table."""
    names = v.table("nation").select(F.col("n_name").alias("subunit"), "n_nationkey")
    fixes = names.where(F.col("n_nationkey").isin(3, 7)).select("subunit", F.lit("CORRECTED").alias("bin"))
    drop = names.where(F.col("n_nationkey") == 11)
    return clean.apply_overrides(v.thr(), "subunit", fixes, drop).select("unit", "subunit", "bin", "period", "y")


@query(
    "code_levels",
    "tree",
    """
SELECT id, concat(coalesce(code2, ''), '.', coalesce(crown::VARCHAR, '')) AS pair, code2 AS code_part, crown AS level_part
FROM v_tree WHERE code2 IS NOT NULL OR crown IS NOT NULL""",
)
def code_levels(v: Views):
    """B12."""
    return clean.split_code_level(v.tree(), "code2", "crown").select("id", "pair", "code_part", "level_part")


@query(
    "roles_from_codes",
    sql="""
SELECT l_orderkey, l_linenumber::BIGINT AS line, l_extendedprice, l_partkey,
       CASE WHEN l_returnflag = 'A' THEN 'Q' WHEN l_returnflag = 'N' THEN 'N' END AS role,
       CASE WHEN l_returnflag = 'A' THEN TRUE WHEN l_returnflag = 'N' THEN FALSE END AS is_requal
FROM lineitem""",
)
def roles_from_codes(v: Views):
    """B13. Return flags A, N, R play the codes -1, 0 and missing."""
    code = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0)
    rows = v.table("lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice", "l_partkey", code.alias("qaqc")
    )
    return clean.flag_from_code(clean.role_from_code(rows, "qaqc", 0, -1), "qaqc", "is_requal").drop("qaqc")


@query(
    "survey_dates",
    sql="""
SELECT DISTINCT o_custkey, d AS survey_date, year(d) AS year
FROM (SELECT o_custkey, o_orderdate::DATE AS d FROM orders
      UNION ALL
      SELECT o_custkey, o_orderdate::DATE + 30 FROM orders WHERE o_orderstatus <> 'O')""",
)
def survey_dates(v: Views):
    """B14. Two text date columns per order, the second missing for open orders."""
    rows = v.table("orders").select(
        "o_custkey",
        text_date("o_orderdate").alias("established"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(F.to_date("o_orderdate"), 30)).alias("_again"),
    )
    rows = rows.withColumn("revisited", F.when(F.col("_again").isNotNull(), text_date("_again")))
    return clean.survey_dates(rows, "o_custkey", ["established", "revisited"])


@query(
    "size_class_totals",
    "regen",
    """
SELECT event, role, corner, target, (seed5_15 + seed15_30 + seed30_50 + seed50_137)::BIGINT AS seedlings,
       (sap0_1 + sap1_25)::BIGINT AS small_saplings, (sap25_5 + sap5_10)::BIGINT AS large_saplings
FROM v_regen""",
)
def size_class_totals(v: Views):
    """B15."""
    from resurvey.operators.regen import INDEX_CLASSES

    out = clean.size_class_totals(v.regen(), INDEX_CLASSES)
    return out.select("event", "role", "corner", "target", *INDEX_CLASSES)


@query(
    "recode_and_classify",
    "regen_base",
    """
SELECT event, role, corner, community, CASE WHEN status IN (0, 4) THEN 2 ELSE status END AS status,
       CASE WHEN community IN ('G001', 'G005', 'G012') THEN 'target'
            WHEN community IN ('G002', 'G020') THEN 'ruderal' ELSE 'other' END AS community_type, cnt
FROM v_regen_base""",
)
def recode_and_classify(v: Views):
    """B16."""
    rows = v._regen_base().select("event", "role", "corner", "community", "status", "cnt")
    rows = clean.recode(rows, "status", {0: 2, 4: 2})
    lists = {"target": ["G001", "G005", "G012"], "ruderal": ["G002", "G020"]}
    return clean.classify_membership(rows, "community", lists, "other", "community_type")


@query(
    "percent_of_mean",
    "thr",
    "SELECT unit, subunit, bin, period, y, round_even(100 * y / (SELECT avg(y) FROM v_thr), 4) AS pct FROM v_thr",
)
def percent_of_mean(v: Views):
    """B17."""
    return rounded(clean.percent_of_mean(v.thr(), "y", "pct"), 4, "pct")


@query("valid_rows", "thr", "SELECT * FROM v_thr WHERE y < 400000")
def valid_rows(v: Views):
    """B18."""
    return clean.valid_rows(v.thr(), "y", 400000)


@query("complete_cases", "pair", "SELECT * FROM v_pair WHERE value1 IS NOT NULL AND fit2 IS NOT NULL")
def complete_cases(v: Views):
    """B18."""
    return clean.complete_cases(v.pair(), ["value1", "fit2"])


MIDPOINT = (
    "CASE cover_class WHEN 1 THEN 0.05 WHEN 2 THEN 0.55 WHEN 3 THEN 1.5 WHEN 4 THEN 3.5 WHEN 5 THEN 7.5 WHEN 6 THEN 17.5 "
    "WHEN 7 THEN 37.5 WHEN 8 THEN 62.5 WHEN 9 THEN 85 WHEN 10 THEN 97.5 END::DOUBLE"
)
FIRST = f", cov AS (SELECT *, {MIDPOINT} AS cover FROM v_spec WHERE role = 'N')"


def first_surveys(v: Views):
    """First-survey rows with cover in percent."""
    return v.spec().where(F.col("role") == "N").withColumn("cover", clean.cover_percent(F.col("cover_class")))


@query(
    "describe_units",
    "spec",
    f"""{FIRST},
tot AS (SELECT plot, year, sum(cover) AS total FROM cov GROUP BY ALL),
rel AS (SELECT plot, year, item, cover, round_even(100 * cover / total, 1) AS rel FROM cov JOIN tot USING (plot, year) WHERE exotic),
lines AS (SELECT plot, year, regexp_replace(printf('%.1f', round_even(sum(rel), 1)), '\\.0$', '') AS s,
                 string_agg(replace(concat(item, ' (', regexp_replace(printf('%.1f', rel), '\\.0$', ''), '%)'), '(0%)', 'trace'), '<br>'
                            ORDER BY cover DESC, item) AS items
          FROM rel GROUP BY ALL)
SELECT plot, year, CASE WHEN s IS NULL THEN concat(plot, ' (', year, ')<br/>0% EXOTIC COVER')
                   ELSE concat(plot, ' (', year, ')<br/>', s, '% EXOTIC COVER<br>-----<br>', items) END AS label
FROM tot LEFT JOIN lines USING (plot, year)""",
)
def describe_units(v: Views):
    """B19."""
    rows = first_surveys(v)
    unit = ["plot", "year"]
    total = rows.groupBy(*unit).agg(F.sum("cover").alias("total"))
    title = F.concat(F.col("plot"), F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    return clean.describe_units(rows.where("exotic"), unit, title, "item", "cover", total, "total", "EXOTIC COVER")


@query(
    "unit_lines",
    "spec",
    f"""{FIRST},
tot AS (SELECT plot, year, sum(cover) AS total FROM cov GROUP BY ALL)
SELECT plot, year, item, cover, round_even(100 * cover / total, 1) AS percent,
       replace(concat(item, ' (', regexp_replace(printf('%.1f', round_even(100 * cover / total, 1)), '\\.0$', ''), '%)'), '(0%)', 'trace') AS line,
       row_number() OVER (PARTITION BY plot, year ORDER BY cover DESC, item) AS position
FROM cov JOIN tot USING (plot, year) WHERE exotic""",
)
def unit_lines(v: Views):
    """B19, long form."""
    rows = first_surveys(v)
    total = rows.groupBy("plot", "year").agg(F.sum("cover").alias("total"))
    return clean.unit_lines(rows.where("exotic"), ["plot", "year"], "item", "cover", total, "total")


_RICH = f"""{FIRST},
rich AS (SELECT plot, year, count(*) FILTER (exotic) AS richness FROM cov GROUP BY ALL)"""


@query(
    "score_bins",
    "spec",
    f"""{_RICH},
top AS (SELECT (2 * ceil(max(richness) / 2.0))::DOUBLE AS bin_top FROM rich)
SELECT plot, year, richness, bin_top,
       CASE WHEN richness < 4 THEN 3 WHEN richness < 8 THEN 2 ELSE 1 END::BIGINT AS score
FROM rich, top""",
)
def score_bins(v: Views):
    """B20."""
    comp = composition(first_surveys(v), ["plot", "year"], "exotic", F.lit(True), "cover")
    rich = comp.where(F.col("type") == "exotic").select("plot", "year", "richness")
    return clean.score_bin(rich, "richness", 4, 8, 2, reverse=True)


@query("row_ids", sql="SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders")
def row_ids(v: Views):
    """B21 over a unique order."""
    return clean.row_ids(v.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(
    "row_ids_with_ties",
    sql="""
SELECT o_orderkey, p AS price, row_number() OVER (ORDER BY p NULLS FIRST, o_orderkey) AS row_id
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderpriority NOT LIKE '1%' THEN o_totalprice END AS p FROM orders)""",
)
def row_ids_with_ties(v: Views):
    """B21 with a value that a third of the rows share, and missing values."""
    price = F.when(F.col("o_orderstatus") == "O", 0.0).when(~F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))
    return clean.row_ids(v.table("orders").select("o_orderkey", price.alias("price")), "price", "o_orderkey")


# ---- C: reshaping -----------------------------------------------------------------


@query(
    "pair_by_role",
    "pair",
    "SELECT unit, value1 AS n_value, fit1::BIGINT AS n_fit, value2 AS q_value, fit2::BIGINT AS q_fit FROM v_pair",
)
def pair_by_role(v: Views):
    """C1."""
    rows = v.rating().withColumn("fit", F.col("fit").cast("long"))
    return reshape.pair_by_role(rows, ["unit"], "role", ["value", "fit"], {"N": "n", "Q": "q"})


@query(
    "melt_cells",
    "spec",
    f"""SELECT unit, role, item, cell, code
FROM (SELECT unit, role, item, {', '.join(CELLS)} FROM v_spec) UNPIVOT INCLUDE NULLS (code FOR cell IN ({', '.join(CELLS)}))""",
)
def melt_cells(v: Views):
    """C2."""
    return reshape.melt_cells(v.spec(), ITEM_CELLS, CELLS, "cell", "code")


@query(
    "codes_to_flags",
    "tree",
    """
, levels AS (SELECT code1 AS code FROM v_tree WHERE code1 IS NOT NULL UNION SELECT code2 FROM v_tree WHERE code2 IS NOT NULL)
SELECT id, code, coalesce(code1 = code, FALSE) OR coalesce(code2 = code, FALSE) AS present FROM v_tree CROSS JOIN levels""",
)
def codes_to_flags(v: Views):
    """C3."""
    trees = v.tree()
    long = reshape.melt_cells(trees, ["id"], ["code1", "code2"], "slot", "code").where(F.col("code").isNotNull())
    return reshape.codes_to_flags(trees, long, ["id"], "code")


@query(
    "complete_grid",
    "cnt",
    """
, r(role) AS (VALUES ('N'), ('Q')), m(module) AS (VALUES (1::BIGINT), (2), (3), (4))
SELECT unit, role, module, coalesce(n, 0) AS n
FROM (SELECT DISTINCT unit FROM v_cnt) CROSS JOIN r CROSS JOIN m LEFT JOIN v_cnt USING (unit, role, module)""",
)
def complete_grid(v: Views):
    """C4."""
    return reshape.complete_grid(v.count(), ["unit"], {"role": ["N", "Q"], "module": [1, 2, 3, 4]}, ["n"])


@query(
    "wide_counts",
    "pair",
    """
SELECT fit1::BIGINT AS fit1, count(*) FILTER (value2 = 'A') AS n_a, count(*) FILTER (value2 = 'N') AS n_n,
       count(*) FILTER (value2 = 'R') AS n_r, count(*) FILTER (value2 IS NULL) AS n_missing
FROM v_pair GROUP BY 1""",
)
def wide_counts(v: Views):
    """C5."""
    rows = v.pair().withColumn("fit1", F.col("fit1").cast("long"))
    return reshape.wide_counts(rows, ["fit1"], "value2", {"A": "n_a", "N": "n_n", "R": "n_r", None: "n_missing"})
