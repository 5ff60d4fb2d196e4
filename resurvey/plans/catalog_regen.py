"""Queries: composition and bands (F1-F10), regeneration (F11-F19), resampling (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.operators import asof, bands, clean, compose, ranktest, regen, resample, reshape
from resurvey.operators.roles import stack_metrics
from resurvey.plans.catalog_rows import FIRST, first_surveys
from resurvey.plans.registry import cents, query, rounded, settled, settled_sql
from resurvey.plans.views import PRIORITY_ITEMS, SIZE_CLASSES, Views
from resurvey.session import written

SEED = 20
REPS, CLUSTER_REPS = 1000, 2000
LEVELS = ["A", "N", "R"]
CORNERS = [f"C{i}" for i in range(1, 9)]

# ---- composition ------------------------------------------------------------------

_COMP = f"""{FIRST},
u AS (SELECT plot, year, any_value(park) AS park, any_value(longitude) AS longitude, any_value(latitude) AS latitude,
             sum(cover) AS total_cover FROM cov GROUP BY plot, year),
ct AS (SELECT plot, year, exotic AS e, count(*) AS richness, sum(cover) AS cover FROM cov GROUP BY ALL),
comp AS (SELECT u.*, type, coalesce(richness, 0) AS richness, coalesce(cover, 0) AS cover,
                round_even(100 * coalesce(cover, 0) / total_cover, 2) AS rel_cover
         FROM u CROSS JOIN (VALUES ('native', FALSE), ('exotic', TRUE)) t(type, e) LEFT JOIN ct USING (plot, year, e))"""
UNIT = ["park", "plot", "year", "longitude", "latitude"]


def composition_rows(v: Views):
    return compose.composition(first_surveys(v), UNIT, "exotic", F.lit(True), "cover")


def priority_rows(v: Views):
    return compose.priority_item_cover(first_surveys(v), UNIT, "item", "cover", PRIORITY_ITEMS)


@query(
    "composition",
    "spec",
    f"""{_COMP}
SELECT park, plot, year, longitude, latitude, type, richness, round_even(cover, 4) AS cover,
       round_even(total_cover, 4) AS total_cover, rel_cover FROM comp""",
)
def composition(v: Views):
    """F1. Every name is identified to species here, so richness counts rows."""
    return rounded(composition_rows(v), 4, "cover", "total_cover")


_ITEMS = f"""{FIRST},
it AS (SELECT park, year, item, count(*) AS freq, sum(cover) AS cover FROM cov WHERE exotic GROUP BY ALL)"""


def exotic_totals(v: Views):
    return compose.item_totals(first_surveys(v).where("exotic"), ["park", "year"], "item", "cover")


@query("item_totals", "spec", f"{_ITEMS} SELECT park, year, item, freq, round_even(cover, 4) AS cover FROM it")
def item_totals(v: Views):
    """F2."""
    return rounded(exotic_totals(v), 4, "cover")


def _top_sql(by: str) -> str:
    return f"""
SELECT park, year, item, freq, round_even(cover, 4) AS cover,
       row_number() OVER (PARTITION BY park, year ORDER BY {by} DESC, item) AS position
FROM (SELECT *, rank() OVER (PARTITION BY park, year ORDER BY {by} DESC) AS rk FROM it) WHERE rk <= 3"""


@query("top_items_by_frequency", "spec", f"{_ITEMS} {_top_sql('freq')}")
def top_items_by_frequency(v: Views):
    """F3, long form; ties at the boundary stay."""
    return rounded(compose.top_items(exotic_totals(v), ["park", "year"], "item", "freq", 3), 4, "cover")


@query(
    "top_list_by_cover",
    "spec",
    f"""{_ITEMS},
top AS ({_top_sql('round_even(cover, 4)')})
SELECT park, year, string_agg(item, ', ' ORDER BY position) AS top_items FROM top GROUP BY ALL""",
)
def top_list_by_cover(v: Views):
    """F3, one text per group."""
    totals = rounded(exotic_totals(v), 4, "cover")
    return compose.top_list(totals, ["park", "year"], "item", "cover", 3)


@query(
    "top_list_by_frequency",
    "spec",
    f"""{_ITEMS},
top AS ({_top_sql('freq')})
SELECT park, year, string_agg(item, ', ' ORDER BY position) AS top_items FROM top GROUP BY ALL""",
)
def top_list_by_frequency(v: Views):
    """F3, one text per group."""
    return compose.top_list(exotic_totals(v), ["park", "year"], "item", "freq", 3)


_PRIO = f"""
, lst(item) AS (VALUES {', '.join(f"('{x}')" for x in PRIORITY_ITEMS)}),
pt AS (SELECT plot, year, item, sum(cover) AS cover FROM cov GROUP BY ALL),
prio AS (SELECT u.*, item, coalesce(cover, 0) AS cover, round_even(100 * coalesce(cover, 0) / total_cover, 2) AS rel_cover
         FROM u CROSS JOIN lst LEFT JOIN pt USING (plot, year, item))"""


@query(
    "priority_item_cover",
    "spec",
    f"""{_COMP}{_PRIO}
SELECT park, plot, year, longitude, latitude, item, round_even(cover, 4) AS cover, round_even(total_cover, 4) AS total_cover, rel_cover,
       rel_cover > 0 AS present FROM prio""",
)
def priority_item_cover(v: Views):
    """F4."""
    return rounded(priority_rows(v), 4, "cover", "total_cover")


_NUM = "regexp_replace(printf('%.1f', round_even(rel_cover, 1)), '\\.0$', '')"
_HEAD = "park, plot, year, longitude, latitude"
_TITLE = "plot, ' (', year, '):<br/>'"


@query(
    "unit_metrics",
    "spec",
    f"""{_COMP}{_PRIO}
SELECT {_HEAD}, 'exotic_cover' AS metric, NULL::VARCHAR AS item, rel_cover AS value, concat({_TITLE}, {_NUM}, '% exotic cover') AS label
FROM comp WHERE type = 'exotic'
UNION ALL SELECT {_HEAD}, 'exotic_richness', NULL, richness, concat({_TITLE}, richness, ' exotic herb species') FROM comp WHERE type = 'exotic'
UNION ALL SELECT {_HEAD}, 'native_richness', NULL, richness, concat({_TITLE}, richness, ' native herb species') FROM comp WHERE type = 'native'
UNION ALL SELECT {_HEAD}, 'priority_cover', item, rel_cover, concat({_TITLE}, {_NUM}, '% cover') FROM prio""",
)
def unit_metrics(v: Views):
    """F5."""
    return compose.unit_metrics(composition_rows(v), priority_rows(v), UNIT, "plot", "year")


# ---- summaries and bands ----------------------------------------------------------

KEYS = ["grain", "unit", "subunit", "grain_bin", "period"]
_GRAINS = """
, g AS (SELECT 'subunit' AS grain, unit, subunit, '' AS grain_bin, period, round(y * 100)::BIGINT AS y FROM v_thr
        UNION ALL SELECT 'bin', unit, subunit, bin, period, round(y * 100)::BIGINT FROM v_thr WHERE bin <> 'MACHINERY')"""
_SUMMARY = f"""{_GRAINS},
sm AS (SELECT grain, unit, subunit, grain_bin, period, count(*) AS n, sum(y)::DOUBLE / count(*) AS mean,
              quantile_cont(y::DOUBLE, 0.5) AS median FROM g GROUP BY ALL)"""


def grain_rows(v: Views):
    """Measures in cents at both grains; one bin is unmapped, so it counts at the coarse grain only."""
    rows = v.thr().withColumn("bin", F.nullif(F.col("bin"), F.lit("MACHINERY"))).withColumn("y", cents("y"))
    return bands.two_grains(rows, ["unit", "subunit", "period"], "bin")


@query(
    "subunit_summary",
    "thr",
    f"""{_SUMMARY}
SELECT grain, unit, subunit, grain_bin, period, n, {settled_sql('mean', unit=100)} AS mean, {settled_sql('median', unit=100)} AS median FROM sm""",
)
def subunit_summary(v: Views):
    """F6, both grains."""
    return settled(bands.subunit_summary(grain_rows(v), KEYS, "y"), "mean", "median", unit=100)


def _thr_metrics(v: Views):
    """Two parameters over the same measures: the price in thousands, and its percent of the mean."""
    price = v.thr().withColumn("m", (cents("y").cast("decimal(18,0)") * F.lit("0.00001").cast("decimal(6,5)")))
    share = clean.percent_of_mean(v.thr(), "y", "m")
    return {"price": price, "share": share}


_METRICS = """
, mt AS (SELECT 'price' AS param, unit, subunit, period, round(y * 100)::BIGINT::DOUBLE / 100000 AS m FROM v_thr
         UNION ALL SELECT 'share', unit, subunit, period, 100 * y / (SELECT avg(y) FROM v_thr) FROM v_thr)"""
_BANDS = """
, bd AS (SELECT 'price' AS param, band, a AS band_min, b AS band_max
         FROM (VALUES ('good', 240, 99999), ('caution', 200, 240), ('concern', 0, 200)) t(band, a, b)
         UNION ALL SELECT 'share', band, a, b FROM (VALUES ('caution', 0, 100), ('good', 100, 99999)) t(band, a, b))"""


def limit_bands(v: Views):
    m = _thr_metrics(v)
    return stack_metrics(
        {
            "price": bands.band_limits(m["price"], "m", (240, 200)),
            "share": bands.band_limits(m["share"], "m", (100,), one_is_concern=False, high_is_good=True),
        },
        "param",
    )


def limit_summary(v: Views):
    """Summaries of both parameters; the price is decimal, so its sums are exact."""
    keys = ["unit", "subunit", "period"]
    return stack_metrics({k: bands.subunit_summary(df, keys, "m") for k, df in _thr_metrics(v).items()}, "param")


@query("band_limits", "thr", f"{_BANDS} SELECT param, band, band_min::DOUBLE AS band_min, band_max::DOUBLE AS band_max FROM bd")
def band_limits(v: Views):
    """F7. All values are positive, so the open lower edge is 0."""
    return limit_bands(v)


_CLOSED = f"""{_METRICS}{_BANDS},
ms AS (SELECT param, unit, subunit, period, count(*) AS n,
              CASE param WHEN 'price' THEN (sum(round(m * 100000)::BIGINT)::DOUBLE / 100000) / count(*) ELSE avg(m) END AS mean,
              quantile_cont(m, 0.5) AS median FROM mt GROUP BY param, unit, subunit, period),
cl AS (SELECT param, band, band_min::DOUBLE AS band_min,
              CASE WHEN band_max = 99999
                   THEN greatest((SELECT max(greatest(mean, median)) FROM ms WHERE ms.param = bd.param),
                                 1.2 * (SELECT max(x.band_max) FROM bd x WHERE x.param = bd.param AND x.band_max <> 99999))
                   ELSE band_max END::DOUBLE AS band_max
       FROM bd)"""


@query("close_bands", "thr", f"{_CLOSED} SELECT param, band, band_min, {settled_sql('band_max')} AS band_max FROM cl")
def close_bands(v: Views):
    """F8."""
    return settled(bands.close_bands(limit_bands(v), limit_summary(v), "param", ["mean", "median"]), "band_max")


@query(
    "band_status",
    "thr",
    f"""{_CLOSED}
SELECT ms.param, unit, subunit, period, n, {settled_sql('mean')} AS mean, {settled_sql('median')} AS median, band AS status
FROM ms LEFT JOIN cl ON cl.param = ms.param AND (band_min <= median AND median < band_max
     OR median = band_max AND band_max = (SELECT max(band_max) FROM cl x WHERE x.param = ms.param))""",
)
def band_status(v: Views):
    """F9, status of the median."""
    summary = limit_summary(v)
    closed = bands.close_bands(limit_bands(v), summary, "param", ["mean", "median"])
    return settled(bands.band_status(summary, closed, "param", "median"), "mean", "median")


# ---- portable draws in SQL --------------------------------------------------------

_M = 2147483647


def _stratum_sql(*keys: str) -> str:
    text = "concat_ws('|', " + ", ".join(keys) + ")"
    return f"(('0x' || substr(md5({text}), 1, 15))::BIGINT % {_M})"


def _state_sql(rep: str, i: str, stratum: str, seed: int) -> str:
    x0 = f"(({rep} * 7919 + {i} * 104729 + {stratum} * 15485863 + {seed}) % {_M})"
    x1 = f"(({x0} * {x0} + 12345) % {_M})"
    x2 = f"({x1} * 48271 % {_M})"
    return f"(({x2} * {x2} + 67891) % {_M})"


def _draws_sql(name: str, source: str, count: str, reps: int, seed: int = SEED) -> str:
    """CTE ``name`` with the drawn index of every (stratum row of ``source``, rep, i)."""
    return f"""{name} AS (SELECT *, {_state_sql('rep', 'i', 'sid', seed)} AS st, {_state_sql('rep', 'i', 'sid', seed)} * n // {_M} AS idx
       FROM (SELECT s.*, unnest(range(0, {count})) AS i FROM (SELECT *, unnest(range(0, {reps})) AS rep FROM {source}) s))"""


_QS = {"lo95": 0.025, "lo68": 0.16, "hi68": 0.84, "hi95": 0.975}
_BOOT = f"""{_GRAINS},
v AS (SELECT *, row_number() OVER (PARTITION BY grain, unit, subunit, grain_bin, period ORDER BY y) - 1 AS idx FROM g),
gs AS (SELECT grain, unit, subunit, grain_bin, period, count(*) AS n, {_stratum_sql(*KEYS)} AS sid FROM g GROUP BY ALL),
{_draws_sql('dr', 'gs', 'n', REPS)},
rp AS (SELECT grain, unit, subunit, grain_bin, period, rep, sum(y)::DOUBLE / count(*) AS mean, quantile_cont(y::DOUBLE, 0.5) AS median
       FROM dr JOIN v USING (grain, unit, subunit, grain_bin, period, idx) WHERE n > 1 GROUP BY ALL),
bt AS (SELECT grain, unit, subunit, grain_bin, period,
              {', '.join(f'{settled_sql(f"quantile_cont({s}, {p})", 1, 100)} AS {s}_{q}' for s in ('mean', 'median') for q, p in _QS.items())}
       FROM rp GROUP BY ALL)"""


def intervals(v: Views, reps: int = REPS):
    return resample.mean_median_interval(grain_rows(v), KEYS, "y", reps, SEED)


@query(
    "mean_median_interval",
    "thr",
    f"""{_BOOT} SELECT * EXCLUDE (n, sid) FROM gs LEFT JOIN bt USING (grain, unit, subunit, grain_bin, period)""",
)
def mean_median_interval(v: Views):
    """G2, both grains."""
    return settled(intervals(v), *resample.INTERVAL_COLUMNS, digits=1, unit=100)


@query(
    "threshold_table",
    "thr",
    f"""{_BOOT},
sm AS (SELECT grain, unit, subunit, grain_bin, period, count(*) AS n, quantile_cont(y::DOUBLE, 0.5) AS median FROM g GROUP BY ALL)
SELECT 'price' AS param, unit, subunit, grain_bin AS bin, period, n, {settled_sql('median', unit=100)} AS value, median_lo68 AS lo68,
       median_hi68 AS hi68, median_lo95 AS lo95, median_hi95 AS hi95
FROM sm LEFT JOIN bt USING (grain, unit, subunit, grain_bin, period) WHERE grain = 'bin' AND unit = 'ASIA'""",
)
def threshold_table(v: Views):
    """F10, one unit by bin, medians."""
    summary = {"price": lambda rows: bands.subunit_summary(rows, KEYS, "y").join(resample.mean_median_interval(rows, KEYS, "y", REPS, SEED), KEYS, "left")}
    out = bands.threshold_table({"price": grain_rows(v)}, "median", by_bin=True, unit="ASIA", summarize=summary)
    return settled(settled(out, "value", unit=100), "lo68", "hi68", "lo95", "hi95", digits=1, unit=100)


# ---- regeneration -----------------------------------------------------------------


@query(
    "resurvey_counts",
    "regen_base",
    """
, p AS (SELECT area, plot, count(DISTINCT event) FILTER (role = 'N') AS n, count(DISTINCT cycle_no) FILTER (role = 'Q') AS q
        FROM v_regen_base GROUP BY ALL)
SELECT area, count(*) AS units, count(*) FILTER (n > 1) AS resurveyed, sum(q)::BIGINT AS quality_surveys FROM p GROUP BY area""",
)
def resurvey_counts(v: Views):
    """F11."""
    return regen.resurvey_counts(v._regen_base(), "area", "plot", "event", "cycle_no", "role")


EVENT = ["event", "area", "plot", "cycle_no", "role"]
_BOX = """
, bx AS (SELECT event, area, plot, cycle_no, role, corner, sum(sap0_1 + sap1_25 + sap25_5)::BIGINT AS box_count
         FROM v_regen WHERE target GROUP BY ALL),
bn AS (SELECT * EXCLUDE (corner), row_number() OVER (PARTITION BY event, role ORDER BY corner) AS box FROM bx),
boxes AS (SELECT event, area, plot, cycle_no, role, box, coalesce(box_count, 0) AS box_count
          FROM (SELECT DISTINCT event, area, plot, cycle_no, role FROM v_regen) CROSS JOIN range(1, 9) r(box)
               LEFT JOIN bn USING (event, area, plot, cycle_no, role, box))"""


def boxes(v: Views):
    return regen.box_counts(v.regen(), EVENT, "corner", "target", regen.BOX_CLASSES, 8)


@query("box_counts", "regen", f"{_BOX} SELECT * FROM boxes")
def box_counts(v: Views):
    """F12."""
    return boxes(v)


EVENT_N = ["event", "area", "zone", "plot", "cycle_no"]
_EN = ", ".join(EVENT_N)


def _tree_sql(name: str, cond: str, targets: str, keys: str = _EN, role: str = "role = 'N'") -> str:
    return f"""{name}0 AS (SELECT {keys}, target, module, count(*) AS trees FROM v_regen_tree
            WHERE status = 1 AND {role} AND target IN ({targets}) AND {cond} GROUP BY ALL),
{name} AS (SELECT {keys}, target, module, coalesce(trees, 0) AS trees
         FROM (SELECT DISTINCT {keys} FROM {name}0) CROSS JOIN (SELECT unnest([{targets}]) AS target)
              CROSS JOIN (SELECT unnest(range(1, 5)) AS module) LEFT JOIN {name}0 USING ({keys}, target, module))"""


def small_trees(v: Views):
    return v.stem_counts(EVENT_N, 10, 15)


def all_target_trees(v: Views):
    return v.stem_counts(EVENT_N, None, None, targets=(True,))


@query("module_tree_counts", "regen_tree", f", {_tree_sql('tr', 'dbh BETWEEN 10 AND 15', 'TRUE, FALSE')} SELECT * FROM tr")
def module_tree_counts(v: Views):
    """F13."""
    return small_trees(v)


def _index_sql(role: str = "role = 'N'", keys: str = _EN, trees: str = "tr") -> str:
    """CTE ``ix``: index of every event, from v_regen and the tree counts."""
    seed = "(50 * (seed5_15 + seed15_30 + seed30_50 + seed50_137) + 5 * (sap0_1 + sap1_25))"
    sap = "(5 * (sap25_5 + sap5_10))"
    return f"""
sx AS (SELECT {keys}, coalesce(sum({seed}) FILTER (target), 0) AS seed_t, coalesce(sum({seed}) FILTER (NOT target), 0) AS seed_o,
              coalesce(sum({sap}) FILTER (target), 0) AS sap_t, coalesce(sum({sap}) FILTER (NOT target), 0) AS sap_o
       FROM v_regen WHERE {role} GROUP BY ALL),
tx AS (SELECT {keys}, sum(trees) FILTER (target) AS t, sum(trees) FILTER (NOT target) AS o FROM {trees} GROUP BY ALL),
ix AS (SELECT {keys}, coalesce(seed_t / nullif(seed_t + seed_o, 0), 0)::DOUBLE AS seed_ratio,
              coalesce((sap_t + coalesce(t, 0)) / nullif(sap_t + coalesce(t, 0) + sap_o + coalesce(o, 0), 0), 0)::DOUBLE AS sap_ratio
       FROM sx LEFT JOIN tx USING ({keys}))"""


@query(
    "regen_index",
    "regen regen_tree",
    f""", {_tree_sql('tr', 'dbh BETWEEN 10 AND 15', 'TRUE, FALSE')}, {_index_sql()}
SELECT {_EN}, round_even(seed_ratio, 6) AS seed_ratio, round_even(sap_ratio, 6) AS sap_ratio, round_even(seed_ratio + sap_ratio, 6) AS regen_index
FROM ix""",
)
def regen_index(v: Views):
    """F14, first surveys."""
    out = regen.regen_index(v.regen().where("role = 'N'"), small_trees(v), EVENT_N)
    return rounded(out, 6, "seed_ratio", "sap_ratio", "regen_index")


_POINTS = """1 * (seed5_15 + seed15_30) * 1250 + 2 * seed30_50 * 1250 + 10 * seed50_137 * 1250
             + 50 * (sap0_1 + sap1_25 + sap25_5 + sap5_10) * 125"""


@query(
    "importance_score",
    "regen regen_tree",
    f""", {_tree_sql('tr', 'TRUE', 'TRUE')},
p AS (SELECT {_EN}, sum({_POINTS})::DOUBLE AS points FROM v_regen WHERE role = 'N' AND target GROUP BY ALL),
t AS (SELECT {_EN}, sum(trees)::DOUBLE * 50 * 25 AS tree_points FROM tr GROUP BY ALL)
SELECT {_EN}, round_even(ln(points + coalesce(tree_points, 0) + 1), 6) AS importance FROM p LEFT JOIN t USING ({_EN})""",
)
def importance_score(v: Views):
    """F15."""
    out = regen.importance_score(v.regen().where("role = 'N'"), all_target_trees(v), EVENT_N)
    return rounded(out, 6, "importance")


@query(
    "role_index_difference",
    "regen regen_tree",
    f""", {_tree_sql('tr', 'dbh BETWEEN 10 AND 15', 'TRUE, FALSE', _EN + ', role', 'TRUE')},
{_index_sql('TRUE', _EN + ', role')},
d AS (SELECT a.seed_ratio + a.sap_ratio - b.seed_ratio - b.sap_ratio AS d
      FROM (FROM ix WHERE role = 'N') a JOIN (FROM ix WHERE role = 'Q') b USING (event))
SELECT count(*) AS pairs, round_even(avg(d), 6) AS mean_difference, round_even(quantile_cont(d, 0.05), 6) AS p05,
       round_even(quantile_cont(d, 0.95), 6) AS p95
FROM d""",
)
def role_index_difference(v: Views):
    """F17, with the trees of both surveys."""
    trees = v.stem_counts([*EVENT_N, "role"], 10, 15, role=None)
    index = regen.regen_index(v.regen(), trees, [*EVENT_N, "role"])
    out = regen.role_index_difference(index, ["event"], "role", "regen_index")
    return rounded(out, 6, "mean_difference", "p05", "p95")


@query(
    "box_stats",
    "regen",
    """
, e AS (SELECT event, role, area, target, sum(seed5_15 + seed15_30 + seed30_50 + seed50_137 + sap0_1 + sap1_25 + sap25_5 + sap5_10)::BIGINT AS total FROM v_regen GROUP BY ALL),
q AS (SELECT area, target, quantile_cont(total::DOUBLE, 0.25) AS q1, quantile_cont(total::DOUBLE, 0.5) AS median,
             quantile_cont(total::DOUBLE, 0.75) AS q3 FROM e GROUP BY ALL)
SELECT area, target, q1, median, q3, count(*) AS n,
       min(total) FILTER (total >= q1 - 1.5::DOUBLE * (q3 - q1) AND total <= q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_low,
       max(total) FILTER (total >= q1 - 1.5::DOUBLE * (q3 - q1) AND total <= q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_high,
       count(*) FILTER (total < q1 - 1.5::DOUBLE * (q3 - q1) OR total > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
FROM e JOIN q USING (area, target) GROUP BY ALL""",
)
def box_stats(v: Views):
    """F19."""
    classes = ["seed5_15", "seed15_30", "seed30_50", "seed50_137", "sap0_1", "sap1_25", "sap25_5", "sap5_10"]
    rows = v.regen().groupBy("event", "role", "area", "target").agg(F.sum(sum(F.col(c) for c in classes)).alias("total"))
    return regen.box_stats(rows, ["area", "target"], "total")


# ---- resampling -------------------------------------------------------------------


def _agreement_sql(by: str, stratum: str, reps: int = 1000) -> str:
    """G1 in SQL: binomial shares of the draws, cell after cell, as ``draws.multinomial`` takes them."""
    names = ", ".join(f"'{x}'" for x in [*LEVELS, "XXX"])
    keys = f"{by}, " if by else ""
    using = f"USING ({by}, category)" if by else "USING (category)"
    out = f"""
, rp AS (SELECT {'coalesce(fit1, 0)::BIGINT AS fit, ' if by else ''}coalesce(value1, 'XXX') AS a, coalesce(value2, 'XXX') AS b FROM v_pair),
ce AS (SELECT {keys}a, b, count(*) AS n FROM rp GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY {by or '1'} ORDER BY a, b) - 1 AS c, sum(n) OVER (PARTITION BY {by or '1'}) AS total,
              sum(n) OVER (PARTITION BY {by or '1'} ORDER BY a, b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, {stratum} AS sid FROM ce),
k0 AS (SELECT DISTINCT {keys}rep, total::BIGINT AS m FROM cn CROSS JOIN (SELECT unnest(range(0, {reps})) AS rep))"""
    for c in range(16):
        out += f""",
d{c} AS (SELECT {keys}rep, m, n / rest::DOUBLE AS p, ({_state_sql('rep', f'{c}', 'sid', SEED)} + 0.5::DOUBLE) / {_M} AS u FROM k{c} JOIN (FROM cn WHERE c = {c}) x {f'USING ({by})' if by else 'ON TRUE'}),
b{c} AS (SELECT *, greatest(0, floor(m * p - 10 * sqrt(m * p * (1 - p)) - 10))::BIGINT AS lo, least(m, ceil(m * p + 10 * sqrt(m * p * (1 - p)) + 10))::BIGINT AS hi FROM d{c} WHERE p < 1),
f{c} AS (SELECT {keys}rep, m, u, lo, hi, sum(w) OVER (PARTITION BY {keys}rep ORDER BY j) AS f, sum(w) OVER (PARTITION BY {keys}rep) AS t
       FROM (SELECT *, exp(lgamma(m + 1.0::DOUBLE) - lgamma(j + 1.0::DOUBLE) - lgamma(m - j + 1.0::DOUBLE) + j * ln(p) + (m - j) * ln(1 - p)) AS w
             FROM (SELECT *, unnest(range(lo, hi + 1)) AS j FROM b{c}))),
g{c} AS (SELECT {keys}rep, least(any_value(hi), any_value(lo) + count(*) FILTER (f <= u * t))::BIGINT AS k FROM f{c} GROUP BY ALL
       UNION ALL SELECT {keys}rep, m FROM d{c} WHERE p >= 1),
k{c + 1} AS (SELECT {keys}rep, m - k AS m FROM k{c} JOIN g{c} USING ({keys}rep))"""
    drawn = " UNION ALL ".join(f"SELECT {keys}rep, {c} AS c, k FROM g{c}" for c in range(16))
    return out + f""",
dr AS ({drawn}),
cl AS (SELECT unnest([{names}]) AS category),
sh AS (SELECT {keys}rep, category, sum(k * ((a = category)::INT + (b = category)::INT)) AS den, sum(2 * k) FILTER (a = category AND b = category) AS num
       FROM dr JOIN cn USING ({keys}c) CROSS JOIN cl GROUP BY ALL),
lm AS (SELECT {keys}category, quantile_cont(psa, 0.05) AS lo, quantile_cont(psa, 0.95) AS hi
       FROM (SELECT {keys}category, round_even(100 * coalesce(coalesce(num, 0)::DOUBLE / nullif(den, 0), 0), 0) AS psa FROM sh) GROUP BY ALL),
pt AS (SELECT {keys}category, 2 * coalesce(sum(n) FILTER (a = category AND b = category), 0) AS num,
              coalesce(sum(n) FILTER (a = category), 0) + coalesce(sum(n) FILTER (b = category), 0) AS denom
       FROM ce CROSS JOIN cl GROUP BY ALL)
SELECT {keys}category, num::BIGINT AS num, denom::BIGINT AS denom, round_even(100 * num / nullif(denom, 0), 0)::DOUBLE AS psa,
       CASE WHEN denom >= 5 THEN round_even(lo, 6) END AS psa_lo, CASE WHEN denom >= 5 THEN round_even(hi, 6) END AS psa_hi
FROM pt LEFT JOIN lm {using}"""


@query("psa_interval", "pair", _agreement_sql("", "0"))
def psa_interval(v: Views):
    """G1; its point part is the query ``specific_agreement``."""
    return rounded(resample.psa_interval(v.pair(), "value1", "value2", LEVELS, 1000, SEED), 6, "psa_lo", "psa_hi")


_CB = f"""{_BOX},
c1 AS (SELECT area, plot, box_count AS y FROM boxes WHERE cycle_no = 1),
un AS (SELECT area, plot, row_number() OVER (PARTITION BY area ORDER BY md5(plot), plot) - 1 AS idx FROM (SELECT DISTINCT area, plot FROM c1)),
vals AS (SELECT area, plot, y, row_number() OVER (PARTITION BY area, plot ORDER BY y) - 1 AS bidx, count(*) OVER (PARTITION BY area, plot) AS nb FROM c1),
ar AS (SELECT area, count(*) AS n, {_stratum_sql('area')} AS sid FROM un GROUP BY area),
{_draws_sql('du', 'ar', 'n', CLUSTER_REPS)},
db AS (SELECT area, rep, n, plot, unnest(range(0, 8)) AS j, i, sid FROM du JOIN un USING (area, idx)),
nbs AS (SELECT DISTINCT area, plot, nb FROM vals),
bx2 AS (SELECT area, n, rep, plot, {_state_sql('rep', '(i * 8 + j)', 'sid', SEED + 1)} * nb // {_M} AS bidx
        FROM db JOIN nbs USING (area, plot)),
mn AS (SELECT area, n, rep, avg(y) AS m FROM bx2 JOIN vals USING (area, plot, bidx) GROUP BY ALL)
SELECT area, n AS units, round_even(quantile_cont(m, 0.05), 6) AS p05, round_even(quantile_cont(m, 0.5), 6) AS p50,
       round_even(quantile_cont(m, 0.95), 6) AS p95
FROM mn GROUP BY ALL"""


def cluster_rows(v: Views):
    return boxes(v).where("cycle_no = 1")


@query("cluster_bootstrap", "regen", _CB)
def cluster_bootstrap(v: Views):
    """G3, first cycle, both roles."""
    out = resample.cluster_bootstrap(cluster_rows(v), ["area"], "plot", "box_count", 8, CLUSTER_REPS, SEED)
    return rounded(out, 6, "p05", "p50", "p95")


STRATA = ["plot", "cycle_no"]


def corner_rows(v: Views):
    """Corner rows of first surveys, computed once for both indices."""
    return written(v.regen().where("role = 'N'").select("event", *STRATA, "target", "corner", *SIZE_CLASSES), "corners")


def index_corners(v: Views, rows: DataFrame | None = None):
    """Corner rows of first surveys on the full grid of eight corners and both target sides."""
    rows = v.regen().where("role = 'N'") if rows is None else rows
    sums = {name: F.sum(expr) for name, expr in regen.shares(regen.INDEX_CLASSES).items()}
    rows = rows.groupBy("event", *STRATA, "target", "corner").agg(*[e.alias(n) for n, e in sums.items()])
    return reshape.complete_grid(rows, ["event", *STRATA], {"target": [True, False], "corner": CORNERS}, list(sums))


def importance_corners(v: Views, rows: DataFrame | None = None):
    rows = v.regen().where("role = 'N'") if rows is None else rows
    sums = {name: F.sum(expr) for name, expr in regen.shares(regen.IMPORTANCE_CLASSES).items()}
    rows = rows.where("target").groupBy("event", *STRATA, "target", "corner").agg(*[e.alias(n) for n, e in sums.items()])
    return reshape.complete_grid(rows, ["event", *STRATA], {"target": [True], "corner": CORNERS}, list(sums))


def _strata_sql(values: dict[str, str], cond: str, targets: str, tree_cond: str) -> str:
    """CTE ``sd``: drawn rows (rep, plot, cycle_no, event, target, kind, values, trees)."""
    sums = ", ".join(f"sum({e})::BIGINT AS {n}" for n, e in values.items())
    zero = ", ".join(f"coalesce({n}, 0) AS {n}" for n in values)
    none = ", ".join(f"0 AS {n}" for n in values)
    names = ", ".join(values)
    return f"""
, c0 AS (SELECT event, plot, cycle_no, target, corner, {sums} FROM v_regen WHERE role = 'N' AND {cond} GROUP BY ALL),
cr AS (SELECT event, plot, cycle_no, target, corner, {zero}
       FROM (SELECT DISTINCT event, plot, cycle_no FROM c0) CROSS JOIN (SELECT unnest([{targets}]) AS target)
            CROSS JOIN (SELECT 'C' || unnest(range(1, 9)) AS corner) LEFT JOIN c0 USING (event, plot, cycle_no, target, corner)),
{_tree_sql('tr', tree_cond, targets)},
al AS (SELECT plot, cycle_no, 's' AS kind, target, md5(concat_ws('|', event, corner)) AS mark, event, {names}, 0 AS trees FROM cr
       UNION ALL SELECT plot, cycle_no, 't', target, md5(concat_ws('|', event, module)), event, {none}, trees FROM tr),
nr AS (SELECT *, row_number() OVER (PARTITION BY plot, cycle_no, kind, target ORDER BY mark, event) - 1 AS idx FROM al),
st AS (SELECT plot, cycle_no, kind, target, count(*) AS n, CASE kind WHEN 's' THEN 8 ELSE 4 END AS k,
              {_stratum_sql('plot', 'cycle_no', "CASE WHEN target THEN 'T' ELSE 'F' END", 'kind')} AS sid FROM al GROUP BY ALL),
{_draws_sql('dx', 'st', 'k', REPS)},
sd AS (SELECT rep, plot, cycle_no, event, target, kind, {names}, trees FROM dx JOIN nr USING (plot, cycle_no, kind, target, idx))"""


_INDEX_VALUES = {
    "seedlings": "seed5_15 + seed15_30 + seed30_50 + seed50_137",
    "small_saplings": "sap0_1 + sap1_25",
    "large_saplings": "sap25_5 + sap5_10",
}
_STATS = (
    "round_even(avg({v}), 6) AS mean, round_even(quantile_cont({v}, 0.025), 6) AS lo95, round_even(quantile_cont({v}, 0.975), 6) AS hi95"
)


def _index_rows(stats: str) -> str:
    """Rows (plot, cycle_no, event) with ``stats`` of the replicates ``v`` of the index; begins with a comma."""
    return f"""{_strata_sql(_INDEX_VALUES, 'TRUE', 'TRUE, FALSE', 'dbh BETWEEN 10 AND 15')},
ev AS (SELECT rep, plot, cycle_no, event, target, sum(50 * seedlings + 5 * small_saplings) AS seed,
              5 * sum(large_saplings) + sum(trees) AS sap FROM sd GROUP BY ALL HAVING bool_or(kind = 's')),
rt AS (SELECT rep, plot, cycle_no, event, max(seed) FILTER (target) AS st, max(seed) FILTER (NOT target) AS so,
              max(sap) FILTER (target) AS pt, max(sap) FILTER (NOT target) AS po FROM ev GROUP BY ALL),
iv AS (SELECT *, (coalesce(st / nullif(st + so, 0), 0) + coalesce(pt / nullif(pt + po, 0), 0))::DOUBLE AS v FROM rt)
SELECT plot, cycle_no, event, {stats} FROM iv GROUP BY ALL"""


@query("regen_index_interval", "regen regen_tree", _index_rows(_STATS.format(v="v")))
def regen_index_interval(v: Views):
    """G4."""
    out = resample.regen_index_interval(index_corners(v), small_trees(v), STRATA, "event", REPS, SEED)
    return rounded(out, 6, "mean", "lo95", "hi95")


_IMPORTANCE_VALUES = {
    "p1": "seed5_15 + seed15_30",
    "p2": "seed30_50",
    "p10": "seed50_137",
    "p50": "sap0_1 + sap1_25 + sap25_5 + sap5_10",
}


def _importance_rows(stats: str) -> str:
    """The same of the importance score."""
    return f"""{_strata_sql(_IMPORTANCE_VALUES, 'target', 'TRUE', 'TRUE')},
iv AS (SELECT rep, plot, cycle_no, event, ln(1 + sum((p1 + 2 * p2 + 10 * p10) * 1250 + 50 * p50 * 125 + trees * 50 * 25)) AS v
       FROM sd GROUP BY ALL HAVING bool_or(kind = 's'))
SELECT plot, cycle_no, event, {stats} FROM iv GROUP BY ALL"""


@query("importance_interval", "regen regen_tree", _importance_rows(_STATS.format(v="v")))
def importance_interval(v: Views):
    """G5."""
    out = resample.importance_interval(importance_corners(v), all_target_trees(v), STRATA, "event", REPS, SEED)
    return rounded(out, 6, "mean", "lo95", "hi95")


# ---- regeneration table and rank test ---------------------------------------------


def index_history(v: Views):
    """Survey date of every event (first ship date), and prior disturbance of its plot.

    A line returned at full quantity plays a disturbance of the plot.
    """
    line = v.table("lineitem")
    day = F.to_date("l_shipdate")
    year = F.year("l_shipdate").cast("long")
    surveys = line.where("l_linestatus = 'O'").groupBy(
        F.concat_ws("-", F.col("l_suppkey").cast("string"), year.cast("string")).alias("event"),
        F.col("l_suppkey").cast("string").alias("plot"),
        clean.cycle_no(year, 1994, 5).alias("cycle_no"),
    ).agg(F.max(day).alias("survey_date")).withColumn("role", F.lit("N"))
    burns = line.where("l_quantity = 50 AND l_returnflag = 'R' AND l_discount >= 0.05").select(
        F.col("l_suppkey").cast("string").alias("plot"), day.alias("event_date")
    )
    hist = asof.asof_prior(surveys, burns, "plot", "survey_date", "event_date", "role")
    return asof.event_since_previous(hist, "plot", "cycle_no", "survey_date", "prior_event", "role", 1825)


_HIST = """
, sv AS (SELECT concat(l_suppkey, '-', year(l_shipdate)) AS event, l_suppkey::VARCHAR AS plot,
                ceil((year(l_shipdate) - 1994) / 5.0)::BIGINT AS cycle_no, max(l_shipdate::DATE) AS survey_date
         FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
bn AS (SELECT DISTINCT l_suppkey::VARCHAR AS plot, l_shipdate::DATE AS event_date FROM lineitem
       WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_discount >= 0.05),
hs AS (SELECT sv.*, (SELECT max(event_date) FROM bn WHERE bn.plot = sv.plot AND bn.event_date < sv.survey_date) AS prior_event FROM sv),
pv AS (SELECT plot, cycle_no + 1 AS cycle_no, max(survey_date) AS previous FROM sv GROUP BY ALL),
hist AS (SELECT event, survey_date, prior_event, prior_event IS NOT NULL AS has_prior,
                coalesce(CASE WHEN cycle_no = 1 THEN prior_event IS NOT NULL
                              ELSE prior_event > coalesce(previous, survey_date - 1825) END, FALSE) AS event_since
         FROM hs LEFT JOIN pv USING (plot, cycle_no))"""


@query(
    "regen_table",
    "regen regen_tree",
    f"""{_HIST}, {_tree_sql('tr', 'dbh BETWEEN 10 AND 15', 'TRUE, FALSE')}, {_index_sql()},
ta AS (SELECT {_EN}, sum(trees)::DOUBLE * 1250 AS tp FROM v_regen_tree_target GROUP BY ALL),
im AS (SELECT {_EN}, sum({_POINTS})::DOUBLE AS points FROM v_regen WHERE role = 'N' AND target GROUP BY ALL),
rows AS (SELECT plot, cycle_no, event, area, round_even(seed_ratio + sap_ratio, 2) AS regen_index,
                round_even(ln(points + coalesce(tp, 0) + 1), 2) AS importance
         FROM ix FULL JOIN im USING ({_EN}) LEFT JOIN ta USING ({_EN}))
SELECT plot, cycle_no, event, area, regen_index, importance, survey_date, prior_event, has_prior, coalesce(event_since, FALSE) AS event_since,
       '(' || (1994 + (cycle_no - 1) * 5) || ',' || (1994 + cycle_no * 5) || ']' AS cycle,
       '[' || (1995 + (cycle_no - 1) * 5) || ',' || (1994 + cycle_no * 5) || ']' AS cycle_display
FROM (SELECT DISTINCT plot FROM rows) CROSS JOIN (SELECT unnest([1, 2, 3]::BIGINT[]) AS cycle_no)
     LEFT JOIN rows USING (plot, cycle_no) LEFT JOIN hist USING (event)""".replace(
        "FROM v_regen_tree_target", "FROM (SELECT event, area, zone, plot, cycle_no, 1 AS trees FROM v_regen_tree WHERE status = 1 AND role = 'N' AND target)"
    ),
)
def regen_table(v: Views):
    """F16 with point indices; a third cycle is expected and not yet surveyed."""
    index = regen.regen_index(v.regen().where("role = 'N'"), small_trees(v), EVENT_N)
    importance = regen.importance_score(v.regen().where("role = 'N'"), all_target_trees(v), EVENT_N)
    metrics = index.join(importance, EVENT_N, "full").select("plot", "cycle_no", "event", "area", "regen_index", "importance")
    history = index_history(v).select("event", "survey_date", "prior_event", "has_prior", "event_since")
    out = regen.regen_table(rounded(metrics, 2, "regen_index", "importance"), history, "plot", [1, 2, 3], ["event"], 1994, 5)
    return out.select(
        "plot", "cycle_no", "event", "area", "regen_index", "importance", "survey_date", "prior_event", "has_prior",
        "event_since", "cycle", "cycle_display",
    )


def _as_table(sql: str) -> str:
    """A query that begins with a comma, as one with tables of its own."""
    return "WITH " + sql.strip().lstrip(",")


def _tagged_stats(tag: str) -> str:
    stats = {"mean": "avg(v)", "lo95": "quantile_cont(v, 0.025)", "hi95": "quantile_cont(v, 0.975)"}
    return ", ".join(f"round_even({e}, 2) AS {tag}_{c}" for c, e in stats.items())


@query(
    "regen_table_intervals",
    "regen regen_tree",
    f"""{_HIST},
ii AS ({_as_table(_index_rows(_tagged_stats('index')))}),
ip AS ({_as_table(_importance_rows(_tagged_stats('importance')))}),
rows AS (SELECT * FROM ii FULL JOIN ip USING (plot, cycle_no, event))
SELECT plot, cycle_no, event, index_mean, index_lo95, index_hi95, importance_mean, importance_lo95, importance_hi95,
       survey_date, prior_event, has_prior, coalesce(event_since, FALSE) AS event_since,
       '(' || (1994 + (cycle_no - 1) * 5) || ',' || (1994 + cycle_no * 5) || ']' AS cycle,
       '[' || (1995 + (cycle_no - 1) * 5) || ',' || (1994 + cycle_no * 5) || ']' AS cycle_display
FROM (SELECT DISTINCT plot FROM rows) CROSS JOIN (SELECT unnest([1, 2, 3]::BIGINT[]) AS cycle_no)
     LEFT JOIN rows USING (plot, cycle_no) LEFT JOIN hist USING (event)""",
)
def regen_table_intervals(v: Views):
    """F16 with the bootstrap means and limits of G4 and G5."""
    corners = corner_rows(v)
    index = resample.regen_index_interval(index_corners(v, corners), small_trees(v), STRATA, "event", REPS, SEED)
    importance = resample.importance_interval(importance_corners(v, corners), all_target_trees(v), STRATA, "event", REPS, SEED)
    rename = lambda df, tag: df.withColumnsRenamed({c: f"{tag}_{c}" for c in ("mean", "lo95", "hi95")})
    keys = [*STRATA, "event"]
    metrics = rename(index, "index").join(rename(importance, "importance"), keys, "full")
    metrics = rounded(metrics, 2, *[c for c in metrics.columns if c not in keys])
    history = index_history(v).select("event", "survey_date", "prior_event", "has_prior", "event_since")
    return regen.regen_table(metrics, history, "plot", [1, 2, 3], ["event"], 1994, 5)


def cycle_means(v: Views):
    """Mean index per plot and cycle, with its zone and whether the plot was ever disturbed."""
    index = regen.regen_index(v.regen().where("role = 'N'"), small_trees(v), EVENT_N)
    exposed = index_history(v).groupBy("plot").agg(F.bool_or("event_since").alias("exposed"))
    per = index.groupBy("zone", "plot", "cycle_no").agg(F.avg("regen_index").alias("value"))
    return per.join(exposed, "plot").withColumn("value", F.bround("value", 6))


_RANKS = f"""{_HIST}, {_tree_sql('tr', 'dbh BETWEEN 10 AND 15', 'TRUE, FALSE')}, {_index_sql()},
ex AS (SELECT plot, bool_or(event_since) AS exposed FROM hist JOIN sv USING (event) GROUP BY plot),
pc AS (SELECT zone, plot, cycle_no, round_even(round_even(avg(seed_ratio + sap_ratio), 6), 2) AS v FROM ix GROUP BY ALL),
dl AS (SELECT zone, exposed, plot, round_even(100 * (max(v) FILTER (cycle_no = 2) - max(v) FILTER (cycle_no = 1)), 0)::BIGINT AS d
       FROM pc JOIN ex USING (plot) GROUP BY ALL),
ok AS (SELECT * FROM dl WHERE d IS NOT NULL),
cn AS (SELECT zone, exposed, count(*) AS n FROM ok GROUP BY ALL),
nz AS (SELECT ok.*, avg(r) OVER (PARTITION BY zone, exposed, abs(d)) AS rk
       FROM (SELECT *, row_number() OVER (PARTITION BY zone, exposed ORDER BY abs(d)) AS r FROM ok WHERE d <> 0) ok),
vs AS (SELECT zone, exposed, coalesce(sum(rk) FILTER (d > 0), 0) AS v_stat FROM nz GROUP BY ALL),
wa AS (SELECT a.zone, a.exposed, (a.d + b.d) / 2 / 100 AS w FROM nz a JOIN nz b ON a.zone = b.zone AND a.exposed = b.exposed AND a.plot <= b.plot),
hl AS (SELECT zone, exposed, quantile_cont(w::DOUBLE, 0.5) AS shift FROM wa GROUP BY ALL)"""


def _rank_test(v: Views):
    return ranktest.signed_rank_by_group(cycle_means(v), ["zone", "exposed"], "plot", "cycle_no", "value", 1, 2)


@query(
    "signed_rank",
    "regen regen_tree",
    f"""{_RANKS}
SELECT zone, exposed, n, CASE WHEN n >= 6 THEN v_stat END AS v_stat, CASE WHEN n >= 6 THEN round_even(shift, 6) END AS shift
FROM cn LEFT JOIN vs USING (zone, exposed) LEFT JOIN hl USING (zone, exposed)""",
)
def signed_rank(v: Views):
    """G6: pairs, statistic and location shift."""
    return rounded(_rank_test(v), 6, "shift").select("zone", "exposed", "n", "v_stat", "shift")


# p and interval: exact by counting subsets of ranks, otherwise the normal tail by Simpson's rule.
_RANK_TEST = f"""{_RANKS},
sz AS (SELECT zone, exposed, abs(d) AS a, count(*) AS t FROM nz GROUP BY ALL),
g AS (SELECT cn.zone, cn.exposed, cn.n, coalesce(sum(t), 0)::BIGINT AS m, coalesce(sum(t * t * t - t), 0)::DOUBLE AS tied,
             coalesce(max(t), 0) = 1 AND coalesce(sum(t), 0) = cn.n AS exact, any_value(v_stat) AS v
      FROM cn LEFT JOIN sz USING (zone, exposed) LEFT JOIN vs USING (zone, exposed) WHERE n >= 6 GROUP BY cn.zone, cn.exposed, cn.n),
sub AS (WITH RECURSIVE s(k, w) AS (SELECT 0, [1::DOUBLE] UNION ALL
    SELECT k + 1, list_transform(range(0, (k + 1) * (k + 2) // 2 + 1),
        lambda i: coalesce(w[i + 1], 0) + CASE WHEN i > k THEN coalesce(w[i - k], 0) ELSE 0 END)
    FROM s WHERE k < (SELECT coalesce(max(m) FILTER (exact), 0) FROM g)) SELECT * FROM s),
cdf AS (SELECT k, i AS v, sum(x) OVER (PARTITION BY k ORDER BY i) / 2::DOUBLE ** k AS p
        FROM (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM sub)),
xt AS (SELECT zone, exposed, least(1, 2 * max(p) FILTER (cdf.v = least(g.v, m * (m + 1) // 2 - g.v))) AS p,
              greatest(1, min(cdf.v) FILTER (p >= 0.05)) AS ord
       FROM g JOIN cdf ON cdf.k = g.m WHERE exact GROUP BY zone, exposed),
no AS (SELECT zone, exposed, m, v - m * (m + 1) / 4::DOUBLE AS z, sqrt(m * (m + 1) * (2 * m + 1) / 24::DOUBLE - tied / 48) AS s FROM g WHERE NOT exact AND m > 0),
nt AS (SELECT *, abs(z - sign(z) / 2) / s / sqrt(2::DOUBLE) AS x FROM no),
np AS (SELECT zone, exposed, 1 - 2 / sqrt(pi()) * x / 3000 * list_sum(list_transform(range(0, 1001),
              lambda i: exp(-((x * i / 1000::DOUBLE) ** 2)) * CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) AS p,
              greatest(1, floor(m * (m + 1) / 4::DOUBLE - 1.6448536269514722 * sqrt(m * (m + 1) * (2 * m + 1) / 24::DOUBLE)))::BIGINT AS ord
       FROM nt),
pr AS (SELECT *, 'exact' AS method FROM xt UNION ALL SELECT *, 'normal' FROM np),
wl AS (SELECT a.zone, a.exposed, list_sort(list(a.d + b.d)) AS w FROM nz a JOIN nz b ON a.zone = b.zone AND a.exposed = b.exposed AND a.plot <= b.plot GROUP BY ALL)"""


@query(
    "signed_rank_intervals",
    "regen regen_tree",
    f"""{_RANK_TEST}
SELECT cn.zone, cn.exposed, cn.n, g.v AS v_stat, round_even(pr.p, 2) AS p_value,
       round_even(CASE WHEN g.m = 0 THEN 0 WHEN g.m > 0 THEN hl.shift END, 2) AS shift,
       round_even(wl.w[pr.ord] / 200::DOUBLE, 2) AS shift_lo, round_even(wl.w[len(wl.w) + 1 - pr.ord] / 200::DOUBLE, 2) AS shift_hi, pr.method
FROM cn LEFT JOIN g USING (zone, exposed) LEFT JOIN pr USING (zone, exposed) LEFT JOIN wl USING (zone, exposed) LEFT JOIN hl USING (zone, exposed)""",
)
def signed_rank_intervals(v: Views):
    """G6: p value and 90 percent interval of the shift."""
    return rounded(_rank_test(v), 2, "p_value", "shift", "shift_lo", "shift_hi").drop("log_p")


@query("stratum_agreement_interval", "pair", _agreement_sql("fit", _stratum_sql("fit")))
def stratum_agreement_interval(v: Views):
    """G1 for every confidence class of the first call."""
    rows = v.pair().withColumn("fit", F.coalesce(F.col("fit1"), F.lit(0)).cast("long"))
    return rounded(resample.psa_interval(rows, "value1", "value2", LEVELS, 1000, SEED, by=["fit"]), 6, "psa_lo", "psa_hi")


