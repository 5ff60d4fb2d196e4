"""Queries: differences (E1-E8, E24-E28), agreement (E9-E17), detection (E18-E23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from resurvey.operators import agree, clean, detect, diffs, reshape, roles
from resurvey.plans.catalog_joins import _SIDES, sides
from resurvey.plans.catalog_rows import PRESENCE
from resurvey.plans.registry import query, rounded
from resurvey.plans.views import CELLS, MODULES, PAIRS, SIZE_CLASSES, Views

LEVELS = ["A", "N", "R"]

# ---- differences ------------------------------------------------------------------

_COUNTS = """
, w AS (SELECT u.unit, m.module, coalesce(sum(n) FILTER (role = 'N'), 0)::BIGINT AS n_count, coalesce(sum(n) FILTER (role = 'Q'), 0)::BIGINT AS q_count
        FROM (SELECT DISTINCT unit FROM v_cnt) u CROSS JOIN (VALUES (1::BIGINT), (2), (3), (4)) m(module)
             LEFT JOIN v_cnt USING (unit, module) GROUP BY ALL)"""
_MEANS = """
, w AS (SELECT unit, module, avg(qty) FILTER (role = 'N') AS n_val, avg(qty) FILTER (role = 'Q') AS q_val FROM v_records
        GROUP BY ALL HAVING count(*) FILTER (role = 'N') > 0 AND count(*) FILTER (role = 'Q') > 0),
d AS (SELECT *, q_val - n_val AS diff FROM w)"""


def module_counts(v: Views):
    return diffs.role_counts(v.records(), ["unit"], "role", sub="module", sub_levels=[1, 2, 3, 4])


def count_diffs(v: Views):
    return diffs.paired_difference(module_counts(v), "n_count", "q_count")


def module_means(v: Views):
    """Complete pairs of module means, rounded so that engines bin them alike."""
    means = diffs.role_means(v.records(), "unit", "role", "module", "qty").where(F.col("grain") == "sub")
    return (
        means.select("unit", "module", F.col("n_mean").alias("n_val"), F.col("q_mean").alias("q_val"))
        .na.drop(subset=["n_val", "q_val"])
        .withColumn("diff", F.bround(F.col("q_val") - F.col("n_val"), 6))
    )


@query("role_counts", "cnt", f"{_COUNTS} SELECT unit, module, n_count, q_count FROM w")
def role_counts(v: Views):
    """E2."""
    return module_counts(v)


@query(
    "paired_difference",
    "cnt",
    f"""{_COUNTS}
SELECT unit, module, n_count, q_count, (n_count + q_count) / 2 AS pair_mean, q_count - n_count AS diff, q_count - n_count AS metric,
       abs(q_count - n_count) <= 1 AS within_1, abs(q_count - n_count) <= 2 AS within_2
FROM w""",
)
def paired_difference(v: Views):
    """E1, absolute form."""
    return count_diffs(v)


@query(
    "paired_percent_difference",
    "records",
    f"""{_MEANS}
SELECT unit, module, round_even(n_val, 6) AS n_val, round_even(q_val, 6) AS q_val, round_even((n_val + q_val) / 2, 6) AS pair_mean,
       round_even(diff, 6) AS diff, round_even(100 * diff / ((n_val + q_val) / 2), 0) AS metric,
       abs(round_even(100 * diff / ((n_val + q_val) / 2), 0)) < 5 AS within_5,
       abs(round_even(100 * diff / ((n_val + q_val) / 2), 0)) < 10 AS within_10
FROM d""",
)
def paired_percent_difference(v: Views):
    """E1, percent form."""
    rows = module_means(v).drop("diff")
    out = diffs.paired_difference(rows, "n_val", "q_val", "percent", (5, 10))
    return rounded(out, 6, "n_val", "q_val", "pair_mean", "diff")


@query(
    "role_means",
    "records",
    """
SELECT CASE WHEN grouping(module) = 0 THEN 'sub' ELSE 'unit' END AS grain, unit, module,
       round_even(avg(qty) FILTER (role = 'N'), 6) AS n_mean, round_even(avg(qty) FILTER (role = 'Q'), 6) AS q_mean
FROM v_records GROUP BY GROUPING SETS ((unit, module), (unit))""",
)
def role_means(v: Views):
    """E3."""
    return rounded(diffs.role_means(v.records(), "unit", "role", "module", "qty"), 6, "n_mean", "q_mean")


@query(
    "role_class_sums",
    "regen",
    f"""
, long AS (SELECT event, corner, role, size_class, cnt FROM v_regen UNPIVOT (cnt FOR size_class IN ({', '.join(SIZE_CLASSES)}))),
grid AS (SELECT DISTINCT event, 'C' || c AS corner, s AS size_class
         FROM v_regen, range(1, 9) r(c), (SELECT unnest({SIZE_CLASSES}) AS s))
SELECT event, corner, size_class, coalesce(sum(cnt) FILTER (role = 'N'), 0)::BIGINT AS n_sum,
       coalesce(sum(cnt) FILTER (role = 'Q'), 0)::BIGINT AS q_sum
FROM grid LEFT JOIN long USING (event, corner, size_class) GROUP BY ALL""",
)
def role_class_sums(v: Views):
    """E4."""
    return diffs.role_class_sums(v.regen(), ["event"], "role", "corner", [f"C{i}" for i in range(1, 9)], SIZE_CLASSES)


@query(
    "difference_cdf",
    "cnt",
    f"""{_COUNTS},
f AS (SELECT module, abs(q_count - n_count) AS level, count(*) AS frequency FROM w GROUP BY ALL),
g AS (SELECT module, unnest(range(min(level), max(level) + 1)) AS level FROM f GROUP BY module)
SELECT module, level::DOUBLE AS difference, coalesce(frequency, 0) AS frequency,
       round_even(100 * sum(coalesce(frequency, 0)) OVER (PARTITION BY module ORDER BY level)
                  / sum(frequency) OVER (PARTITION BY module), 1) AS cdf
FROM g LEFT JOIN f USING (module, level)""",
)
def difference_cdf(v: Views):
    """E5."""
    return diffs.difference_cdf(count_diffs(v), "metric", ["module"])


@query(
    "difference_freq",
    "cnt",
    f"{_COUNTS} SELECT module, abs(q_count - n_count) AS difference, count(*) AS frequency FROM w GROUP BY ALL",
)
def difference_freq(v: Views):
    """E6."""
    return diffs.difference_freq(count_diffs(v), "metric", ["module"])


@query(
    "interval_freq",
    "records",
    f"""{_MEANS},
i AS (SELECT round_even(abs(diff), 6) AS a, CASE WHEN round_even(abs(diff), 6) <= 1 THEN 0 ELSE ceil(round_even(abs(diff), 6) / 3) END AS k FROM d),
g AS (SELECT unnest(range(0, max(k)::BIGINT + 1)) AS k FROM i)
SELECT CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 1 ELSE (k - 1) * 3 END::DOUBLE AS above,
       CASE WHEN k = 0 THEN 1 ELSE k * 3 END::DOUBLE AS up_to, count(a) FILTER (a > 0) AS frequency
FROM g LEFT JOIN i USING (k) GROUP BY k""",
)
def interval_freq(v: Views):
    """E7."""
    return diffs.interval_freq(module_means(v), "diff", 3)


@query(
    "ecdf_at",
    "records",
    f"""{_MEANS},
p AS (SELECT abs(round_even(100 * diff / ((n_val + q_val) / 2), 0)) AS a FROM d),
g AS (SELECT unnest(range(0, (SELECT ceil(max(a) / 5)::BIGINT + 2 FROM p))) * 5.0::DOUBLE AS up_to)
SELECT up_to, round_even(100 * count(*) FILTER (a <= up_to) / count(*), 0) AS cum_percent FROM g, p GROUP BY up_to""",
)
def ecdf_at(v: Views):
    """E8."""
    rows = diffs.paired_difference(module_means(v).drop("diff"), "n_val", "q_val", "percent", ())
    return diffs.ecdf_at(rows, "metric", 5)


@query(
    "joint_counts",
    "cnt",
    f"""{_COUNTS},
j AS (SELECT n_count, q_count, count(*) AS pairs FROM w GROUP BY ALL)
SELECT *, (SELECT max(pairs) FROM j) AS modal_count, pairs = (SELECT max(pairs) FROM j) AS is_modal FROM j""",
)
def joint_counts(v: Views):
    """E24."""
    return diffs.joint_counts(module_counts(v), "n_count", "q_count")


_LIMITS = "round_even(quantile_cont({d}, 0.025), 6) AS lower_limit, round_even(quantile_cont({d}, 0.975), 6) AS upper_limit"


@query(
    "bland_altman",
    "cnt",
    f"""{_COUNTS}
SELECT module, count(*) AS pairs, round_even(avg(q_count - n_count), 6) AS bias, {_LIMITS.format(d='(q_count - n_count)::DOUBLE')}
FROM w GROUP BY module""",
)
def bland_altman(v: Views):
    """E25, per module."""
    return rounded(diffs.bland_altman(module_counts(v), "n_count", "q_count", ["module"]), 6, "bias", "lower_limit", "upper_limit")


@query(
    "bland_altman_overall",
    "records",
    f"""{_MEANS} SELECT count(*) AS pairs, round_even(avg(diff), 6) AS bias, {_LIMITS.format(d='diff')} FROM d""",
)
def bland_altman_overall(v: Views):
    """E25 over all pairs of means."""
    return rounded(diffs.bland_altman(module_means(v), "n_val", "q_val"), 6, "bias", "lower_limit", "upper_limit")


@query(
    "bland_altman_points",
    "cnt",
    f"""{_COUNTS} SELECT unit, module, n_count, q_count, (n_count + q_count) / 2 AS pair_mean, q_count - n_count AS diff FROM w""",
)
def bland_altman_points(v: Views):
    """E25, the points."""
    return diffs.bland_altman_points(module_counts(v), "n_count", "q_count")


@query(
    "histogram",
    "cnt",
    f"""{_COUNTS}
SELECT module, floor((q_count - n_count) / 3.0::DOUBLE + 0.5) * 3 AS bar_center, count(*) AS frequency FROM w GROUP BY ALL""",
)
def histogram(v: Views):
    """E27, bars of width 3 centred on 0, per module."""
    return diffs.histogram(count_diffs(v), "metric", 3, 0, ["module"])


@query(
    "class_bars",
    "spec",
    "SELECT role, cover_class::DOUBLE AS bar_center, count(*) AS frequency FROM v_spec GROUP BY ALL",
)
def class_bars(v: Views):
    """E27, bars per class and role."""
    return diffs.histogram(v.spec(), "cover_class", 1, 0, ["role"])


@query(
    "ecdf",
    "records",
    f"""{_MEANS},
f AS (SELECT abs(round_even(diff, 6)) AS difference, count(*) AS frequency FROM d GROUP BY 1)
SELECT difference, frequency, round_even(sum(frequency) OVER (ORDER BY difference) / (SELECT count(*) FROM d), 6) AS share FROM f""",
)
def ecdf(v: Views):
    """E28."""
    return rounded(diffs.ecdf(module_means(v), "diff"), 6, "share")


# ---- agreement --------------------------------------------------------------------

_CODED = """
, k AS (SELECT unit, coalesce(value1, 'XXX') AS a, coalesce(value2, 'XXX') AS b, fit1, fit2 FROM v_pair),
lv(category, ord) AS (VALUES ('A', 0), ('N', 1), ('R', 2), ('XXX', 3))"""


@query(
    "contingency",
    "pair",
    f"""{_CODED}
SELECT x.category AS rating1, y.category AS rating2, count(unit) AS pairs,
       round_even(count(unit) / (SELECT count(*) FROM k), 9) AS proportion
FROM lv x CROSS JOIN lv y LEFT JOIN k ON a = x.category AND b = y.category GROUP BY ALL""",
)
def contingency(v: Views):
    """E9."""
    return rounded(agree.contingency(v.pair(), "value1", "value2", LEVELS), 9, "proportion")


@query(
    "interrater_matrix",
    "pair",
    f"""{_CODED},
t AS (SELECT unit, greatest(x.ord, y.ord) AS hi, least(x.ord, y.ord) AS lo FROM k JOIN lv x ON a = x.category JOIN lv y ON b = y.category)
SELECT x.category AS high, y.category AS low, count(unit) AS pairs
FROM lv x JOIN lv y ON y.ord <= x.ord LEFT JOIN t ON hi = x.ord AND lo = y.ord GROUP BY ALL""",
)
def interrater_matrix(v: Views):
    """E10."""
    return agree.interrater_matrix(v.pair(), "value1", "value2", LEVELS)


@query(
    "specific_agreement",
    "pair",
    f"""{_CODED},
s AS (SELECT category, 2 * count(*) FILTER (a = category AND b = category) AS num,
             count(*) FILTER (a = category) + count(*) FILTER (b = category) AS denom
      FROM lv CROSS JOIN k GROUP BY category)
SELECT category, num, denom, round_even(100 * num / nullif(denom, 0), 0) AS psa FROM s""",
)
def specific_agreement(v: Views):
    """E11."""
    return agree.specific_agreement(v.pair(), "value1", "value2", LEVELS)


@query(
    "specific_agreement_by_fit",
    "pair",
    f"""{_CODED},
f AS (SELECT DISTINCT coalesce(fit1, 0)::BIGINT AS fit FROM k),
s AS (SELECT fit, category, 2 * count(*) FILTER (a = category AND b = category) AS num,
             count(*) FILTER (a = category) + count(*) FILTER (b = category) AS denom
      FROM lv CROSS JOIN f JOIN k ON coalesce(fit1, 0) = fit GROUP BY ALL)
SELECT fit, category, num, denom, round_even(100 * num / nullif(denom, 0), 0) AS psa FROM s""",
)
def specific_agreement_by_fit(v: Views):
    """E11 for every confidence class of the first call."""
    rows = v.pair().withColumn("fit", F.coalesce(F.col("fit1"), F.lit(0)).cast("long"))
    return agree.specific_agreement(rows, "value1", "value2", LEVELS, by=["fit"])


@query(
    "overall_agreement",
    "pair",
    """
SELECT count(*) FILTER (m) AS matches, count(*) FILTER (NOT m) AS mismatches, round_even(avg(m::INT), 9) AS share
FROM (SELECT coalesce(value1 = value2, FALSE) AS m FROM v_pair)""",
)
def overall_agreement(v: Views):
    """E12."""
    return rounded(agree.overall_agreement(v.pair(), "value1", "value2"), 9, "share")


_FLAGS = f"""{_SIDES},
lv(code) AS (VALUES ('A'), ('N'), ('R')),
fp AS (SELECT n.link_id AS link, code, n.rater AS rater1, coalesce(n.code1 = code, FALSE) OR coalesce(n.code2 = code, FALSE) AS v1,
              q.rater AS rater2, coalesce(q.code1 = code, FALSE) OR coalesce(q.code2 = code, FALSE) AS v2
       FROM n LEFT JOIN q ON n.link_id = q.id CROSS JOIN lv)"""


def flag_pairs(v: Views):
    n, q = sides(v)
    return agree.flag_pairs(n, q, "link_id", "id", ["code1", "code2"], "rater", LEVELS)


@query("flag_pairs", "tree", f"{_FLAGS} SELECT * FROM fp")
def flag_pairs_query(v: Views):
    """C3 and D1 together: the long pairs behind the code summaries."""
    return flag_pairs(v)


_OPTIONAL = """
, o AS (SELECT unit, fit1 = 1 AS f1, fit2 = 1 AS f2, value1, value2, coalesce(value1, value2) AS code FROM v_pair)"""


@query(
    "binary_match_types",
    "pair",
    f"""{_OPTIONAL}
SELECT code, count(*) FILTER (f1 AND f2) AS n11, count(*) FILTER (NOT f1 AND NOT f2) AS n00,
       count(*) FILTER (f1 IS NULL OR f2 IS NULL OR f1 <> f2) AS n10
FROM o GROUP BY code""",
)
def binary_match_types(v: Views):
    """E13, with missing sides."""
    rows = v.pair().select(
        F.coalesce("value1", "value2").alias("code"), (F.col("fit1") == 1).alias("f1"), (F.col("fit2") == 1).alias("f2")
    )
    return agree.binary_match_types(rows, "code", "f1", "f2")


_LEVELED = f"""{_SIDES},
fl AS (SELECT n.link_id AS link, code, CASE WHEN n.code1 = code THEN n.level1 END AS l1, CASE WHEN q.code1 = code THEN q.level1 END AS l2
       FROM n LEFT JOIN q ON n.link_id = q.id CROSS JOIN (VALUES ('A'), ('N'), ('R')) lv(code))"""


@query(
    "match_types_optional",
    "tree",
    f"""{_LEVELED}
SELECT code, count(*) FILTER (l1 IS NULL AND l2 IS NULL) AS both_missing, count(*) FILTER (l1 = l2) AS matched,
       count(*) FILTER ((l1 IS NULL) <> (l2 IS NULL) OR l1 <> l2) AS mismatched
FROM fl GROUP BY code""",
)
def match_types_optional(v: Views):
    """E14, per condition code."""
    n, q = sides(v)
    left = n.select(F.col("link_id").alias("link"), F.col("code1").alias("c1"), F.col("level1").alias("s1"))
    right = q.select(F.col("id").alias("link"), F.col("code1").alias("c2"), F.col("level1").alias("s2"))
    code = F.explode(F.array(*[F.lit(x) for x in LEVELS]))
    rows = left.join(right, "link", "left").withColumn("code", code).select(
        "code",
        F.when(F.col("c1") == F.col("code"), F.col("s1")).alias("l1"),
        F.when(F.col("c2") == F.col("code"), F.col("s2")).alias("l2"),
    )
    return agree.match_types_optional(rows, "code", "l1", "l2")


@query(
    "code_agreement",
    "tree",
    f"""{_FLAGS}
SELECT code, count(*) FILTER (v1 AND v2) AS n11, count(*) FILTER (NOT v1 AND NOT v2) AS n00, count(*) FILTER (v1 <> v2) AS n10,
       count(*) FILTER (v1) + count(*) FILTER (v2) AS denom, 0::BIGINT AS missing_uses,
       coalesce(round_even(200 * count(*) FILTER (v1 AND v2) / nullif(count(*) FILTER (v1) + count(*) FILTER (v2), 0), 0), 0) AS psa
FROM fp GROUP BY code""",
)
def code_agreement(v: Views):
    """E15."""
    return agree.code_agreement(flag_pairs(v), "code", "v1", "v2")


@query(
    "fit_crosstab",
    "pair",
    """
SELECT CASE WHEN coalesce(fit1 = 1, FALSE) AND coalesce(fit2 = 1, FALSE) THEN '11'
            WHEN coalesce(fit1 = 1, FALSE) OR coalesce(fit2 = 1, FALSE) THEN '1+/+1' ELSE '++' END AS fit_class,
       count(*) FILTER (coalesce(value1 = value2, FALSE)) AS matches, count(*) FILTER (NOT coalesce(value1 = value2, FALSE)) AS mismatches
FROM v_pair GROUP BY 1""",
)
def fit_crosstab(v: Views):
    """E16."""
    return agree.fit_crosstab(v.pair(), "value1", "value2", "fit1", "fit2")


@query(
    "rater_rates",
    "tree",
    f"""{_FLAGS},
s AS (SELECT rater1 AS rater, code, v1 AS said, v1 OR v2 AS either FROM fp
      UNION ALL SELECT rater2, code, v2, v1 OR v2 FROM fp WHERE rater2 IS NOT NULL)
SELECT rater, code, count(*) FILTER (said) AS said_true, count(*) FILTER (either) AS either_true, count(*) AS rated_units,
       floor(100.0::DOUBLE * count(*) FILTER (said) / nullif(count(*) FILTER (either), 0))::BIGINT AS percent_true
FROM s GROUP BY ALL""",
)
def rater_rates(v: Views):
    """E17."""
    return agree.rater_rates(flag_pairs(v), "code", "rater1", "v1", "rater2", "v2")


# ---- detection --------------------------------------------------------------------

_DET = """
, det AS (SELECT unit, item, coalesce(bool_or(role = 'N'), FALSE) AS n_seen, coalesce(bool_or(role = 'Q'), FALSE) AS q_seen
          FROM v_spec GROUP BY ALL)"""


def _summary_sql(group: str, table: str) -> str:
    """Detection summary of a table with n_seen and q_seen."""
    return f"""
SELECT {group}, a AS n_only, b AS q_only, a + m AS n_richness, b + m AS q_richness,
       round_even(100 * (a + b) / nullif(a + b + 2 * m, 0), 0)::BIGINT AS turnover, b - a AS rich_diff,
       round_even(100 * abs(b - a) / nullif((a + b + 2 * m) / 2, 0), 0)::BIGINT AS rich_diff_percent,
       a + b + m AS unique_items, m AS matched,
       round_even(100 * m / nullif((a + b + 2 * m) / 2, 0), 0)::BIGINT AS match_by_mean,
       round_even(100 * m / nullif(a + b + m, 0), 0)::BIGINT AS match_by_unique
FROM (SELECT {group}, count(*) FILTER (n_seen AND NOT q_seen) AS a, count(*) FILTER (q_seen AND NOT n_seen) AS b,
             count(*) FILTER (n_seen AND q_seen) AS m FROM {table} GROUP BY ALL)"""


def detections(v: Views):
    return detect.detection_match(v.spec(), ["unit"], "item")


@query(
    "detection_match",
    "spec",
    f"""{_DET}
SELECT *, n_seen AND q_seen AS both_seen, concat(upper(n_seen::VARCHAR), '-', upper(q_seen::VARCHAR)) AS match_type FROM det""",
)
def detection_match(v: Views):
    """E18."""
    return detections(v)


@query("detection_summary", "spec", f"{_DET} {_summary_sql('unit', 'det')}")
def detection_summary(v: Views):
    """E19."""
    return detect.detection_summary(detections(v), ["unit"])


_FLAG_COLS = detect.scale_columns(MODULES, CELLS)
_LONG = " UNION ALL ".join(
    f"SELECT subset, unit, item, '{s}' AS scale, '{p}' AS position, coalesce(bool_or(role = 'N' AND {c}), FALSE) AS n_seen, "
    f"coalesce(bool_or(role = 'Q' AND {c}), FALSE) AS q_seen FROM parts GROUP BY subset, unit, item"
    for (s, p), c in _FLAG_COLS.items()
)
_ROLLED = """CASE WHEN upper(substr(item, 1, 4)) IN ('SMAL', 'LARG') THEN upper(substr(item, 1, 4)) ELSE item END"""
_PRES_COLS = "unit, role, item, in_plot, " + ", ".join([*MODULES, *CELLS])
_REPORT = f"""{PRESENCE},
hi AS (SELECT DISTINCT unit, item FROM v_spec WHERE cover_class > 8),
rolled AS (SELECT unit, role, {_ROLLED} AS item, {', '.join(f'max({c}) AS {c}' for c in CELLS)} FROM v_spec GROUP BY unit, role, {_ROLLED}),
rf AS (SELECT unit, role, item, {', '.join(f"coalesce({a}, CASE WHEN {b} IS NULL THEN 0 ELSE 1 END) AS {a}, {b}" for a, b in PAIRS)} FROM rolled),
ri AS (SELECT unit, role, item, {', '.join(f"{a}, coalesce({b}, CASE WHEN {a} = 0 THEN 0 ELSE 1 END) AS {b}" for a, b in PAIRS)} FROM rf),
rp AS (SELECT unit, role, item, TRUE AS in_plot, {', '.join(f"({a} + {b}) > 0 AS {m}" for m, (a, b) in MODULES.items())},
              {', '.join(f"{c} > 1 AS {c}" for c in CELLS)} FROM ri WHERE {' + '.join(CELLS)} > 0),
parts AS (SELECT 'all' AS subset, {_PRES_COLS} FROM pres
          UNION ALL SELECT 'high_cover', {_PRES_COLS} FROM pres WHERE (unit, item) IN (SELECT (unit, item) FROM hi)
          UNION ALL SELECT 'rolled_up', {_PRES_COLS} FROM rp),
long AS ({_LONG})"""


def presence_rows(v: Views):
    """Presence flags of the items as recorded, and of the items rolled up to genus."""
    spec = v.spec()
    base = clean.presence_flags(clean.impute_cells(spec, PAIRS), CELLS, MODULES)
    rolled = clean.roll_up_taxa(spec, "item", ["SMAL", "LARG"], ["unit", "role"], CELLS)
    return base, clean.presence_flags(clean.impute_cells(rolled, PAIRS), CELLS, MODULES)


@query("detection_report", "spec", f"{_REPORT} {_summary_sql('subset, unit, scale, position', 'long')}")
def detection_report(v: Views):
    """E20."""
    return detect.detection_report(*presence_rows(v), ["unit"], "item", _FLAG_COLS, F.col("cover_class") > 8)


@query(
    "detection_difference_cdf",
    "spec",
    f"""{_REPORT},
s AS ({_summary_sql('subset, unit, scale, position', 'long')}),
fq AS (SELECT subset, scale, abs(rich_diff) AS level, count(*) AS frequency FROM s GROUP BY ALL),
g AS (SELECT subset, scale, unnest(range(min(level), max(level) + 1)) AS level FROM fq GROUP BY subset, scale)
SELECT subset, scale, level::DOUBLE AS difference, coalesce(frequency, 0) AS frequency,
       round_even(100 * sum(coalesce(frequency, 0)) OVER (PARTITION BY subset, scale ORDER BY level)
                  / sum(frequency) OVER (PARTITION BY subset, scale), 1) AS cdf
FROM g LEFT JOIN fq USING (subset, scale, level)""",
)
def detection_difference_cdf(v: Views):
    """E20 with E5: richness differences per subset and scale."""
    return diffs.difference_cdf(detection_report(v), "rich_diff", ["subset", "scale"])


@query(
    "numeric_summary",
    "spec",
    f"""{_DET},
s AS ({_summary_sql('unit', 'det')}),
l AS (SELECT variable, value FROM (SELECT n_richness, q_richness, turnover, rich_diff_percent, unique_items, matched FROM s)
      UNPIVOT (value FOR variable IN (n_richness, q_richness, turnover, rich_diff_percent, unique_items, matched)))
SELECT variable, min(value)::DOUBLE AS minimum, round_even(quantile_cont(value::DOUBLE, 0.25), 6) AS q1,
       round_even(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round_even(avg(value), 6) AS mean,
       round_even(quantile_cont(value::DOUBLE, 0.75), 6) AS q3, max(value)::DOUBLE AS maximum
FROM l GROUP BY variable""",
)
def numeric_summary(v: Views):
    """E26."""
    cols = ["n_richness", "q_richness", "turnover", "rich_diff_percent", "unique_items", "matched"]
    return rounded(diffs.numeric_summary(detect.detection_summary(detections(v), ["unit"]), cols), 6, "q1", "median", "mean", "q3")


@query(
    "unmatched_items",
    "spec",
    f"""{_DET},
r AS (SELECT item, count(*) AS detections, count(*) FILTER (NOT (n_seen AND q_seen)) AS unmatched FROM det GROUP BY item),
p AS (SELECT *, round_even(100 * unmatched / detections, 0)::BIGINT AS unmatched_percent FROM r WHERE detections >= 30)
SELECT *, rank() OVER (ORDER BY unmatched_percent DESC) AS position FROM p WHERE unmatched_percent > 50""",
)
def unmatched_items(v: Views):
    """E21."""
    return detect.unmatched_items(detections(v), "item", 30, 50)


MIN_DETECTIONS = {"plot": 5, "module": 30, "cell": 60}
_BY_SCALE = " UNION ALL ".join(
    f"""
SELECT '{scale}' AS scale, *, rank() OVER (ORDER BY unmatched_percent DESC) AS position
FROM (SELECT item, detections, unmatched, round_even(100 * unmatched / detections, 0)::BIGINT AS unmatched_percent FROM rs
      WHERE scale = '{scale}' AND detections >= {k}) WHERE unmatched_percent > 50"""
    for scale, k in MIN_DETECTIONS.items()
)


@query(
    "unmatched_items_by_scale",
    "spec",
    f"""{_REPORT},
rs AS (SELECT scale, item, count(*) AS detections, count(*) FILTER (NOT (n_seen AND q_seen)) AS unmatched
       FROM long WHERE subset = 'all' GROUP BY ALL)
{_BY_SCALE}""",
)
def unmatched_items_by_scale(v: Views):
    """E21 at the three scales, each with its minimum of detections."""
    long = detect.scaled_match(presence_rows(v)[0], ["unit"], "item", _FLAG_COLS)
    tables = {s: detect.unmatched_items(long.where(F.col("scale") == s), "item", k, 50) for s, k in MIN_DETECTIONS.items()}
    return roles.stack_metrics(tables, "scale")


def _list_sql(cond: str, name: str) -> str:
    return f"coalesce(string_agg(item, ' - ' ORDER BY item) FILTER ({cond}), '') AS {name}"


@query(
    "match_lists",
    "spec",
    f"""{_DET}
SELECT unit, {_list_sql('n_seen AND q_seen', 'both_surveys')}, {_list_sql('n_seen AND NOT q_seen', 'first_only')},
       {_list_sql('NOT n_seen AND q_seen', 'resurvey_only')}
FROM det GROUP BY unit""",
)
def match_lists(v: Views):
    """E22."""
    return detect.match_lists(detections(v), ["unit"], "item")


@query(
    "match_rows",
    "spec",
    f"""{_DET},
ls AS (SELECT unit, item, CASE WHEN n_seen AND q_seen THEN 'both_surveys' WHEN n_seen THEN 'first_only' WHEN q_seen THEN 'resurvey_only' END AS list
       FROM det)
SELECT unit, item, list, row_number() OVER (PARTITION BY unit, list ORDER BY item) AS position FROM ls WHERE list IS NOT NULL""",
)
def match_rows(v: Views):
    """E22, long form."""
    return detect.match_rows(detections(v), ["unit"], "item")


@query(
    "class_difference",
    "spec",
    """
, w AS MATERIALIZED (SELECT unit, item, max(cover_class) FILTER (role = 'N') AS n_class, max(cover_class) FILTER (role = 'Q') AS q_class
                    FROM v_spec GROUP BY unit, item)
SELECT unit, item, n_class, q_class, abs(q_class - n_class) AS abs_diff FROM w WHERE n_class IS NOT NULL AND q_class IS NOT NULL""",
)
def class_difference(v: Views):
    """E23."""
    return detect.class_difference(v.spec(), ["unit"], "item", "cover_class")


@query(
    "class_difference_matrix",
    "spec",
    """
, p AS (SELECT n.cover_class AS a, q.cover_class AS b
        FROM (FROM v_spec WHERE role = 'N') n JOIN (FROM v_spec WHERE role = 'Q') q USING (unit, item)),
lv AS (SELECT x::BIGINT AS ord FROM range(1, 12) t(x)),
t AS (SELECT greatest(a, b) AS hi, least(a, b) AS lo FROM p)
SELECT CASE WHEN x.ord = 11 THEN 'XXX' ELSE x.ord::VARCHAR END AS high, CASE WHEN y.ord = 11 THEN 'XXX' ELSE y.ord::VARCHAR END AS low,
       count(hi) AS pairs
FROM lv x JOIN lv y ON y.ord <= x.ord LEFT JOIN t ON hi = x.ord AND lo = y.ord GROUP BY ALL""",
)
def class_difference_matrix(v: Views):
    """E10 over the ten cover classes of matched items."""
    wide = reshape.pair_by_role(v.spec(), ["unit", "item"], "role", ["cover_class"], {"N": "n", "Q": "q"})
    wide = wide.na.drop(subset=["n_cover_class", "q_cover_class"])
    return agree.interrater_matrix(wide, "n_cover_class", "q_cover_class", range(1, 11))
