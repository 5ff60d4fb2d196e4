"""Queries: joins and set operations (D), prior-event history, quality checks (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from resurvey.operators import asof, checks, clean, diffs, reshape, roles
from resurvey.plans.registry import cents, query, rounded, settled, settled_sql
from resurvey.plans.views import Views

_SIDES = """
, n AS (SELECT * FROM v_tree WHERE role = 'N'), q AS (SELECT * FROM v_tree WHERE role = 'Q')"""


def sides(v: Views):
    """First surveys and re-surveys of the trees."""
    t = v.tree()
    return t.where(F.col("role") == "N"), t.where(F.col("role") == "Q")


@query(
    "pair_by_link",
    "tree",
    f"""{_SIDES}
SELECT q.id AS link, n.status AS status_1, q.status AS status_2, n.crown AS crown_1, q.crown AS crown_2,
       coalesce(n.status = q.status, FALSE) AS status_match, coalesce(n.crown = q.crown, FALSE) AS crown_match
FROM n JOIN q ON n.link_id = q.id""",
)
def pair_by_link(v: Views):
    """D1, both-missing pairs count as a mismatch."""
    return roles.pair_by_link(*sides(v), "link_id", "id", ["status", "crown"])


@query(
    "pair_by_link_optional",
    "tree",
    f"""{_SIDES}
SELECT q.id AS link, n.crown AS crown_1, q.crown AS crown_2, coalesce(n.crown = q.crown, FALSE) AS crown_match
FROM n JOIN q ON n.link_id = q.id WHERE n.crown IS NOT NULL OR q.crown IS NOT NULL""",
)
def pair_by_link_optional(v: Views):
    """D1, both-missing pairs left out."""
    return roles.pair_by_link(*sides(v), "link_id", "id", ["crown"], both_null_mismatch=False)


@query(
    "missing_both",
    "tree",
    f"{_SIDES} SELECT q.id AS link FROM n JOIN q ON n.link_id = q.id WHERE n.crown IS NULL AND q.crown IS NULL",
)
def missing_both(v: Views):
    """D1, the pairs reported as missing on both sides."""
    return roles.missing_both(*sides(v), "link_id", "id", "crown")


@query(
    "unlinked",
    "tree",
    f"""{_SIDES}
SELECT id, 'no re-survey' AS side FROM n WHERE link_id NOT IN (SELECT id FROM q)
UNION ALL SELECT id, 'no first survey' FROM q WHERE link_id NOT IN (SELECT id FROM n)""",
)
def unlinked(v: Views):
    """D2."""
    return roles.unlinked(*sides(v), "link_id", "id", "link_id", "id")


@query(
    "both_status",
    "tree",
    f"{_SIDES} SELECT q.id AS link FROM n JOIN q ON n.link_id = q.id WHERE n.status IN (1, 2) AND q.status IN (1, 2)",
)
def both_status(v: Views):
    """D3."""
    return roles.both_status(*sides(v), "link_id", "id", "status", [1, 2])


@query(
    "lookup",
    "thr",
    """
SELECT unit, subunit, bin, period, y, c_name AS plot_group
FROM v_thr LEFT JOIN (SELECT n_name AS subunit, 'G' || n_nationkey AS c_name FROM nation WHERE n_nationkey % 4 <> 0) USING (subunit)""",
)
def lookup(v: Views):
    """D4. A dimension that does not know every key."""
    dim = v.table("nation").where(F.col("n_nationkey") % 4 != 0)
    dim = dim.select(F.col("n_name").alias("subunit"), F.concat(F.lit("G"), F.col("n_nationkey").cast("string")).alias("plot_group"))
    return roles.lookup(v.thr(), dim, "subunit").select("unit", "subunit", "bin", "period", "y", "plot_group")


# ---- as-of ------------------------------------------------------------------------

_PRIOR = """
, hist AS (SELECT s.*, b.event_date AS prior_event FROM v_surveys s ASOF LEFT JOIN v_burns b
           ON s.unit = b.unit AND s.survey_date > b.event_date)"""


def prior(v: Views):
    """Surveys with their latest earlier event."""
    return asof.asof_prior(v.surveys(), v.burns(), "unit", "survey_date", "event_date", "role")


@query("asof_prior", "surveys burns", f"{_PRIOR} SELECT *, prior_event IS NOT NULL AS has_prior FROM hist")
def asof_prior(v: Views):
    """D5."""
    return prior(v)


@query(
    "event_since_previous",
    "surveys burns",
    f"""{_PRIOR},
prev AS (SELECT unit, cycle_no + 1 AS cycle_no, max(survey_date) AS previous FROM v_surveys GROUP BY ALL)
SELECT unit, role, survey_date, cycle_no, prior_event, prior_event IS NOT NULL AS has_prior,
       coalesce(CASE WHEN cycle_no = 1 THEN prior_event IS NOT NULL
                     ELSE prior_event > coalesce(previous, survey_date - 5) END, FALSE) AS event_since
FROM hist LEFT JOIN prev USING (unit, cycle_no)""",
)
def event_since_previous(v: Views):
    """D6 with a five-day look-back for unsurveyed cycles (the data span one month)."""
    return asof.event_since_previous(prior(v), "unit", "cycle_no", "survey_date", "prior_event", "role", 5)


@query(
    "years_since_event",
    "surveys burns",
    f"""{_PRIOR}
SELECT *, prior_event IS NOT NULL AS has_prior, round_even((survey_date - prior_event) / 365.0::DOUBLE, 6) AS years_since
FROM hist WHERE prior_event IS NOT NULL""",
)
def years_since_event(v: Views):
    """F18."""
    return rounded(asof.years_since_event(prior(v), "survey_date", "prior_event", "role"), 6, "years_since")


_MAIN = """
, ev AS (SELECT DISTINCT concat(plot, ' - ', year) AS event, park, plot, year FROM v_spec WHERE role = 'N'),
main AS (SELECT event, park, plot, year, ceil((year - 1994) / 5.0)::BIGINT AS cycle_no, 'N' AS role,
                'G' || year AS "group" FROM ev WHERE year <> 1997),
grp AS (SELECT plot, min("group") AS "group" FROM main WHERE plot NOT LIKE 'PK03%' GROUP BY 1)"""


def _main_and_groups(v: Views):
    ev = v.spec().where(F.col("role") == "N").select(
        F.concat("plot", F.lit(" - "), F.col("year").cast("string")).alias("event"), "park", "plot", "year"
    ).distinct()
    main = ev.where(F.col("year") != 1997).select(
        "event", "park", "plot", "year", clean.cycle_no(F.col("year"), 1994, 5).alias("cycle_no"),
        F.lit("N").alias("role"), F.concat(F.lit("G"), F.col("year").cast("string")).alias("group"),
    )
    groups = main.where(~F.col("plot").startswith("PK03")).groupBy("plot").agg(F.min("group").alias("group"))
    side = v.spec().where(F.col("role") == "N").select(
        F.concat("plot", F.lit(" - "), F.col("year").cast("string")).alias("event"), "item"
    )
    return side, main, groups


@query(
    "backfill_events",
    "spec",
    f"""{_MAIN}
SELECT concat(s.plot, ' - ', s.year) AS event, s.item, s.park, s.plot, s.year, ceil((s.year - 1994) / 5.0)::BIGINT AS cycle_no,
       'N' AS role, CASE WHEN main.event IS NULL THEN grp."group" ELSE main."group" END AS "group", main.event IS NULL AS backfilled
FROM (SELECT * FROM v_spec WHERE role = 'N') s LEFT JOIN main ON main.event = concat(s.plot, ' - ', s.year)
     LEFT JOIN grp ON grp.plot = s.plot""",
)
def backfill_events(v: Views):
    """D7, the filled rows."""
    side, main, groups = _main_and_groups(v)
    return roles.backfill_events(side, main, "event", groups, 1994, 5)[0]


@query(
    "backfill_main",
    "spec",
    f"""{_MAIN}
SELECT event, ev.park, ev.plot, ev.year, ceil((ev.year - 1994) / 5.0)::BIGINT AS cycle_no, 'N' AS role,
       CASE WHEN ev.year = 1997 THEN grp."group" ELSE 'G' || ev.year END AS "group"
FROM ev LEFT JOIN grp USING (plot)""",
)
def backfill_main(v: Views):
    """D7, the main table with the new events."""
    side, main, groups = _main_and_groups(v)
    return roles.backfill_events(side, main, "event", groups, 1994, 5)[1]


@query(
    "high_value_flag",
    "spec",
    """
, high AS (SELECT DISTINCT unit, item FROM v_spec WHERE cover_class > 8)
SELECT unit, role, item, cover_class,
       CASE WHEN item NOT LIKE '%ring' THEN (unit, item) IN (SELECT (unit, item) FROM high) END AS high
FROM v_spec""",
)
def high_value_flag(v: Views):
    """D8."""
    rows = v.spec().select("unit", "role", "item", "cover_class")
    return roles.high_value_flag(rows, ["unit", "item"], "cover_class", 8, ~F.col("item").endswith("ring"))


@query(
    "key_differences",
    sql="""
SELECT doc_id::VARCHAR AS id, 'a' AS only_in FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT doc_id::VARCHAR, 'b' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def key_differences(v: Views):
    """D9. Documents against labels: not every document has one."""
    id_ = F.col("doc_id").cast("string").alias("id")
    return roles.key_differences(v.table("documents").select(id_), v.table("labels").select(id_), "id")


@query(
    "merge_summaries",
    "pair",
    """
, a AS (SELECT value1 AS code, count(*) AS first_calls FROM v_pair WHERE value1 IS NOT NULL GROUP BY 1),
b AS (SELECT value2 AS code, count(*) AS second_calls FROM v_pair WHERE value2 IS NOT NULL GROUP BY 1),
c AS (SELECT value1 AS code, count(*) AS agreed FROM v_pair WHERE value1 = value2 GROUP BY 1)
SELECT code, first_calls, second_calls, agreed FROM a FULL JOIN b USING (code) FULL JOIN c USING (code)""",
)
def merge_summaries(v: Views):
    """D10."""
    p = v.pair()
    n = F.count(F.lit(1))
    a = p.where(F.col("value1").isNotNull()).groupBy(F.col("value1").alias("code")).agg(n.alias("first_calls"))
    b = p.where(F.col("value2").isNotNull()).groupBy(F.col("value2").alias("code")).agg(n.alias("second_calls"))
    c = p.where(F.col("value1") == F.col("value2")).groupBy(F.col("value1").alias("code")).agg(n.alias("agreed"))
    return roles.merge_summaries([a, b, c], ["code"])


@query(
    "stack_metrics",
    "thr",
    f"""
SELECT 'price' AS metric, unit, count(*) AS n, {settled_sql('sum(round(y * 100)::BIGINT)::DOUBLE / count(*)', unit=100)} AS mean FROM v_thr GROUP BY unit
UNION ALL SELECT 'share', unit, count(*), {settled_sql('avg(100 * y / (SELECT avg(y) FROM v_thr))')} FROM v_thr GROUP BY unit""",
)
def stack_metrics(v: Views):
    """D11."""
    summary = lambda df, c: df.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), (F.sum(c).cast("double") / F.count(c)).alias("mean"))
    price = settled(summary(v.thr().withColumn("c", cents("y")), "c"), "mean", unit=100)
    share = settled(summary(clean.percent_of_mean(v.thr(), "y", "pct"), "pct"), "mean")
    return roles.stack_metrics({"price": price, "share": share})


# ---- K: quality checks ------------------------------------------------------------


@query(
    "conflicting_keys",
    sql="""SELECT l_orderkey, count(DISTINCT l_returnflag) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""",
)
def conflicting_keys(v: Views):
    """K1."""
    return checks.conflicting_keys(v.table("lineitem"), "l_orderkey", "l_returnflag")


@query("not_exact_pair", "rating", "SELECT unit, count(*) AS entries FROM v_rating GROUP BY unit HAVING count(*) <> 2")
def not_exact_pair(v: Views):
    """K2."""
    return checks.not_exact_pair(v.rating(), "unit")


@query(
    "missing_sides",
    "pair",
    """
SELECT unit, CASE WHEN a AND b THEN 'both missing' WHEN a THEN 'first missing' ELSE 'second missing' END AS problem
FROM (SELECT unit, value1 IS NULL AS a, value2 IS NULL AS b FROM v_pair) WHERE a OR b""",
)
def missing_sides(v: Views):
    """K3."""
    return checks.missing_sides(v.pair(), "unit", "value1", "value2")


@query(
    "too_many_children",
    "regen",
    "SELECT event, role, count(DISTINCT corner) AS children FROM v_regen GROUP BY ALL HAVING count(DISTINCT corner) > 6",
)
def too_many_children(v: Views):
    """K4 with a limit of six corners (the tables have at most seven)."""
    return checks.too_many_children(v.regen(), ["event", "role"], "corner", 6)


@query(
    "illegal_codes",
    "regen",
    "SELECT event, role, target, corner FROM v_regen WHERE corner NOT IN ('C1', 'C2', 'C3', 'C4', 'C5', 'C6')",
)
def illegal_codes(v: Views):
    """K5."""
    return checks.illegal_codes(v.regen(), ["event", "role", "target"], "corner", [f"C{i}" for i in range(1, 7)])


@query(
    "zero_zero_share",
    "cnt",
    """
, w AS (SELECT unit, module, coalesce(max(n) FILTER (role = 'N'), 0) AS n, coalesce(max(n) FILTER (role = 'Q'), 0) AS q
      FROM v_cnt GROUP BY ALL)
SELECT round_even(100 * avg(CASE WHEN n = 0 AND q = 0 THEN 1 ELSE 0 END), 0) AS zero_zero_percent,
       max(greatest(n, q))::DOUBLE AS max_count
FROM w""",
)
def zero_zero_share(v: Views):
    """K6."""
    wide = reshape.pair_by_role(v.count(), ["unit", "module"], "role", ["n"], {"N": "n", "Q": "q"}).fillna(0)
    return diffs.zero_zero_share(wide, "n_n", "q_n")


@query(
    "orphans",
    "surveys burns",
    "SELECT DISTINCT unit, event_date AS survey_date FROM v_burns WHERE (unit, event_date) NOT IN (SELECT (unit, survey_date) FROM v_surveys)",
)
def orphans(v: Views):
    """K7. Event dates on which the unit was not surveyed."""
    side = v.burns().withColumnRenamed("event_date", "survey_date")
    return checks.orphans(side, v.surveys(), ["unit", "survey_date"])


@query(
    "main_without_year",
    "pair",
    "SELECT unit FROM v_pair WHERE fit2 IS NULL",
)
def main_without_year(v: Views):
    """K7. Main rows without a value."""
    return checks.without_value(v.pair(), ["unit"], "fit2")


@query(
    "incomplete_parents",
    "regen",
    """
, want(corner) AS (VALUES ('C1'), ('C2'), ('C3'), ('C4'), ('C5'), ('C6'), ('C7')),
seen AS (SELECT DISTINCT event, role, target, corner FROM v_regen)
SELECT event, role, target, 7 - count(*) AS seen, string_agg(corner, ',' ORDER BY corner) AS missing
FROM (SELECT DISTINCT event, role, target FROM seen) p CROSS JOIN want
WHERE (event, role, target, corner) NOT IN (SELECT (event, role, target, corner) FROM seen) GROUP BY ALL""",
)
def incomplete_parents(v: Views):
    """K8."""
    return checks.incomplete_parents(v.regen(), ["event", "role", "target"], "corner", [f"C{i}" for i in range(1, 8)])
