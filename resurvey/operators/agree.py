"""Agreement between two surveys on categories and on sets of binary codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resurvey.operators.reshape import code_list

MISSING = "XXX"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def _levels(levels: Sequence, missing: bool = True) -> list[str]:
    return [str(x) for x in levels] + ([MISSING] if missing else [])


def _checked(c: Column, levels: Sequence[str], what: str) -> Column:
    """The value itself, or an error when it is not on the level list."""
    stop = F.raise_error(F.concat(F.lit(f"{what}: value not in levels: "), c))
    return F.when(c.isin(list(levels)), c).otherwise(stop.cast("string"))


def pair_cells(df: DataFrame, c1: str, c2: str, levels: Sequence, missing: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the (rating 1, rating 2) cells that occur: at most (levels + 1)^2 rows per ``by``.

    Everything about agreement is computed from these cells, never from the pairs again.
    """
    names = _levels(levels, missing)
    return (
        df.select(
            *by,
            _checked(_text(c1), names, "pair_cells").alias("rating1"),
            _checked(_text(c2), names, "pair_cells").alias("rating2"),
        )
        .groupBy(*by, "rating1", "rating2")
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


def contingency(df: DataFrame, c1: str, c2: str, levels: Sequence) -> DataFrame:
    """E9. Full table of both ratings with missing as a level, zero cells kept, and proportions."""
    cells = pair_cells(df, c1, c2, levels)
    names = F.array(*[F.lit(x) for x in _levels(levels)])
    grid = df.sparkSession.range(1).select(F.explode(names).alias("rating1")).withColumn("rating2", F.explode(names))
    total = cells.agg(F.sum("pairs").alias("t")).scalar()
    return (
        grid.join(cells, ["rating1", "rating2"], "left")
        .fillna(0, subset=["pairs"])
        .withColumn("proportion", F.try_divide(F.col("pairs"), total))
    )


def interrater_matrix(df: DataFrame, c1: str, c2: str, levels: Sequence) -> DataFrame:
    """E10. Unordered pairs in one triangle, level order as given (missing last), zeros kept.

    ``high`` is the later level of the pair, ``low`` the earlier one.
    """
    names = _levels(levels)
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    table = F.array(*[F.lit(n) for n in names])
    cells = (
        pair_cells(df, c1, c2, levels)
        .select(order[F.col("rating1")].alias("a"), order[F.col("rating2")].alias("b"), "pairs")
        .groupBy(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .agg(F.sum("pairs").alias("pairs"))
    )
    numbers = F.sequence(F.lit(0), F.lit(len(names) - 1))
    grid = df.sparkSession.range(1).select(F.explode(numbers).alias("hi"))
    grid = grid.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("hi"))))
    return (
        grid.join(cells, ["hi", "lo"], "left")
        .fillna(0, subset=["pairs"])
        .select(table[F.col("hi")].alias("high"), table[F.col("lo")].alias("low"), "pairs")
    )


def specific_agreement(
    df: DataFrame, c1: str, c2: str, levels: Sequence, missing: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """E11. Proportion of specific agreement of every category in one pass.

    num = 2 * agreed pairs, denom = uses of the category by either survey,
    psa = round(100 * num / denom), NULL when the category was never used.
    """
    by = list(by)
    cells = pair_cells(df, c1, c2, levels, missing, by)
    same = F.col("rating1") == F.col("rating2")
    uses = F.array(
        F.struct(F.col("rating1").alias("category"), F.when(same, F.col("pairs")).otherwise(0).alias("num")),
        F.struct(F.col("rating2").alias("category"), F.when(same, F.col("pairs")).otherwise(0).alias("num")),
    )
    got = (
        cells.select(*by, "pairs", F.explode(uses).alias("_u"))
        .groupBy(*by, F.col("_u.category").alias("category"))
        .agg(F.sum("_u.num").alias("num"), F.sum("pairs").alias("denom"))
    )
    names = F.array(*[F.lit(x) for x in _levels(levels, missing)])
    base = cells.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return (
        base.withColumn("category", F.explode(names))
        .join(got, by + ["category"], "left")
        .fillna(0, subset=["num", "denom"])
        .withColumn("psa", F.bround(F.try_divide(100 * F.col("num"), F.col("denom"))))
    )


def overall_agreement(df: DataFrame, c1: str, c2: str, by: Sequence[str] = ()) -> DataFrame:
    """E12. Counts of match and mismatch and the share of matches; a NULL side is a mismatch."""
    match = F.coalesce(F.col(c1) == F.col(c2), F.lit(False))
    return df.select(*by, match.alias("_m")).groupBy(*by).agg(
        F.count(F.when(F.col("_m"), 1)).alias("matches"),
        F.count(F.when(~F.col("_m"), 1)).alias("mismatches"),
        F.avg(F.col("_m").cast("int")).alias("share"),
    )


def binary_type(v1: Column, v2: Column) -> Column:
    """``11``, ``00`` or ``10/01``; any missing value makes it ``10/01``."""
    return F.when(v1 & v2, "11").when(~v1 & ~v2, "00").otherwise("10/01")


def binary_match_types(df: DataFrame, code: str, v1: str, v2: str) -> DataFrame:
    """E13. Match types counted per code, wide: n11, n00, n10."""
    kind = binary_type(F.col(v1), F.col(v2))
    return df.withColumn("_k", kind).groupBy(code).agg(
        F.count(F.when(F.col("_k") == "11", 1)).alias("n11"),
        F.count(F.when(F.col("_k") == "00", 1)).alias("n00"),
        F.count(F.when(F.col("_k") == "10/01", 1)).alias("n10"),
    )


def match_types_optional(df: DataFrame, code: str, v1: str, v2: str) -> DataFrame:
    """E14. Match types for optional values, both missing being its own type."""
    a, b = F.col(v1), F.col(v2)
    kind = F.when(a.isNull() & b.isNull(), "NA/NA").when(a == b, "MATCH").otherwise("MISMATCH")
    return df.withColumn("_k", kind).groupBy(code).agg(
        F.count(F.when(F.col("_k") == "NA/NA", 1)).alias("both_missing"),
        F.count(F.when(F.col("_k") == "MATCH", 1)).alias("matched"),
        F.count(F.when(F.col("_k") == "MISMATCH", 1)).alias("mismatched"),
    )


def code_agreement(df: DataFrame, code: str, v1: str, v2: str) -> DataFrame:
    """E15. Per code: match types and the specific agreement on TRUE, one aggregate in all.

    A code never reported by either survey has psa 0.
    """
    counted = df.groupBy(code).agg(
        F.count(F.when(F.col(v1) & F.col(v2), 1)).alias("n11"),
        F.count(F.when(~F.col(v1) & ~F.col(v2), 1)).alias("n00"),
        F.count(F.lit(1)).alias("_all"),
        (F.count(F.when(F.col(v1), 1)) + F.count(F.when(F.col(v2), 1))).alias("denom"),
        (F.count(F.when(F.col(v1).isNull(), 1)) + F.count(F.when(F.col(v2).isNull(), 1))).alias("missing_uses"),
    )
    psa = F.bround(F.try_divide(200 * F.col("n11"), F.col("denom")))
    return counted.select(
        code,
        "n11",
        "n00",
        (F.col("_all") - F.col("n11") - F.col("n00")).alias("n10"),
        "denom",
        "missing_uses",
        F.coalesce(psa, F.lit(0.0)).alias("psa"),
    )


def fit_class(fit1: Column, fit2: Column, best: int = 1) -> Column:
    """Confidence class of two calls: ``11``, ``++`` or ``1+/+1``; missing counts as not best."""
    a = F.coalesce(fit1 == best, F.lit(False))
    b = F.coalesce(fit2 == best, F.lit(False))
    return F.when(a & b, "11").when(~a & ~b, "++").otherwise("1+/+1")


def fit_crosstab(df: DataFrame, c1: str, c2: str, fit1: str, fit2: str) -> DataFrame:
    """E16. Match and mismatch counts of every confidence class."""
    match = F.coalesce(F.col(c1) == F.col(c2), F.lit(False))
    return (
        df.select(fit_class(F.col(fit1), F.col(fit2)).alias("fit_class"), match.alias("_m"))
        .groupBy("fit_class")
        .agg(F.count(F.when(F.col("_m"), 1)).alias("matches"), F.count(F.when(~F.col("_m"), 1)).alias("mismatches"))
    )


def rater_rates(df: DataFrame, code: str, rater1: str, v1: str, rater2: str, v2: str) -> DataFrame:
    """E17. Per rater and code: TRUE calls, pairs where either survey said TRUE, truncated percent,
    and the number of rated units.  A NULL rater is left out."""
    either = F.coalesce(F.col(v1), F.lit(False)) | F.coalesce(F.col(v2), F.lit(False))
    sides = F.array(
        F.struct(F.col(rater1).alias("rater"), F.coalesce(F.col(v1), F.lit(False)).alias("said")),
        F.struct(F.col(rater2).alias("rater"), F.coalesce(F.col(v2), F.lit(False)).alias("said")),
    )
    return (
        df.select(code, either.alias("_either"), F.explode(sides).alias("_s"))
        .where(F.col("_s.rater").isNotNull())
        .groupBy(F.col("_s.rater").alias("rater"), code)
        .agg(
            F.count(F.when(F.col("_s.said"), 1)).alias("said_true"),
            F.count(F.when(F.col("_either"), 1)).alias("either_true"),
            F.count(F.lit(1)).alias("rated_units"),
        )
        .withColumn("percent_true", F.floor(F.try_divide(100.0 * F.col("said_true"), F.col("either_true"))).cast("long"))
    )


def flag_pairs(n: DataFrame, q: DataFrame, link: str, q_id: str, code_cols: Sequence[str], rater: str, levels: Sequence[str] = ()) -> DataFrame:
    """Linked pairs x codes with the two presence flags and raters (input of E13, E15, E17).

    The codes are all that occur in either survey, in upper case, and those in ``levels``.  Each
    pair carries its few codes as an array, so one join serves all codes.  First surveys without
    a partner stay, with FALSE for the partner.
    """

    def codes(df: DataFrame, key: str, tag: str) -> DataFrame:
        listed = F.transform(F.array_compact(F.array(*[F.col(c) for c in code_cols])), F.upper)
        return df.select(F.col(key).alias("link"), listed.alias(f"_codes{tag}"), F.col(rater).alias(f"rater{tag}"))

    first, again = codes(n, link, "1"), codes(q, q_id, "2")
    found = first.select(F.explode("_codes1").alias("code")).unionByName(again.select(F.explode("_codes2").alias("code")))
    has = lambda tag: F.coalesce(F.array_contains(F.col(f"_codes{tag}"), F.col("code")), F.lit(False))
    return (
        first.join(again, "link", "left")
        .withColumn("code", F.explode(code_list(found, "code", levels)))
        .select("link", "code", "rater1", has("1").alias("v1"), "rater2", has("2").alias("v2"))
    )
