"""Role pivot, cells to rows, code flags, zero-filled grids, category counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resurvey.functions.order import join_groups


def pair_by_role(
    df: DataFrame, unit: Sequence[str], role: str, values: Sequence[str], role_map: Mapping[str, str]
) -> DataFrame:
    """C1. One row per unit with an ``n_`` and a ``q_`` column per value.

    ``role_map`` names the codes of the two roles, e.g. ``{"N": "n", "Q": "q"}``; it has no
    default because some sources use the codes the other way round.  Two rows for one unit
    and role are an error.
    """
    aggs = []
    for code, prefix in role_map.items():
        here = F.col(role) == code
        twice = F.count(F.when(here, 1)) > 1
        for v in values:
            one = F.max(F.when(here, F.col(v)))
            stop = F.raise_error(F.lit(f"pair_by_role: more than one {code} row for a unit"))
            aggs.append(F.when(twice, stop.cast(df.schema[v].dataType)).otherwise(one).alias(f"{prefix}_{v}"))
    return df.groupBy(*unit).agg(*aggs)


def melt_cells(df: DataFrame, ids: Sequence[str], cells: Sequence[str], name: str = "cell", value: str = "value") -> DataFrame:
    """C2. Wide cells to long."""
    return df.unpivot(list(ids), list(cells), name, value)


# Codes that a list may hold; every unit gets a row for each of them.
MOST_CODES = 10_000


def code_list(codes: DataFrame, code: str, levels: Sequence[str] = ()) -> Column:
    """The codes of a grid as an array: the listed ones, then any others that occur, in order.

    A one-row aggregate finds them; more than ``MOST_CODES`` distinct codes are an error.
    """
    found = codes.agg(F.array_sort(F.collect_set(code)).alias("found"))
    stop = F.raise_error(F.lit(f"more than {MOST_CODES} codes")).cast("array<string>")
    found = found.select(F.when(F.size("found") > MOST_CODES, stop).otherwise(F.col("found")).alias("found")).scalar()
    return F.array_union(F.array(*[F.lit(x) for x in levels]), found) if levels else found


def codes_to_flags(
    units: DataFrame, codes: DataFrame, unit: Sequence[str], code: str, levels: Sequence[str] = ()
) -> DataFrame:
    """C3. Long table with one row per unit and code and ``present``; units without codes
    keep a FALSE row for every code.

    The codes are those that occur and those in ``levels``; ``checks.illegal_codes`` reports codes
    beyond a list.
    """
    unit = list(unit)
    seen = codes.where(F.col(code).isNotNull()).select(*unit, code).distinct().withColumn("_hit", F.lit(True))
    grid = units.select(*unit).distinct().withColumn(code, F.explode(code_list(codes, code, levels)))
    return grid.join(seen, unit + [code], "left").select(*unit, code, F.col("_hit").isNotNull().alias("present"))


# Aggregates of a grid completed inside the grouping; more would leave whole-stage codegen.
MAX_WIDE_AGGREGATES = 24


def complete_grid(
    df: DataFrame, unit: Sequence[str], levels: Mapping[str, Sequence], measures: Sequence[str], fill=0
) -> DataFrame:
    """C4. Every unit seen in ``df`` with every combination of fixed level lists, measures filled.

    ``df`` has one row per unit and combination; two are an error.  Rows at a level that is not
    listed are not part of the grid (``illegal_codes`` finds them).  The levels are parameters,
    so there is no cross join: a small grid is completed in the aggregate that groups the units,
    a large one by a left join from exploded literals.
    """
    unit = list(unit)
    kinds = {name: df.schema[name].dataType for name in levels}
    cells = list(product(*levels.values()))
    if len(cells) * (len(measures) + 1) > MAX_WIDE_AGGREGATES:
        return _joined_grid(df, unit, levels, measures, fill)
    aggs, structs = [], []
    hits = F.lit(0)
    known = F.lit(False)
    for k, cell in enumerate(cells):
        here = F.lit(True)
        for name, value in zip(levels, cell, strict=True):
            here = here & (F.col(name) == F.lit(value).cast(kinds[name]))
        known = known | here
        hits = hits + F.coalesce(F.max(F.when(here, 1)), F.lit(0))
        aggs += [F.max(F.when(here, F.col(m))).alias(f"_{m}_{k}") for m in measures]
        names = [F.lit(value).cast(kinds[name]).alias(name) for name, value in zip(levels, cell, strict=True)]
        structs.append(F.struct(*names, *[F.col(f"_{m}_{k}").alias(m) for m in measures]))
    stop = F.raise_error(F.lit("complete_grid: more than one row for a unit and level")).cast("boolean")
    single = F.when(F.count(F.when(known, 1)) > hits, stop).otherwise(True)
    return (
        df.groupBy(*unit)
        .agg(single.alias("_single"), *aggs)
        .where("_single")
        .select(*unit, F.explode(F.array(*structs)).alias("_c"))
        .select(*unit, "_c.*")
        .fillna(fill, subset=list(measures))
    )


def _joined_grid(df: DataFrame, unit: list[str], levels: Mapping[str, Sequence], measures: Sequence[str], fill) -> DataFrame:
    grid = df.select(*unit).distinct()
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v).cast(df.schema[name].dataType) for v in values])))
    keys = unit + list(levels)
    listed = F.lit(True)
    for name, values in levels.items():
        listed = listed & F.col(name).isin(list(values))
    stop = F.raise_error(F.lit("complete_grid: more than one row for a unit and level")).cast("boolean")
    single = F.when(F.count(F.lit(1)) > 1, stop).otherwise(True)
    rows = df.where(listed).groupBy(*keys).agg(single.alias("_single"), *[F.max(m).alias(m) for m in measures])
    rows = rows.where("_single").drop("_single")
    # both sides grow with the data, whatever their compressed files let Spark expect
    return join_groups(grid, rows.hint("merge"), keys, "left").fillna(fill, subset=list(measures))


def wide_counts(df: DataFrame, key: Sequence[str], cat: str, levels: Mapping[str, str], value: str | None = None) -> DataFrame:
    """C5. Rows (or ``value``) counted per key in one column per listed category, 0 when absent.

    ``levels`` maps a category to its column name.  Conditional aggregates, so no job has to
    find the categories first.
    """
    aggs = []
    for level, name in levels.items():
        here = F.col(cat).eqNullSafe(F.lit(level))
        agg = F.count(F.when(here, 1)) if value is None else F.coalesce(F.sum(F.when(here, F.col(value))), F.lit(0))
        aggs.append(agg.alias(name))
    return df.groupBy(*key).agg(*aggs)
