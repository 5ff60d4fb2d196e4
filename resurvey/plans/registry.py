"""Named queries over the given tables, each with its check in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resurvey.plans.view_sql import with_views
from resurvey.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of ``Views``; ``sql`` is its check, with the named views in front."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return fn

    return wrap


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round double columns half-even for comparison (sums differ in the last bits by order)."""
    return df.withColumns({c: F.bround(c, digits) for c in cols})


def _factor(expr, digits: int, unit: int):
    """``expr`` in units of the last digit: by one multiplication or one division, alike in Spark and SQL."""
    up, down = 10.0 ** max(0, digits - len(str(unit)) + 1), 10.0 ** max(0, len(str(unit)) - 1 - digits)
    return f"({expr}) * {up}::DOUBLE / {down}::DOUBLE" if isinstance(expr, str) else expr * F.lit(up) / F.lit(down)


def settled(df: DataFrame, *cols: str, digits: int = 3, unit: int = 1) -> DataFrame:
    """Round to ``digits``, halves up, values given in parts of ``unit`` (1, 10, 100, ...).

    Means of amounts in cents often end exactly on a rounding border.  Summed as whole cents and
    divided once they are the same number everywhere, and so is what this makes of them.
    """
    return df.withColumns({c: F.floor(_factor(F.col(c), digits, unit) + 0.5) / F.lit(10.0**digits) for c in cols})


def settled_sql(expr: str, digits: int = 3, unit: int = 1) -> str:
    """The same rounding in SQL."""
    return f"floor({_factor(expr, digits, unit)} + 0.5::DOUBLE) / {10.0**digits}::DOUBLE"


def cents(c: str) -> Column:
    """An amount as whole cents."""
    return F.round(F.col(c) * 100).cast("long")


def text_date(c: str) -> Column:
    """Date as month/day/year text, without leading zeros."""
    d = F.to_date(c)
    return F.concat_ws("/", F.month(d).cast("string"), F.day(d).cast("string"), F.year(d).cast("string"))
