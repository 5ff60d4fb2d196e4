"""Prior-event history of units (as-of joins on dates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_prior(
    surveys: DataFrame, events: DataFrame, unit: str, survey_date: str, event_date: str, role: str | None = None
) -> DataFrame:
    """D5. Latest event strictly before the survey date, per survey row.

    Both sides are first reduced to one row per (unit, day), so a busy unit costs one row per
    day, never one per record; the running maximum then runs over days only.  Adds
    ``prior_event`` (date or NULL) and ``has_prior``; both are NULL for re-surveys when
    ``role`` is given.
    """
    days = (
        surveys.select(unit, F.col(survey_date).alias("_day"), F.lit(None).cast("date").alias("_event"))
        .unionByName(events.select(unit, F.col(event_date).alias("_day"), F.col(event_date).alias("_event")))
        .where(F.col("_day").isNotNull())
        .groupBy(unit, "_day")
        .agg(F.max("_event").alias("_event"))
    )
    earlier = Window.partitionBy(unit).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    history = days.select(unit, F.col("_day").alias(survey_date), F.max("_event").over(earlier).alias("prior_event"))
    out = surveys.join(history, [unit, survey_date], "left").withColumn("has_prior", F.col("prior_event").isNotNull())
    if role is not None:
        first = F.col(role) == "N"
        out = out.withColumn("prior_event", F.when(first, F.col("prior_event")))
        out = out.withColumn("has_prior", F.when(first, F.col("has_prior")))
    return out


def event_since_previous(
    df: DataFrame, unit: str, cycle: str, survey_date: str, event: str, role: str, days: int
) -> DataFrame:
    """D6. Was there an event since the unit's survey one cycle earlier?

    First cycle: TRUE when any prior event exists.  Later: the event is after the survey of
    cycle - 1, or, if that cycle was not surveyed, after ``survey_date - days``.  A gap of two
    cycles is not bridged, hence a keyed join and not ``lag``.  With several surveys in the
    previous cycle the latest date counts.  Missing answers are FALSE.
    """
    previous = (
        df.where((F.col(role) == "N") & F.col(survey_date).isNotNull())
        .groupBy(unit, (F.col(cycle) + 1).alias(cycle))
        .agg(F.max(survey_date).alias("_previous"))
    )
    since = F.coalesce(F.col("_previous"), F.date_sub(F.col(survey_date), days))
    answer = F.when(F.col(cycle) == 1, F.col(event).isNotNull()).otherwise(F.col(event) > since)
    return (
        df.join(previous, [unit, cycle], "left")
        .withColumn("event_since", F.coalesce(F.when(F.col(role) == "N", answer), F.lit(False)))
        .drop("_previous")
    )


def years_since_event(df: DataFrame, survey_date: str, event: str, role: str) -> DataFrame:
    """F18. Years (days / 365) from the latest prior event to the survey, first surveys only."""
    return (
        df.where((F.col(role) == "N") & F.col(event).isNotNull() & F.col(survey_date).isNotNull())
        .withColumn("years_since", F.datediff(survey_date, event) / 365)
    )
