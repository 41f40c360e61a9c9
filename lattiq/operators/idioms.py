"""Idioms of calculated fields that have a plan of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scalar import double


def argmax_members(df: DataFrame, by: Sequence[str], member: str, measure: Column, least: bool = False) -> DataFrame:
    """The members whose aggregate is the largest (or least) within each combination of ``by``; ties all stay.

    Two group-bys and a join: no window over all members of a key.
    """
    per = df.groupBy(*by, member).agg(measure.alias("value"))
    best = per.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg((F.min if least else F.max)("value").alias("_best"))
    on = per["value"] == best["_best"]
    for c in by:
        on = on & per[c].eqNullSafe(best[f"_{c}"])
    return per.join(best, on).select(*by, member, "value")


def value_at_extreme_date(df: DataFrame, by: Sequence[str], day: str, value: str, first: bool = False) -> DataFrame:
    """The average value on the latest (or first) date of each combination of ``by``: by, day, value."""
    ends = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg((F.min if first else F.max)(day).alias("_day"))
    on = df[day] == ends["_day"]
    for c in by:
        on = on & df[c].eqNullSafe(ends[f"_{c}"])
    return df.join(ends, on).groupBy(*[df[c] for c in by], df[day]).agg(F.avg(value).alias(value))


def year_gated(day: Column, value: Column, year: int) -> Column:
    """SUM(IF YEAR(day) = year THEN value END), as an aggregate column."""
    return F.sum(F.when(F.year(day) == year, value))


def compound_growth(first: Column, last: Column, periods: Column) -> Column:
    """(last / first) to the power 1 / periods, less 1."""
    return F.pow(F.try_divide(double(last), double(first)), F.try_divide(F.lit(1.0), double(periods))) - 1
