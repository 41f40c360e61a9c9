"""Derived columns and model objects: groups, bins, parameters, calendars, row filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.functions.scalar import sunday_week

#: Members of a group beyond which a join takes the place of a chain of comparisons.
GROUP_CHAIN = 200
#: Values of a parameter's series at most.
SERIES_ROWS = 10_000


def group_column(x: Column, groups: Mapping[str, Sequence], other: str | None = None, keep_unlisted: bool = True) -> Column:
    """The label of the first group that lists the value; unlisted values stay, or become ``other``."""
    out = None
    for label, members in groups.items():
        out = (F if out is None else out).when(x.isin(list(members)), F.lit(label))
    rest = x.cast("string") if keep_unlisted and other is None else F.lit(other)
    return rest if out is None else out.otherwise(rest)


def with_group(df: DataFrame, column: str, groups: Mapping[str, Sequence], name: str, other: str | None = None, keep_unlisted: bool = True) -> DataFrame:
    """``df`` with a group column; large groups are joined, the mapping being of a size known here."""
    members = sum(map(len, groups.values()))
    if members <= GROUP_CHAIN:
        return df.withColumn(name, group_column(F.col(column), groups, other, keep_unlisted))
    first: dict = {}
    for label, values in groups.items():
        for v in values:
            first.setdefault(v, label)
    mapping = df.sparkSession.createDataFrame(list(first.items()), ["_member", "_label"])
    mapping = F.broadcast(mapping) if members <= 100_000 else mapping
    rest = F.col(column).cast("string") if keep_unlisted and other is None else F.lit(other)
    return df.join(mapping, df[column] == F.col("_member"), "left").withColumn(name, F.coalesce("_label", rest)).drop("_member", "_label")


def bin_column(x: Column, size: float, peg: float = 0.0) -> Column:
    """Lower edge of the bin of a number."""
    if size <= 0:
        raise UnsupportedCalc("a bin's size must be positive", "type")
    return F.floor((x - peg) / size) * size + peg


def hierarchy(df: DataFrame, levels: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Measures at each drill level: grouped by the first 0, 1, ... levels, with ``level``."""
    depth = F.lit(len(levels)) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return df.rollup(*levels).agg(depth.alias("level"), *[m.alias(n) for n, m in measures.items()])


# -- calendars -----------------------------------------------------------------


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row a day over the full years from ``first`` to ``last``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(date(first.year, 1, 1)), F.lit(date(last.year, 12, 31)))).alias("Date"))
    d = F.col("Date")
    month_start = F.trunc(d, "month")
    return days.select(
        d,
        F.year(d).cast("bigint").alias("Year"),
        F.quarter(d).cast("bigint").alias("Quarter"),
        F.month(d).cast("bigint").alias("Month"),
        F.date_format(d, "MMMM").alias("Month Name"),
        sunday_week(d).cast("bigint").alias("Week of Year"),
        F.floor((F.day(d) + F.dayofweek(month_start) - 2) / 7 + 1).cast("bigint").alias("Week of Month"),
        F.day(d).cast("bigint").alias("Day"),
        F.dayofweek(d).cast("bigint").alias("Weekday"),
        F.date_format(d, "EEEE").alias("Day Name"),
        F.extract(F.lit("YEAROFWEEK"), d).cast("bigint").alias("ISO Year"),
    )


def calendar_of(df: DataFrame, *columns: str) -> DataFrame:
    """The calendar that covers these date columns; two dates go to the driver, no rows."""
    ends = df.agg(F.least(*_twice(columns, F.min)).cast("date"), F.greatest(*_twice(columns, F.max)).cast("date")).first()
    if ends[0] is None:
        return calendar(df.sparkSession, date(1970, 1, 1), date(1970, 12, 31)).limit(0)
    return calendar(df.sparkSession, *ends)


def _twice(columns: Sequence[str], f: Callable) -> list[Column]:
    found = [f(c) for c in columns]
    return found * 2 if len(found) == 1 else found


def primary_date(columns: Mapping[str, str], chosen: str | None = None) -> str | None:
    """The one date column a calendar joins by; with several and no choice, none is active."""
    dates = [c for c, kind in columns.items() if kind in ("date", "datetime")]
    if chosen is not None:
        return chosen if chosen in dates else None
    return dates[0] if len(dates) == 1 else None


def join_calendar(df: DataFrame, column: str, days: DataFrame) -> DataFrame:
    """Facts with their day's attributes, by exact date; Spark broadcasts the days if they are few."""
    return df.join(days, F.to_date(df[column]) == days["Date"], "left")


# -- parameters ---------------------------------------------------------------


def parameter_range(low: float | None, high: float | None, step: float | None, default: float | None) -> tuple[float, float, float, float]:
    """Ends, step and default of a numeric parameter.

    An open upper end is four times the default or twenty steps, whichever is
    more, on the grid; a series beyond SERIES_ROWS is cut at its end, never
    coarsened.
    """
    low = 0.0 if low is None else float(low)
    step = float(step) if step and step > 0 else 1.0
    default = low if default is None else float(default)
    if high is None:
        steps = max(1, round((max(default * 4, low + step * 20) - low) / step))
        high = low + step * steps
        if high < default:
            high = low + step * (int((default - low) / step) + 1)
    if int((float(high) - low) / step) + 1 > SERIES_ROWS:
        high = low + step * (SERIES_ROWS - 1)
    return low, float(high), step, default


def parameter_series(spark: SparkSession, low: float | None, high: float | None, step: float | None = None, default: float | None = None) -> DataFrame:
    """The values of a numeric parameter (column value), with a default that is off the grid."""
    low, high, step, default = parameter_range(low, high, step, default)
    count = int((high - low) / step + 1e-9) + 1
    values = spark.range(count).select((F.lit(low) + F.col("id") * F.lit(step)).alias("value"))
    k = round((default - low) / step)
    if not low - 1e-9 <= default <= high + 1e-9 or abs(low + k * step - default) > 1e-9:
        values = values.union(spark.range(1).select(F.lit(default).alias("value")))
    return values


def parameter_members(spark: SparkSession, members: Sequence, aliases: Mapping | None = None) -> DataFrame:
    """The values of a list parameter (value, label)."""
    kind = {bool: "boolean", int: "bigint", float: "double", date: "date"}.get(type(members[0]), "string") if members else "string"
    return spark.createDataFrame([(m, str((aliases or {}).get(m, m))) for m in members], f"value {kind}, label string")


def field_swap(choice: object, fields: Mapping, default: str | None = None) -> str:
    """The field that a parameter chooses; worked out on the driver, so only that field is read."""
    if choice in fields:
        return fields[choice]
    if default is None:
        raise UnsupportedCalc(f"no field for {choice!r}", "parameter")
    return default


def view_swap(choice: object, views: Mapping, default: object = None):
    """The view that a parameter's value shows: of views stacked in one place, the others are not computed."""
    if choice in views:
        return views[choice]
    if default is None:
        raise UnsupportedCalc(f"no view for {choice!r}", "parameter")
    return default


def date_band_filter(df: DataFrame, column: str, bands: Sequence[int], selected: int | None = None) -> DataFrame:
    """Rows in the chosen band of days before the latest date of the table.

    Ascending bands v0 < v1 < ... : the first keeps the last v0 days, those
    between keep days from v(k-1) back to v(k), the last keeps all.
    """
    bands = list(bands)
    if len(bands) < 2 or any(a >= b for a, b in zip(bands, bands[1:])):
        raise UnsupportedCalc("bands must ascend, two at least", "parameter")
    selected = bands[0] if selected is None else selected
    if selected not in bands:
        return df.filter(F.lit(False))
    k = bands.index(selected)
    if k == len(bands) - 1:
        return df
    latest = df.agg(F.to_date(F.max(column)).alias("_latest"))
    joined = df.crossJoin(F.broadcast(latest))  # one row
    day = F.to_date(df[column])
    keep = day > F.date_sub("_latest", selected)
    if k:
        keep = keep & (day <= F.date_sub("_latest", bands[k - 1]))
    return joined.filter(keep).drop("_latest")


def row_filter(df: DataFrame, formula: str, user: str, captions: Mapping[str, str] | None = None) -> DataFrame:
    """Row-level security: ``[Field] = USERNAME()`` in either order; anything else lets no row through.

    The user is an argument, so that results can be reproduced.
    """
    from lattiq.plans.nodes import Binary, Call, Field
    from lattiq.plans.parser import parse

    try:
        tree = parse(formula)
    except UnsupportedCalc:
        return df.filter(F.lit(False))
    if isinstance(tree, Binary) and tree.op == "=":
        for f, u in ((tree.a, tree.b), (tree.b, tree.a)):
            column = (captions or {}).get(f.name, f.name) if isinstance(f, Field) else None
            if column in df.columns and u == Call("USERNAME", ()):
                return df.filter(F.col(f"`{column}`") == F.lit(user))
    return df.filter(F.lit(False))
