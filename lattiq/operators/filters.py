"""Filters of view queries as columns.

Dimension filters keep their column bare on one side wherever they can, so
that they reach the scan as pushed filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.plans.nodes import DATE, DATETIME, TEXT

KINDS = ("SET", "MATCH", "QUANTITATIVE_NUMERICAL", "QUANTITATIVE_DATE", "DATE", "TOP", "CONDITION")


@dataclass(frozen=True)
class Filter:
    """A filter of a view query, as its JSON form has it.

    ``field``: caption, with ``function`` for an aggregate, or ``formula``.
    ``context`` filters come before FIXED expressions.
    """

    kind: str
    field: str | None = None
    formula: str | None = None
    function: str | None = None
    context: bool = False
    exclude: bool = False
    values: tuple = ()
    contains: str | None = None
    starts_with: str | None = None
    ends_with: str | None = None
    quantitative: str = "RANGE"
    low: object = None
    high: object = None
    include_nulls: bool = False
    period: str | None = None
    relative: str | None = None
    range_n: int | None = None
    anchor: date | None = None
    how_many: int | None = None
    direction: str = "TOP"
    by: tuple[str | None, str | None] = (None, None)
    by_formula: str | None = None

    @classmethod
    def from_json(cls, x: dict) -> Filter:
        kind = x.get("filterType", "").upper()
        if kind not in KINDS:
            raise UnsupportedCalc(f"no filter {kind or 'without a type'}", "filter")
        f = x.get("field", {})
        by = x.get("fieldToMeasure", {})
        as_date = lambda v: v if v is None or isinstance(v, date) else datetime.fromisoformat(v.replace("Z", "")) if len(v) > 10 else date.fromisoformat(v)
        dated = kind == "QUANTITATIVE_DATE"
        low, high = (x.get("minDate"), x.get("maxDate")) if dated else (x.get("min"), x.get("max"))
        return cls(
            kind, f.get("fieldCaption"), f.get("calculation"), f.get("function"), bool(x.get("context")), bool(x.get("exclude")), tuple(x.get("values", ())),
            x.get("contains"), x.get("startsWith"), x.get("endsWith"), x.get("quantitativeFilterType", "RANGE").upper(), as_date(low) if dated else low, as_date(high) if dated else high, bool(x.get("includeNulls")),
            (x.get("periodType") or "").upper() or None, (x.get("dateRangeType") or "").upper() or None, x.get("rangeN"), as_date(x.get("anchorDate")), x.get("howMany"), x.get("direction", "TOP").upper(),
            (by.get("fieldCaption"), by.get("function")), by.get("calculation"),
        )


def set_filter(x: Column, values: tuple, exclude: bool) -> Column:
    """Null may be among the values; an exclusion keeps rows that are null unless it names null."""
    there = [v for v in values if v is not None]
    found = x.isin(there) if there else F.lit(False)
    if None in values:
        found = found | x.isNull()
        return ~found & x.isNotNull() if exclude else found
    return F.coalesce(~found, F.lit(True)) if exclude else found


def match_filter(x: Column, f: Filter, dtype: str) -> Column:
    """Case-sensitive; several patterns must all match, and an exclusion turns the whole round."""
    if dtype != TEXT:
        raise UnsupportedCalc(f"MATCH on {dtype}", "filter")
    tests = [g(x, F.lit(v)) for g, v in ((F.contains, f.contains), (F.startswith, f.starts_with), (F.endswith, f.ends_with)) if v is not None]
    if not tests:
        raise UnsupportedCalc("MATCH without a pattern", "filter")
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(~out, F.lit(True)) if f.exclude else out


def range_filter(x: Column, f: Filter) -> Column:
    """Bounds are inclusive; on timestamps an upper date means its midnight."""
    kind = f.quantitative
    if kind in ("ONLY_NULL", "ONLY_NON_NULL"):
        return x.isNull() if kind == "ONLY_NULL" else x.isNotNull()
    need = {"RANGE": (f.low, f.high), "MIN": (f.low,), "MAX": (f.high,)}.get(kind)
    if need is None or None in need:
        raise UnsupportedCalc(f"{kind} without its bounds", "filter")
    low = x >= F.lit(f.low) if kind != "MAX" else None
    high = x <= F.lit(f.high) if kind != "MIN" else None
    out = low & high if low is not None and high is not None else low if high is None else high
    return out | x.isNull() if f.include_nulls else out


def _add_months(d: date, n: int) -> date:
    at = d.year * 12 + d.month - 1 + n
    return date(at // 12, at % 12 + 1, 1)


def period_start(period: str, d: date) -> date:
    """First day of the period that holds d; weeks begin on Sunday."""
    if period == "DAYS":
        return d
    if period == "WEEKS":
        return d - timedelta(days=(d.weekday() + 1) % 7)
    if period in ("MONTHS", "QUARTERS", "YEARS"):
        return date(d.year, {"MONTHS": d.month, "QUARTERS": (d.month - 1) // 3 * 3 + 1, "YEARS": 1}[period], 1)
    raise UnsupportedCalc(f"no period {period}", "filter")


def period_add(period: str, start: date, n: int) -> date:
    if period in ("DAYS", "WEEKS"):
        return start + timedelta(days=n * (1 if period == "DAYS" else 7))
    return _add_months(start, n * {"MONTHS": 1, "QUARTERS": 3, "YEARS": 12}[period])


def relative_range(f: Filter, anchor: date) -> tuple[date, date]:
    """First day and the day after the last of a relative date filter, worked out once on the driver."""
    anchor = f.anchor or anchor
    anchor = anchor.date() if isinstance(anchor, datetime) else anchor
    period = (f.period or "") if (f.period or "").endswith("S") else f"{f.period}S"
    now, kind = period_start(period, anchor), f.relative
    if kind in ("LASTN", "NEXTN") and not f.range_n:
        raise UnsupportedCalc(f"{kind} without rangeN", "filter")
    if kind == "CURRENT":
        return now, period_add(period, now, 1)
    if kind == "LAST":
        return period_add(period, now, -1), now
    if kind == "NEXT":
        return period_add(period, now, 1), period_add(period, now, 2)
    if kind == "TODATE":
        return now, anchor + timedelta(days=1)
    if kind == "LASTN":  # the current period is the last of them
        return period_add(period, now, 1 - f.range_n), period_add(period, now, 1)
    if kind == "NEXTN":
        return period_add(period, now, 1), period_add(period, now, 1 + f.range_n)
    raise UnsupportedCalc(f"no date range {kind}", "filter")


def relative_filter(x: Column, f: Filter, anchor: date) -> Column:
    first, after = relative_range(f, anchor)
    out = (x >= F.lit(first)) & (x < F.lit(after))
    return out | x.isNull() if f.include_nulls else out


def condition(f: Filter, x: Column, dtype: str, anchor: date) -> Column:
    if f.kind == "SET":
        return set_filter(x, f.values, f.exclude)
    if f.kind == "MATCH":
        return match_filter(x, f, dtype)
    if f.kind == "CONDITION":
        return F.coalesce(~x, F.lit(True)) if f.exclude else x
    if f.kind in ("QUANTITATIVE_DATE", "DATE") and dtype not in (DATE, DATETIME):
        raise UnsupportedCalc(f"{f.kind} on {dtype}", "filter")
    return relative_filter(x, f, anchor) if f.kind == "DATE" else range_filter(x, f)
