"""Aggregate functions of the formula language."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.functions.registry import Function
from lattiq.plans.nodes import BOOL, INT, REAL, TEXT, Node

AGGREGATES: dict[str, Function] = {}


def _add(name: str, params: str, result, build, optional: int = 0) -> None:
    AGGREGATES[name] = Function(name, params, result, build, optional)


@dataclass(frozen=True, eq=False)
class Percentile:
    """An exact percentile of a column, ``of`` a tree; ``plans.percentiles.grouped`` aggregates it."""

    x: Column
    at: float
    of: Node | None = None


def attr(x: Column) -> Column:
    """The value if it is the only one (nulls count as a value of their own), else ``*``.

    Least and greatest value tell that, so there is no distinct count to shuffle.
    """
    one = F.min(x).eqNullSafe(F.max(x)) & (F.min(x.isNull()) == F.max(x.isNull()))
    return F.when(one, F.min(x).cast("string")).when(F.count(F.lit(1)) > 0, F.lit("*"))


def group_concat(x: Column, separator: str = ",") -> Column:
    """Duplicates stay; in order of the values, so that the result is defined."""
    return F.array_join(F.sort_array(F.collect_list(x.cast("string"))), separator)


def _least(x: Column) -> Column:
    return F.min(F.coalesce(x, F.lit(False)))


def _most(x: Column) -> Column:
    return F.max(F.coalesce(x, F.lit(False)))


_add("SUM", "n", lambda x: x, F.sum)
_add("AVG", "n", REAL, F.avg)
_add("MIN", "a", lambda x: x, F.min)
_add("MAX", "a", lambda x: x, F.max)
_add("COUNT", "a", INT, F.count)
_add("COUNTD", "a", INT, F.count_distinct)
_add("MEDIAN", "n", REAL, lambda x: Percentile(x.cast("double"), 0.5))
_add("STDEV", "n", REAL, F.stddev_samp)
_add("STDEVP", "n", REAL, F.stddev_pop)
_add("VAR", "n", REAL, F.var_samp)
_add("VARP", "n", REAL, F.var_pop)
_add("PERCENTILE", "nk", REAL, lambda x, k: Percentile(x.cast("double"), k))
_add("ATTR", "a", TEXT, attr)
_add("GROUP_CONCAT", "as", TEXT, group_concat, 1)
_add("CORR", "nn", REAL, lambda x, y: _paired(F.corr, x, y))
_add("COVAR", "nn", REAL, lambda x, y: _paired(F.covar_samp, x, y))
_add("COVARP", "nn", REAL, lambda x, y: _paired(F.covar_pop, x, y))


def _paired(f, x: Column, y: Column) -> Column:
    """Rows where both are there; null where the statistic isn't defined."""
    found = f(x.cast("double"), y.cast("double"))
    return F.when(~F.isnan(found), found)


def aggregate(name: str, args, columns: list[Column], dtypes: list[str]) -> Column | Percentile:
    """The aggregate column, or the percentile to aggregate. Booleans: MIN is AND, MAX is OR, null counts as false."""
    if name in ("MIN", "MAX") and dtypes[0] == BOOL:
        return (_least if name == "MIN" else _most)(columns[0])
    found = AGGREGATES[name].column(args, columns)
    return replace(found, of=args[0]) if isinstance(found, Percentile) else found


#: Outer aggregates of LOD expressions, over the distinct grain.
REAGGREGATES = ("SUM", "AVG", "MIN", "MAX", "MEDIAN", "COUNT", "STDEV", "STDEVP", "VAR", "VARP", "PERCENTILE")

#: Query functions that read a part of a field instead of aggregating it.
FIELD_PARTS = {p: p.lower() for p in ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY")} | {f"TRUNC_{p}": p.lower() for p in ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY")}


def query_function(name: str) -> str:
    """The name of an aggregate as a query spells it."""
    name = {"COUNT_DISTINCT": "COUNTD", "DISTINCTCOUNT": "COUNTD", "AVERAGE": "AVG", "STDEV_P": "STDEVP", "VAR_P": "VARP"}.get(name.upper(), name.upper())
    if name not in AGGREGATES:
        raise UnsupportedCalc(f"no function {name}", "function")
    return name
