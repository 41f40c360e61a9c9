"""Row-level functions, all as built-in Spark expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.functions.registry import Function
from lattiq.plans.nodes import BOOL, DATE, DATETIME, INT, NULL, REAL, TEXT

SCALARS: dict[str, Function] = {}


def _add(name: str, params: str, result, build, optional: int = 0, parts: tuple[str, ...] = (), extension: bool = False) -> None:
    SCALARS[name] = Function(name, params, result, build, optional, parts, extension)


def common_type(*dtypes: str) -> str:
    """The type of branches: null fits all, int widens to real and date to datetime; else none fits."""
    kinds = {d for d in dtypes if d != NULL}
    if not kinds:
        return NULL
    if len(kinds) == 1:
        return kinds.pop()
    if kinds == {INT, REAL}:
        return REAL
    if kinds == {DATE, DATETIME}:
        return DATETIME
    return ""


def _same(*dtypes: str) -> str:
    from lattiq.errors import UnsupportedCalc

    found = common_type(*dtypes)
    if not found:
        raise UnsupportedCalc(f"mixed types {', '.join(dtypes)}", "type")
    return found


def double(x: Column) -> Column:
    return x.cast("double")


def divide(a: Column, b: Column) -> Column:
    """Real division; null where b is 0 or null."""
    return F.try_divide(double(a), double(b))


def floored_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for divisor 0."""
    return a - b * F.floor(divide(a, b))


def whole_div(a: Column, b: Column) -> Column:
    """Division of whole numbers toward zero; null for divisor 0."""
    return divide(a, b).cast("bigint")


# -- numbers ---------------------------------------------------------------

for _name in ("SQRT", "EXP", "LN", "SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "COT", "DEGREES", "RADIANS"):
    _add(_name, "n", REAL, lambda x, f=getattr(F, _name.lower()): f(double(x)))
_add("ABS", "n", lambda x: x, F.abs)
_add("SIGN", "n", INT, lambda x: F.sign(x).cast("bigint"))
_add("CEILING", "n", INT, lambda x: F.ceil(x).cast("bigint"))
_add("FLOOR", "n", INT, lambda x: F.floor(x).cast("bigint"))
_add("ROUND", "ni", lambda x, n=None: x if n is None and x == INT else REAL, lambda x, n=None: F.round(x) if n is None else F.round(double(x), n), 1)
_add("LOG", "nn", REAL, lambda x, b=None: F.log10(double(x)) if b is None else F.ln(double(x)) / F.ln(double(b)), 1)
_add("LOG2", "n", REAL, lambda x: F.log2(double(x)))
_add("POWER", "nn", REAL, lambda x, n: F.pow(double(x), double(n)))
_add("SQUARE", "n", lambda x: x, lambda x: x * x)
_add("PI", "", REAL, lambda: F.pi())
_add("ATAN2", "nn", REAL, lambda y, x: F.atan2(double(y), double(x)))
_add("DIV", "nn", INT, whole_div)
_add("MOD", "nn", lambda a, b: _same(a, b), floored_mod)
_add("INT", "n", INT, lambda x: x.cast("bigint"))
_add("FLOAT", "n", REAL, double)

# -- text ------------------------------------------------------------------


def _char(n: Column) -> Column:
    # UTF-32 holds every code point as four bytes, so this reaches beyond 255.
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")


def _proper(s: Column) -> Column:
    """A letter after a non-letter (or at the start) is a capital, every other letter small."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def _locate(t: Column, s: Column, start: Column | None = None) -> Column:
    return F.call_function("locate", t, s, *([] if start is None else [start.cast("int")]))


def _or_none(at: Column) -> Column:
    return F.when(at == 0, F.lit(-1)).otherwise(at)


def _find_nth(s: Column, t: Column, n: Column) -> Column:
    """Where the n-th occurrence of t begins, which may overlap the one before; 0 if there is none."""
    step = lambda at, _: F.when(at < 0, at).otherwise(_or_none(_locate(t, s, at + 1)))
    return F.greatest(F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0), step), F.lit(0))


_add("LEN", "t", INT, lambda s: F.length(s).cast("bigint"))
_add("UPPER", "t", TEXT, F.upper)
_add("LOWER", "t", TEXT, F.lower)
_add("PROPER", "t", TEXT, _proper)
_add("LEFT", "tn", TEXT, lambda s, n: F.left(s, n.cast("int")))
_add("RIGHT", "tn", TEXT, lambda s, n: F.right(s, n.cast("int")))
_add("MID", "tnn", TEXT, lambda s, i, n=None: s.substr(i.cast("int"), F.length(s) if n is None else n.cast("int")), 1)
_add("REPLACE", "ttt", TEXT, F.replace)
_add("CONTAINS", "tt", BOOL, F.contains)
_add("STARTSWITH", "tt", BOOL, F.startswith)
_add("ENDSWITH", "tt", BOOL, F.endswith)
_add("FIND", "ttn", INT, lambda s, t, i=None: _locate(t, s, i).cast("bigint"), 1)
_add("SPACE", "n", TEXT, lambda n: F.repeat(F.lit(" "), n.cast("int")))
_add("CHAR", "n", TEXT, _char)
_add("ASCII", "t", INT, lambda s: F.ascii(s).cast("bigint"))
_add("TRIM", "t", TEXT, F.trim, extension=True)
_add("LTRIM", "t", TEXT, F.ltrim, extension=True)
_add("RTRIM", "t", TEXT, F.rtrim, extension=True)
_add("SPLIT", "ttn", TEXT, lambda s, d, n: F.split_part(s, d, n.cast("int")), extension=True)
_add("FINDNTH", "ttn", INT, lambda s, t, n: _find_nth(s, t, n).cast("bigint"), extension=True)
_add("REGEXP_MATCH", "tt", BOOL, lambda s, p: F.rlike(s, p), extension=True)
_add("REGEXP_EXTRACT", "ts", TEXT, lambda s, p: F.regexp_extract(s, p, 1), extension=True)
_add("REGEXP_EXTRACT_NTH", "tsi", TEXT, lambda s, p, n: F.regexp_extract(s, p, n), extension=True)
_add("REGEXP_REPLACE", "ttt", TEXT, F.regexp_replace, extension=True)
_add("STR", "a", TEXT, lambda x: x.cast("string"), extension=True)

# -- logic -----------------------------------------------------------------

_add("IIF", "baaa", lambda c, *xs: _same(*xs), lambda c, a, b, unknown=None: F.when(c, a).otherwise(b) if unknown is None else F.when(c.isNull(), unknown).when(c, a).otherwise(b), 1)
_add("ZN", "n", lambda x: x, lambda x: F.coalesce(x, F.lit(0)))
_add("IFNULL", "aa", lambda a, b: _same(a, b), F.coalesce)
_add("ISNULL", "a", BOOL, F.isnull)

# -- dates -----------------------------------------------------------------


def sunday_week(d: Column) -> Column:
    """Weeks begin on Sunday and the first one holds January 1."""
    return F.floor((F.dayofyear(d) + F.dayofweek(F.trunc(d, "year")) - 2) / 7) + 1


_READ = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "week": sunday_week,
    "day": F.day,
    "hour": F.hour,
    "minute": F.minute,
    "second": lambda d: F.floor(F.second(d)),
    "weekday": F.dayofweek,
    "dayofyear": F.dayofyear,
    "iso-year": lambda d: F.extract(F.lit("YEAROFWEEK"), d),
    "iso-week": F.weekofyear,
    "iso-weekday": lambda d: F.weekday(d) + 1,
}
_CLOCK = ("hour", "minute", "second")
_STEPS = ("year", "quarter", "month", "week", "day", *_CLOCK)


def date_part(part: str, d: Column) -> Column:
    return _READ[part](d).cast("bigint")


def date_diff(part: str, a: Column, b: Column) -> Column:
    """How many boundaries of the part lie between a and b, not how many whole parts."""
    if part == "day":
        return F.datediff(b, a).cast("bigint")
    if part == "week":  # Sundays
        return F.floor((F.datediff(b, a) + F.dayofweek(a) - 1) / 7).cast("bigint")
    years = F.year(b) - F.year(a)
    if part in ("year", "quarter", "month"):
        per = {"year": 1, "quarter": 4, "month": 12}[part]
        return (years if per == 1 else years * per + _READ[part](b) - _READ[part](a)).cast("bigint")
    return F.timestamp_diff(part.upper(), F.date_trunc(part, a), F.date_trunc(part, b)).cast("bigint")


def date_add(part: str, n: Column, d: Column) -> Column:
    """Adds whole parts; months end no later than the month's last day, and the time stays."""
    return F.timestamp_add(part.upper(), n.cast("int"), d)


def date_trunc(part: str, d: Column) -> Column:
    """Start of the part; weeks begin on Sunday, ISO weeks on Monday."""
    if part == "week":
        return F.date_trunc("day", F.timestamp_add("DAY", 1 - F.dayofweek(d), d))
    return F.date_trunc("week" if part == "iso-week" else part, d)


for _part in ("YEAR", "QUARTER", "MONTH", "DAY", "WEEK"):
    _add(_part, "d", INT, lambda d, p=_part.lower(): date_part(p, d))
_add("ISOYEAR", "d", INT, lambda d: date_part("iso-year", d))
_add("ISOQUARTER", "d", INT, lambda d: (F.floor((F.least(F.weekofyear(d), F.lit(52)) - 1) / 13) + 1).cast("bigint"), extension=True)
_add("ISOWEEK", "d", INT, lambda d: date_part("iso-week", d))
_add("ISOWEEKDAY", "d", INT, lambda d: date_part("iso-weekday", d))
_add("DATEPART", "pd", INT, date_part, parts=tuple(_READ))
_add("DATENAME", "pd", TEXT, lambda p, d: F.date_format(d, {"year": "yyyy", "month": "MMMM", "weekday": "EEEE"}[p]), parts=("year", "month", "weekday"))
_add("DATETRUNC", "pd", DATETIME, date_trunc, parts=(*_STEPS, "iso-week"))
_add("DATEADD", "pnd", DATETIME, date_add, parts=_STEPS)
_add("DATEDIFF", "pdd", INT, date_diff, parts=_STEPS)
_add("DATE", "d", DATE, F.to_date)
_add("DATETIME", "d", DATETIME, lambda d: d.cast("timestamp"))
_add("MAKEDATE", "nnn", DATE, lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")))
_add("MAKETIME", "nnn", DATETIME, lambda h, m, s: F.make_timestamp(F.lit(1899), F.lit(12), F.lit(30), h.cast("int"), m.cast("int"), s.cast("decimal(16,6)")), extension=True)
_add("MAKEDATETIME", "dd", DATETIME, lambda d, t: F.make_timestamp(F.year(d), F.month(d), F.day(d), F.hour(t), F.minute(t), F.second(t).cast("decimal(16,6)")), extension=True)
_add("DATEPARSE", "st", DATETIME, lambda f, s: F.try_to_timestamp(s, F.lit(f)), extension=True)
_add("ISDATE", "t", BOOL, lambda s: F.try_to_timestamp(s).isNotNull(), extension=True)

#: Names that are known and never computed: they run foreign code or need geometry.
REFUSED = frozenset("SCRIPT_BOOL SCRIPT_INT SCRIPT_REAL SCRIPT_STR RAWSQL_BOOL RAWSQL_DATE RAWSQL_DATETIME RAWSQL_INT RAWSQL_REAL RAWSQL_STR RAWSQLAGG_BOOL RAWSQLAGG_REAL RAWSQLAGG_INT RAWSQLAGG_STR MAKEPOINT MAKELINE DISTANCE BUFFER AREA HEXBINX HEXBINY MODEL_QUANTILE MODEL_PERCENTILE".split())
