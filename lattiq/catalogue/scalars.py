"""Row-level functions."""

from lattiq.catalogue.base import register, star
from lattiq.plans.view import with_calcs


def _rows(name: str, keys: str, formulas: dict[str, str], sql: str) -> None:
    def run(spark, sf_dir):
        return with_calcs(star(spark, sf_dir), formulas).select(*keys.split(), *formulas)

    register(name, sql)(run)


_rows(
    "scalar_string",
    "p_partkey",
    {
        "len": "LEN([Part Name])",
        "upper": "UPPER([Type])",
        "lower": "LOWER([Type])",
        "left4": "LEFT([Part Name], 4)",
        "right2": "RIGHT([Part Name], 2)",
        "mid3": "MID([Part Name], 3, 4)",
        "tail": "MID([Part Name], 3)",
        "swap": "REPLACE([Brand], 'Brand', 'B.')",
        "has": "CONTAINS([Type], 'STEEL')",
        "starts": "STARTSWITH([Type], 'S')",
        "ends": "ENDSWITH([Brand], '1')",
        "at": "FIND([Part Name], 'e')",
        "at5": "FIND([Part Name], 'e', 6)",
        "pad": "'a' + SPACE(2) + [Brand]",
        "code": "ASCII([Part Name])",
        "letter": "CHAR(65 + [Size] % 26)",
        "greek": "CHAR(945)",
        "proper": "PROPER([Type])",
        "trimmed": "TRIM('  ' + [Brand] + ' ')",
        "piece": "SPLIT([Brand], '#', 2)",
        "digits": "REGEXP_EXTRACT([Brand], '([0-9]+)')",
        "starred": "REGEXP_REPLACE([Brand], '[0-9]', '*')",
        "numbered": "REGEXP_MATCH([Brand], '[0-9]$')",
    },
    """SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS len, upper(p_type) AS upper, lower(p_type) AS lower, left(p_name, 4) AS left4, right(p_name, 2) AS right2, substr(p_name, 3, 4) AS mid3, substr(p_name, 3) AS tail,
    replace(p_brand, 'Brand', 'B.') AS swap, contains(p_type, 'STEEL') AS has, starts_with(p_type, 'S') AS starts, ends_with(p_brand, '1') AS ends, CAST(instr(p_name, 'e') AS BIGINT) AS at,
    CAST(CASE WHEN instr(substr(p_name, 6), 'e') > 0 THEN instr(substr(p_name, 6), 'e') + 5 ELSE 0 END AS BIGINT) AS at5, 'a  ' || p_brand AS pad, CAST(unicode(p_name) AS BIGINT) AS code, chr(CAST(65 + p_size % 26 AS INT)) AS letter, chr(945) AS greek,
    list_aggregate(list_transform(regexp_extract_all(lower(p_type), '([a-z]+|[^a-z]+)'), lambda r: upper(r[1]) || substr(r, 2)), 'string_agg', '') AS proper,
    trim('  ' || p_brand || ' ') AS trimmed, split_part(p_brand, '#', 2) AS piece, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_brand, '[0-9]', '*', 'g') AS starred, regexp_matches(p_brand, '[0-9]$') AS numbered FROM part""",
)
_rows(
    "scalar_math",
    "l_orderkey l_linenumber",
    {
        "a": "ABS([Discount] - 0.05) > 0.02",
        "r": "ROUND(SQRT([Quantity]), 4)",
        "sg": "SIGN([Quantity] - 25)",
        "e": "ROUND(EXP([Discount]), 4)",
        "l": "ROUND(LN([Quantity]), 4)",
        "l10": "ROUND(LOG([Quantity]), 4)",
        "lb": "ROUND(LOG([Quantity], 3), 4)",
        "l2": "ROUND(LOG2([Quantity]), 4)",
        "trig": "ROUND(SIN([Tax]) + COS([Tax]) + TAN([Tax]) + ASIN([Tax]) + ACOS([Tax]) + ATAN([Tax]), 4)",
        "cot": "ROUND(COT([Quantity]), 4)",
        "deg": "ROUND(DEGREES([Tax]) + RADIANS([Quantity]), 4)",
        "up": "CEILING([Price] / 1000)",
        "down": "FLOOR([Price] / 1000)",
        "p": "POWER([Quantity], 2)",
        "hat": "-2 ^ 2 + [Quantity] ^ 2",
        "sq": "SQUARE([l_linenumber])",
        "div": "DIV([l_orderkey], 7 - [l_linenumber])",
        "mod": "MOD([l_orderkey] - 5000, 7)",
        "neg": "[l_orderkey] % -7",
        "ratio": "ROUND([Price] / ([l_linenumber] - 1), 4)",
        "t": "INT(0 - [Price])",
        "angle": "ROUND(ATAN2([Tax], [Discount] + 1), 4)",
        "circle": "ROUND(PI() * [Quantity], 4)",
    },
    """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) > 0.02 AS a, round(sqrt(l_quantity), 4) AS r, CAST(sign(l_quantity - 25) AS BIGINT) AS sg, round(exp(l_discount), 4) AS e, round(ln(l_quantity), 4) AS l, round(log10(l_quantity), 4) AS l10,
    round(ln(l_quantity) / ln(3), 4) AS lb, round(log2(l_quantity), 4) AS l2, round(sin(l_tax) + cos(l_tax) + tan(l_tax) + asin(l_tax) + acos(l_tax) + atan(l_tax), 4) AS trig, round(cot(l_quantity), 4) AS cot, round(degrees(l_tax) + radians(l_quantity), 4) AS deg,
    CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS up, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS down, pow(l_quantity, 2) AS p, 4 + pow(l_quantity, 2) AS hat, CAST(l_linenumber AS BIGINT) * l_linenumber AS sq,
    CAST(CASE WHEN l_linenumber <> 7 THEN trunc(l_orderkey / (7 - l_linenumber)) END AS BIGINT) AS div, CAST(l_orderkey - 5000 - 7 * floor((l_orderkey - 5000) / 7) AS BIGINT) AS mod, CAST(l_orderkey + 7 * floor(l_orderkey / -7) AS BIGINT) AS neg,
    CASE WHEN l_linenumber <> 1 THEN round(l_extendedprice / (l_linenumber - 1), 4) END AS ratio, CAST(trunc(-l_extendedprice) AS BIGINT) AS t, round(atan2(l_tax, l_discount + 1), 4) AS angle, round(pi() * l_quantity, 4) AS circle FROM lineitem""",
)
_rows(
    "scalar_logic",
    "o_orderkey",
    {
        "branch": "IF [Total] > 300000 THEN 'big' ELSEIF [Total] > 100000 THEN 'mid' END",
        "searched": "CASE WHEN [Order Status] = 'F' THEN 1 WHEN [Total] < 1000 THEN 2 ELSE 3 END",
        "simple": "CASE [Order Status] WHEN 'F' THEN 'final' WHEN 'f' THEN 'never' ELSE 'open' END",
        "iif": "IIF([Total] >= [Parameters].[Min Total], 'yes', 'no')",
        "unknown": "IIF(NULL = 1, 'a', 'b', 'c')",
        "both": "NOT [Order Status] = 'F' AND ([Total] > 1000 OR ISNULL([Customer]))",
        "member": "[Priority] IN ('1-URGENT', '2-HIGH')",
        "zn": "ZN(IF [Total] > 400000 THEN [Total] END)",
        "ifnull": "IFNULL(IF [Total] > 400000 THEN 'x' END, 'y')",
        "ordered": "[Priority] >= '3'",
        "lesser": "MIN([Total], 100000.0)",
    },
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS branch, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_totalprice < 1000 THEN 2 ELSE 3 END AS BIGINT) AS searched,
    CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END AS simple, CASE WHEN o_totalprice >= 200000 THEN 'yes' ELSE 'no' END AS iif, 'c' AS unknown, o_orderstatus <> 'F' AND (o_totalprice > 1000 OR o_custkey IS NULL) AS both,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS member, CASE WHEN o_totalprice > 400000 THEN o_totalprice ELSE 0 END AS zn, CASE WHEN o_totalprice > 400000 THEN 'x' ELSE 'y' END AS ifnull, o_orderpriority >= '3' AS ordered, least(o_totalprice, 100000.0::DOUBLE) AS lesser FROM orders""",
)
_PARTS = ("year", "quarter", "month", "day", "hour", "minute", "second")
_rows(
    "scalar_date_part",
    "o_orderkey",
    {f"p_{p}": f"DATEPART('{p}', [Order Date])" for p in _PARTS}
    | {"y": "YEAR([Order Date])", "wk": "WEEK([Order Date])", "iw": "ISOWEEK([Order Date])", "id": "ISOWEEKDAY([Order Date])", "iy": "ISOYEAR([Order Date])", "wd": "DATEPART('weekday', [Order Date])", "mn": "DATENAME('month', [Order Date])", "dn": "DATENAME('weekday', [Order Date])", "yn": "DATENAME('year', [Order Date])"},
    "SELECT o_orderkey, "
    + ", ".join(f"CAST({p}(o_orderdate) AS BIGINT) AS p_{p}" for p in _PARTS)
    + """, year(o_orderdate) AS y, CAST((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) // 7 + 1 AS BIGINT) AS wk, week(o_orderdate) AS iw, isodow(o_orderdate) AS id, isoyear(o_orderdate) AS iy, dayofweek(o_orderdate) + 1 AS wd, monthname(o_orderdate) AS mn, dayname(o_orderdate) AS dn, CAST(year(o_orderdate) AS VARCHAR) AS yn FROM orders""",
)
_STEPS = {"day": 45, "week": 3, "month": 13, "quarter": -2, "year": -1, "hour": 30, "minute": 90, "second": 3700}
_SHOWN = "STR({})"
_rows(
    "scalar_date_add",
    "o_orderkey",
    {f"a_{p}": f"STR(DATEADD('{p}', {n}, [Order Date]))" for p, n in _STEPS.items()} | {"plus": "STR(DATE([Order Date]) + 10)", "minus": "DATE([Order Date]) - #1995-01-01#", "made": "STR(MAKEDATE(YEAR([Order Date]), 2, 28))"},
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderdate + INTERVAL ({n * (3 if p == 'quarter' else 1)}) {'month' if p == 'quarter' else p} AS VARCHAR) AS a_{p}" for p, n in _STEPS.items())
    + ", CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS plus, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS minus, CAST(make_date(year(o_orderdate), 2, 28) AS VARCHAR) AS made FROM orders",
)
_DIFFS = ("day", "month", "quarter", "year", "hour", "minute", "second")
_rows(
    "scalar_date_diff",
    "l_orderkey l_linenumber",
    {f"d_{p}": f"DATEDIFF('{p}', [Order Date], [Ship Date])" for p in _DIFFS} | {"d_week": "DATEDIFF('week', [Order Date], [Ship Date])", "back": "DATEDIFF('month', [Ship Date], #2000-01-31#)"},
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"date_diff('{p}', o_orderdate, l_shipdate) AS d_{p}" for p in _DIFFS) + ", date_diff('day', date_trunc('week', o_orderdate + INTERVAL 1 DAY), date_trunc('week', l_shipdate + INTERVAL 1 DAY)) // 7 AS d_week, date_diff('month', l_shipdate, DATE '2000-01-31') AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
_rows(
    "scalar_date_trunc",
    "o_orderkey",
    {f"t_{p}": f"STR(DATE(DATETRUNC('{p}', [Order Date])))" for p in ("day", "month", "quarter", "year")} | {"t_week": "STR(DATE(DATETRUNC('week', [Order Date])))", "t_iso": "STR(DATE(DATETRUNC('iso-week', [Order Date])))", "t_hour": "STR(DATETRUNC('hour', DATEADD('minute', 95, [Order Date])))"},
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(CAST(date_trunc('{p}', o_orderdate) AS DATE) AS VARCHAR) AS t_{p}" for p in ("day", "month", "quarter", "year"))
    + ", CAST(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT) AS VARCHAR) AS t_week, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS t_iso, CAST(date_trunc('hour', o_orderdate + INTERVAL 95 MINUTE) AS VARCHAR) AS t_hour FROM orders",
)
