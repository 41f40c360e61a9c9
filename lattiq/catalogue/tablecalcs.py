"""Table calculations over marks."""

from lattiq.catalogue.base import calc, dim, register, star, view
from lattiq.operators.model import Model
from lattiq.plans.nodes import Call, Field
from lattiq.plans.tablecalc import quick
from lattiq.plans.view import ViewField, ViewQuery, run_view

YEAR, BY = dim("Order Date", "year", "YEAR"), dim("Priority")
ORDER, PART = ["year"], ["Priority"]
_MARKS = "WITH m AS (SELECT year(o_orderdate) AS year, o_orderpriority AS Priority, sum(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY 1, 2) "
_P = "PARTITION BY Priority"
_PO = f"{_P} ORDER BY year"


def _tc(name: str, formulas: dict[str, str], sql: str, decimals: dict[str, int] | None = None) -> None:
    decimals = decimals or {}
    view(name, [YEAR, BY, *[calc(n, f, decimals.get(n), order=ORDER, part=PART) for n, f in formulas.items()]], _MARKS + f"SELECT year, Priority, {sql} FROM m")


_tc(
    "tc_index_size_first_last",
    {"i": "INDEX()", "n": "SIZE()", "f": "FIRST()", "l": "LAST()"},
    f"row_number() OVER ({_PO}) AS i, count(*) OVER ({_P}) AS n, 1 - row_number() OVER ({_PO}) AS f, count(*) OVER ({_P}) - row_number() OVER ({_PO}) AS l",
)
_tc(
    "tc_running",
    {"s": "RUNNING_SUM(SUM([Total]))", "a": "RUNNING_AVG(SUM([Total]))", "lo": "RUNNING_MIN(SUM([Total]))", "hi": "RUNNING_MAX(SUM([Total]))", "c": "RUNNING_COUNT(SUM([Total]))"},
    ", ".join(f"{'round(' if f != 'count' else ''}{f}(x) OVER ({_PO} ROWS UNBOUNDED PRECEDING){', 4)' if f != 'count' else ''} AS {n}" for n, f in (("s", "sum"), ("a", "avg"), ("lo", "min"), ("hi", "max"), ("c", "count"))),
    dict.fromkeys(("s", "a", "lo", "hi"), 4),
)
_WHOLE = {"SUM": "sum(x)", "AVG": "avg(x)", "MIN": "min(x)", "MAX": "max(x)", "MEDIAN": "median(x)", "STDEV": "stddev_samp(x)", "STDEVP": "stddev_pop(x)", "PERCENTILE": "quantile_cont(x, 0.25)"}
_tc(
    "tc_window",
    {f"w_{a.lower()}": f"WINDOW_{a}(SUM([Total]){', 0.25' if a == 'PERCENTILE' else ''})" for a in _WHOLE} | {"w_var": "WINDOW_VAR(COUNT([Order]))", "w_varp": "WINDOW_VARP(COUNT([Order]))", "w_count": "WINDOW_COUNT(SUM([Total]))"},
    ", ".join(f"round({f} OVER ({_P}), 4) AS w_{a.lower()}" for a, f in _WHOLE.items()) + f", round(var_samp(n) OVER ({_P}), 4) AS w_var, round(var_pop(n) OVER ({_P}), 4) AS w_varp, count(x) OVER ({_P}) AS w_count",
    {f"w_{a.lower()}": 4 for a in (*_WHOLE, "VAR", "VARP")},
)
_MOVES = {"SUM": "sum", "AVG": "avg", "MIN": "min", "MAX": "max"}
_tc(
    "tc_moving",
    {f"m_{a.lower()}": f"WINDOW_{a}(SUM([Total]), -2, 0)" for a in _MOVES} | {"m_count": "WINDOW_COUNT(SUM([Total]), -1, 1)", "m_sd": "WINDOW_STDEV(SUM([Total]), -1, 1)", "m_rest": "WINDOW_SUM(SUM([Total]), 0, LAST())"},
    ", ".join(f"round({f}(x) OVER ({_PO} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m_{a.lower()}" for a, f in _MOVES.items())
    + f", count(x) OVER ({_PO} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m_count, round(stddev_samp(x) OVER ({_PO} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS m_sd, round(sum(x) OVER ({_PO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS m_rest",
    dict.fromkeys(("m_sum", "m_avg", "m_min", "m_max", "m_sd", "m_rest"), 4),
)
_tc(
    "tc_lookup",
    {"prev": "LOOKUP(SUM([Total]), -1)", "next2": "LOOKUP(SUM([Total]), 2)", "own": "LOOKUP(SUM([Total]), 0)", "first": "LOOKUP(SUM([Total]), FIRST())"},
    f"round(lag(x) OVER ({_PO}), 4) AS prev, round(lead(x, 2) OVER ({_PO}), 4) AS next2, round(x, 4) AS own, round(first_value(x) OVER ({_PO}), 4) AS first",
    dict.fromkeys(("prev", "next2", "own", "first"), 4),
)
_tc(
    "tc_rank_family",
    {"r": "RANK(COUNT([Order]))", "ra": "RANK(COUNT([Order]), 'asc')", "d": "RANK_DENSE(COUNT([Order]))", "m": "RANK_MODIFIED(COUNT([Order]))", "p": "RANK_PERCENTILE(COUNT([Order]))", "u": "RANK_UNIQUE(COUNT([Order]))"},
    f"rank() OVER ({_P} ORDER BY n DESC) AS r, rank() OVER ({_P} ORDER BY n) AS ra, dense_rank() OVER ({_P} ORDER BY n DESC) AS d, count(*) OVER ({_P} ORDER BY n DESC) AS m, round((count(*) OVER ({_P} ORDER BY n) - 1) / (count(*) OVER ({_P}) - 1), 4) AS p, row_number() OVER ({_P} ORDER BY n DESC, year) AS u",
    {"p": 4},
)
view(
    "tc_total_pct",
    [YEAR, BY, calc("pct", "SUM([Total]) / TOTAL(SUM([Total]))", 4, part=PART), calc("mean", "TOTAL(AVG([Total]))", 4, part=PART), calc("kinds", "TOTAL(COUNTD([Customer]))", part=["year"]), calc("all", "TOTAL(MEDIAN([Total]))", 4)],
    "WITH p AS (SELECT o_orderpriority AS Priority, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders GROUP BY 1), y AS (SELECT year(o_orderdate) AS year, count(DISTINCT o_custkey) AS k FROM orders GROUP BY 1) SELECT year(o_orderdate) AS year, o_orderpriority AS Priority, round(sum(o_totalprice) / any_value(s), 4) AS pct, round(any_value(a), 4) AS mean, any_value(k) AS kinds, (SELECT round(median(o_totalprice), 4) FROM orders) AS \"all\" FROM orders JOIN p ON Priority = o_orderpriority JOIN y ON y.year = year(o_orderdate) GROUP BY 1, 2",
)
view(
    "tc_nested",
    [YEAR, BY, calc("rank_of_run", "RANK(RUNNING_SUM(SUM([Total])) - SUM([Total]))", order=ORDER, part=PART), calc("smooth", "WINDOW_AVG(RUNNING_SUM(COUNT([Order])), -1, 0)", 4, order=ORDER, part=PART)],
    "WITH m AS (SELECT year(o_orderdate) AS year, o_orderpriority AS Priority, sum(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY 1, 2), "
    f"r AS (SELECT *, sum(x) OVER ({_PO} ROWS UNBOUNDED PRECEDING) - x AS s, sum(n) OVER ({_PO} ROWS UNBOUNDED PRECEDING) AS c FROM m) SELECT year, Priority, rank() OVER ({_P} ORDER BY s DESC) AS rank_of_run, round(avg(c) OVER ({_PO} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS smooth FROM r",
)


def _quick(name: str, kinds: dict[str, dict], sql: str, first: tuple[dict, ...] = (YEAR, BY), order=ORDER, part=PART) -> None:
    def run(spark, sf_dir):
        model: Model = star(spark, sf_dir)
        x = Call("SUM", (Field("Total"),))
        fields = [ViewField.from_json(f) for f in first]
        fields += [ViewField(alias=n, decimals=4, tree=quick(k["kind"], x, **{a: b for a, b in k.items() if a != "kind"}), partition_by=tuple(part), order_by=tuple((o, False) for o in order)) for n, k in kinds.items()]
        return run_view(model, ViewQuery(tuple(fields)))

    register(name, sql)(run)


_LAG = f"lag(x) OVER ({_PO})"
_quick(
    "tc_pctdiff",
    {"diff": {"kind": "difference"}, "pct": {"kind": "percent_difference"}, "signed": {"kind": "percent_difference", "absolute": False}},
    _MARKS + f"SELECT year, Priority, round(x - {_LAG}, 4) AS diff, round((x - {_LAG}) / abs({_LAG}), 4) AS pct, round((x - {_LAG}) / {_LAG}, 4) AS signed FROM m",
)
_quick(
    "tc_cagr",
    {"growth": {"kind": "compound_growth"}, "pctile": {"kind": "percentile"}, "share": {"kind": "percent_of_total"}, "moving": {"kind": "moving_average", "back": 1, "forth": 1}},
    _MARKS + f""", r AS (SELECT *, row_number() OVER ({_PO}) AS i, first_value(x) OVER ({_PO}) AS f, dense_rank() OVER ({_P} ORDER BY x) AS d, sum(x) OVER ({_P}) AS s, avg(x) OVER ({_PO} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a, count(*) OVER ({_P}) AS n2 FROM m)
    SELECT year, Priority, round(CASE WHEN i = 1 THEN 0 ELSE pow(x / f, 1.0 / (i - 1)) - 1 END, 4) AS growth, round((d - 1) / (max(d) OVER ({_P}) - 1), 4) AS pctile, round(x / s, 4) AS share, round(a, 4) AS moving FROM r""".replace("WITH m AS", "WITH m AS", 1),
)
_QUARTER = dim("Order Date", "quarter", "QUARTER")
_QM = "WITH m AS (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2) "
_quick(
    "tc_yoy",
    {"yoy": {"kind": "year_over_year", "per": 4}},
    _QM + "SELECT year, quarter, round((x - lag(x, 4) OVER (ORDER BY year, quarter)) / abs(lag(x, 4) OVER (ORDER BY year, quarter)), 4) AS yoy FROM m",
    (YEAR, _QUARTER),
    ["year", "quarter"],
    [],
)
_quick("tc_ytd", {"ytd": {"kind": "year_to_date"}}, _QM + "SELECT year, quarter, round(sum(x) OVER (PARTITION BY year ORDER BY quarter ROWS UNBOUNDED PRECEDING), 4) AS ytd FROM m", (YEAR, _QUARTER), ["quarter"], ["year"])
_quick(
    "tc_ytd_growth",
    {"growth": {"kind": "year_to_date_growth", "per": 4, "partition": ["year"], "order": ["quarter"]}},
    _QM.rstrip() + ", y AS (SELECT year, quarter, sum(x) OVER (PARTITION BY year ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS t FROM m) SELECT year, quarter, round((t - lag(t, 4) OVER w) / abs(lag(t, 4) OVER w), 4) AS growth FROM y WINDOW w AS (ORDER BY year, quarter)",
    (YEAR, _QUARTER),
    ["year", "quarter"],
    [],
)
_quick("tc_quick_rank", {"dense": {"kind": "rank", "style": "dense", "way": "asc"}, "window": {"kind": "window", "agg": "MAX"}, "run": {"kind": "running", "agg": "AVG"}}, _MARKS + f"SELECT year, Priority, CAST(dense_rank() OVER ({_P} ORDER BY x) AS BIGINT) AS dense, round(max(x) OVER ({_P}), 4) AS \"window\", round(avg(x) OVER ({_PO} ROWS UNBOUNDED PRECEDING), 4) AS run FROM m")
view(
    "tc_window_pairs",
    [YEAR, BY, calc("r", "WINDOW_CORR(SUM([Total]), COUNT([Order]))", 4, part=PART), calc("c", "WINDOW_COVAR(COUNT([Order]), COUNTD([Customer]))", 4, part=PART), calc("cp", "WINDOW_COVARP(COUNT([Order]), COUNTD([Customer]))", 4, part=PART)],
    f"WITH m AS (SELECT year(o_orderdate) AS year, o_orderpriority AS Priority, sum(o_totalprice) AS x, count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders GROUP BY 1, 2) SELECT year, Priority, round(corr(x, n) OVER ({_P}), 4) AS r, round(covar_samp(n, k) OVER ({_P}), 4) AS c, round(covar_pop(n, k) OVER ({_P}), 4) AS cp FROM m",
)
view(
    "tc_filtered",
    [YEAR, BY, calc("r", "RANK(SUM([Total]))", part=PART)],
    _MARKS + f"SELECT year, Priority, r FROM (SELECT *, rank() OVER ({_P} ORDER BY x DESC) AS r FROM m) WHERE r <= 2",
    [{"filterType": "CONDITION", "field": {"calculation": "RANK(SUM([Total])) <= 2"}}],
)
_tc(
    "tc_previous_value",
    {"smooth": "SUM([Total]) / 1000 + 0.5 * PREVIOUS_VALUE(0)", "path": "PREVIOUS_VALUE('') + CHAR(64 + INDEX())"},
    f"round(list_reduce(list_prepend(0, list(x / 1000) OVER ({_PO} ROWS UNBOUNDED PRECEDING)), lambda a, b: b + 0.5 * a), 4) AS smooth, substr('ABCDEFGHIJ', 1, CAST(row_number() OVER ({_PO}) AS INT)) AS path",
    {"smooth": 4},
)
