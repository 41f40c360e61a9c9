"""Aggregates."""

from lattiq.catalogue.base import calc, dim, register, star, table, view
from lattiq.operators.profile import profile, totals_and_dimensions

view(
    "agg_basic",
    [dim("Flag"), calc("s", "SUM([Price])", 4), calc("a", "AVG([Quantity])", 4), calc("lo", "MIN([Price])"), calc("hi", "MAX([Price])"), calc("n", "COUNT([Discount])"), calc("parts", "COUNTD([l_partkey])")],
    "SELECT l_returnflag AS Flag, round(sum(l_extendedprice), 4) AS s, round(avg(l_quantity), 4) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_discount) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
)
view(
    "agg_stats",
    [dim("Flag"), calc("sd", "STDEV([Price])", 4), calc("sdp", "STDEVP([Price])", 4), calc("v", "VAR([Quantity])", 4), calc("vp", "VARP([Quantity])", 4), calc("med", "MEDIAN([Price])", 4), calc("p90", "PERCENTILE([Price], 0.9)", 4)],
    "SELECT l_returnflag AS Flag, round(stddev_samp(l_extendedprice), 4) AS sd, round(stddev_pop(l_extendedprice), 4) AS sdp, round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1",
)
view(
    "agg_ratio",
    [dim("Flag"), calc("per", "SUM([Price]) / SUM([Quantity])", 4), calc("none", "SUM([Price]) / (SUM([Quantity]) - SUM([Quantity]))", 4), calc("label", "IF SUM([Price]) > AVG([Price]) * 1000 THEN 'many' ELSE 'few' END"), calc("zn", "ZN(SUM([Tax]))", 4)],
    "SELECT l_returnflag AS Flag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS per, CAST(NULL AS DOUBLE) AS none, CASE WHEN sum(l_extendedprice) > avg(l_extendedprice) * 1000 THEN 'many' ELSE 'few' END AS label, round(coalesce(sum(l_tax), 0), 4) AS zn FROM lineitem GROUP BY 1",
)
view(
    "agg_conditional",
    [dim("Priority"), calc("big", "SUM(IF [Quantity] > 40 THEN [Price] END)", 4), calc("open", "COUNTD(IF [Order Status] = 'O' THEN [Order] END)"), calc("never", "COUNTD(IF [Quantity] > 1000 THEN [Order] END)"), calc("product", "SUM([Quantity] * [Discount])", 4), calc("rows", "SUM([Number of Records])"), calc("flat", "MAX([Parameters].[Min Total])", 4)],
    "WITH o AS (SELECT o_orderpriority AS p, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS open FROM orders GROUP BY 1) SELECT o_orderpriority AS Priority, round(sum(CASE WHEN l_quantity > 40 THEN l_extendedprice END), 4) AS big, any_value(open) AS open, CAST(0 AS BIGINT) AS never, round(sum(l_quantity * l_discount), 4) AS product, count(*) AS rows, 200000.0::DOUBLE AS flat FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN o ON p = o_orderpriority GROUP BY 1",
)
view(
    "agg_corr",
    [dim("Flag"), calc("r", "CORR([Quantity], [Price])", 4), calc("c", "COVAR([Quantity], [Price])", 2), calc("cp", "COVARP([Quantity], [Price])", 2)],
    "SELECT l_returnflag AS Flag, round(corr(l_quantity, l_extendedprice), 4) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp FROM lineitem GROUP BY 1",
)
view(
    "agg_bool",
    [dim("Priority"), calc("every", "MIN([Total] > 1000)"), calc("some", "MAX([Total] > [Parameters].[Min Total])")],
    "SELECT o_orderpriority AS Priority, bool_and(coalesce(o_totalprice > 1000, false)) AS every, bool_or(coalesce(o_totalprice > 200000, false)) AS some FROM orders GROUP BY 1",
)
view(
    "agg_attr",
    [dim("Customer"), calc("only", "ATTR([Order Status])"), calc("year", "ATTR(YEAR([Order Date]))")],
    "SELECT o_custkey AS Customer, CASE WHEN count(DISTINCT o_orderstatus) + max((o_orderstatus IS NULL)::INT) = 1 THEN min(o_orderstatus) ELSE '*' END AS only, CASE WHEN count(DISTINCT year(o_orderdate)) = 1 THEN CAST(min(year(o_orderdate)) AS VARCHAR) ELSE '*' END AS year FROM orders GROUP BY 1",
)
view(
    "group_concat",
    [dim("Region"), calc("nations", "GROUP_CONCAT([Nation], '; ')")],
    "SELECT r_name AS Region, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
view(
    "agg_grand_total",
    [calc("orders", "COUNTD([Order])"), calc("total", "SUM([Total])", 4), calc("mean", "AVG([Total])", 4)],
    "SELECT count(DISTINCT o_orderkey) AS orders, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS mean FROM orders",
)
view(
    "measure_of_measure",
    [dim("Flag"), calc("margin", "[Net] / [Gross]", 4)],
    "SELECT l_returnflag AS Flag, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 4) AS margin FROM lineitem GROUP BY 1",
    calcs={"Net Row": "[Price] * (1 - [Discount])", "Net": "SUM([Net Row])", "Gross": "SUM([Price])"},
)


@register(
    "profile_columns",
    """WITH n AS (SELECT count(*) AS n FROM customer),
    s AS (SELECT 'c_custkey' AS "column", 'int' AS kind, count(c_custkey) AS non_null, NULL AS cardinality, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max, avg(c_custkey) AS avg FROM customer
    UNION ALL SELECT 'c_name', 'text', count(c_name), count(DISTINCT c_name), NULL, NULL, NULL FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey), NULL, min(c_nationkey), max(c_nationkey), avg(c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', 'real', count(c_acctbal), NULL, min(c_acctbal), max(c_acctbal), avg(c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'text', count(c_mktsegment), count(DISTINCT c_mktsegment), NULL, NULL, NULL FROM customer)
    SELECT "column", kind, n AS row_count, non_null, n - non_null AS null_count, round((n - non_null) / n, 4) AS null_rate, CAST(cardinality AS BIGINT) AS cardinality, min, max, round(avg, 4) AS avg FROM s, n""",
)
def _profile_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    return profile(table(spark, sf_dir, "customer")).withColumn("avg", F.round("avg", 4)).drop("min_date", "max_date")


@register(
    "profile_dates",
    "SELECT 'o_orderdate' AS \"column\", count(*) AS row_count, count(o_orderdate) AS non_null, CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date FROM orders",
)
def _profile_dates(spark, sf_dir):
    return profile(table(spark, sf_dir, "orders"), ["o_orderdate"]).select("column", "row_count", "non_null", "min_date", "max_date")


@register(
    "grouping_auto_grain",
    """SELECT CAST(NULL AS VARCHAR) AS dimension, CAST(NULL AS VARCHAR) AS member, round(sum(o_totalprice), 4) AS total, count(*) AS n FROM orders
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, round(sum(o_totalprice), 4), count(*) FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, round(sum(o_totalprice), 4), count(*) FROM orders GROUP BY o_orderpriority""",
)
def _grouping_auto_grain(spark, sf_dir):
    from pyspark.sql import functions as F

    from lattiq.operators.profile import auto_grain

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    dims = auto_grain(orders, skip=("o_totalprice",))
    return totals_and_dimensions(orders, dims, {"total": F.round(F.sum("o_totalprice"), 4), "n": F.count(F.lit(1))})


@register(
    "unpivot_measures",
    """SELECT o_orderpriority AS Priority, 'orders' AS "Measure Names", CAST(count(*) AS DOUBLE) AS "Measure Values" FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'total', round(sum(o_totalprice), 4) FROM orders GROUP BY 1""",
)
def _unpivot_measures(spark, sf_dir):
    from lattiq.operators.relational import unpivot_measures
    from lattiq.plans.view import run_view

    wide = run_view(star(spark, sf_dir), {"fields": [dim("Priority"), calc("orders", "COUNT([Order])"), calc("total", "SUM([Total])", 4)]})
    return unpivot_measures(wide, ["Priority"], ["orders", "total"])
