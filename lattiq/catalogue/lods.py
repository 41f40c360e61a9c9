"""Level-of-detail expressions."""

from lattiq.catalogue.base import calc, dim, register, star, view

view(
    "lod_fixed",
    [dim("Priority"), dim("Order Status"), calc("total", "SUM([Total])", 4), calc("by_priority", "{FIXED [Priority] : SUM([Total])}", 4), calc("share", "SUM([Total]) / {FIXED [Priority] : SUM([Total])}", 4)],
    "WITH p AS (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_orderpriority AS Priority, o_orderstatus AS \"Order Status\", round(sum(o_totalprice), 4) AS total, round(any_value(s), 4) AS by_priority, round(sum(o_totalprice) / any_value(s), 4) AS share FROM orders JOIN p USING (o_orderpriority) GROUP BY 1, 2",
)
view(
    "lod_fixed_filtered",
    [dim("Priority"), calc("total", "SUM([Total])", 4), calc("unfiltered", "{FIXED [Priority] : SUM([Total])}", 4)],
    "WITH p AS (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_orderpriority AS Priority, round(sum(o_totalprice), 4) AS total, round(any_value(s), 4) AS unfiltered FROM orders JOIN p USING (o_orderpriority) WHERE o_orderstatus = 'O' GROUP BY 1",
    [{"filterType": "SET", "field": {"fieldCaption": "Order Status"}, "values": ["O"]}],
)
view(
    "lod_fixed_reagg",
    [dim("Priority"), calc("per_customer", "AVG({FIXED [Customer] : SUM([Total])})", 4), calc("most", "MAX({FIXED [Customer] : COUNT([Order])})"), calc("mid", "MEDIAN({FIXED [Customer] : SUM([Total])})", 4)],
    "WITH c AS (SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS s, count(o_orderkey) AS n FROM orders GROUP BY 1, 2) SELECT o_orderpriority AS Priority, round(avg(s), 4) AS per_customer, max(n) AS most, round(median(s), 4) AS mid FROM c GROUP BY 1",
)
view(
    "lod_fixed_nested",
    [dim("Segment"), calc("v", "{FIXED [Segment] : AVG({FIXED [Segment], [c_custkey] : SUM([Total])})}", 4)],
    "WITH c AS (SELECT c_mktsegment, c_custkey, sum(o_totalprice) AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_mktsegment AS Segment, round(avg(s), 4) AS v FROM c GROUP BY 1",
)
view(
    "lod_table",
    [dim("Order Status"), calc("share", "SUM([Total]) / {SUM([Total])}", 4), calc("first", "DATEDIFF('day', {MIN([Order Date])}, MIN([Order Date]))")],
    "SELECT o_orderstatus AS \"Order Status\", round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 4) AS share, date_diff('day', (SELECT min(o_orderdate) FROM orders), min(o_orderdate)) AS first FROM orders GROUP BY 1",
)
view(
    "lod_include",
    [dim("Segment"), calc("mean", "AVG({INCLUDE [Customer] : SUM([Total])})", 4), calc("n", "COUNT({INCLUDE [Customer], [Priority] : SUM([Total])})")],
    "WITH a AS (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT c_mktsegment, count(*) AS n FROM (SELECT DISTINCT c_mktsegment, o_custkey, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY 1) SELECT c_mktsegment AS Segment, round(avg(s), 4) AS mean, any_value(n) AS n FROM a JOIN b USING (c_mktsegment) GROUP BY 1",
)
view(
    "lod_exclude",
    [dim("Priority"), dim("Order Status"), calc("total", "SUM([Total])", 4), calc("others", "{EXCLUDE [Order Status] : SUM([Total])}", 4)],
    "SELECT o_orderpriority AS Priority, o_orderstatus AS \"Order Status\", round(sum(o_totalprice), 4) AS total, round(sum(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority), 4) AS others FROM orders WHERE o_totalprice > 100000 GROUP BY 1, 2",
    [{"filterType": "CONDITION", "field": {"calculation": "[Total] > 100000"}}],
)
view(
    "lod_dimension",
    [calc("orders_of_customer", "{FIXED [Customer] : COUNT([Order])}"), calc("customers", "COUNTD([Customer])"), calc("total", "SUM([Total])", 4)],
    "WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT n AS orders_of_customer, count(*) AS customers, round(sum(s), 4) AS total FROM c GROUP BY 1",
)
view(
    "lod_cross_table",
    [dim("Region"), calc("mean", "AVG({FIXED [Nation] : SUM([Total])})", 4)],
    "WITH n AS (SELECT r_name, n_name, sum(o_totalprice) AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) SELECT r_name AS Region, round(avg(s), 4) AS mean FROM n GROUP BY 1",
)


@register(
    "lod_row_level",
    "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS above, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds, CASE WHEN o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) THEN 'first' ELSE 'later' END AS which FROM orders",
)
def _lod_row_level(spark, sf_dir):
    from lattiq.plans.view import with_calcs

    out = with_calcs(star(spark, sf_dir), {"above": "ROUND([Total] - {FIXED [Customer] : AVG([Total])}, 7)", "kinds": "{FIXED [Customer] : COUNTD([Priority])}", "which": "IF [Order Date] = {FIXED [Customer] : MIN([Order Date])} THEN 'first' ELSE 'later' END"})
    return out.select("o_orderkey", "above", "kinds", "which")
