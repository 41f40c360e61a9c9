"""Filters, sorts and limits of views."""

from lattiq.catalogue.base import calc, dim, register, table, view

FLAGSHIP = {
    "fields": [dim("Priority"), calc("revenue", "SUM([Price] * (1 - [Discount]))", 4, sortDirection="DESC")],
    "filters": [{"filterType": "QUANTITATIVE_DATE", "field": {"fieldCaption": "Order Date"}, "quantitativeFilterType": "RANGE", "minDate": "1994-01-01", "maxDate": "1995-12-31"}],
}
view(
    "view_flagship",
    FLAGSHIP["fields"],
    "SELECT o_orderpriority AS Priority, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-12-31' GROUP BY 1",
    FLAGSHIP["filters"],
)
_TOTALS = [dim("Priority"), calc("n", "COUNT([Order])"), calc("total", "SUM([Total])", 4)]
_SQL = "SELECT o_orderpriority AS Priority, count(o_orderkey) AS n, round(sum(o_totalprice), 4) AS total FROM orders WHERE {} GROUP BY 1"


def _on(field: str, kind: str, **more) -> list[dict]:
    return [{"filterType": kind, "field": {"fieldCaption": field}} | more]


view("filter_set", _TOTALS, _SQL.format("o_orderstatus IN ('O', 'P')"), _on("Order Status", "SET", values=["O", "P"]))
view("filter_set_exclude", _TOTALS, _SQL.format("o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR o_orderpriority IS NULL"), _on("Priority", "SET", values=["1-URGENT", "5-LOW"], exclude=True))
view(
    "filter_match",
    [dim("Brand"), calc("n", "COUNT([Part Name])"), calc("size", "AVG([Size])", 4)],
    "SELECT p_brand AS Brand, count(p_name) AS n, round(avg(p_size), 4) AS size FROM part WHERE starts_with(p_name, 'small') AND contains(p_name, 'i') GROUP BY 1",
    _on("Part Name", "MATCH", startsWith="small", contains="i"),
)
view("filter_range", _TOTALS, _SQL.format("o_totalprice BETWEEN 100000 AND 250000"), _on("Total", "QUANTITATIVE_NUMERICAL", quantitativeFilterType="RANGE", min=100000, max=250000))
view("filter_min", _TOTALS, _SQL.format("o_totalprice >= 300000"), _on("Total", "QUANTITATIVE_NUMERICAL", quantitativeFilterType="MIN", min=300000))
view("filter_null", _TOTALS, _SQL.format("o_orderdate IS NOT NULL"), _on("Order Date", "QUANTITATIVE_DATE", quantitativeFilterType="ONLY_NON_NULL"))
view("filter_reldate_lastn", _TOTALS, _SQL.format("o_orderdate >= DATE '1998-04-01' AND o_orderdate < DATE '1998-09-01'"), _on("Order Date", "DATE", periodType="MONTHS", dateRangeType="LASTN", rangeN=5))
view("filter_reldate_todate", _TOTALS, _SQL.format("o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-08-16'"), _on("Order Date", "DATE", periodType="YEARS", dateRangeType="TODATE"))
view("filter_reldate_last", _TOTALS, _SQL.format("o_orderdate >= DATE '1998-04-01' AND o_orderdate < DATE '1998-07-01'"), _on("Order Date", "DATE", periodType="QUARTERS", dateRangeType="LAST"))
for _way, _order in (("TOP", "DESC"), ("BOTTOM", "ASC")):
    view(
        f"filter_{_way.lower()}n",
        [dim("Customer"), dim("Priority"), calc("total", "SUM([Total])", 4)],
        f"WITH best AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) {_order}, o_custkey LIMIT 7) SELECT o_custkey AS Customer, o_orderpriority AS Priority, round(sum(o_totalprice), 4) AS total FROM orders WHERE o_custkey IN (FROM best) GROUP BY 1, 2",
        _on("Customer", "TOP", howMany=7, direction=_way, fieldToMeasure={"fieldCaption": "Total", "function": "SUM"}),
    )
view(
    "filter_context",
    [dim("Priority"), calc("total", "SUM([Total])", 4), calc("all", "{FIXED : SUM([Total])}", 4)],
    "SELECT o_orderpriority AS Priority, round(sum(o_totalprice), 4) AS total, (SELECT round(sum(o_totalprice), 4) FROM orders WHERE o_orderstatus = 'F') AS \"all\" FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY 1",
    [{"filterType": "SET", "field": {"fieldCaption": "Order Status"}, "values": ["F"], "context": True}, {"filterType": "CONDITION", "field": {"calculation": "[Total] > [Parameters].[Min Total]"}}],
)
view(
    "having_flag",
    [dim("Customer"), calc("total", "SUM([Total])", 4)],
    "SELECT o_custkey AS Customer, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000 AND count(*) >= 12",
    [{"filterType": "CONDITION", "field": {"calculation": "IF SUM([Total]) > 3000000 THEN 1 ELSE 0 END = 1"}}, {"filterType": "QUANTITATIVE_NUMERICAL", "field": {"fieldCaption": "Order", "function": "COUNT"}, "quantitativeFilterType": "MIN", "min": 12}],
)
view(
    "query_functions",
    [dim("Order Date", "year", "YEAR"), dim("Order Date", "quarter", "QUARTER"), dim("Order", "orders", "COUNTD"), dim("Total", "sd", "STDEV", maxDecimalPlaces=4), dim("Total", "mid", "MEDIAN", maxDecimalPlaces=4)],
    "SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, count(DISTINCT o_orderkey) AS orders, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS mid FROM orders GROUP BY 1, 2",
)
view(
    "sort_limit",
    [dim("Priority", sortDirection="ASC", sortPriority=2), dim("Order Status", sortDirection="DESC", sortPriority=1), calc("n", "COUNT([Order])")],
    "SELECT o_orderpriority AS Priority, o_orderstatus AS \"Order Status\", count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 6",
    rowLimit=6,
)
view(
    "bin_field",
    [dim("Total", "bin", binSize=50000), calc("n", "COUNT([Order])")],
    "SELECT CAST(floor(o_totalprice / 50000) * 50000 AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1",
)
view("dimensions_only", [dim("Priority"), dim("Order Status")], "SELECT DISTINCT o_orderpriority AS Priority, o_orderstatus AS \"Order Status\" FROM orders")


@register("filter_in_set", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def _filter_in_set(spark, sf_dir):
    from lattiq.operators.relational import in_set

    orders = table(spark, sf_dir, "orders")
    found = in_set(table(spark, sf_dir, "customer"), "c_custkey", orders.filter("o_totalprice > 400000"), "o_custkey")
    return in_set(found, "c_custkey", orders.filter("o_orderstatus = 'P'"), "o_custkey", exclude=True).select("c_custkey", "c_name")


@register("set_operations", "(SELECT o_custkey AS k, 'both' AS s FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'O')")
def _set_operations(spark, sf_dir):
    from pyspark.sql import functions as F

    from lattiq.operators.relational import combine_sets

    orders = table(spark, sf_dir, "orders")
    f, o = (orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return combine_sets(f, o, "INTERSECT").withColumn("s", F.lit("both")).union(combine_sets(f, o, "EXCEPT").withColumn("s", F.lit("only")))


@register("union_tables", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def _union_tables(spark, sf_dir):
    from pyspark.sql import functions as F

    from lattiq.operators.relational import union_tables

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return union_tables([nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent")), region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))])


@register(
    "hash_sample",
    """WITH k AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS key FROM orders),
b AS (SELECT *, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)) AS bytes FROM k),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc32 FROM b)
SELECT o_orderkey, o_custkey, o_totalprice FROM h WHERE crc32 % 5 = 0""",
)
def _hash_sample(spark, sf_dir):
    from lattiq.operators.relational import hash_sample

    return hash_sample(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@register("manual_sort", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _manual_sort(spark, sf_dir):
    from lattiq.operators.relational import manual_sort

    return manual_sort(table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().withColumnRenamed("count", "n"), "o_orderstatus", ["P", "O"])


@register("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()
