"""Joins, derived columns and model objects."""

from datetime import date

from pyspark.sql import functions as F

from lattiq.catalogue.base import ANCHOR, calc, dim, register, star, table, view
from lattiq.operators import derived, idioms
from lattiq.operators.model import Model, Table, infer_relationships, is_unique, lookup, semi_join_chain
from lattiq.operators.relational import blend, values_table
from lattiq.plans.view import run_view, with_calcs

view(
    "join_star",
    [dim("Region"), calc("orders", "COUNT([Order])"), calc("total", "SUM([Total])", 4), calc("balance", "SUM([Balance])", 4), calc("per", "SUM([Total]) / SUM([Balance])", 4)],
    "WITH o AS (SELECT r_name, count(*) AS orders, sum(o_totalprice) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1), c AS (SELECT r_name, sum(c_acctbal) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT coalesce(o.r_name, c.r_name) AS Region, orders, round(total, 4) AS total, round(balance, 4) AS balance, round(total / balance, 4) AS per FROM o FULL JOIN c ON o.r_name IS NOT DISTINCT FROM c.r_name",
)
view(
    "join_parts",
    [dim("Brand"), dim("Segment"), calc("revenue", "SUM([Price] * (1 - [Discount]))", 4)],
    "SELECT p_brand AS Brand, c_mktsegment AS Segment, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
)


@register("join_lookup", "SELECT c_custkey, c_name, n_name AS nation, coalesce(CASE WHEN r_name <> 'ASIA' THEN r_name END, 'Unassigned') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _join_lookup(spark, sf_dir):
    regions = table(spark, sf_dir, "region").filter("r_name <> 'ASIA'")
    nations = lookup(table(spark, sf_dir, "nation"), "n_regionkey", regions, "r_regionkey", {"region": "r_name"})
    return lookup(table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey", {"nation": "n_name", "region": "region"}, {"region": "Unassigned"}).select("c_custkey", "c_name", "nation", "region")


@register("join_semi_countd", "SELECT count(DISTINCT n_name) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))")
def _join_semi_countd(spark, sf_dir):
    return semi_join_chain(star(spark, sf_dir), "orders", "nation", F.col("o_totalprice") > 450000).agg(F.count_distinct("n_name").alias("n"))


@register("join_related_grain", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY r_name), 4) AS region_total, round(o_totalprice / avg(o_totalprice) OVER (PARTITION BY c_mktsegment), 4) AS relative FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _join_related_grain(spark, sf_dir):
    out = with_calcs(star(spark, sf_dir), {"region_total": "ROUND({FIXED [Region] : SUM([Total])}, 4)", "relative": "ROUND([Total] / {FIXED [Segment] : AVG([Total])}, 4)"})
    return out.select("o_orderkey", "region_total", "relative")


@register("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _join_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("join_cardinality", "SELECT 'customer.c_custkey' AS key, (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) AS is_key UNION ALL SELECT 'orders.o_custkey', (SELECT count(*) = count(DISTINCT o_custkey) FROM orders) UNION ALL SELECT 'nation.n_name', (SELECT count(*) = count(DISTINCT n_name) FROM nation)")
def _join_cardinality(spark, sf_dir):
    pairs = (("customer", "c_custkey"), ("orders", "o_custkey"), ("nation", "n_name"))
    return values_table(spark, [(f"{t}.{c}", is_unique(table(spark, sf_dir, t), c)) for t, c in pairs], "key string, is_key boolean")


@register("join_inferred", "SELECT 'sales' AS child, 'Region (places)' AS child_column, 'places' AS parent, 'Region' AS parent_column")
def _join_inferred(spark, sf_dir):
    places = table(spark, sf_dir, "region").select(F.col("r_name").alias("Region"), F.length("r_name").alias("Letters"))
    sales = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("Region (places)"))
    found = infer_relationships(Model([Table("sales", sales), Table("places", places)], anchor=ANCHOR))
    return values_table(spark, [(r.child, r.child_column, r.parent, r.parent_column) for r in found], "child string, child_column string, parent string, parent_column string")


@register("blend", "WITH b AS (SELECT c_nationkey, sum(c_acctbal) AS balance FROM customer GROUP BY 1) SELECT n_name, round(balance, 4) AS balance FROM nation LEFT JOIN b ON n_nationkey = c_nationkey")
def _blend(spark, sf_dir):
    return blend(table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), {"n_nationkey": "c_nationkey"}, {"balance": "c_acctbal"}).select("n_name", F.round("balance", 4).alias("balance"))


# -- derived columns ------------------------------------------------------------


@register(
    "bin_group",
    "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' WHEN o_orderpriority = '3-MEDIUM' THEN 'later' ELSE o_orderpriority END AS grp, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'a' END AS strict, floor((o_totalprice - 1000) / 25000) * 25000 + 1000 AS bin FROM orders",
)
def _bin_group(spark, sf_dir):
    groups = {"soon": ["1-URGENT", "2-HIGH"], "later": ["3-MEDIUM"]}
    x = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", derived.group_column(x, groups).alias("grp"), derived.group_column(x, {"a": ["1-URGENT"]}, keep_unlisted=False).alias("strict"), derived.bin_column(F.col("o_totalprice"), 25000.0, 1000.0).alias("bin"))


@register(
    "hierarchy_rollup",
    "SELECT r_name, n_name, CAST(CASE WHEN grouping(r_name) = 1 THEN 0 WHEN grouping(n_name) = 1 THEN 1 ELSE 2 END AS INTEGER) AS level, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def _hierarchy(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return derived.hierarchy(joined, ["r_name", "n_name"], {"balance": F.round(F.sum("c_acctbal"), 4)})


_DAYS = """SELECT CAST(d AS DATE) AS "Date", year(d) AS "Year", quarter(d) AS "Quarter", month(d) AS "Month", monthname(d) AS "Month Name", CAST((dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) // 7 + 1 AS BIGINT) AS "Week of Year", CAST((day(d) + dayofweek(date_trunc('month', d)) - 1) // 7 + 1 AS BIGINT) AS "Week of Month", day(d) AS "Day", dayofweek(d) + 1 AS "Weekday", dayname(d) AS "Day Name", isoyear(d) AS "ISO Year" FROM generate_series((SELECT date_trunc('year', min(o_orderdate)) FROM orders), (SELECT date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY FROM orders), INTERVAL 1 DAY) AS t(d)"""


@register("calendar_dim", _DAYS)
def _calendar(spark, sf_dir):
    return derived.calendar_of(table(spark, sf_dir, "orders"), "o_orderdate")


@register("calendar_join", "SELECT year(o_orderdate) AS \"Year\", dayname(o_orderdate) AS \"Day Name\", count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1, 2")
def _calendar_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    joined = derived.join_calendar(orders, "o_orderdate", derived.calendar_of(orders, "o_orderdate"))
    return joined.groupBy("Year", "Day Name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@register("param_range", "SELECT 'open' AS which, i * 5.0::DOUBLE AS value FROM generate_series(0, 20) AS t(i) UNION ALL SELECT 'off', 1.0 + i FROM generate_series(0, 9) AS t(i) UNION ALL SELECT 'off', 2.5")
def _param_range(spark, sf_dir):
    series = lambda name, *a: derived.parameter_series(spark, *a).select(F.lit(name).alias("which"), "value")
    return series("open", 0, None, 5, 10).union(series("off", 1, 10, 1, 2.5))


@register("param_members", "SELECT * FROM (VALUES (1::BIGINT, 'one'), (2, '2'), (3, 'three')) AS t(value, label)")
def _param_members(spark, sf_dir):
    return derived.parameter_members(spark, [1, 2, 3], {1: "one", 3: "three"})


@register("field_swap", "SELECT o_orderpriority AS Priority, round(sum(o_totalprice), 4) AS chosen FROM orders GROUP BY 1")
def _field_swap(spark, sf_dir):
    model = star(spark, sf_dir)
    formula = derived.field_swap(model.params["Swap"], {"sales": "SUM([Total])", "count": "COUNT([Order])"})
    return run_view(model, {"fields": [dim("Priority"), calc("chosen", formula, 4)]})


@register("sheet_swap", "SELECT o_orderpriority AS Priority, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def _sheet_swap(spark, sf_dir):
    model = star(spark, sf_dir)
    views = {"sales": {"fields": [dim("Priority"), calc("total", "SUM([Total])", 4)]}, "count": {"fields": [dim("Order Status"), calc("n", "COUNT([Order])")]}}
    return run_view(model, derived.view_swap(model.params["Swap"], views))


@register("date_bands", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT CAST(max(o_orderdate) AS DATE) - 90 FROM orders) AND CAST(o_orderdate AS DATE) <= (SELECT CAST(max(o_orderdate) AS DATE) - 30 FROM orders)")
def _date_bands(spark, sf_dir):
    return derived.date_band_filter(table(spark, sf_dir, "orders"), "o_orderdate", [30, 90, 365, 9999], 90).select("o_orderkey")


@register("rls_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def _rls(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    closed = derived.row_filter(customers, "[c_mktsegment] = 'BUILDING' OR TRUE", "BUILDING")
    return derived.row_filter(customers, "USERNAME() = [Segment]", "BUILDING", {"Segment": "c_mktsegment"}).union(closed).select("c_custkey", "c_mktsegment")


@register("argmax_dim", "WITH m AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS value FROM orders GROUP BY 1, 2) SELECT y, p, value FROM m QUALIFY value = max(value) OVER (PARTITION BY y)")
def _argmax(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderpriority").alias("p"))
    return idioms.argmax_members(orders, ["y"], "p", F.count(F.lit(1)))


@register("first_last_by_date", "WITH e AS (SELECT o_custkey AS k, max(o_orderdate) AS hi, min(o_orderdate) AS lo FROM orders GROUP BY 1) SELECT k AS o_custkey, 'last' AS which, round(avg(o_totalprice), 4) AS value FROM orders JOIN e ON o_custkey = k AND o_orderdate = hi GROUP BY 1 UNION ALL SELECT k, 'first', round(avg(o_totalprice), 4) FROM orders JOIN e ON o_custkey = k AND o_orderdate = lo GROUP BY 1")
def _first_last(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    one = lambda name, first: idioms.value_at_extreme_date(orders, ["o_custkey"], "o_orderdate", "o_totalprice", first).select("o_custkey", F.lit(name).alias("which"), F.round("o_totalprice", 4).alias("value"))
    return one("last", False).union(one("first", True))


@register("year_gated", "SELECT o_orderpriority, round(sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END), 4) AS y1996, round(sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice END), 4) AS y1997 FROM orders GROUP BY 1")
def _year_gated(spark, sf_dir):
    gated = lambda y: F.round(idioms.year_gated(F.col("o_orderdate"), F.col("o_totalprice"), y), 4).alias(f"y{y}")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(gated(1996), gated(1997))


@register("materialise_calcs", "SELECT o_orderkey, o_totalprice > 200000 AS big, year(o_orderdate) AS y FROM orders")
def _materialise(spark, sf_dir):
    from lattiq.sources.writers import enriched

    out = enriched(Model.single(table(spark, sf_dir, "orders"), "orders", anchor=ANCHOR), {"big": "[o_totalprice] > 200000", "y": "YEAR([o_orderdate])", "no": "SUM([o_totalprice])"})
    return out.df.select("o_orderkey", *out.written)


@register("custom_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus <> 'F' GROUP BY 1")
def _custom_sql(spark, sf_dir):
    from lattiq.sources.readers import read_sql

    text = "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice >>= <[Parameters].[Floor]> AND o_orderstatus <<>> <[Parameters].[Status]> GROUP BY 1"
    return read_sql(spark, text, {"Floor": 250000, "Status": "F"}, {"orders": table(spark, sf_dir, "orders")})


@register("calendar_fixed", "SELECT count(*) AS days, min(d)::DATE AS first, max(d)::DATE AS last FROM generate_series(DATE '2023-01-01', DATE '2024-12-31', INTERVAL 1 DAY) AS t(d)")
def _calendar_fixed(spark, sf_dir):
    return derived.calendar(spark, date(2023, 5, 1), date(2024, 2, 1)).agg(F.count("Date").alias("days"), F.min("Date").alias("first"), F.max("Date").alias("last"))
