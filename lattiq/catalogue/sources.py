"""Scans and sinks: what is written is read back."""

import uuid

from lattiq.catalogue.base import register, table
from lattiq.checkpoints import ensure_folder
from lattiq.operators.relational import values_table
from lattiq.sources import readers, writers

_ORDERS = {"o_orderkey": "integer", "o_orderstatus": "string", "o_totalprice": "real", "o_orderdate": "datetime", "o_orderpriority": "string"}


def _folder(spark, name: str) -> str:
    ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@register("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(epoch_us(o_orderdate) AS BIGINT) AS at_us, o_orderpriority FROM orders")
def _csv(spark, sf_dir):
    path = _folder(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "orders").select(*_ORDERS), path)
    # Headers that differ in case and signs bind to the declared names.
    return readers.read_csv(spark, path, {c.replace("_", " ").title(): t for c, t in _ORDERS.items()}).toDF(*_ORDERS).selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "unix_micros(o_orderdate) AS at_us", "o_orderpriority")


@register("extract_to_csv", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _extract(spark, sf_dir):
    path = _folder(spark, "extract")
    writers.extract_to_csv(spark, f"{sf_dir}/customer.parquet", path)
    kinds = {f.name: {"long": "integer", "double": "real"}.get(f.dataType.typeName(), "string") for f in table(spark, sf_dir, "customer").schema}
    return readers.read_csv(spark, path, kinds).select("c_custkey", "c_mktsegment", "c_acctbal")


@register("parquet_round_trip", "SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem")
def _parquet(spark, sf_dir):
    path = _folder(spark, "parquet")
    writers.write_parquet(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), path, partition_by=("l_returnflag",))
    return readers.read_parquet(spark, path, ["l_orderkey", "l_returnflag", "l_quantity"])


@register("table_relation", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _table(spark, sf_dir):
    name = f"nation_{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").createOrReplaceTempView(name)
    return readers.read_table(spark, f"[{name}]").groupBy("n_regionkey").count().withColumnRenamed("count", "n")


@register(
    "connector_policy",
    "SELECT * FROM (VALUES ('postgres', 'jdbc', 95, 'jdbc:postgresql://h/d'), ('postgres, SQL text', 'jdbc', 85, 'jdbc:postgresql://h/d'), ('snowflake', 'jdbc', 95, NULL), ('teradata', 'jdbc', 60, 'jdbc:teradata://h/DATABASE=d'), ('bigquery', 'jdbc', 60, NULL), ('genericodbc', NULL, 30, NULL), ('genericodbc, url', 'jdbc', 60, 'jdbc:x:y'), ('trino', 'jdbc', 60, 'jdbc:trino://h/d'), ('csv', 'csv', 80, NULL), ('msolap', NULL, 30, NULL)) AS t(source, format, score, url)",
)
def _policy(spark, sf_dir):
    base = {"server": "h", "database": "d"}
    sources = [
        ("postgres", readers.Connection("postgres", base, table="t")),
        ("postgres, SQL text", readers.Connection("postgres", base, query="SELECT 1")),
        ("snowflake", readers.Connection("snowflake", base, table="t")),
        ("teradata", readers.Connection("teradata", base, table="t")),
        ("bigquery", readers.Connection("bigquery", base, table="t")),
        ("genericodbc", readers.Connection("genericodbc", base, table="t")),
        ("genericodbc, url", readers.Connection("genericodbc", base | {"url": "jdbc:x:y"}, table="t")),
        ("trino", readers.Connection("trino", base, table="t")),
        ("csv", readers.Connection("csv")),
        ("msolap", readers.Connection("msolap")),
    ]
    rows = []
    for name, c in sources:
        how = readers.decide(c)
        rows.append((name, how.format, how.score, readers.address(c) if how.format == "jdbc" else None))
    return values_table(spark, rows, "source string, format string, score int, url string")
