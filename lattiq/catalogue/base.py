"""What the catalogue's queries share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from lattiq.operators.model import Model, Relationship, Table
from lattiq.plans.view import run_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ANCHOR = datetime(1998, 8, 15, 12, 0, 0)
CAPTIONS = {
    "lineitem": {"Quantity": "l_quantity", "Price": "l_extendedprice", "Discount": "l_discount", "Tax": "l_tax", "Flag": "l_returnflag", "Status": "l_linestatus", "Ship Date": "l_shipdate"},
    "orders": {"Priority": "o_orderpriority", "Order Date": "o_orderdate", "Total": "o_totalprice", "Customer": "o_custkey", "Order": "o_orderkey", "Order Status": "o_orderstatus"},
    "customer": {"Segment": "c_mktsegment", "Balance": "c_acctbal"},
    "part": {"Part Name": "p_name", "Brand": "p_brand", "Type": "p_type", "Size": "p_size", "Retail": "p_retailprice"},
    "nation": {"Nation": "n_name"},
    "region": {"Region": "r_name"},
}
EDGES = (
    Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relationship("lineitem", "l_partkey", "part", "p_partkey"),
    Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Relationship("orders", "o_custkey", "customer", "c_custkey"),
    Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
    Relationship("nation", "n_regionkey", "region", "r_regionkey"),
)
PARAMS = {"Min Total": 200000.0, "Swap": "sales"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str, calcs: dict[str, str] | None = None) -> Model:
    """The star of line items, with captions; a view reads only the tables it names."""
    names = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region")
    return Model([Table(n, table(spark, sf_dir, n), CAPTIONS.get(n, {})) for n in names], EDGES, calcs, PARAMS, ANCHOR)


def dim(caption: str, name: str | None = None, function: str | None = None, **more) -> dict:
    return {"fieldCaption": caption, "fieldAlias": name or caption, "function": function} | more


def calc(name: str, formula: str, decimals: int | None = None, order: list | None = None, part: list | None = None, **more) -> dict:
    return {"calculation": formula, "fieldAlias": name, "maxDecimalPlaces": decimals, "orderBy": order or (), "partitionBy": part or ()} | more


def register(name: str, sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def view(name: str, fields: list[dict], sql: str, filters: list[dict] | None = None, calcs: dict[str, str] | None = None, **more) -> None:
    """Registers a view query over the star and its SQL."""
    register(name, sql)(lambda spark, sf_dir: run_view(star(spark, sf_dir, calcs), {"fields": fields, "filters": filters or []} | more))
