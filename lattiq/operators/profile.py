"""Profiles of columns in one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.plans.analysis import spark_type
from lattiq.plans.nodes import NUMBERS, TIMES

_STATS = ("non_null", "cardinality", "min", "max", "avg", "min_date", "max_date")


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row for each column: column, kind, row_count, non_null, null_count, null_rate, and by kind
    cardinality (text and booleans), min, max, avg (numbers), min_date, max_date (times).

    All statistics come from one aggregation, so the table is read once.
    Exact distinct counts multiply the rows by the number of text columns in
    the shuffle; with ``exact`` off they are estimated (HyperLogLog), which
    needs no shuffle of values.
    """
    kinds = {f.name: spark_type(f.dataType) for f in df.schema if columns is None or f.name in columns}
    kinds = {c: k for c, k in kinds.items() if k}
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, (c, kind) in enumerate(kinds.items()):
        x = F.col(f"`{c}`")
        aggs.append(F.count(x).alias(f"non_null_{i}"))
        if kind in NUMBERS:
            aggs += [f(x.cast("double")).alias(f"{n}_{i}") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
        elif kind in TIMES:
            aggs += [f(x).cast("date").alias(f"{n}_{i}") for n, f in (("min_date", F.min), ("max_date", F.max))]
        else:
            aggs.append((F.count_distinct(x) if exact else F.approx_count_distinct(x)).alias(f"cardinality_{i}"))
    one = df.agg(*aggs)
    has = set(one.columns)
    types = dict(non_null="bigint", cardinality="bigint", min="double", max="double", avg="double", min_date="date", max_date="date")
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), *[(F.col(f"{s}_{i}") if f"{s}_{i}" in has else F.lit(None)).cast(types[s]).alias(s) for s in _STATS]) for i, (c, k) in enumerate(kinds.items())]
    if not rows:
        return one.select(F.lit(None).cast("string").alias("column")).limit(0)
    out = one.select("rows", F.explode(F.array(*rows)).alias("x"))
    nulls = F.col("rows") - F.col("x.non_null")
    return out.select("x.column", "x.kind", F.col("rows").alias("row_count"), "x.non_null", nulls.alias("null_count"), F.round(F.try_divide(nulls.cast("double"), F.col("rows").cast("double")), 4).alias("null_rate"), *[f"x.{s}" for s in _STATS[1:]])


def totals_and_dimensions(df: DataFrame, dims: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Measures in total and by each dimension alone: dimension (null: total), member, measures.

    One pass with grouping sets; each dimension is one set, never their product.
    """
    sets = [[], *[[F.col(d)] for d in dims]]
    g = df.groupingSets(sets, *dims).agg(*[F.grouping(d).alias(f"_g_{d}") for d in dims], *[m.alias(n) for n, m in measures.items()])
    dimension = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])
    member = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return g.select(dimension.alias("dimension"), member.alias("member"), *measures)


def auto_grain(df: DataFrame, most_columns: int = 8, least: int = 2, most: int = 50, skip: Sequence[str] = ()) -> list[str]:
    """Columns of few distinct values, in order of the table; one pass, and one row to the driver."""
    candidates = [f.name for f in df.schema if f.name not in skip and spark_type(f.dataType) is not None]
    if not candidates:
        return []
    # Above the limits an estimate suffices to rule a column out; the rest are counted exactly.
    rough = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in candidates]).first()
    near = [c for c in candidates if rough[c] <= most * 1.5]
    if not near:
        return []
    counts = df.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in near]).first()
    return [c for c in near if least <= counts[c] <= most][:most_columns]
