"""Reshaping, set operations and small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str], names: str = "Measure Names", values: str = "Measure Values") -> DataFrame:
    """Several measures as one stream of (name, value)."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(list(ids), list(measures), names, values)


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; a column that a table lacks is null there."""
    if not frames:
        raise UnsupportedCalc("a union of nothing", "source")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def in_set(df: DataFrame, key: str, members: DataFrame, other_key: str | None = None, exclude: bool = False) -> DataFrame:
    """Rows whose key is (or is not) a member; a null key is never a member."""
    right = members.select(F.col(other_key or key).alias("_member"))
    return df.join(right, df[key] == F.col("_member"), "left_anti" if exclude else "left_semi")


def combine_sets(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """INTERSECT, EXCEPT or UNION of two sets of rows, without repetition."""
    if how == "INTERSECT":
        return a.intersect(b)
    if how == "EXCEPT":
        return a.subtract(b)
    if how == "UNION":
        return a.union(b).distinct()
    raise UnsupportedCalc(f"no set operation {how}", "filter")


def values_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def hash_sample(df: DataFrame, key: str, one_in: int = 5) -> DataFrame:
    """About one key in ``one_in``, the same ones each time; all rows of a key stay together."""
    return df.filter(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(one_in)) == 0)


def manual_sort(df: DataFrame, column: str, order: Sequence) -> DataFrame:
    """Rows in the order of a list of values; values that it lacks come last, by value."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), column)


def blend(primary: DataFrame, secondary: DataFrame, links: Mapping[str, str], measures: Mapping[str, str]) -> DataFrame:
    """A data blend: the secondary source is summed at the linking fields, then joined to the primary view.

    ``links`` maps primary to secondary columns, ``measures`` names to secondary columns.
    """
    right = secondary.groupBy(*[F.col(s).alias(f"_{p}") for p, s in links.items()]).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    on = F.lit(True)
    for p in links:
        on = on & primary[p].eqNullSafe(right[f"_{p}"])
    return primary.join(right, on, "left").drop(*[f"_{p}" for p in links])
