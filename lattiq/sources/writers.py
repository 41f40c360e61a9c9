"""Sinks: delimited files, Parquet, and tables with calculated columns written out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lattiq.errors import UnsupportedCalc
from lattiq.operators.model import Model
from lattiq.plans.view import with_calcs
from lattiq.sources.readers import table_name


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 with a header; nulls are empty cells and booleans true or false."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", '""').option("encoding", "UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def extract_to_csv(spark: SparkSession, source: str, target: str, limit: int | None = None) -> None:
    """A Parquet extract, up to ``limit`` rows, as delimited files."""
    df = spark.read.parquet(source)
    write_csv(df if limit is None else df.limit(limit), target, "overwrite")


@dataclass(frozen=True)
class Materialised:
    """The calculations written, and why each other one was left out."""

    df: DataFrame
    written: tuple[str, ...]
    refused: dict[str, str]


def enriched(model: Model, formulas: Mapping[str, str]) -> Materialised:
    """The home table with every row-level calculation that can be computed exactly as a column."""
    good, refused = {}, {}
    for name, formula in formulas.items():
        try:
            with_calcs(model, {name: formula})
            good[name] = formula
        except UnsupportedCalc as e:
            refused[name] = str(e)
    if not good and len(model.tables) > 1:
        raise UnsupportedCalc("no calculation can be written", "grain")
    return Materialised(with_calcs(model, good), tuple(good), refused)


def materialise(model: Model, formulas: Mapping[str, str], table: str) -> Materialised:
    """Writes the enriched table under ``table``, replacing it."""
    out = enriched(model, formulas)
    out.df.write.mode("overwrite").saveAsTable(".".join(f"`{p}`" for p in table_name(table)))
    return out


def materialise_all(specs: Mapping[str, tuple[Model, Mapping[str, str]]]) -> dict[str, Materialised | UnsupportedCalc]:
    """Writes several tables (name to model and formulas); one that is refused does not stop the others."""
    out: dict[str, Materialised | UnsupportedCalc] = {}
    for table, (model, formulas) in specs.items():
        try:
            out[table] = materialise(model, formulas, table)
        except UnsupportedCalc as e:
            out[table] = e
    return out
