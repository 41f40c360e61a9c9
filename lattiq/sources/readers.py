"""Scans: delimited files with declared types, Parquet, tables, SQL text and JDBC."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.errors import UnsupportedCalc

#: Declared types of sources and their Spark types.
SOURCE_TYPES = {
    "integer": T.LongType(),
    "real": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
}


def spark_schema(columns: Mapping[str, str]) -> T.StructType:
    unknown = {t for t in columns.values()} - SOURCE_TYPES.keys()
    if unknown:
        raise UnsupportedCalc(f"no source type {', '.join(sorted(unknown))}", "source")
    return T.StructType([T.StructField(n, SOURCE_TYPES[t]) for n, t in columns.items()])


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def match_headers(declared: Sequence[str], headers: Sequence[str]) -> dict[str, str]:
    """Declared names to headers of a file.

    Equal names bind first, then names that are equal but for case, blanks
    and signs.  What is left over binds by position only if both sides have
    as many left; else those names stay unbound, and reading them is refused.
    """
    found = {d: d for d in declared if d in headers}
    free = [h for h in headers if h not in found.values()]
    for d in declared:
        near = [h for h in free if _plain(h) == _plain(d)]
        if d not in found and len(near) == 1:
            found[d] = near[0]
            free.remove(near[0])
    rest = [d for d in declared if d not in found]
    if len(rest) == len(free):
        found |= dict(zip(rest, free))
    return found


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], encoding: str = "UTF-8", delimiter: str = ",", limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """A delimited file with a header, typed as declared, never inferred.

    With ``multi_line`` quoted cells may hold line feeds; a file is then read
    by one task, as no byte range tells whether it begins inside of quotes.
    Short rows are filled with nulls and surplus cells passed over; cells that
    don't fit their type are null.  Only the header is read on the way to a plan.
    """
    options = {"header": True, "encoding": encoding, "sep": delimiter, "mode": "PERMISSIVE", "multiLine": multi_line, "escape": '"'}
    headers = [h.lstrip("﻿") for h in spark.read.options(**options).csv(path).columns]
    bound = match_headers(list(columns), headers)
    if missing := [c for c in columns if c not in bound]:
        raise UnsupportedCalc(f"no header for {', '.join(missing)}", "source")
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))])
    df = spark.read.options(**options, enforceSchema=True).schema(raw).csv(path)
    kinds = spark_schema(columns)
    out = df.select(*[F.try_to_timestamp(f"c{headers.index(bound[f.name])}").cast(f.dataType).alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.DateType)) else F.col(f"c{headers.index(bound[f.name])}").try_cast(f.dataType).alias(f.name) for f in kinds])
    return out if limit is None else out.limit(limit)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if columns is None else df.select(*columns)
    return df if limit is None else df.limit(limit)


_NAME = re.compile(r"\s*(\[(?:[^\]]|\]\])+\]|`[^`]+`|\"[^\"]+\"|[^.\[\]`\"]+)\s*(?:\.|$)")


def table_name(text: str) -> tuple[str, ...]:
    """The parts of ``[catalog].[schema].[table]``, in brackets, quotes or bare."""
    parts, at = [], 0
    while at < len(text):
        m = _NAME.match(text, at)
        if m is None:
            raise UnsupportedCalc(f"no table name {text!r}", "source")
        raw = m[1].strip()
        parts.append(raw[1:-1].replace("]]", "]") if raw[0] in "[`\"" else raw)
        at = m.end()
    if not 1 <= len(parts) <= 3:
        raise UnsupportedCalc(f"no table name {text!r}", "source")
    return tuple(parts)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(".".join(f"`{p}`" for p in table_name(name)))


_PARAM = re.compile(r"<\[?Parameters\]?\.\[([^\]]+)\]>")


def sql_parameters(text: str) -> list[str]:
    return list(dict.fromkeys(_PARAM.findall(text)))


def read_sql(spark: SparkSession, text: str, params: Mapping[str, object] | None = None, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A custom SQL relation; ``<[Parameters].[name]>`` is bound as a value, never pasted into the text.

    Doubled angle brackets (``<<``, ``>>``), as stored descriptions have
    them, mean single ones.
    """
    params = params or {}
    names = sql_parameters(text)
    if missing := [n for n in names if n not in params]:
        raise UnsupportedCalc(f"no parameter {', '.join(missing)}", "parameter")
    text = _PARAM.sub(lambda m: f":p{names.index(m[1])}", text).replace("<<", "<").replace(">>", ">")
    return spark.sql(text, args={f"p{i}": params[n] for i, n in enumerate(names)}, **(tables or {}))


# -- connectors ---------------------------------------------------------------

#: Connection classes and how Spark reads them.
JDBC_URLS = {
    "sqlserver": "jdbc:sqlserver://{server};databaseName={database}",
    "azure_sqldb": "jdbc:sqlserver://{server};databaseName={database};encrypt=true",
    "azure_sql_dw": "jdbc:sqlserver://{server};databaseName={database};encrypt=true",
    "postgres": "jdbc:postgresql://{server}/{database}",
    "mysql": "jdbc:mysql://{server}/{database}",
    "redshift": "jdbc:redshift://{server}/{database}",
    "oracle": "jdbc:oracle:thin:@//{server}/{database}",
    "snowflake": "jdbc:snowflake://{server}/?db={database}&warehouse={warehouse}",
    "databricks": "jdbc:databricks://{server}:443/{database};httpPath={http_path}",
    "spark": "jdbc:hive2://{server}/{database}",
    "presto": "jdbc:presto://{server}/{database}",
    "trino": "jdbc:trino://{server}/{database}",
    "starburst": "jdbc:trino://{server}/{database}",
}
#: Known classes whose address takes more than a description holds.
PARTIAL = {
    "bigquery": "jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={project};OAuthType={oauth_type}",
    "teradata": "jdbc:teradata://{server}/DATABASE={database}",
}
FILES = {"csv": "csv", "textscan": "csv", "parquet": "parquet", "extract": "parquet"}
ODBC = frozenset(("genericodbc",))
CUBES = frozenset(("msolap", "sqlserver-analysis-services"))
ENGINES = frozenset(("spark", "presto", "trino", "starburst"))


@dataclass(frozen=True)
class Connection:
    kind: str
    options: Mapping[str, str] = field(default_factory=dict)
    #: SQL text instead of a table.
    query: str | None = None
    table: str | None = None
    extract: bool = False


@dataclass(frozen=True)
class Decision:
    """How a source is read: format (None: not at all), confidence from 30 to 95, why, and what to do by hand."""

    format: str | None
    score: int
    reason: str
    follow_ups: tuple[str, ...] = ()


def _address(c: Connection) -> tuple[str | None, tuple[str, ...]]:
    """The JDBC address, or the options that it still needs; a ``url`` among the options is the address as it stands."""
    template = c.options.get("url") or (JDBC_URLS | PARTIAL).get(c.kind.lower())
    if template is None:
        return None, ("url",)
    if "url" in c.options:
        return template, ()
    missing = tuple(n for _, n, _, _ in Formatter().parse(template) if n and n not in c.options)
    return None if missing else template.format(**c.options), missing


def address(c: Connection) -> str | None:
    """The JDBC address, if the options are all there."""
    return _address(c)[0]


def decide(c: Connection) -> Decision:
    """How to read a connection; what its address still lacks is among the follow-ups, and ``jdbc_options`` refuses it until then."""
    kind, less = c.kind.lower(), 10 if c.query else 0
    review = ("review the SQL text",) if c.query else ()
    if kind in CUBES:
        return Decision(None, 30, "a finished multidimensional model is no table source")
    if kind in FILES:
        return Decision(FILES[kind], 80, "a file", ("give the file's path",) if "path" not in c.options else ())
    missing = tuple(f"give {n}" for n in _address(c)[1])
    if kind in ODBC or kind in ENGINES:
        named = kind in ENGINES or any(c.options.get(k) for k in ("dsn", "driver", "url"))
        return Decision("jdbc", 60, "through a driver", (*review, "put the driver on the cluster", *missing)) if named else Decision(None, 30, "neither a data source name nor a driver is given")
    if kind in JDBC_URLS:
        return Decision("jdbc", (90 if c.extract else 95) - less, "a supported database", (*review, *missing))
    if kind in PARTIAL:
        return Decision("jdbc", 60 - less, "known, but its address has to be completed", (*review, *missing))
    return Decision(None, 30, f"no way to read {c.kind}")


def jdbc_options(c: Connection) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``; nothing is connected to."""
    url, missing = _address(c)
    if url is None:
        raise UnsupportedCalc(f"{c.kind} needs {', '.join(missing)}", "source")
    out = {"url": url, "fetchsize": c.options.get("fetchsize", "10000")}
    out |= {"driver": c.options["driver_class"]} if "driver_class" in c.options else {}
    out |= {"query": c.query} if c.query else {"dbtable": ".".join(table_name(c.table or ""))}
    # With these a table is read by many tasks; a query text can't be split.
    split = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
    return out | ({k: c.options[k] for k in split} if not c.query and all(k in c.options for k in split) else {})


def read(spark: SparkSession, c: Connection, columns: Mapping[str, str] | None = None) -> DataFrame:
    how = decide(c)
    if how.format is None:
        raise UnsupportedCalc(how.reason, "source")
    if how.format == "csv":
        if columns is None:
            raise UnsupportedCalc("delimited files need declared types", "source")
        return read_csv(spark, c.options["path"], columns, c.options.get("encoding", "UTF-8"), c.options.get("delimiter", ","))
    if how.format == "parquet":
        return read_parquet(spark, c.options["path"])
    return spark.read.format("jdbc").options(**jdbc_options(c)).load()
