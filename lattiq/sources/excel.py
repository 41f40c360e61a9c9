"""Excel sheets as tables: each file is parsed where its bytes are read.

Files come through Spark's binary reader, so any store that Spark reads will
do.  A sheet has 1 048 576 rows at most, which bounds a task's memory; many
files are many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.session import importable
from lattiq.sources.readers import match_headers, spark_schema

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = datetime(1899, 12, 30)
BATCH_ROWS = 4096


def _place(reference: str) -> int:
    """Column number, from 0, of a cell's reference."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(raw: bytes, sheet: str | None = None) -> Iterator[list]:
    """Rows of cells (text, number or boolean; None where empty) of a sheet, the first by default."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(f"{_REL}id")] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise UnsupportedCalc(f"no sheet {sheet}", "source")
        target = (sheets[sheet] if sheet is not None else next(iter(sheets.values()))).lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list = []
                for c in row.findall(f"{_MAIN}c"):
                    at = _place(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, v = c.get("t"), c.findtext(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None:
                        cells[at] = shared[int(v)] if kind == "s" else v == "1" if kind == "b" else None if kind == "e" else v if kind in ("str", "d") else float(v)
                row.clear()
                yield cells


def _text(v, dtype: str) -> str | None:
    """A cell as text that casts to its declared type; serial numbers become dates."""
    if v is None:
        return None
    if dtype in ("date", "datetime") and isinstance(v, float):
        return (_EPOCH + timedelta(days=v)).isoformat(sep=" ")
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def read_excel(spark: SparkSession, path: str, columns: Mapping[str, str], sheet: str | None = None) -> DataFrame:
    """A sheet with a header in its first row, of one file or all files of a folder, typed as declared.

    Empty rows are passed over; cells that don't fit their type are null.
    """
    names, dtypes = list(columns), list(columns.values())

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = sheet_rows(raw.as_py(), sheet)
                header = [str(h or "").strip() for h in next(rows, [])]
                bound = match_headers(names, [h for h in header if h])
                if missing := [n for n in names if n not in bound]:
                    raise UnsupportedCalc(f"no header for {', '.join(missing)}", "source")
                at, held = [header.index(bound[n]) for n in names], []
                for row in rows:
                    if any(v is not None for v in row):
                        held.append([_text(row[i], d) if i < len(row) else None for i, d in zip(at, dtypes)])
                    if len(held) >= BATCH_ROWS:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.string()) for i in range(len(names))], [f"c{i}" for i in range(len(names))])

    importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    found = files.mapInArrow(run, ", ".join(f"c{i} string" for i in range(len(names))))
    return found.select(*[(F.try_to_timestamp(f"c{i}").cast(f.dataType) if d in ("date", "datetime") else F.col(f"c{i}").try_cast(f.dataType)).alias(f.name) for i, (f, d) in enumerate(zip(spark_schema(columns), dtypes))])
