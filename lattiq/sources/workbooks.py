"""Workbook files (.tds, .twb and their zipped forms .tdsx, .twbx) to models and view queries.

A file describes connections, tables with declared columns, relationships,
calculated fields, parameters, groups, bins and worksheets.  What a worksheet
shows becomes a view query; what can't be taken over exactly is refused with
a reason, sheet by sheet, and never guessed.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from lattiq.errors import UnsupportedCalc
from lattiq.operators.filters import Filter
from lattiq.operators.model import Model, Relationship, Table, is_unique
from lattiq.plans.nodes import Call, Field
from lattiq.plans.tablecalc import quick
from lattiq.plans.view import ViewField, ViewQuery
from lattiq.sources.readers import SOURCE_TYPES, Connection

#: Pill derivations and the query functions they stand for (fixed values of the file format).
AGGREGATES = {"Sum": "SUM", "Avg": "AVG", "Min": "MIN", "Max": "MAX", "Count": "COUNT", "CountD": "COUNTD", "Median": "MEDIAN", "Stdev": "STDEV", "StdevP": "STDEVP", "Var": "VAR", "VarP": "VARP", "Attribute": "ATTR"}
PARTS = {"Year": "YEAR", "Quarter": "QUARTER", "Month": "MONTH", "Week": "WEEK", "Day": "DAY"} | {f"{p}-Trunc": f"TRUNC_{p.upper()}" for p in ("Year", "Quarter", "Month", "Week", "Day")}
PLAIN = ("None", "User", "")
#: Prefixes of pills' names, for pills that are used without being declared.
PREFIXES = {"none": None, "usr": None, "sum": "SUM", "avg": "AVG", "min": "MIN", "max": "MAX", "cnt": "COUNT", "ctd": "COUNTD", "med": "MEDIAN", "std": "STDEV", "stp": "STDEVP", "var": "VAR", "vrp": "VARP", "attr": "ATTR"} | {"yr": "YEAR", "qr": "QUARTER", "mn": "MONTH", "wk": "WEEK", "dy": "DAY"} | {f"t{k}": f"TRUNC_{v}" for k, v in {"yr": "YEAR", "qr": "QUARTER", "mn": "MONTH", "wk": "WEEK", "dy": "DAY"}.items()}
RANKS = {"competition": "competition", "dense": "dense", "modifiedcompetition": "modified", "unique": "unique"}
_PILL = re.compile(r"\[((?:[^\]]|\]\])+)\]\.\[((?:[^\]]|\]\])+)\]")


@dataclass(frozen=True)
class Column:
    remote: str
    name: str
    dtype: str


@dataclass
class Relation:
    name: str
    connection: str | None
    table: str | None = None
    query: str | None = None
    columns: list[Column] = field(default_factory=list)


@dataclass(frozen=True)
class Edge:
    """An equality of two columns of two relations; which side is unique is not known yet."""

    left: str
    left_column: str
    right: str
    right_column: str


@dataclass(frozen=True)
class Parameter:
    caption: str
    name: str
    value: object
    members: tuple = ()
    low: float | None = None
    high: float | None = None
    step: float | None = None


@dataclass
class Source:
    name: str
    caption: str
    connections: dict[str, Connection]
    relations: dict[str, Relation]
    edges: list[Edge]
    calcs: dict[str, str]
    captions: dict[str, str]
    hidden: set[str]
    hierarchies: dict[str, list[str]]
    warnings: list[str]


@dataclass
class Workbook:
    sources: dict[str, Source]
    parameters: dict[str, Parameter]
    sheets: dict[str, ElementTree.Element]

    def source(self, name: str | None = None) -> Source:
        if name is None and len(self.sources) == 1:
            return next(iter(self.sources.values()))
        found = [s for s in self.sources.values() if name in (s.name, s.caption)]
        if len(found) != 1:
            raise UnsupportedCalc(f"no single data source {name}", "source")
        return found[0]


def read_text(path: str) -> str:
    """The description in a file, or in the only such member of a zipped one."""
    if not zipfile.is_zipfile(path):
        return Path(path).read_text("utf-8-sig")
    with zipfile.ZipFile(path) as z:
        members = [n for n in z.namelist() if n.lower().endswith((".tds", ".twb"))]
        if len(members) != 1:
            raise UnsupportedCalc(f"{len(members)} descriptions in {path}", "source")
        return z.read(members[0]).decode("utf-8-sig")


def _bare(name: str | None) -> str:
    name = (name or "").strip()
    return name[1:-1].replace("]]", "]") if name.startswith("[") and name.endswith("]") else name


def _value(text: str | None, dtype: str):
    """A literal of the format: texts are quoted, dates in number signs."""
    if text is None:
        return None
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return text[1:-1].replace('""', '"')
    if text[:1] == text[-1:] == "#" and len(text) > 1:
        from lattiq.plans.lexer import date_literal

        return date_literal(text[1:-1])
    if text == "%null%":
        return None
    if dtype == "boolean":
        return text.lower() == "true"
    if dtype == "integer":
        return int(float(text))
    if dtype == "real":
        return float(text)
    return text


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _literal(v) -> str:
    return "NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v)


def _calculation(column: ElementTree.Element, warnings: list[str]) -> str | None:
    """The formula of a calculated, binned or grouped column; None for a plain one."""
    calc = column.find("calculation")
    if calc is None:
        return None
    kind, formula = calc.get("class"), calc.get("formula")
    if kind == "bin":
        size = calc.get("size-parameter") or calc.get("size") or "1"
        peg = calc.get("peg") or "0"
        return f"FLOOR(({formula} - {peg}) / {size}) * {size} + {peg}"
    if kind == "categorical-bin":
        x = calc.get("column")
        tests = []
        for b in calc.findall("bin"):
            members = [_value(v.text, "string") for v in b.findall("value")]
            tests.append(f"IF {x} IN ({', '.join(map(_literal, members))}) THEN {_quoted(str(_value(b.get('value'), 'string')))}" if None not in members else f"IF ISNULL({x}) OR {x} IN ({', '.join(_literal(m) for m in members if m is not None) or _quoted('')}) THEN {_quoted(str(_value(b.get('value'), 'string')))}")
        if not tests:
            return x
        default = calc.get("default")
        rest = _literal(_value(default, "string")) if default else x
        return " ELSE".join(tests) + f" ELSE {rest} END"
    if formula is None:
        warnings.append(f"{column.get('caption') or column.get('name')}: a calculation without a formula")
    return formula


def _relations(node: ElementTree.Element, out: dict[str, Relation], edges: list[Edge], warnings: list[str]) -> None:
    for r in node.findall("relation"):
        kind = r.get("type")
        if kind in ("join", "union", "collection"):
            if kind == "union":
                warnings.append("a union's tables are separate tables")
            for clause in r.findall("clause"):
                _edge(clause.find("expression"), None, None, edges, warnings)
            _relations(r, out, edges, warnings)
        elif kind in ("table", "text") and r.get("name") not in out:
            text = (r.text or "").strip() if kind == "text" else None
            out[r.get("name")] = Relation(r.get("name"), r.get("connection"), r.get("table") if kind == "table" else None, text)


def _edge(expression: ElementTree.Element | None, left: str | None, right: str | None, edges: list[Edge], warnings: list[str]) -> None:
    """Only a single equality of two columns is a relationship; anything else is passed over with a warning."""
    parts = [] if expression is None else [e.get("op") or "" for e in expression.findall("expression")]
    if expression is None or expression.get("op") != "=" or len(parts) != 2 or not all(p.startswith("[") for p in parts):
        warnings.append("a relationship that is no equality of two columns was passed over")
        return
    ends = []
    for text, table in zip(parts, (left, right)):
        m = _PILL.fullmatch(text)
        ends.append((m[1], m[2]) if m else (table, _bare(text)))
    if None in (ends[0][0], ends[1][0]):
        warnings.append("a relationship without tables was passed over")
        return
    edges.append(Edge(*ends[0], *ends[1]))


def _source(node: ElementTree.Element) -> Source:
    warnings: list[str] = []
    connections, relations, edges = {}, {}, []
    top = node.find("connection")
    if top is not None:
        for named in top.findall("named-connections/named-connection"):
            c = named.find("connection")
            options = {"server": c.get("server", ""), "database": c.get("dbname", "")} | {k: v for k, v in (("warehouse", c.get("warehouse")), ("http_path", c.get("http-path")), ("path", c.get("filename"))) if v}
            connections[named.get("name")] = Connection(c.get("class", ""), options, extract=node.find("extract") is not None)
        _relations(top, relations, edges, warnings)
        for rec in top.findall("metadata-records/metadata-record"):
            owner = relations.get(_bare(rec.findtext("parent-name")))
            dtype = rec.findtext("local-type")
            if rec.get("class") == "column" and owner is not None:
                if dtype in SOURCE_TYPES:
                    owner.columns.append(Column(rec.findtext("remote-name") or "", _bare(rec.findtext("local-name")), dtype))
                else:
                    warnings.append(f"{rec.findtext('remote-name')}: no type {dtype}")
    objects = {}
    for o in node.iter("object"):
        inner = o.find(".//relation")
        if inner is not None:
            objects[o.get("id")] = inner.get("name")
    local = {c.name: (r.name, c.remote) for r in relations.values() for c in r.columns}
    for r in node.iter("relationship"):
        ends = [objects.get((r.find(e).get("object-id") if r.find(e) is not None else None), None) for e in ("first-end-point", "second-end-point")]
        _edge(r.find("expression"), *ends, edges, warnings)
    edges = [Edge(e.left, local.get(e.left_column, (0, e.left_column))[1], e.right, local.get(e.right_column, (0, e.right_column))[1]) for e in edges]
    calcs, captions, hidden = {}, {}, set()
    for c in node.findall("column"):
        name = _bare(c.get("name"))
        if c.get("hidden") == "true":
            hidden.add(name)
        formula = _calculation(c, warnings)
        if formula is not None:
            calcs[name] = formula
            calcs[c.get("caption") or name] = formula
        elif c.get("caption"):
            captions[c.get("caption")] = name
    levels = {d.get("name"): [_bare(f.get("name")) for f in d.findall("field")] for d in node.findall("drill-paths/drill-path")}
    return Source(node.get("name") or node.get("formatted-name") or "", node.get("caption") or node.get("formatted-name") or node.get("name") or "", connections, relations, edges, calcs, captions, hidden, levels, warnings)


def _parameter(c: ElementTree.Element) -> Parameter:
    dtype = c.get("datatype", "string")
    r = c.find("range")
    number = lambda k: float(r.get(k)) if r is not None and r.get(k) and dtype in ("integer", "real") else None
    members = tuple(_value(m.get("value"), dtype) for m in c.findall("members/member"))
    name = _bare(c.get("name"))
    return Parameter(c.get("caption") or name, name, _value(c.get("value"), dtype), members, number("min"), number("max"), number("granularity"))


def load(path: str) -> Workbook:
    """Reads a description; only names and texts, no data."""
    return parse(read_text(path))


def parse(text: str) -> Workbook:
    try:
        root = ElementTree.fromstring(text.lstrip("﻿"))
    except ElementTree.ParseError as e:
        raise UnsupportedCalc(f"no workbook: {e}", "source") from e
    found = [root] if root.tag == "datasource" else root.findall("datasources/datasource")
    params, sources = {}, {}
    for node in found:
        if node.get("name") == "Parameters" or node.get("hasconnection") == "false":
            for c in node.findall("column"):
                p = _parameter(c)
                params[p.name] = p
        else:
            s = _source(node)
            sources[s.name] = s
    return Workbook(sources, params, {w.get("name"): w for w in root.findall("worksheets/worksheet")})


def to_model(book: Workbook, frames: Callable[[Relation], DataFrame] | Mapping[str, DataFrame], source: str | None = None, anchor=None) -> Model:
    """The model of a data source over its tables' DataFrames, by relation (or by name).

    A relationship's direction is probed: the side whose column is unique is
    the parent.  Many-to-many ones are left out with a warning.
    """
    s = book.source(source)
    tables = []
    for r in s.relations.values():
        df = frames(r) if callable(frames) else frames[r.name]
        names = {c.name: c.remote for c in r.columns if c.remote in df.columns and c.name != c.remote}
        names |= {caption: names.get(name, name) for caption, name in s.captions.items() if names.get(name, name) in df.columns and caption != name}
        tables.append(Table(r.name, df, names))
    by_name, edges = {t.name: t for t in tables}, []
    for e in s.edges:
        if e.left not in by_name or e.right not in by_name:
            s.warnings.append(f"no tables for {e.left} and {e.right}")
        elif is_unique(by_name[e.right].df, e.right_column):
            edges.append(Relationship(e.left, e.left_column, e.right, e.right_column))
        elif is_unique(by_name[e.left].df, e.left_column):
            edges.append(Relationship(e.right, e.right_column, e.left, e.left_column))
        else:
            s.warnings.append(f"{e.left} and {e.right} are many-to-many")
    params = {n: p.value for p in book.parameters.values() for n in (p.name, p.caption)}
    return Model(tables, edges, s.calcs, params, anchor)


# -- worksheets ---------------------------------------------------------------------


class _Sheet:
    def __init__(self, node: ElementTree.Element):
        self.node = node
        self.instances = {_bare(i.get("name")): i for i in node.iter("column-instance")}
        self.columns = {_bare(c.get("name")): c for c in node.iter("column") if c.get("name")}

    def pills(self, text: str | None) -> list[str]:
        return [m[2] for m in _PILL.finditer(text or "")]

    def field(self, pill: str) -> tuple[str, str | None]:
        """The column of a pill and its query function."""
        i = self.instances.get(pill)
        if i is None:
            parts = pill.split(":")
            if pill not in self.columns and len(parts) == 3:
                if parts[0] not in PREFIXES:
                    raise UnsupportedCalc(f"no pill {pill}", "field")
                return parts[1], PREFIXES[parts[0]]
            own = self.columns.get(pill)
            plain = own is not None and own.get("role") == "measure" and own.find("calculation") is None
            return pill, AGGREGATES.get(own.get("aggregation") or "Sum") if plain else None
        how = i.get("derivation") or ""
        if how not in PLAIN and how not in AGGREGATES and how not in PARTS:
            raise UnsupportedCalc(f"no derivation {how}", "field")
        return _bare(i.get("column")), AGGREGATES.get(how) or PARTS.get(how)

    def shown(self) -> tuple[list[str], list[str], list[str]]:
        """Pills on rows, on columns and on marks, each once."""
        table = self.node.find("table")
        rows, cols = self.pills(table.findtext("rows")), self.pills(table.findtext("cols"))
        marks = [p for e in table.findall("panes/pane/encodings/*") for p in self.pills(e.get("column"))]
        return rows, cols, [p for p in dict.fromkeys(marks) if p not in rows + cols]


def _is_dimension(sheet: _Sheet, pill: str) -> bool:
    column, function = sheet.field(pill)
    if function is not None:
        return function in PARTS.values()
    own = sheet.columns.get(column)
    return own is None or own.get("role") != "measure"


def _addressing(calc: ElementTree.Element, rows: list[str], cols: list[str], others: list[str], names: dict[str, str]) -> tuple[tuple[str, ...], tuple[tuple[str, bool], ...]]:
    """Partition and order of a table calculation, as output names."""
    kind = calc.get("ordering-type") or "Rows"
    if kind == "Rows":
        along, apart = cols, rows + others
    elif kind == "Columns":
        along, apart = rows, cols + others
    elif kind == "Field":
        named = [m[2] for o in calc.findall("order") for m in _PILL.finditer(o.get("field") or "")] or [m[2] for m in _PILL.finditer(calc.get("ordering-field") or "")]
        along = [p for p in rows + cols + others if p in named]
        if len(along) < len(set(named)):
            raise UnsupportedCalc("addressing by a field that isn't shown", "table calc")
        apart = [p for p in rows + cols + others if p not in named]
    elif kind in ("RowInPane", "ColumnInPane"):
        # A pane is what one member of the outer field has; with more fields on the axis it could be cut in several ways.
        axis, other = (cols, rows) if kind == "RowInPane" else (rows, cols)
        if len(axis) > 2:
            raise UnsupportedCalc(f"addressing {kind} along {len(axis)} fields", "table calc")
        along, apart = axis[-1:], other + axis[:-1] + others
    else:
        raise UnsupportedCalc(f"addressing {kind}", "table calc")
    return tuple(names[p] for p in apart), tuple((names[p], False) for p in along)


def _quick_tree(calc: ElementTree.Element, x):
    kind, agg = calc.get("type"), (calc.get("aggregation") or "Sum").upper()
    if kind == "CumTotal":
        return quick("running", x, agg=agg)
    if kind == "WindowTotal":
        ends = [int(calc.get(k)) if calc.get(k) not in (None, "") else None for k in ("from", "to")]
        return quick("window", x, agg=agg, start=ends[0], end=ends[1])
    if kind == "Rank":
        style, _, way = (calc.get("rank-options") or "Competition,Descending").partition(",")
        if style.lower() not in RANKS:
            raise UnsupportedCalc(f"rank {style}", "table calc")
        return quick("rank", x, style=RANKS[style.lower()], way="asc" if way.lower().startswith("asc") else "desc")
    simple = {"PctDiff": "percent_difference", "Difference": "difference", "PercentOfTotal": "percent_of_total", "PctOfTotal": "percent_of_total"}
    if kind not in simple:
        raise UnsupportedCalc(f"table calculation {kind}", "table calc")
    return quick(simple[kind], x)


def _member(f: ElementTree.Element) -> list:
    function = f.get("function")
    if function == "member":
        return [_value(f.get("member"), "string")]
    if function == "union":
        return [m for c in f.findall("groupfilter") for m in _member(c)]
    raise UnsupportedCalc(f"a filter by {function}", "filter")


def _filter(sheet: _Sheet, f: ElementTree.Element) -> Filter | None:
    pill = (sheet.pills(f.get("column")) or [_bare(f.get("column"))])[0]
    column, function = sheet.field(pill)
    context, kind = f.get("context") == "true", f.get("class")
    if kind == "categorical":
        g = f.find("groupfilter")
        if g is None or g.get("function") == "level-members":
            return None
        exclude = g.get("function") == "except"
        if exclude:
            first, *rest = g.findall("groupfilter")
            if first.get("function") != "level-members":
                raise UnsupportedCalc("an exclusion from a part", "filter")
            members = [m for c in rest for m in _member(c)]
        else:
            members = _member(g)
        dtype = sheet.columns[column].get("datatype", "string") if column in sheet.columns else "string"
        dtype = "integer" if function in PARTS.values() and not function.startswith("TRUNC") else dtype
        return Filter("SET", column, function=function, context=context, exclude=exclude, values=tuple(_value(m, dtype) if isinstance(m, str) and dtype != "string" else m for m in members))
    if kind == "quantitative":
        low, high = (_value(f.findtext(k), "real") for k in ("min", "max"))
        nulls = f.get("included-values") or "in-range"
        if nulls in ("null", "non-null"):
            return Filter("QUANTITATIVE_NUMERICAL", column, function=function, context=context, quantitative="ONLY_NULL" if nulls == "null" else "ONLY_NON_NULL")
        shape = "RANGE" if low is not None and high is not None else "MIN" if low is not None else "MAX"
        return Filter("QUANTITATIVE_NUMERICAL", column, function=function, context=context, quantitative=shape, low=low, high=high, include_nulls=nulls == "in-range-or-null")
    if kind == "relative-date":
        first, last = int(f.get("first-period", "0")), int(f.get("last-period", "0"))
        period = {"day": "DAYS", "week": "WEEKS", "month": "MONTHS", "quarter": "QUARTERS", "year": "YEARS"}.get(f.get("period-type-v2") or f.get("period-type") or "")
        shape = {(0, 0): ("CURRENT", None), (-1, -1): ("LAST", None), (1, 1): ("NEXT", None)}.get((first, last)) or (("LASTN", 1 - first) if last == 0 and first < 0 else ("NEXTN", last) if first == 1 else None)
        if period is None or shape is None:
            raise UnsupportedCalc("a range of periods", "filter")
        return Filter("DATE", column, function=function, context=context, period=period, relative=shape[0], range_n=shape[1])
    raise UnsupportedCalc(f"a {kind} filter", "filter")


def to_view(book: Workbook, name: str) -> ViewQuery:
    """The view query of a worksheet: dimensions group, measures aggregate, table calculations run along their addressing."""
    sheet = _Sheet(book.sheets[name])
    rows, cols, marks = sheet.shown()
    dims = [p for p in rows + cols + marks if _is_dimension(sheet, p)]
    names = {p: sheet.columns[sheet.field(p)[0]].get("caption") or sheet.field(p)[0] if sheet.field(p)[0] in sheet.columns else sheet.field(p)[0] for p in rows + cols + marks}
    taken: dict[str, int] = {}
    for p, n in names.items():  # a field may be shown in several ways
        function = sheet.field(p)[1]
        n = f"{function}({n})" if function else n
        taken[n] = taken.get(n, 0) + 1
        names[p] = n if taken[n] == 1 else f"{n} {taken[n]}"
    sorts = {}
    for s in [*sheet.node.iter("computed-sort"), *sheet.node.iter("sort")]:
        by = sheet.pills(s.get("using"))
        if by and by[0] in names:
            sorts[by[0]] = (s.get("direction") or "ASC").upper()
        elif s.get("class") != "manual" and (own := sheet.pills(s.get("column"))) and own[0] in names and not s.get("using"):
            sorts[own[0]] = (s.get("direction") or "ASC").upper()
    in_dims = lambda ps: [p for p in ps if p in dims]
    fields = []
    for p in dict.fromkeys(rows + cols + marks):
        column, function = sheet.field(p)
        calc = sheet.instances[p].find("table-calc") if p in sheet.instances else None
        own = calc if calc is not None else sheet.columns[column].find("calculation/table-calc") if column in sheet.columns else None
        partition, order = _addressing(own, in_dims(rows), in_dims(cols), in_dims(marks), names) if own is not None and p not in dims else ((), ())
        sort = sorts.get(p)
        if calc is not None and calc.get("type"):
            x = Call(function, (Field(column),)) if function else Field(column)
            fields.append(ViewField(alias=names[p], tree=_quick_tree(calc, x), partition_by=partition, order_by=order, sort=sort))
        else:
            fields.append(ViewField(caption=column, function=function, alias=names[p], partition_by=partition, order_by=order, sort=sort))
    filters = [x for f in sheet.node.findall("table/view/filter") if (x := _filter(sheet, f)) is not None]
    return ViewQuery(tuple(fields), tuple(filters))


_PASSED_ON = re.compile(r"\s*\[Parameters\]\.\[((?:[^\]]|\]\])+)\]\s*")


def sheet_swaps(book: Workbook) -> dict[str, dict[str, tuple]]:
    """Parameters that choose among worksheets: the parameter's caption to each sheet's values that show it.

    A sheet is gated by a filter that keeps members of a calculation which
    only passes a parameter on.  One such sheet alone is no swap.
    """
    found: dict[str, dict[str, tuple]] = {}
    for name, node in book.sheets.items():
        sheet = _Sheet(node)
        for f in node.findall("table/view/filter"):
            column = sheet.field((sheet.pills(f.get("column")) or [_bare(f.get("column"))])[0])[0] if f.get("class") == "categorical" else None
            calc = sheet.columns[column].find("calculation") if column in sheet.columns else None
            m = _PASSED_ON.fullmatch(calc.get("formula") or "") if calc is not None else None
            groups = f.find("groupfilter")
            if m and groups is not None and groups.get("function") in ("member", "union"):
                param = next((p for p in book.parameters.values() if _bare(p.name) == m[1].replace("]]", "]")), None)
                dtype = sheet.columns[column].get("datatype", "string")
                members = tuple(_value(x, dtype) if isinstance(x, str) and dtype != "string" else x for x in _member(groups))
                found.setdefault(param.caption if param else m[1], {})[name] = members
    return {p: sheets for p, sheets in found.items() if len(sheets) > 1}


def visible(book: Workbook, values: dict[str, object]) -> list[str]:
    """The worksheets that are shown with these parameter values; sheets that no swap gates always are."""
    hidden = {name for p, sheets in sheet_swaps(book).items() if p in values for name, members in sheets.items() if values[p] not in members}
    return [name for name in book.sheets if name not in hidden]


def coverage(book: Workbook) -> dict[str, str]:
    """Each worksheet with ``ok`` or why it is refused."""
    out = {}
    for name in book.sheets:
        try:
            to_view(book, name)
            out[name] = "ok"
        except UnsupportedCalc as e:
            out[name] = str(e)
    return out


def find(folder: str) -> dict[str, Workbook | UnsupportedCalc]:
    """All workbook files under a folder, read or refused one by one."""
    out: dict[str, Workbook | UnsupportedCalc] = {}
    for p in sorted(Path(folder).rglob("*")):
        if p.suffix.lower() in (".tds", ".twb", ".tdsx", ".twbx"):
            try:
                out[str(p)] = load(str(p))
            except (UnsupportedCalc, OSError, UnicodeDecodeError, zipfile.BadZipFile) as e:
                out[str(p)] = e if isinstance(e, UnsupportedCalc) else UnsupportedCalc(str(e), "source")
    return out
