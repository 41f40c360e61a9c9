"""View queries: fields, filters and sorts, compiled to one DataFrame plan.

The order of operations is that of the source language: context filters,
FIXED expressions, dimension and top-N filters, grouping with INCLUDE and
EXCLUDE, filters on aggregates, table calculations, sorts, limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.functions.aggregates import AGGREGATES, FIELD_PARTS, query_function
from lattiq.operators.filters import Filter, condition
from lattiq.operators.model import Model
from lattiq.plans.analysis import AGG, CONST, LOD, ROW, TABLE, Analyzer, Lowerer
from lattiq.plans.grain import Grain, Rows, fresh, null_safe_join
from lattiq.plans.nodes import INT, NUMBERS, REAL, TEXT, Along, Binary, Call, Field, Lit, Lod, Node, Slot
from lattiq.plans.parser import parse
from lattiq.plans.tablecalc import Addressing, TableCalcs


@dataclass(frozen=True)
class ViewField:
    """A field of a view: a caption (with ``function``) or a formula, and how it is shown."""

    caption: str | None = None
    formula: str | None = None
    function: str | None = None
    alias: str | None = None
    bin_size: float | None = None
    decimals: int | None = None
    sort: str | None = None
    priority: int | None = None
    partition_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    tree: Node | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        shown = self.caption or self.formula or "value"
        return f"{self.function.upper()}({shown})" if self.function else shown

    @classmethod
    def from_json(cls, x: dict) -> ViewField:
        order = tuple((o, False) if isinstance(o, str) else (o["field"], o.get("direction", "ASC").upper() == "DESC") for o in x.get("orderBy", ()))
        return cls(x.get("fieldCaption"), x.get("calculation"), x.get("function"), x.get("fieldAlias"), x.get("binSize"), x.get("maxDecimalPlaces"), x.get("sortDirection"), x.get("sortPriority"), tuple(x.get("partitionBy", ())), order)


@dataclass(frozen=True)
class ViewQuery:
    fields: tuple[ViewField, ...]
    filters: tuple[Filter, ...] = ()
    parameters: dict = field(default_factory=dict)
    limit: int | None = None

    @classmethod
    def from_json(cls, x: dict) -> ViewQuery:
        q = x.get("query", x)
        params = {p["parameterCaption"]: p["value"] for p in q.get("parameters", ())}
        return cls(tuple(map(ViewField.from_json, q["fields"])), tuple(map(Filter.from_json, q.get("filters", ()))), params, q.get("rowLimit"))


class _Planner:
    def __init__(self, model: Model, query: ViewQuery):
        if query.parameters:
            model = model.with_params(query.parameters)
        self.model, self.query = model, query
        self.analyzer = Analyzer(model.field_type, model.param, model.anchor)

    # -- trees -----------------------------------------------------------

    def tree(self, caption: str | None, formula: str | None, function: str | None, bin_size: float | None = None) -> Node:
        if (caption is None) == (formula is None):
            raise UnsupportedCalc("a field is a caption or a formula", "field")
        node = self.model.expand(parse(formula) if formula is not None else Field(caption))
        if bin_size:
            if self.analyzer.info(node).dtype not in NUMBERS or bin_size <= 0:
                raise UnsupportedCalc("bins are of numbers and have a positive size", "type")
            size = Lit(bin_size, INT if isinstance(bin_size, int) else REAL)
            node = Binary("*", Call("FLOOR", (Binary("/", node, size),)), size)
        if function and (f := function.upper()) in FIELD_PARTS:
            return Call("DATETRUNC" if f.startswith("TRUNC_") else "DATEPART", (Lit(FIELD_PARTS[f], TEXT), node))
        return Call(query_function(function), (node,)) if function else node

    def level(self, node: Node) -> str:
        return self.analyzer.info(node).level

    # -- rows ------------------------------------------------------------

    def rows(self, home: str, tables: set[str], plain: list[tuple[Filter, Node]], tops: list[tuple[Filter, Node, Node]]) -> Rows:
        frame = self.model.frame(home, tables)
        for f, node in plain:
            if f.context:
                if self.level(node) == LOD or any(isinstance(n, Lod) for n in node.walk()):
                    raise UnsupportedCalc("a LOD expression in a context filter", "filter")
                frame = frame.filter(self.condition(f, Rows(self.model, self.analyzer, frame), node))
        rows = Rows(self.model, self.analyzer, frame)
        for f, node in plain:
            if not f.context:
                rows, (node,) = rows.with_fixed(node)
                rows = Rows(self.model, self.analyzer, rows.context, rows.df.filter(self.condition(f, rows, node)))
        for f, dim, by in tops:
            rows = Rows(self.model, self.analyzer, rows.context, self.top(rows, f, dim, by))
        return rows

    def condition(self, f: Filter, rows: Rows, node: Node):
        return condition(f, rows.column(node), self.analyzer.info(node).dtype, self.model.anchor)

    def top(self, rows: Rows, f: Filter, dim: Node, by: Node) -> DataFrame:
        """Keeps rows of the first members by a measure over the context; ties go by the member."""
        if not f.how_many or f.how_many < 1 or f.direction not in ("TOP", "BOTTOM"):
            raise UnsupportedCalc("TOP needs howMany and a direction", "filter")
        key, measure = fresh("key"), fresh("by")
        grain = Grain(Rows(self.model, self.analyzer, rows.context), [(key, dim)])
        by = grain.add(by)
        members = grain.frame().select(key, grain.column(by).alias(measure))
        order = F.col(measure).desc_nulls_last() if f.direction == "TOP" else F.col(measure).asc_nulls_last()
        best = members.orderBy(order, key).limit(f.how_many).select(key)
        return rows.df.join(best, rows.column(dim).eqNullSafe(best[key]), "left_semi")

    # -- the plan --------------------------------------------------------

    def run(self) -> DataFrame:
        shown = [(f, self.model.expand(f.tree) if f.tree is not None else self.tree(f.caption, f.formula, f.function, f.bin_size)) for f in self.query.fields]
        if not shown:
            raise UnsupportedCalc("a view without fields", "field")
        names = [f.name for f, _ in shown]
        if len(set(names)) < len(names):
            raise UnsupportedCalc("two fields of one name", "field")
        dims, values = [], []
        own = {n for _, n in shown if self.level(n) in (ROW, CONST)}
        for f, node in shown:
            (dims if node in own or self.level(node) == LOD and not self.as_value(node, own) else values).append((f, node))
        filters = [(f, self.tree(f.field, f.formula, f.function)) for f in self.query.filters]
        after = [(f, n) for f, n in filters if self.level(n) == AGG and f.kind != "TOP"]
        late = [(f, n) for f, n in filters if self.level(n) == TABLE]
        plain = [(f, n) for f, n in filters if self.level(n) in (ROW, CONST, LOD) and f.kind != "TOP"]
        tops = [(f, n, self.tree(f.by[0], f.by_formula, f.by[1])) for f, n in filters if f.kind == "TOP"]
        if any(self.level(by) != AGG for *_, by in tops):
            raise UnsupportedCalc("TOP goes by an aggregate", "filter")

        marks, slots = self.marks(dims, [n for _, n in values] + [n for _, n in after + late], plain, tops)
        lower = lambda n: Lowerer(self.analyzer, lambda m: F.col(f"`{m.column}`") if isinstance(m, Slot) else None).column(n)
        for f, n in after:
            n = slots[n]
            marks = marks.filter(condition(f, lower(n), self.analyzer.info(n).dtype, self.model.anchor))

        at = [Addressing(f.partition_by, f.order_by) for f, _ in values] + [Addressing() for _ in after + late]
        self.plan_totals([(slots[n], a) for (_, n), a in zip(values, at)] + [(slots[n], at[0]) for _, n in late])
        calcs = TableCalcs(marks, self.analyzer, lambda m, n, a: self.total(m, n, a, dims, plain, tops))
        done = [(f, calcs.value(slots[n], a)) for (f, n), a in zip(values, at)]
        late_done = [(f, calcs.value(slots[n], at[0])) for f, n in late] if late else []
        out = calcs.marks
        for f, n in late_done:
            out = out.filter(condition(f, lower(n), self.analyzer.info(n).dtype, self.model.anchor))
        columns = {f.name: F.col(f"`{f.name}`") for f, _ in dims} | {f.name: lower(n) for f, n in done}
        out = out.select(*[(F.round(columns[f.name], f.decimals) if f.decimals is not None else columns[f.name]).alias(f.name) for f, _ in shown])
        sorts = sorted((f for f, _ in shown if f.sort), key=lambda f: (f.priority if f.priority is not None else 1 << 30))
        if sorts:
            out = out.orderBy(*[F.col(f"`{f.name}`").desc_nulls_last() if f.sort.upper() == "DESC" else F.col(f"`{f.name}`").asc_nulls_first() for f in sorts])
        return out if self.query.limit is None else out.limit(self.query.limit)

    def as_value(self, node: Node, dims: set[Node]) -> bool:
        """Whether a bare LOD expression is one value a mark; with dimensions that the view lacks it is a dimension itself."""
        return all(n.kind != "FIXED" or set(n.dims) <= dims for n in node.walk() if isinstance(n, Lod))

    def homes(self, dims: list[Node], values: list[Node], extra: list[Node]) -> dict[str, list[Node]]:
        """The home table of each value; a view without values has one home."""
        at = self.model.tables_of(*dims)
        if not values:
            return {self.model.home(at | self.model.tables_of(*extra)): []}
        out: dict[str, list[Node]] = {}
        if len(self.model.tables) == 1:
            return {next(iter(self.model.tables)): values}
        for v in values:
            for a in self.atoms(v):
                # What names no table, such as a count of records, is counted over the view's most detailed one.
                home = self.model.home(self.model.tables_of(a) or at | self.model.tables_of(*values))
                if any(self.model.path(home, t) is None for t in at):
                    raise UnsupportedCalc(f"{home} does not reach the view's dimensions", "cross table")
                out.setdefault(home, []).append(a)
        if not out:
            return {self.model.home(at | self.model.tables_of(*extra)): []}
        return out

    def atoms(self, node: Node) -> list[Node]:
        """The outermost aggregates and LOD expressions of a tree."""
        if isinstance(node, Call) and node.name in AGGREGATES and self.level(node) == AGG and not (node.name in ("MIN", "MAX") and len(node.args) == 2) or isinstance(node, Lod):
            return [node]
        return [a for c in node.children() for a in self.atoms(c)]

    def marks(self, dims: list[tuple[ViewField, Node]], values: list[Node], plain, tops) -> tuple[DataFrame, dict[Node, Node]]:
        """The grouped frame, and each value over its columns.

        Values of different fact tables are grouped each on its own and then
        joined by the dimensions, so facts never multiply each other.
        """
        extra = [n for _, n in plain] + [x for _, n, by in tops for x in (n, by)]
        named = [(f.name, n) for f, n in dims]
        homes = self.homes([n for _, n in dims], values, extra)
        frames, where = [], {}
        for home, atoms in homes.items():
            tables = {home} | self.model.tables_of(*[n for _, n in named], *extra, *atoms)
            rows = self.rows(home, tables, plain, tops)
            if len(homes) == 1:
                grain = Grain(rows, named)
                out = {v: grain.add(v) for v in values}
                return grain.frame(), out
            own = [(n if not frames else fresh("dim"), d) for n, d in named]
            grain = Grain(rows, own)
            for a in atoms:
                where[a] = grain.add(a)
            frames.append((grain.frame(), [n for n, _ in own]))
        names = frames[0][1]

        def both(left: DataFrame, right: tuple[DataFrame, list[str]]) -> DataFrame:
            df, keys = right
            if not names:
                return null_safe_join(left, df, [])
            on = reduce(lambda a, b: a & b, [left[a].eqNullSafe(df[b]) for a, b in zip(names, keys)])
            out = left.join(df, on, "full_outer")
            return out.withColumns({a: F.coalesce(left[a], df[b]) for a, b in zip(names, keys)}).drop(*keys)

        place = lambda n: where[n] if n in where else n.rebuild(place)
        return reduce(both, frames[1:], frames[0][0]), {v: place(v) for v in values}

    def plan_totals(self, trees: list[tuple[Node, Addressing]]) -> None:
        pass

    def total(self, marks: DataFrame, node: Node, at: Addressing, dims, plain, tops) -> tuple[DataFrame, Node]:
        raise UnsupportedCalc("TOTAL was not planned", "table calc")


class _WithTotals(_Planner):
    """TOTAL(aggregate): the rows are aggregated anew at the grain of the partition."""

    def marks(self, dims, values, plain, tops):
        totals: list[Call] = []

        def cut(node: Node) -> Node:
            if isinstance(node, Call) and node.name == "TOTAL":
                if node not in totals:
                    totals.append(node)
                return Call("TOTAL", (Slot(f"_total{totals.index(node)}", self.analyzer.info(node).dtype, AGG),))
            return node.rebuild(cut)

        self.totals = totals
        bare = [cut(v) for v in values]
        frame, slots = super().marks(dims, bare, plain, tops)
        return frame, {v: slots[b] for v, b in zip(values, bare)}

    def plan_totals(self, trees):
        """Which totals are wanted at which partition; those of one partition are aggregated together."""
        self.wanted: dict[frozenset[str], list[str]] = {}
        self.found: dict[tuple[frozenset[str], str], Slot] = {}

        def look(n: Node, part: tuple[str, ...]) -> None:
            if isinstance(n, Call) and n.name == "TOTAL":
                names = self.wanted.setdefault(frozenset(part), [])
                if n.args[0].column not in names:
                    names.append(n.args[0].column)
            for c in n.children():
                look(c, n.partition if isinstance(n, Along) else part)

        for tree, at in trees:
            look(tree, at.partition)

    def total(self, marks, node, at, dims, plain, tops):
        part = frozenset(at.partition)
        if (part, node.column) in self.found:
            return marks, self.found[part, node.column]
        chosen = [(f, n) for f, n in dims if f.name in part]
        if len(chosen) < len(part):
            raise UnsupportedCalc("TOTAL restarts at dimensions of the view only", "table calc")
        trees = [self.totals[int(c.removeprefix("_total"))].args[0] for c in self.wanted[part]]
        right, out = _Planner.marks(self, chosen, trees, plain, tops)
        keys = [(f.name, fresh("key")) for f, _ in chosen]
        lower = Lowerer(self.analyzer, lambda m: F.col(f"`{m.column}`") if isinstance(m, Slot) else None)
        values = [(fresh("total"), t) for t in trees]
        right = right.select(*[F.col(f"`{a}`").alias(b) for a, b in keys], *[lower.column(out[t]).alias(v) for v, t in values])
        self.found |= {(part, c): Slot(v, self.analyzer.info(t).dtype, TABLE) for c, (v, t) in zip(self.wanted[part], values)}
        return null_safe_join(marks, right, keys), self.found[part, node.column]


def run_view(model: Model, query: ViewQuery | dict) -> DataFrame:
    """The DataFrame of a view query; nothing is computed until it is read."""
    return _WithTotals(model, query if isinstance(query, ViewQuery) else ViewQuery.from_json(query)).run()


def measure_level(model: Model, formula: str) -> str:
    """``row``, ``agg``, ``table``, ``lod`` or ``const``: how a calculated field has to be used."""
    return Analyzer(model.field_type, model.param, model.anchor).info(model.expand(parse(formula))).level


def with_calcs(model: Model, formulas: dict[str, str]) -> DataFrame:
    """The rows of the model's home table with row-level calculations as new columns.

    FIXED expressions are allowed.  The table's own columns keep names and types.
    """
    analyzer = Analyzer(model.field_type, model.param, model.anchor)
    trees = {name: model.expand(parse(f)) for name, f in formulas.items()}
    for name, t in trees.items():
        if analyzer.info(t).level not in (ROW, CONST, LOD):
            raise UnsupportedCalc(f"{name} is no row-level calculation", "grain")
    tables = model.tables_of(*trees.values())
    home = model.home(tables) if tables or len(model.tables) == 1 else None
    if home is None:
        raise UnsupportedCalc("which table's rows?", "cross table")
    rows = Rows(model, analyzer, model.frame(home, tables | {home}))
    rows, lowered = rows.with_fixed(*trees.values())
    columns = {name: rows.column(t) for name, t in zip(trees, lowered)}
    own = model.tables[home]
    kept = [F.col(f"`{own.qualified(f.name)}`").cast(f.dataType).alias(f.name) for f in own.df.schema]
    return rows.df.select(*kept, *[c.alias(n) for n, c in columns.items()])
