"""Aggregation at a grain: plain aggregates in one group-by, LOD expressions beside it.

A LOD expression is a group-by of its own, joined back by null-safe equality.
It is never a window: a window would need all rows of a key in one task,
while a group-by combines on the map side first.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.functions.aggregates import AGGREGATES, REAGGREGATES, Percentile, aggregate
from lattiq.plans.analysis import AGG, CONST, LOD, ROW, Lowerer
from lattiq.plans.nodes import Call, Field, Lod, Node, Slot
from lattiq.plans.percentiles import grouped

_numbers = count()


def fresh(prefix: str) -> str:
    return f"_{prefix}{next(_numbers)}"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "left") -> DataFrame:
    """Joins on pairs of columns where null equals null; no pairs means one row on the right."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # an aggregate without grouping: one row
    on = reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in keys])
    return left.join(right, on, how).drop(*[b for _, b in keys])


class Rows:
    """Rows of a home table, before and after the dimension filters.

    ``context`` is what FIXED expressions see.
    """

    def __init__(self, model, analyzer, context: DataFrame, filtered: DataFrame | None = None):
        self.model, self.analyzer, self.context = model, analyzer, context
        self.df = context if filtered is None else filtered

    def leaf(self, node: Node) -> Column | None:
        if isinstance(node, Field):
            return self.model.column(node)
        return F.col(f"`{node.column}`") if isinstance(node, Slot) else None

    def column(self, node: Node) -> Column:
        return Lowerer(self.analyzer, self.leaf).column(node)

    def with_fixed(self, *nodes: Node) -> tuple[Rows, list[Node]]:
        """The trees with their FIXED expressions as columns of the rows.

        Expressions of the same dimensions come from one group-by and one join.
        """
        rows, done = self, {}
        groups: dict[tuple[Node, ...], list[Lod]] = {}
        for lod in dict.fromkeys(x for n in nodes for x in outermost(n)):
            if lod.kind != "FIXED":
                raise UnsupportedCalc(f"{lod.kind} in a row-level calculation", "lod")
            groups.setdefault(lod.dims, []).append(lod)
        for dims, lods in groups.items():
            keys = [(fresh("key"), d) for d in dims]
            group = Grain(Rows(self.model, self.analyzer, self.context), keys)
            values = [(fresh("lod"), group.add(lod.body)) for lod in lods]
            right = group.frame().select(*[k for k, _ in keys], *[group.column(body).alias(v) for v, body in values])
            rows, trees = rows.with_fixed(*dims)
            own = [(fresh("dim"), d) for d in trees]
            left = rows.df.withColumns({c: rows.column(d) for c, d in own})
            joined = null_safe_join(left, right, [(c, k) for (c, _), (k, _) in zip(own, keys)]).drop(*[c for c, _ in own])
            rows = Rows(self.model, self.analyzer, rows.context, joined)
            done |= {lod: Slot(v, self.analyzer.info(lod).dtype, ROW) for lod, (v, _) in zip(lods, values)}

        def change(n: Node) -> Node:
            return done[n] if n in done else n.rebuild(change)

        return rows, [change(n) for n in nodes] if done else list(nodes)


def outermost(node: Node) -> list[Lod]:
    """The LOD expressions of a tree that are in no other one."""
    return [node] if isinstance(node, Lod) else [x for c in node.children() for x in outermost(c)]


class Grain:
    """Rows grouped by dimensions (name and tree); ``add`` gives trees over the grouped columns.

    LOD expressions of one kind and the same dimensions share a group-by.
    """

    def __init__(self, rows: Rows, dims: list[tuple[str, Node]]):
        self.analyzer, self.dims = rows.analyzer, dims
        self.rows, trees = rows.with_fixed(*[d for _, d in dims])
        self.row_dims = [(n, d) for (n, _), d in zip(dims, trees)]
        self.aggs: dict[Node, tuple[str, Column | Percentile]] = {}
        self.inner: dict[tuple, Inner] = {}

    def add(self, node: Node) -> Node:
        if isinstance(node, Call) and node.name in AGGREGATES and self.analyzer.info(node).level == AGG and not (node.name in ("MIN", "MAX") and len(node.args) == 2):
            direct = [a for a in node.args if isinstance(a, Lod)]
            return self.reaggregated(node, direct[0]) if direct else self.plain(node)
        if isinstance(node, Lod):
            return self.bare(node)
        return node.rebuild(self.add)

    def plain(self, node: Call) -> Slot:
        if node not in self.aggs:
            self.rows, args = self.rows.with_fixed(*node.args)
            column = aggregate(node.name, args, [self.rows.column(a) for a in args], [self.analyzer.info(a).dtype for a in node.args])
            self.aggs[node] = (fresh("agg"), column)
        return Slot(self.aggs[node][0], self.analyzer.info(node).dtype, AGG)

    def beside(self, kind: str, shared: list[tuple[str, Node]], more: tuple[Node, ...], outer: bool) -> Inner:
        """The group-by of LOD expressions over the dimensions ``shared`` with this grain and ``more`` ones."""
        at = (kind, tuple(d for _, d in shared), more, outer)
        if at not in self.inner:
            rows = Rows(self.rows.model, self.analyzer, self.rows.context, self.rows.context if kind == "FIXED" else self.rows.df)
            keys = [(n, fresh("key")) for n, _ in shared]
            grain = Grain(rows, [(k, d) for (_, k), (_, d) in zip(keys, shared)] + [(fresh("key"), d) for d in more])
            self.inner[at] = Inner(grain, keys, outer)
        return self.inner[at]

    def reaggregated(self, node: Call, lod: Lod) -> Slot:
        """OUTER({FIXED or INCLUDE dims : inner}): over the distinct grain, not over rows."""
        if node.name not in REAGGREGATES or len(node.args) > 1 and node.name != "PERCENTILE":
            raise UnsupportedCalc(f"{node.name} over a LOD expression", "lod")
        if lod.kind == "EXCLUDE" or not lod.dims:
            raise UnsupportedCalc(f"{node.name} over {'an EXCLUDE' if lod.dims else 'a table-scoped'} expression", "lod")
        own = {d for _, d in self.dims}
        inner = self.beside(lod.kind, self.dims, tuple(d for d in dict.fromkeys(lod.dims) if d not in own), True)
        args = [F.col(inner.value(lod.body)), *[self.rows.column(a) for a in node.args[1:]]]
        out = fresh("lod")
        inner.outer[out] = aggregate(node.name, node.args, args, [self.analyzer.info(a).dtype for a in node.args])
        return Slot(out, self.analyzer.info(node).dtype, AGG)

    def bare(self, lod: Lod) -> Slot:
        """A LOD expression as a value of this grain."""
        if lod.kind == "INCLUDE":
            raise UnsupportedCalc("INCLUDE without an outer aggregate", "lod")
        if lod.kind == "FIXED" and not set(lod.dims) <= {d for _, d in self.dims}:
            raise UnsupportedCalc("a FIXED expression of other dimensions without an outer aggregate", "lod")
        shared = [(n, d) for n, d in self.dims if (d in lod.dims) == (lod.kind == "FIXED")]
        value = self.beside(lod.kind, shared, (), False).value(lod.body)
        return Slot(value, self.analyzer.info(lod).dtype, AGG)

    def frame(self) -> DataFrame:
        """One row for each combination of the dimensions, with all columns that ``add`` promised."""
        dims = {n: self.rows.column(d) for n, d in self.row_dims}
        aggs = dict(self.aggs.values())
        rows = self.rows.df
        if aggs:
            out = grouped(rows, dims, aggs)
        elif dims:
            out = rows.select(*[c.alias(n) for n, c in dims.items()]).distinct()
        else:
            out = rows.groupBy().agg(F.count(F.lit(1)).alias(fresh("rows")))
        for inner in self.inner.values():
            out = null_safe_join(out, inner.frame(), inner.keys)
        return out

    def column(self, node: Node) -> Column:
        if self.analyzer.info(node).level not in (AGG, CONST, LOD):
            raise UnsupportedCalc("a bare field among aggregates", "grain")
        return Lowerer(self.analyzer, lambda n: F.col(f"`{n.column}`") if isinstance(n, Slot) else None).column(node)


class Inner:
    """A grain beside another: its values, aggregated again where ``again`` is set, by the keys that both share."""

    def __init__(self, grain: Grain, keys: list[tuple[str, str]], again: bool):
        self.grain, self.keys, self.again = grain, keys, again
        self.values: dict[Node, tuple[str, Node]] = {}
        self.outer: dict[str, Column | Percentile] = {}

    def value(self, body: Node) -> str:
        if body not in self.values:
            self.values[body] = (fresh("lod"), self.grain.add(body))
        return self.values[body][0]

    def frame(self) -> DataFrame:
        own = [k for _, k in self.keys]
        out = self.grain.frame().select(*(n for n, _ in self.grain.dims), *[self.grain.column(t).alias(v) for v, t in self.values.values()])
        return grouped(out, {k: F.col(k) for k in own}, self.outer) if self.again else out
