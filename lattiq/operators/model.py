"""The model layer: tables with captions, relationships, calculated fields and parameters.

A model never copies data.  It joins only the tables that a query needs, each
many-to-one along a unique path from the query's home table, so no row of the
home table is ever multiplied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.plans.analysis import RECORDS, spark_type, widened
from lattiq.plans.nodes import BOOL, DATE, DATETIME, INT, NULL, REAL, TEXT, Field, Lit, Node
from lattiq.plans.parser import parse


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``child`` to one of ``parent``, by one column each."""

    child: str
    child_column: str
    parent: str
    parent_column: str


@dataclass
class Table:
    name: str
    df: DataFrame
    #: Caption to column; columns without a caption go by their own name.
    captions: dict[str, str] = field(default_factory=dict)

    @cached_property
    def columns(self) -> dict[str, str]:
        named = set(self.captions.values())
        return {c: c for c in self.df.columns if c not in named} | self.captions

    @cached_property
    def types(self) -> dict[str, str | None]:
        return {f.name: spark_type(f.dataType) for f in self.df.schema}

    def qualified(self, column: str) -> str:
        return f"{self.name}__{column}"

    def frame(self) -> DataFrame:
        return self.df.select(*[widened(F.col(f"`{f.name}`"), f.dataType).alias(self.qualified(f.name)) for f in self.df.schema])


def _free(name: str, taken: set[str]) -> str:
    """The name, with a number where another one is the same but for case."""
    out, n = name, 2
    while out.lower() in taken:
        out, n = f"{name} {n}", n + 1
    taken.add(out.lower())
    return out


def literal(value) -> Lit:
    """A Python value as a literal."""
    for kind, dtype in ((bool, BOOL), (int, INT), (float, REAL), (str, TEXT), (datetime, DATETIME), (date, DATE)):
        if isinstance(value, kind):
            return Lit(value, dtype)
    if value is None:
        return Lit(None, NULL)
    raise UnsupportedCalc(f"no literal for {type(value).__name__}", "parameter")


class Model:
    """Tables, relationships, calculated fields (caption to formula) and parameters (name to value).

    ``anchor`` is what TODAY and relative dates refer to; by default the time
    at which the model was made, so one model gives one answer.  ``trusted``
    says that every child key has its parent: a parent's key column is then
    read from the child, without a join.
    """

    def __init__(self, tables: Sequence[Table], relationships: Sequence[Relationship] = (), calcs: Mapping[str, str] | None = None, params: Mapping[str, object] | None = None, anchor: datetime | None = None, trusted: bool = False):
        self.tables = {t.name: t for t in tables}
        self.relationships = list(relationships)
        self.calcs, self.params, self.trusted = dict(calcs or {}), dict(params or {}), trusted
        self.anchor = anchor or datetime.now(UTC).replace(tzinfo=None, microsecond=0)
        for r in self.relationships:
            for name, column in ((r.child, r.child_column), (r.parent, r.parent_column)):
                if name not in self.tables or column not in self.tables[name].df.columns:
                    raise UnsupportedCalc(f"a relationship needs {name}.{column}", "cross table")

    @classmethod
    def combined(cls, models: Sequence[Model]) -> Model:
        """All tables of several models; names of tables and calculations that clash get a number."""
        tables, edges, calcs, params = [], [], {}, {}
        for m in models:
            names = {}
            taken = {t.name.lower() for t in tables}
            for t in m.tables.values():
                names[t.name] = _free(t.name, taken)
                tables.append(Table(names[t.name], t.df, t.captions))
            edges += [Relationship(names[r.child], r.child_column, names[r.parent], r.parent_column) for r in m.relationships]
            taken = {c.lower() for c in calcs}
            for name, formula in m.calcs.items():
                calcs[name if calcs.get(name) == formula else _free(name, taken)] = formula
            params |= {k: v for k, v in m.params.items() if k not in params}
        return cls(tables, edges, calcs, params, models[0].anchor if models else None, all(m.trusted for m in models))

    def with_params(self, params: Mapping[str, object]) -> Model:
        if unknown := params.keys() - self.params.keys():
            raise UnsupportedCalc(f"no parameter {', '.join(sorted(unknown))}", "parameter")
        return Model(list(self.tables.values()), self.relationships, self.calcs, self.params | dict(params), self.anchor, self.trusted)

    @classmethod
    def single(cls, df: DataFrame, name: str = "data", **options) -> Model:
        return cls([Table(name, df, options.pop("captions", {}))], **options)

    # -- names -----------------------------------------------------------

    def resolve(self, f: Field) -> tuple[Table, str]:
        """The table and column of a field; ambiguous captions are refused, never guessed."""
        tables = [self.tables[f.table]] if f.table in self.tables else list(self.tables.values()) if f.table is None else []
        for same in (lambda a, b: a == b, lambda a, b: a.lower() == b.lower()):
            found = [(t, c) for t in tables for caption, c in t.columns.items() if same(caption, f.name)]
            if len(found) == 1:
                return found[0]
            if found:
                raise UnsupportedCalc(f"[{f.name}] is in {', '.join(t.name for t, _ in found)}", "field")
        raise UnsupportedCalc(f"no field [{f.name}]", "field")

    def field_type(self, f: Field) -> str:
        t, c = self.resolve(f)
        if t.types[c] is None:
            raise UnsupportedCalc(f"[{f.name}] has a type without calculations", "type")
        return t.types[c]

    def column(self, f: Field) -> Column:
        t, c = self.resolve(f)
        return F.col(f"`{t.qualified(c)}`")

    def param(self, name: str) -> Lit:
        if name not in self.params:
            raise UnsupportedCalc(f"no parameter [{name}]", "parameter")
        return literal(self.params[name])

    def expand(self, node: Node, path: tuple[str, ...] = ()) -> Node:
        """The tree with calculated fields put in; a cycle is refused."""
        if isinstance(node, Field):
            if node.table is None and node.name in self.calcs:
                if node.name in path:
                    raise UnsupportedCalc(" -> ".join([*path, node.name]), "cycle")
                return self.expand(parse(self.calcs[node.name]), (*path, node.name))
            if self.trusted and (key := self._child_key(node)) is not None:
                return key
            if node.name == RECORDS and not any(RECORDS in t.columns for t in self.tables.values()) or (node.table or "").endswith("_internal_object_id__"):
                return Lit(1, INT)
        return node.rebuild(lambda n: self.expand(n, path))

    def _child_key(self, f: Field) -> Field | None:
        """The child's column that equals a parent's key, from the only child there is."""
        try:
            t, c = self.resolve(f)
        except UnsupportedCalc:
            return None
        found = [r for r in self.relationships if (r.parent, r.parent_column) == (t.name, c)]
        return Field(found[0].child_column, found[0].child) if len(found) == 1 else None

    def tables_of(self, *nodes: Node) -> set[str]:
        return {self.resolve(f)[0].name for n in nodes for f in n.walk() if isinstance(f, Field)}

    def describe(self, spark) -> DataFrame:
        """What can be asked for: table, caption, column, type; calculations have no table, and parameters neither."""
        rows = [(t.name, caption, c, t.types[c]) for t in self.tables.values() for caption, c in t.columns.items()]
        rows += [(None, name, formula, "calculation") for name, formula in self.calcs.items()]
        rows += [(None, name, str(value), "parameter") for name, value in self.params.items()]
        return spark.createDataFrame(rows, "table string, caption string, column string, type string")

    # -- joins -----------------------------------------------------------

    def path(self, child: str, parent: str) -> list[Relationship] | None:
        """The only many-to-one path up from child to parent; None if there is none, refused if there are several."""
        found: list[list[Relationship]] = []

        def climb(at: str, so_far: list[Relationship]) -> None:
            if at == parent:
                found.append(so_far)
                return
            for r in self.relationships:
                if r.child == at and r.parent not in {child, *(x.parent for x in so_far)}:
                    climb(r.parent, [*so_far, r])

        climb(child, [])
        if len(found) > 1:
            raise UnsupportedCalc(f"several paths from {child} to {parent}", "cross table")
        return found[0] if found else None

    def home(self, tables: set[str]) -> str:
        """The table of which all others are parents, direct or not."""
        names = tables or ({next(iter(self.tables))} if len(self.tables) == 1 else set())
        homes = [t for t in names if all(self.path(t, o) is not None for o in names)]
        if len(homes) != 1:
            raise UnsupportedCalc(f"no single table reaches {', '.join(sorted(names)) or 'what is counted'}", "cross table")
        return homes[0]

    def frame(self, home: str, tables: set[str]) -> DataFrame:
        """The home table's rows, each once, with the columns of parents (left joins).

        Columns are called table__column.  Small parents are broadcast by
        their size, as Spark finds it; none is forced.
        """
        out, joined = self.tables[home].frame(), {home}
        for t in sorted(tables - {home}):
            path = self.path(home, t)
            if path is None:
                raise UnsupportedCalc(f"{home} has no path to {t}", "cross table")
            for r in path:
                if r.parent not in joined:
                    joined.add(r.parent)
                    parent = self.tables[r.parent]
                    left = F.col(f"`{self.tables[r.child].qualified(r.child_column)}`")
                    out = out.join(parent.frame(), left == F.col(f"`{parent.qualified(r.parent_column)}`"), "left")
        return out


# -- relationships that are found or checked ------------------------------


def is_unique(df: DataFrame, column: str) -> bool:
    """Whether non-null values of the column are distinct: one group-by, stopped at the first pair."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").limit(1).count() == 0


def upgraded(model: Model, a: tuple[str, str], b: tuple[str, str]) -> Relationship | None:
    """A many-to-one relationship toward ``b`` if b's column is a key, else None (stays many-to-many).

    Only the target side is probed and the direction never flips.
    """
    if is_unique(model.tables[b[0]].df, b[1]):
        return Relationship(*a, *b)
    return None


def key_like(table: str, column: str) -> bool:
    """Names of primary keys: ``id``, ``key``, ``pk``, or the table's name (or its singular) with one of those."""
    c, t = column.lower().replace("_", ""), table.lower().replace("_", "")
    names = {t, t.removesuffix("s")}
    return c in ("id", "key", "pk") or any(c == n + end for n in names for end in ("id", "key", "pk"))


def key_confidence(dtype: str, column: str) -> str:
    """How likely a column is a key: whole numbers and id-like names high, text and booleans low."""
    c = column.lower()
    if dtype == INT or c.endswith(("id", "key", "_pk")):
        return "high"
    return "low" if dtype in (TEXT, BOOL) else "medium"


def infer_relationships(model: Model, probe: bool = True) -> list[Relationship]:
    """Edges for columns that are called ``Base (Table)`` in one table and ``Base`` in Table.

    Types must agree; uniqueness decides the direction; a pair of tables gets
    one edge at most, and many-to-many gets none.
    """
    out, pairs = [], set()
    for t in model.tables.values():
        for caption, column in t.columns.items():
            if not caption.endswith(")") or " (" not in caption:
                continue
            base, _, other = caption[:-1].rpartition(" (")
            o = next((x for x in model.tables.values() if x.name.lower() == other.lower() and x is not t), None)
            home = o and next((c for k, c in o.columns.items() if k.lower() == base.lower()), None)
            if home is None or frozenset((t.name, o.name)) in pairs or t.types[column] != o.types[home]:
                continue
            if not probe or is_unique(o.df, home):
                out.append(Relationship(t.name, column, o.name, home))
            elif is_unique(t.df, column):
                out.append(Relationship(o.name, home, t.name, column))
            else:
                continue
            pairs.add(frozenset((t.name, o.name)))
    return out


# -- lookups and semi-joins -------------------------------------------------


def lookup(df: DataFrame, key: str, other: DataFrame, other_key: str, columns: Mapping[str, str], default: Mapping[str, object] | None = None) -> DataFrame:
    """Adds columns (new name to column of ``other``) by key; ``other`` is cut to one row a key.

    Where a key has several rows the least values are taken, so the result is
    defined and no row of ``df`` is multiplied.  Missing keys give null, or
    the default of that column.
    """
    one = other.filter(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias("_key")).agg(F.min(F.struct(*[F.col(c).alias(n) for n, c in columns.items()])).alias("_row"))
    out = df.join(one, df[key] == F.col("_key"), "left")
    pick = [F.coalesce(F.col("_row")[n], F.lit(default[n])).alias(n) if default and n in default else F.col("_row")[n].alias(n) for n in columns]
    return out.select(*[df[c] for c in df.columns], *pick)


def semi_join_chain(model: Model, source: str, target: str, condition: Column | None = None, max_hops: int = 4) -> DataFrame:
    """Rows of ``target`` that some row of ``source`` (where ``condition`` holds) leads to.

    Follows the unique relationship path, in either direction, of at most
    ``max_hops`` steps, as a chain of left semi joins: nothing is multiplied.
    """
    edges: dict[str, list[tuple[str, str, str]]] = {}
    for r in model.relationships:
        edges.setdefault(r.child, []).append((r.parent, r.child_column, r.parent_column))
        edges.setdefault(r.parent, []).append((r.child, r.parent_column, r.child_column))
    found: list[list[tuple[str, str, str]]] = []

    def walk(at: str, seen: set[str], so_far: list) -> None:
        if at == target:
            found.append(so_far)
        elif len(so_far) < max_hops:
            for step in edges.get(at, []):
                if step[0] not in seen:
                    walk(step[0], {*seen, step[0]}, [*so_far, step])

    walk(source, {source}, [])
    if len(found) != 1:
        raise UnsupportedCalc(f"{len(found)} paths from {source} to {target}", "cross table")
    rows = model.tables[source].df
    rows = rows if condition is None else rows.filter(condition)
    for table, near, far in found[0]:
        keys = rows.select(F.col(near).alias("_near"))
        nxt = model.tables[table].df
        rows = nxt.join(keys, nxt[far] == F.col("_near"), "left_semi")
    return rows


def countd_if_related(model: Model, field_table: str, column: str, source: str, condition: Column) -> DataFrame:
    """COUNTD(IF condition on another table THEN column END): one row ``n``, 0 if nothing matches."""
    return semi_join_chain(model, source, field_table, condition).agg(F.count_distinct(column).alias("n"))
