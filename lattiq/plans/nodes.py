"""The typed tree that formulas are parsed into."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from datetime import date, datetime

INT, REAL, TEXT, BOOL, DATE, DATETIME, NULL = "int", "real", "text", "bool", "date", "datetime", "null"
NUMBERS, TIMES = (INT, REAL), (DATE, DATETIME)


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()

    def rebuild(self, change: Callable[[Node], Node]) -> Node:
        """A copy whose children went through ``change``."""
        return replace(self, **{f.name: _mapped(getattr(self, f.name), change) for f in fields(self)})


def _nodes(x) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)


def _mapped(x, change):
    if isinstance(x, Node):
        return change(x)
    return tuple(_mapped(y, change) for y in x) if isinstance(x, tuple) else x


@dataclass(frozen=True)
class Lit(Node):
    value: int | float | str | bool | date | datetime | None
    dtype: str


@dataclass(frozen=True)
class Field(Node):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class In(Node):
    x: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Case(Node):
    """IF and searched CASE; a simple CASE has equality tests."""

    whens: tuple[tuple[Node, Node], ...]
    default: Node | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Lod(Node):
    """kind: FIXED, INCLUDE or EXCLUDE; the table-scoped form is FIXED without dimensions."""

    kind: str
    dims: tuple[Node, ...]
    body: Node


@dataclass(frozen=True)
class Slot(Node):
    """A column that the planner has worked out already."""

    column: str
    dtype: str
    level: str


@dataclass(frozen=True)
class Along(Node):
    """A table calculation with an addressing of its own inside another one."""

    body: Node
    partition: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]
