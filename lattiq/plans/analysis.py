"""Types and levels of trees, and their lowering to Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.functions.aggregates import AGGREGATES
from lattiq.functions.scalar import REFUSED, SCALARS, common_type, divide, double, floored_mod
from lattiq.plans.nodes import BOOL, DATE, DATETIME, INT, NULL, NUMBERS, REAL, TEXT, TIMES, Along, Binary, Call, Case, Field, In, Lit, Lod, Node, Param, Slot, Unary

#: Levels: constant, row, aggregate (one value a mark), table (over marks). A LOD expression fits row and aggregate.
CONST, ROW, AGG, TABLE, LOD = "const", "row", "agg", "table", "lod"

_WINDOWED = ("SUM", "AVG", "MIN", "MAX", "COUNT", "MEDIAN", "STDEV", "STDEVP", "VAR", "VARP")
#: Table calculations: least and most arguments.
TABLE_CALCS = (
    dict.fromkeys(("INDEX", "SIZE", "FIRST", "LAST"), (0, 0))
    | {f"RUNNING_{a}": (1, 1) for a in ("SUM", "AVG", "MIN", "MAX", "COUNT")}
    | {f"WINDOW_{a}": (1, 3) for a in _WINDOWED}
    | dict.fromkeys(("RANK", "RANK_DENSE", "RANK_MODIFIED", "RANK_PERCENTILE", "RANK_UNIQUE"), (1, 2))
    | {"WINDOW_PERCENTILE": (2, 4), "LOOKUP": (2, 2), "TOTAL": (1, 1), "PREVIOUS_VALUE": (1, 1)}
    | dict.fromkeys(("WINDOW_CORR", "WINDOW_COVAR", "WINDOW_COVARP"), (2, 4))
)
RECORDS = "Number of Records"


def spark_type(kind: T.DataType) -> str | None:
    """The formula language's type of a column; None where it has none (arrays, maps, structs, binary)."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return REAL
    for k, name in ((T.StringType, TEXT), (T.CharType, TEXT), (T.VarcharType, TEXT), (T.BooleanType, BOOL), (T.DateType, DATE), (T.TimestampType, DATETIME), (T.TimestampNTZType, DATETIME)):
        if isinstance(kind, k):
            return name
    return None


def widened(column: Column, kind: T.DataType) -> Column:
    """Whole numbers as bigint and floats as double, so that results don't depend on storage widths."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return column.cast("bigint")
    return column.cast("double") if isinstance(kind, T.FloatType) else column


@dataclass(frozen=True)
class Info:
    dtype: str
    level: str


def join_levels(*levels: str) -> str:
    kinds = set(levels) - {CONST}
    if ROW in kinds and kinds & {AGG, TABLE}:
        raise UnsupportedCalc("a bare field among aggregates", "grain")
    for level in (TABLE, AGG, ROW, LOD):
        if level in kinds:
            return level
    return CONST


class Analyzer:
    """Checks trees against the fields and parameters there are."""

    def __init__(self, field_type: Callable[[Field], str], param: Callable[[str], Lit], anchor: datetime):
        self.field_type, self.param, self.anchor = field_type, param, anchor
        self.known: dict[Node, Info] = {}

    def info(self, node: Node) -> Info:
        found = self.known.get(node)
        if found is None:
            found = self.known[node] = self._info(node)
        return found

    def _info(self, node: Node) -> Info:
        if isinstance(node, Lit):
            return Info(node.dtype, CONST)
        if isinstance(node, Slot):
            return Info(node.dtype, node.level)
        if isinstance(node, Param):
            return Info(self.param(node.name).dtype, CONST)
        if isinstance(node, Field):
            return Info(self.field_type(node), ROW)
        if isinstance(node, Unary):
            x = self.info(node.x)
            self._want(x.dtype, (BOOL,) if node.op == "NOT" else NUMBERS, node.op)
            return x
        if isinstance(node, Binary):
            return self._binary(node)
        if isinstance(node, In):
            infos = [self.info(n) for n in (node.x, *node.items)]
            if not all(self._comparable(infos[0].dtype, i.dtype) for i in infos[1:]):
                raise UnsupportedCalc("IN over mixed types", "type")
            return Info(BOOL, join_levels(*(i.level for i in infos)))
        if isinstance(node, Case):
            return self._case(node)
        if isinstance(node, Lod):
            return self._lod(node)
        if isinstance(node, Along):
            return self.info(node.body)
        assert isinstance(node, Call)
        return self._call(node)

    @staticmethod
    def _want(dtype: str, kinds: tuple[str, ...], what: str) -> None:
        if dtype not in (*kinds, NULL):
            raise UnsupportedCalc(f"{what} does not take {dtype}", "type")

    @staticmethod
    def _comparable(a: str, b: str) -> bool:
        return NULL in (a, b) or a == b or {a, b} <= set(NUMBERS) or {a, b} <= set(TIMES)

    def _binary(self, node: Binary) -> Info:
        a, b, op = self.info(node.a), self.info(node.b), node.op
        level = join_levels(a.level, b.level)
        if op in ("AND", "OR"):
            self._want(a.dtype, (BOOL,), op)
            self._want(b.dtype, (BOOL,), op)
            return Info(BOOL, level)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            if not self._comparable(a.dtype, b.dtype) or op not in ("=", "<>") and BOOL in (a.dtype, b.dtype):
                raise UnsupportedCalc(f"{a.dtype} {op} {b.dtype}", "type")
            return Info(BOOL, level)
        if op == "+" and TEXT in (a.dtype, b.dtype):
            self._want(a.dtype, (TEXT,), op)
            self._want(b.dtype, (TEXT,), op)
            return Info(TEXT, level)
        if op in "+-" and a.dtype in TIMES:
            if op == "-" and b.dtype in TIMES:
                return Info(INT if (a.dtype, b.dtype) == (DATE, DATE) else REAL, level)
            self._want(b.dtype, NUMBERS, f"{a.dtype} {op}")
            return Info(DATE if a.dtype == DATE and b.dtype == INT else DATETIME, level)
        self._want(a.dtype, NUMBERS, op)
        self._want(b.dtype, NUMBERS, op)
        return Info(REAL if op in "/^" else common_type(a.dtype, b.dtype), level)

    def _case(self, node: Case) -> Info:
        tests, values = [self.info(t) for t, _ in node.whens], [self.info(v) for _, v in node.whens]
        if node.default is not None:
            values.append(self.info(node.default))
        for t in tests:
            self._want(t.dtype, (BOOL,), "a condition")
        dtype = common_type(*(v.dtype for v in values))
        if not dtype:
            raise UnsupportedCalc("branches of different types", "type")
        return Info(dtype, join_levels(*(i.level for i in (*tests, *values))))

    def _lod(self, node: Lod) -> Info:
        for d in node.dims:
            if self.info(d).level not in (ROW, LOD):
                raise UnsupportedCalc("a LOD dimension must be a row-level field", "lod")
        inside = [n for n in node.body.walk() if isinstance(n, Lod)]
        if inside and (node.kind != "FIXED" or any(n.kind != "FIXED" for n in inside)):
            raise UnsupportedCalc("INCLUDE and EXCLUDE do not nest", "lod")
        body = self.info(node.body)
        if body.level not in (AGG, LOD):
            raise UnsupportedCalc("a LOD expression needs an aggregate", "lod")
        return Info(body.dtype, LOD)

    def _call(self, node: Call) -> Info:
        name = node.name
        if name in REFUSED:
            raise UnsupportedCalc(f"{name} is never computed", "function")
        args = [self.info(a) for a in node.args]
        dtypes = [a.dtype for a in args]
        if name in ("TODAY", "NOW"):
            return Info(DATE if name == "TODAY" else DATETIME, CONST)
        if name == "USERNAME":
            raise UnsupportedCalc("USERNAME outside a row filter", "function")
        if name in ("MIN", "MAX") and len(args) == 2:  # the row-level forms
            if not self._comparable(*dtypes):
                raise UnsupportedCalc(f"{name} over mixed types", "type")
            return Info(common_type(*dtypes), join_levels(*(a.level for a in args)))
        if name in AGGREGATES:
            if any(a.level in (AGG, TABLE) for a in args):
                raise UnsupportedCalc(f"{name} of an aggregate", "grain")
            if name in ("COUNTD", "ATTR", "GROUP_CONCAT", "CORR", "COVAR", "COVARP") and any(isinstance(a, Lod) for a in node.args):
                raise UnsupportedCalc(f"{name} over a LOD expression", "lod")
            return Info(AGGREGATES[name].result_of(node.args, dtypes), AGG)
        if name in TABLE_CALCS:
            return Info(self._table_type(node, args), TABLE)
        if name not in SCALARS:
            raise UnsupportedCalc(f"no function {name}", "function")
        return Info(SCALARS[name].result_of(node.args, dtypes), join_levels(*(a.level for a in args)))

    def _table_type(self, node: Call, args: list[Info]) -> str:
        name, (least, most) = node.name, TABLE_CALCS[node.name]
        if not least <= len(args) <= most or name.startswith("WINDOW_") and (most - len(args)) % 2:
            raise UnsupportedCalc(f"{name} does not take {len(args)} arguments", "table calc")
        if any(a.level == ROW for a in args):
            raise UnsupportedCalc(f"{name} needs an aggregate", "grain")
        if name == "TOTAL" and args[0].level != AGG:
            raise UnsupportedCalc("TOTAL needs an aggregate", "table calc")
        last = name.rpartition("_")[2]
        if name in ("INDEX", "SIZE", "FIRST", "LAST") or last == "COUNT" or name.startswith("RANK") and last != "PERCENTILE":
            return INT
        if args and name not in ("LOOKUP", "TOTAL", "PREVIOUS_VALUE") and last not in ("MIN", "MAX") and not name.startswith("RANK"):
            self._want(args[0].dtype, NUMBERS, name)
        if last in ("AVG", "MEDIAN", "STDEV", "STDEVP", "VAR", "VARP", "PERCENTILE", "CORR", "COVAR", "COVARP"):
            return REAL
        return args[0].dtype


class Lowerer:
    """Builds the Spark column of a tree; ``leaf`` gives the columns of fields and of what was worked out."""

    def __init__(self, analyzer: Analyzer, leaf: Callable[[Node], Column | None]):
        self.analyzer, self.leaf = analyzer, leaf

    def column(self, node: Node) -> Column:
        if (found := self.leaf(node)) is not None:
            return found
        if isinstance(node, Lit):
            return self.literal(node)
        if isinstance(node, Param):
            return self.literal(self.analyzer.param(node.name))
        if isinstance(node, Unary):
            return ~self.truth(node.x) if node.op == "NOT" else -self.column(node.x)
        if isinstance(node, Binary):
            return self.binary(node)
        if isinstance(node, In):
            return self.column(node.x).isin([self.column(i) for i in node.items])
        if isinstance(node, Case):
            out = None
            for test, value in node.whens:
                out = (F if out is None else out).when(self.truth(test), self.column(value))
            return out if node.default is None else out.otherwise(self.column(node.default))
        if isinstance(node, Call):
            return self.call(node)
        raise UnsupportedCalc(f"{type(node).__name__} {getattr(node, 'name', '')} can't stand here", "grain")

    def truth(self, node: Node) -> Column:
        """A condition; a bare NULL is one of unknown truth."""
        x = self.column(node)
        return x.cast("boolean") if self.analyzer.info(node).dtype == NULL else x

    @staticmethod
    def literal(node: Lit) -> Column:
        if node.dtype == NULL:
            return F.lit(None)
        if node.dtype == DATETIME:
            return F.lit(node.value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
        return F.lit(node.value).cast("bigint") if node.dtype == INT else F.lit(node.value)

    def binary(self, node: Binary) -> Column:
        op = node.op
        if op in ("AND", "OR"):
            a, b = self.truth(node.a), self.truth(node.b)
            return a & b if op == "AND" else a | b
        a, b = self.column(node.a), self.column(node.b)
        ta, tb = self.analyzer.info(node.a).dtype, self.analyzer.info(node.b).dtype
        if op == "=":
            return a == b
        if op == "<>":
            return a != b
        if op in ("<", "<=", ">", ">="):
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op == "/":
            return divide(a, b)
        if op == "%":
            return floored_mod(a, b)
        if op == "^":
            return F.pow(double(a), double(b))
        if op == "*":
            return a * b
        if TEXT in (ta, tb):
            return F.concat(a, b)
        if ta in TIMES:
            return self.shifted(a, b, ta, tb, op)
        return a + b if op == "+" else a - b

    @staticmethod
    def shifted(a: Column, b: Column, ta: str, tb: str, op: str) -> Column:
        if tb in TIMES:
            if (ta, tb) == (DATE, DATE):
                return F.datediff(a, b).cast("bigint")
            return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86_400_000_000.0
        n = b if op == "+" else -b
        if ta == DATE and tb == INT:
            return F.date_add(a, n.cast("int"))
        return F.timestamp_micros(F.unix_micros(a.cast("timestamp")) + F.round(n * 86_400_000_000.0).cast("bigint"))

    def call(self, node: Call) -> Column:
        if node.name in ("TODAY", "NOW"):
            now = self.analyzer.anchor
            return F.lit(now.date()) if node.name == "TODAY" else self.literal(Lit(now, DATETIME))
        if node.name in ("MIN", "MAX") and len(node.args) == 2:  # null if either is
            a, b = (self.column(x) for x in node.args)
            return F.when(a.isNotNull() & b.isNotNull(), (F.least if node.name == "MIN" else F.greatest)(a, b))
        if node.name in SCALARS:
            own = SCALARS[node.name]
            return own.column(node.args, [self.truth(a) if code == "b" else self.column(a) for code, a in zip(own.params, node.args)])
        raise UnsupportedCalc(f"{node.name} can't stand here", "grain")
