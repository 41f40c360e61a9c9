"""Table calculations: windows over marks, the aggregated rows of a view.

Marks are as many as the view shows, not as the tables have rows.  Frames are
always stated, because Spark's default with an order is RANGE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.functions.scalar import divide
from lattiq.plans.analysis import TABLE, TABLE_CALCS, Analyzer, Lowerer
from lattiq.plans.grain import fresh
from lattiq.plans.nodes import BOOL, DATE, DATETIME, INT, NULL, REAL, TEXT, Along, Binary, Call, Case, Lit, Node, Param, Slot

_START, _END = Window.unboundedPreceding, Window.unboundedFollowing
_PLAIN = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "STDEV": F.stddev_samp, "STDEVP": F.stddev_pop, "VAR": F.var_samp, "VARP": F.var_pop}
_WHOLE_ONLY = {"MEDIAN": lambda x: F.median(x.cast("double"))}
SPARK_NAMES = {INT: "bigint", REAL: "double", TEXT: "string", BOOL: "boolean", DATE: "date", DATETIME: "timestamp", NULL: "void"}
_PAIRED = {"CORR": F.corr, "COVAR": F.covar_samp, "COVARP": F.covar_pop}


@dataclass(frozen=True)
class Addressing:
    """Output columns that restart a calculation, and those along which it runs (name, descending)."""

    partition: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()

    def window(self):
        return Window.partitionBy(*[F.col(f"`{p}`") for p in self.partition])

    def keys(self) -> list[Column]:
        if not self.order:
            raise UnsupportedCalc("this calculation needs an order", "table calc")
        return [F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_first() for n, down in self.order]

    def ordered(self):
        return self.window().orderBy(*self.keys())


def _is_previous(node: Node) -> bool:
    return isinstance(node, Call) and node.name == "PREVIOUS_VALUE"


def bound(node: Node) -> int:
    """A whole number, or FIRST() or LAST() for an end of the partition."""
    if isinstance(node, Lit) and node.dtype == INT:
        return node.value
    if isinstance(node, Call) and node.name in ("FIRST", "LAST"):
        return _START if node.name == "FIRST" else _END
    raise UnsupportedCalc("frame bounds must be whole numbers, FIRST() or LAST()", "table calc")


class TableCalcs:
    """Works out trees over marks; each calculation becomes a column, so that they may nest."""

    def __init__(self, marks: DataFrame, analyzer: Analyzer, total: Callable[[DataFrame, Node, Addressing], tuple[DataFrame, Node]]):
        self.marks, self.analyzer, self.total = marks, analyzer, total
        self.done: dict[tuple[Node, Addressing], Slot] = {}

    def lower(self, node: Node) -> Column:
        return Lowerer(self.analyzer, lambda n: F.col(f"`{n.column}`") if isinstance(n, Slot) else None).column(node)

    def value(self, node: Node, at: Addressing) -> Node:
        """A whole calculation, which may refer to its own previous result."""
        if any(_is_previous(n) for n in node.walk()):
            return self.folded(node, at)
        return self.add(node, at)

    def folded(self, node: Node, at: Addressing) -> Slot:
        """An expression with PREVIOUS_VALUE: folded over the marks up to each one (an extension).

        The list of marks before each mark is squared in the length of a
        partition, which is that of an axis.
        """
        starts = {n.args[0] for n in node.walk() if _is_previous(n)}
        if len(starts) > 1 or any(not isinstance(s, (Lit, Param)) for s in starts):
            raise UnsupportedCalc("PREVIOUS_VALUE needs one constant to begin with", "table calc")

        def rest(n: Node) -> Node:
            if _is_previous(n):
                return n
            if isinstance(n, Call) and n.name in TABLE_CALCS:
                if any(_is_previous(x) for x in n.walk()):
                    raise UnsupportedCalc(f"{n.name} of PREVIOUS_VALUE", "table calc")
                return self.add(n, at)
            return n.rebuild(rest)

        node = rest(node)
        dtype = self.analyzer.info(node).dtype
        kind = SPARK_NAMES[dtype]
        inputs = sorted({n.column for n in node.walk() if isinstance(n, Slot)})
        marks = F.collect_list(F.struct(*[F.col(f"`{c}`").alias(c) for c in inputs], F.lit(1).alias("_one"))).over(at.ordered().rowsBetween(_START, 0))

        def step(so_far: Column, mark: Column) -> Column:
            leaf = lambda n: mark[n.column] if isinstance(n, Slot) else so_far if _is_previous(n) else None
            return Lowerer(self.analyzer, leaf).column(node).cast(kind)

        found, out = fresh("marks"), fresh("calc")
        self.marks = self.marks.withColumn(found, marks).withColumn(out, F.aggregate(F.col(found), self.lower(next(iter(starts))).cast(kind), step)).drop(found)
        return Slot(out, dtype, TABLE)

    def add(self, node: Node, at: Addressing) -> Node:
        if isinstance(node, Along):
            return self.add(node.body, Addressing(node.partition, node.order))
        if not (isinstance(node, Call) and node.name in TABLE_CALCS):
            return node.rebuild(lambda n: self.add(n, at))
        if (node, at) in self.done:
            return self.done[node, at]
        dtype = self.analyzer.info(node).dtype
        if node.name == "TOTAL":
            self.marks, out = self.total(self.marks, node.args[0], at)
            return out
        values = []
        for k, a in enumerate(node.args):
            if k > (node.name.rpartition("_")[2] in _PAIRED):  # bounds, offsets and directions
                values.append(a)
                continue
            a = self.add(a, at)
            if any(isinstance(n, Slot) and n.level == TABLE for n in a.walk()) and not isinstance(a, Slot):
                column = fresh("arg")
                self.marks = self.marks.withColumn(column, self.lower(a))
                a = Slot(column, self.analyzer.info(a).dtype, TABLE)
            values.append(a)
        out = fresh("calc")
        self.marks = self.marks.withColumn(out, self.calc(node.name, tuple(values), at))
        self.done[node, at] = slot = Slot(out, dtype, TABLE)
        return slot

    def calc(self, name: str, args: tuple[Node, ...], at: Addressing) -> Column:
        whole = at.window()
        size = F.count(F.lit(1)).over(whole)
        if name == "SIZE":
            return size
        if name in ("INDEX", "FIRST", "LAST"):
            place = F.row_number().over(at.ordered()).cast("bigint")
            return {"INDEX": place, "FIRST": 1 - place, "LAST": size - place}[name]
        x = self.lower(args[0])
        if name == "LOOKUP":
            k = bound(args[1])
            if k in (_START, _END):
                return (F.first if k == _START else F.last)(x).over(at.ordered().rowsBetween(_START, _END))
            return F.lag(x, -k).over(at.ordered()) if k < 0 else F.lead(x, k).over(at.ordered()) if k else x
        if name.startswith("RANK"):
            return self.rank(name, x, args, at, size)
        family, _, what = name.partition("_")
        if family == "RUNNING":
            return _PLAIN[what](x).over(at.ordered().rowsBetween(_START, 0))
        pair = what in _PAIRED
        fixed = 2 if pair or what == "PERCENTILE" else 1
        frame = args[fixed:]
        ends = (bound(frame[0]), bound(frame[1])) if frame else (_START, _END)
        moving = ends != (_START, _END)
        if pair:
            y = self.lower(args[1])
            both = x.isNotNull() & y.isNotNull()
            f = lambda: _PAIRED[what](F.when(both, x.cast("double")), F.when(both, y.cast("double")))
        elif what == "PERCENTILE":
            if not isinstance(args[1], Lit):
                raise UnsupportedCalc("WINDOW_PERCENTILE needs a literal", "table calc")
            f = lambda: F.percentile(x.cast("double"), args[1].value)
        else:
            f = lambda: (_PLAIN.get(what) or _WHOLE_ONLY[what])(x)
        if moving and what in ("MEDIAN", "PERCENTILE"):
            raise UnsupportedCalc(f"a moving {name}", "table calc")
        return f().over(at.ordered().rowsBetween(*ends) if moving else whole)

    def rank(self, name: str, x: Column, args: tuple[Node, ...], at: Addressing, size: Column) -> Column:
        way = "asc" if name == "RANK_PERCENTILE" else "desc"
        if len(args) > 1:
            if not isinstance(args[1], Lit) or str(args[1].value).lower() not in ("asc", "desc"):
                raise UnsupportedCalc("ranks go 'asc' or 'desc'", "table calc")
            way = args[1].value.lower()
        key = x.asc_nulls_last() if way == "asc" else x.desc_nulls_last()
        by = at.window().orderBy(key)
        if name == "RANK":
            out = F.rank().over(by)
        elif name == "RANK_DENSE":
            out = F.dense_rank().over(by)
        elif name == "RANK_UNIQUE":  # ties in the order of addressing
            out = F.row_number().over(at.window().orderBy(key, *at.keys()))
        else:
            last = F.count(F.lit(1)).over(by.rangeBetween(_START, 0))
            if name == "RANK_MODIFIED":
                out = last
            else:
                ranked = F.count(x).over(at.window())
                return F.when(x.isNotNull(), F.when(ranked == 1, F.lit(0.0)).otherwise(divide(last - 1, ranked - 1)))
        return F.when(x.isNotNull(), out.cast("bigint"))


# -- quick table calculations ----------------------------------------------


def quick(kind: str, x: Node, **options) -> Node:
    """The tree of a quick table calculation over an aggregate.

    running (agg), window (agg, start, end), rank (style, way), difference,
    percent_difference (absolute: divide by the size of the prior value, which
    is the default, or by the value itself), percent_of_total, moving_average
    (back, forth), compound_growth, percentile, year_over_year (per: marks a
    year), year_to_date_growth (per, and partition and order of the sum to
    date, which restarts each year while the growth runs along all years).
    """
    k = lambda v: Lit(v, INT)
    if kind == "year_to_date_growth":
        to_date = Along(Call("RUNNING_SUM", (x,)), tuple(options["partition"]), tuple((o, False) for o in options["order"]))
        return quick("year_over_year", to_date, per=options["per"])
    prior = Call("LOOKUP", (x, k(-options.get("per", 1))))
    if kind in ("running", "year_to_date"):  # year to date: with the year among the partition
        return Call(f"RUNNING_{options.get('agg', 'SUM')}", (x,))
    if kind == "window":
        ends = (options.get("start"), options.get("end"))
        if (ends[0] is None) != (ends[1] is None):
            raise UnsupportedCalc("a window needs both bounds or none", "table calc")
        return Call(f"WINDOW_{options.get('agg', 'SUM')}", (x, *[k(e) for e in ends if e is not None]))
    if kind == "moving_average":
        return Call("WINDOW_AVG", (x, k(-options.get("back", 2)), k(options.get("forth", 0))))
    if kind == "rank":
        style = {"competition": "RANK", "dense": "RANK_DENSE", "modified": "RANK_MODIFIED", "unique": "RANK_UNIQUE"}.get(options.get("style", "competition"))
        if style is None:
            raise UnsupportedCalc("ranks are competition, dense, modified or unique", "table calc")
        return Call(style, (x, Lit(options.get("way", "desc"), "text")))
    if kind == "difference":
        return Binary("-", x, prior)
    if kind in ("percent_difference", "year_over_year"):
        base = Call("ABS", (prior,)) if options.get("absolute", True) else prior
        return Binary("/", Binary("-", x, prior), base)
    if kind == "percent_of_total":
        return Binary("/", x, Call("TOTAL", (x,)))
    if kind == "compound_growth":  # (x / first) to the power 1 / (place - 1), less 1; 0 on the first mark
        first, place = Call("LOOKUP", (x, Call("FIRST", ()))), Call("INDEX", ())
        root = Binary("/", k(1), Binary("-", place, k(1)))
        return Case(((Binary("=", place, k(1)), k(0)),), Binary("-", Binary("^", Binary("/", x, first), root), k(1)))
    if kind == "percentile":  # by distinct values
        up, down = Call("RANK_DENSE", (x, Lit("asc", "text"))), Call("RANK_DENSE", (x, Lit("desc", "text")))
        return Binary("/", Binary("-", up, k(1)), Binary("-", Binary("+", up, down), k(2)))
    raise UnsupportedCalc(f"no quick table calculation {kind}", "table calc")
