"""Comparing values: two expressions over one table, ranges, and probes of two tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.operators.model import Model
from lattiq.operators.profile import auto_grain, totals_and_dimensions
from lattiq.plans.analysis import AGG, Analyzer
from lattiq.plans.grain import Grain, Rows
from lattiq.plans.nodes import DATE, DATETIME, INT, REAL, TEXT, Field
from lattiq.plans.parser import parse

TOLERANCE = 1e-9
PROBE_TOLERANCE = 0.01


def close(a: Column, b: Column, relative: float = TOLERANCE, absolute: float = TOLERANCE) -> Column:
    """Equal within tolerance; two nulls agree, one null does not, and two NaN agree."""
    both = F.abs(a - b) <= absolute + relative * F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.isnan(a) & F.isnan(b)) | both)


def compare_scalars(a: Column, b: Column, exact: bool = False, relative: float = TOLERANCE, absolute: float = TOLERANCE, blank_is_zero: bool = True) -> Column:
    """``verified`` or ``mismatch``; by default a blank agrees with 0."""
    a, b = a.cast("double"), b.cast("double")
    if blank_is_zero:
        fill = lambda x, y: F.when(x.isNull() & (y == 0), F.lit(0.0)).otherwise(x)
        a, b = fill(a, b), fill(b, a)
    same = a.eqNullSafe(b) if exact else close(a, b, relative, absolute)
    return F.when(same, "verified").otherwise("mismatch")


def _both(model: Model, first: str, second: str):
    analyzer = Analyzer(model.field_type, model.param, model.anchor)
    trees = [model.expand(parse(f)) for f in (first, second)]
    if any(analyzer.info(t).level != AGG for t in trees):
        raise UnsupportedCalc("both sides must be aggregates", "grain")
    return analyzer, trees


def compare_expressions(model: Model, first: str, second: str, dims: Sequence[str] = ()) -> DataFrame:
    """Both expressions at the grain of ``dims`` with ``verdict``: agree, differ or blank (null on either side)."""
    analyzer, trees = _both(model, first, second)
    nodes = [model.expand(Field(d)) for d in dims]
    tables = model.tables_of(*trees, *nodes)
    home = model.home(tables)
    grain = Grain(Rows(model, analyzer, model.frame(home, tables | {home})), list(zip(dims, nodes)))
    a, b = (grain.add(t) for t in trees)
    frame = grain.frame().select(*[f"`{d}`" for d in dims], grain.column(a).cast("double").alias("first"), grain.column(b).cast("double").alias("second"))
    verdict = F.when(F.col("first").isNull() | F.col("second").isNull(), "blank").when(close(F.col("first"), F.col("second")), "agree").otherwise("differ")
    return frame.withColumn("verdict", verdict)


@dataclass(frozen=True)
class Verdict:
    status: str
    compared: int = 0
    where: str | None = None
    first: float | None = None
    second: float | None = None


def reconcile(model: Model, first: str, second: str, dims: Sequence[str] | None = None) -> Verdict:
    """``pass``, ``fail`` with one place where they differ, or ``inconclusive``.

    The total is always compared, and each column of few values (or the given
    grain), with one query a grain up to the first that differs.
    """
    try:
        analyzer, trees = _both(model, first, second)
        tables = model.tables_of(*trees)
        home = model.home(tables)
    except UnsupportedCalc as e:
        return Verdict("inconclusive", where=str(e))
    own = model.tables[home]
    used = {model.resolve(f)[1] for t in trees for f in t.walk() if isinstance(f, Field)}
    grains = [list(dims)] if dims else [[c] for c in auto_grain(own.df, skip=tuple(used))]
    compared = 0
    for grain in [[], *grains]:
        got = compare_expressions(model, first, second, grain)
        worst = got.groupBy().agg(F.count(F.when(F.col("verdict") != "blank", 1)).alias("n"), F.min(F.when(F.col("verdict") == "differ", F.struct(F.concat_ws(", ", *[F.concat(F.lit(f"{d}="), F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("null"))) for d in grain]).alias("at"), "first", "second"))).alias("bad")).first()
        compared += worst["n"]
        if (bad := worst["bad"]) is not None:
            return Verdict("fail", compared, bad["at"] or "grand total", bad["first"], bad["second"])
    return Verdict("pass", compared) if compared else Verdict("inconclusive", where="nothing to compare")


def rank_candidates(model: Model, truth: str, candidates: Sequence[str]) -> list[tuple[str, str]]:
    """Candidates with ``high`` (agrees), ``medium`` (can't be decided) or ``low`` (differs), best first, ties as given."""
    grade = {"pass": "high", "inconclusive": "medium", "fail": "low"}
    found = [(c, grade[reconcile(model, truth, c).status]) for c in candidates]
    return sorted(found, key=lambda x: ("high", "medium", "low").index(x[1]))


# -- ranges -------------------------------------------------------------------


def range_relationship(a_min: Column, a_max: Column, b_min: Column, b_max: Column, relative: float | None = None) -> Column:
    """equal, subset (a within b), superset, partial, disjoint or unknown, of two closed ranges.

    With ``relative`` ends count as equal within that tolerance.
    """
    a0, a1 = F.least(a_min, a_max), F.greatest(a_min, a_max)
    b0, b1 = F.least(b_min, b_max), F.greatest(b_min, b_max)
    same = (lambda x, y: x == y) if relative is None else (lambda x, y: F.abs(x - y) <= relative * F.greatest(F.abs(x), F.abs(y)) + 1e-9)
    unknown = a_min.isNull() | a_max.isNull() | b_min.isNull() | b_max.isNull()
    return (
        F.when(unknown, "unknown")
        .when(F.greatest(a0, b0) > F.least(a1, b1), "disjoint")
        .when(same(a0, b0) & same(a1, b1), "equal")
        .when((a0 >= b0) & (a1 <= b1), "subset")
        .when((b0 >= a0) & (b1 <= a1), "superset")
        .otherwise("partial")
    )


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> tuple[Column, Column]:
    return F.greatest(a_min, b_min), F.least(a_max, b_max)


# -- probes ---------------------------------------------------------------------


@dataclass(frozen=True)
class Probe:
    column: str
    function: str  # SUM or COUNTD


#: Names that say little about whether two tables are the same (fixed values).
GENERIC = frozenset(
    "id key pk fk uuid guid rowid index seq name fullname firstname lastname title label description desc code type category status state flag active enabled "
    "date datetime timestamp createddate modifieddate updateddate createdat updatedat year month day week quarter hour value amount qty quantity count total sum price cost "
    "region country city zip zipcode postalcode address currency comment comments notes source version number num".split()
)


def plan_probes(a: DataFrame, b: DataFrame, most_columns: int = 4, measures: Sequence[str] = ()) -> tuple[list[str], list[Probe]]:
    """Window columns (dates first, then numbers that are no measures) and probes over shared columns.

    Distinctive names come first; numbers get SUM and all get COUNTD.
    """
    from lattiq.plans.analysis import spark_type

    types = [{f.name: spark_type(f.dataType) for f in df.schema} for df in (a, b)]
    shared = sorted(set(types[0]) & set(types[1]), key=lambda c: (c.lower().replace("_", "") in GENERIC, c))[: max(0, most_columns)]
    windows, probes = [], []
    for c in shared:
        kind = {INT: "number", REAL: "number", DATE: "date", DATETIME: "date"}
        kinds = {kind.get(t[c], TEXT) for t in types}
        if kinds == {"date"} or kinds == {"number"} and c not in measures:
            windows.append((kinds != {"date"}, c))
        if kinds == {"number"}:
            probes.append(Probe(c, "SUM"))
        probes.append(Probe(c, "COUNTD"))
    return [c for _, c in sorted(windows, key=lambda w: w[0])], probes


def verify_tables(a: DataFrame, b: DataFrame, windows: Sequence[str], probes: Sequence[Probe], tolerance: float = PROBE_TOLERANCE) -> DataFrame:
    """One row for each probe: column, function, first, second, window_column, relationship, outcome.

    Both tables are cut to the overlap of the first window column whose
    ranges meet, then each is aggregated once.  outcome: agree, disagree or
    inconclusive; without a window first_ge or second_ge says on which side
    the larger value is.  Ranges that do not meet give ``disjoint`` rows.
    """
    spark, relation, chosen = a.sparkSession, "unknown", None
    for w in windows:
        ends = [df.agg(F.min(w).alias("lo"), F.max(w).alias("hi")) for df in (a, b)]
        both = ends[0].crossJoin(ends[1].select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2")))  # one row each
        numeric = dict(a.dtypes)[w] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        got = both.select("lo", "hi", "lo2", "hi2", range_relationship(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"), tolerance if numeric else None).alias("r")).first()
        relation = got["r"]
        if relation == "disjoint":
            rows = [(p.column, p.function, None, None, w, relation, "disagree") for p in probes]
            return spark.createDataFrame(rows, "column string, function string, first double, second double, window_column string, relationship string, outcome string")
        if relation != "unknown":
            chosen = w
            a, b = (df.filter(F.col(w).between(F.lit(max(got["lo"], got["lo2"])), F.lit(min(got["hi"], got["hi2"])))) for df in (a, b))
            break
    build = {"SUM": lambda c: F.sum(c), "COUNTD": lambda c: F.count_distinct(c)}
    one = [df.agg(*[build[p.function](p.column).cast("double").alias(f"p{i}") for i, p in enumerate(probes)]) for df in (a, b)]
    pair = one[0].crossJoin(one[1].select(*[F.col(f"p{i}").alias(f"q{i}") for i in range(len(probes))]))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(p.column).alias("column"), F.lit(p.function).alias("function"), F.col(f"p{i}").alias("first"), F.col(f"q{i}").alias("second")) for i, p in enumerate(probes)])).alias("x")
    out = pair.select(rows).select("x.*")
    x, y = F.col("first"), F.col("second")
    agree = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))
    differs = F.lit("disagree") if chosen else F.when(y >= x, "second_ge").otherwise("first_ge")
    outcome = F.when(x.isNull() & y.isNull(), "agree").when(x.isNull() | y.isNull(), "inconclusive").when(agree, "agree").otherwise(differs)
    return out.select("column", "function", "first", "second", F.lit(chosen).cast("string").alias("window_column"), F.lit(relation if chosen else "unknown").alias("relationship"), outcome.alias("outcome"))


def verdict_of(probes: DataFrame) -> DataFrame:
    """One row: verdict (verified, compatible, mismatch, inconclusive), relationship, agreed, disagreed."""
    n = lambda *kinds: F.count(F.when(F.col("outcome").isin(*kinds), 1))
    s = probes.agg(F.max(F.coalesce("window_column", F.lit(""))).alias("w"), F.max("relationship").alias("r"), n("agree").alias("agreed"), n("disagree").alias("bad"), n("first_ge").alias("fge"), n("second_ge").alias("sge"))
    windowed = F.col("w") != ""
    directions = (F.col("fge") > 0).cast("int") + (F.col("sge") > 0).cast("int")
    verdict = (
        F.when(windowed & (F.col("bad") > 0), "mismatch")
        .when(windowed & (F.col("agreed") > 0), "verified")
        .when(windowed | (F.col("agreed") + F.col("fge") + F.col("sge") == 0), "inconclusive")
        .when(directions == 0, "verified")
        .when(directions == 1, "compatible")
        .otherwise("inconclusive")
    )
    relation = F.when(windowed, F.col("r")).when(verdict == "inconclusive", F.when(directions == 2, "partial").otherwise("unknown")).when(directions == 0, "equal").when(F.col("sge") > 0, "subset").otherwise("superset")
    return s.select(verdict.alias("verdict"), relation.alias("relationship"), "agreed", (F.col("bad") + F.col("fge") + F.col("sge")).alias("disagreed"))


__all__ = ["Probe", "Verdict", "close", "compare_expressions", "compare_scalars", "overlap", "plan_probes", "range_relationship", "rank_candidates", "reconcile", "totals_and_dimensions", "verdict_of", "verify_tables"]
