"""Group-bys with exact percentiles whose groups need not fit in a task.

Spark's ``percentile`` brings the distinct values of a group to one task, from
every task that has some.  So a sketch first tells large groups' bounds between
which the wanted ranks are, and whatever is outside counts as the bound: no
value between them changes its rank, and few distinct values are left to bring.
The result is exact: how many values are outside is counted as well.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions.aggregates import Percentile

#: Groups of at most so many values are aggregated as they are; many more than 1 / ERROR, so that a rank's rounding does not count.
WHOLE = 100_000
#: A sketch's ranks are off by at most this part of the group; the bounds are three times as far from the wanted rank.
ERROR = 1 / 2000

_numbers = count()


def grouped(df: DataFrame, dims: dict[str, Column], aggs: dict[str, Column | Percentile]) -> DataFrame:
    """The rows grouped by ``dims``, with ``aggs``."""
    wanted = {n: p for n, p in aggs.items() if isinstance(p, Percentile)}
    if wanted:
        df, bounds = bounded(df, list(dims.values()), list(wanted.values()))
        aggs = aggs | {n: exact(p, *bounds[p]) for n, p in wanted.items()}
    return df.groupBy(*[c.alias(n) for n, c in dims.items()]).agg(*[c.alias(n) for n, c in aggs.items()])


def bounded(df: DataFrame, dims: list[Column], wanted: list[Percentile]) -> tuple[DataFrame, dict[Percentile, tuple[Column, Column]]]:
    """The rows with the bounds of their group, null where the group is small, and which columns they are."""
    if df.isStreaming:  # can't be read twice
        return df, dict.fromkeys(wanted, (F.lit(None).cast("double"),) * 2)
    number = next(_numbers)
    own, keys = ([f"_{name}{number}_{i}" for i in range(len(dims))] for name in ("by", "group"))
    rows = df.withColumns(dict(zip(own, dims)))
    same: dict[object, list[Percentile]] = {}  # those of one tree share a sketch
    for p in wanted:
        same.setdefault(p.of, []).append(p)
    sketches, ends, bounds = [], [], {}
    for i, ps in enumerate(same.values()):
        at = [min(max(float(p.at) + away, 0.0), 1.0) for p in ps for away in (-3 * ERROR, 3 * ERROR)]
        found = f"_sketch{number}_{i}"
        x = F.nanvl(ps[0].x, F.lit(float("inf")))  # NaN is the largest value
        sketches.append(F.when(F.count(x) > WHOLE, F.percentile_approx(x, at, round(1 / ERROR))).alias(found))
        for j, p in enumerate(ps):
            names = f"_lo{number}_{i}_{j}", f"_hi{number}_{i}_{j}"
            ends += [_away(F.col(found)[2 * j], -1).alias(names[0]), F.nullif(_away(F.col(found)[2 * j + 1], 1), F.lit(float("inf"))).alias(names[1])]
            bounds[p] = tuple(map(F.col, names))
    groups = rows.groupBy(*[F.col(o).alias(k) for o, k in zip(own, keys)]).agg(*sketches).select(*keys, *ends)
    if not dims:
        return rows.crossJoin(F.broadcast(groups)), bounds
    # At most one row for every WHOLE rows, so it is small enough to send.
    groups = groups.filter(reduce(lambda a, b: a | b, [lo.isNotNull() for lo, _ in bounds.values()]))
    on = reduce(lambda a, b: a & b, [rows[o].eqNullSafe(groups[k]) for o, k in zip(own, keys)])
    return rows.join(F.broadcast(groups), on, "left"), bounds


def _away(x: Column, way: int) -> Column:
    """A bit further out: sums that are computed again may differ in their last digits."""
    return x * (1 + way * 1e-12 * F.signum(x))


def exact(p: Percentile, lo: Column, hi: Column) -> Column:
    """The percentile over the values between the bounds, those outside being as the bounds."""
    n, rank = F.count(p.x), (F.count(p.x) - 1) * F.lit(float(p.at))
    missed = (n > 0) & ((F.count_if(p.x < lo) > F.floor(rank)) | (n - F.count_if(p.x > hi) <= F.ceil(rank)))
    near = F.when(p.x.isNotNull(), F.greatest(F.least(p.x, hi), lo))  # both leave out null bounds
    return F.when(missed, F.raise_error(F.lit("a percentile's rows changed while they were read"))).otherwise(F.percentile(near, p.at))
