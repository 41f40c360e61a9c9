"""Percentiles of large groups: exact, with few values brought to one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattiq.operators.model import Model
from lattiq.plans.view import run_view

AT = (0, 0.25, 0.5, 0.9, 1)
NAN, INF = float("nan"), float("inf")


@pytest.fixture()
def small(monkeypatch):
    """Bounds for groups of some hundred rows."""
    percentiles = pytest.importorskip("lattiq.plans.percentiles")
    monkeypatch.setattr(percentiles, "WHOLE", 500)
    monkeypatch.setattr(percentiles, "ERROR", 1 / 100)


def view(df, fields, dims=("g",)):
    fields = [{"fieldCaption": d, "fieldAlias": d} for d in dims] + [{"calculation": f, "fieldAlias": n} for n, f in fields.items()]
    return run_view(Model.single(df, "t"), {"fields": fields})


def percentile(values, at):
    """As SQL has it: between the two nearest ranks, NaN being the largest."""
    xs = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not xs:
        return None
    rank = (len(xs) - 1) * at
    low, high = xs[math.floor(rank)], xs[math.ceil(rank)]
    return low if low == high or rank == int(rank) else (math.ceil(rank) - rank) * low + (rank - math.floor(rank)) * high


def same(a, b):
    return a == b or a is not None and b is not None and math.isnan(a) and math.isnan(b)


def groups(n=3000):
    pick = random.Random(7)
    return {
        "normal": [pick.gauss(0, 1) for _ in range(n)],
        "long tail": [math.exp(pick.gauss(0, 9)) for _ in range(n + 1)],
        "ties": [float(pick.randrange(4)) for _ in range(n)],
        "two halves": [-1e300] * (n // 2) + [1e300] * (n // 2),
        "constant": [3.5] * n,
        "near each other": [1e9 + pick.random() / 1e6 for _ in range(n)],
        "sorted": [float(i) for i in range(n)],
        "nulls": [None if i % 3 else pick.random() for i in range(n)],
        "nan": [NAN if i % 5 == 0 else pick.random() for i in range(n)],
        "infinite": [INF if i % 4 == 0 else -INF if i % 4 == 1 else NAN if i % 4 == 2 else 1.0 for i in range(n)],
        "nothing": [None] * n,
        "small": [2.0, 1.0, 4.0, NAN],
        None: [pick.random() - 0.5 for _ in range(n)],
    }


def test_bounds_leave_percentiles_exact(spark, small):
    data = groups()
    rows = [(g, v, None if v is None else -v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    fields = {f"x{i}": f"PERCENTILE([x], {p})" for i, p in enumerate(AT)} | {"m": "MEDIAN([y])", "n": "COUNT([x])", "hi": "MAX([x])"}
    got = {r["g"]: r for r in view(df, fields).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        for i, p in enumerate(AT):
            assert same(got[g][f"x{i}"], percentile(vs, p)), (g, p)
        assert same(got[g]["m"], percentile([None if v is None else -v for v in vs], 0.5)), g
        assert got[g]["n"] == sum(v is not None for v in vs)
    every = [v for vs in data.values() for v in vs]
    (total,) = view(df, {f"x{i}": f"PERCENTILE([x], {p})" for i, p in enumerate(AT)}, ()).collect()
    assert all(same(total[f"x{i}"], percentile(every, p)) for i, p in enumerate(AT))


def test_bounds_over_a_distinct_grain_and_an_empty_table(spark, small):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (F.col("id") % 3000).alias("k"), (F.col("id") % 977).cast("double").alias("x"))
    fields = {"m": "MEDIAN({FIXED [k] : SUM([x])})", "d": "COUNTD([k])", "p": "PERCENTILE([x], 0.1)"}
    got = {r["g"]: r for r in view(df, fields).collect()}
    for g in (0, 1):
        sums = {}
        for i in range(g, 6000, 2):
            sums[i % 3000] = sums.get(i % 3000, 0.0) + i % 977
        assert (got[g]["m"], got[g]["d"]) == (percentile(sums.values(), 0.5), 1500)
        assert got[g]["p"] == percentile([float(i % 977) for i in range(g, 6000, 2)], 0.1)
    none = df.filter("false")
    assert view(none, fields).collect() == []
    assert view(none, {"m": "MEDIAN([x])"}, ()).collect() == [(None,)]


def most_read(spark, action):
    """The most bytes of shuffle that one task read in ``action``."""
    sc = spark.sparkContext._jsc.sc()
    nothing, store = spark._jvm.java.util.ArrayList(), sc.statusStore()
    sc.listenerBus().waitUntilEmpty()
    before = max((s.stageId() for s in stages(spark, store, nothing)), default=-1)
    out = action()
    sc.listenerBus().waitUntilEmpty()
    read = []
    for s in stages(spark, store, nothing):
        if s.stageId() > before and str(s.status()) == "COMPLETE":
            tasks = store.taskList(s.stageId(), s.attemptId(), 10_000)
            read += [m.get().shuffleReadMetrics() for i in range(tasks.size()) if (m := tasks.apply(i).taskMetrics()).isDefined()]
    return out, max(m.localBytesRead() + m.remoteBytesRead() for m in read)


def stages(spark, store, nothing):
    found = store.stageList(nothing, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), nothing)
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("spread", ["id / 7", "1e9 + id / 1e6", "exp(id / 50000)"])
def test_one_task_reads_few_of_a_groups_values(spark, spread):
    df = spark.range(0, 800_000, 1, 8).select((F.col("id") % 2).alias("g"), F.expr(f"CAST({spread} AS DOUBLE)").alias("x"))
    rows, most = most_read(spark, lambda: view(df, {"m": "MEDIAN([x])", "p": "PERCENTILE([x], 0.9)", "sd": "STDEV([x])"}).collect())
    values = [r[0] for r in df.filter("g = 0").select("x").collect()]
    assert {r["g"]: (r["m"], r["p"]) for r in rows}[0] == (percentile(values, 0.5), percentile(values, 0.9))
    assert most < 2_000_000, most  # sketches of two groups from eight tasks; the groups' values are 9 MB and more


def test_a_stream_is_read_once(spark, tmp_path):
    spark.range(0, 101).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g bigint, x double").parquet(str(tmp_path / "in"))
    q = view(stream, {"m": "MEDIAN([x])"}).writeStream.outputMode("complete").format("memory").queryName("medians").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("medians").collect()} == {(0, 50.0), (1, 50.0)}
